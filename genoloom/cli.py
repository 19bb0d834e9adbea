"""Commands: table, annotate, coding-change, strict, convert, reduce, sequence and db. Inputs and outputs named - are the standard ones."""

from __future__ import annotations

import argparse
import glob
import hashlib
import json
import os
import shutil
import sys
import time
import urllib.request

from pyspark.sql import SparkSession

from genoloom import sinks
from genoloom.operators import left_align
from genoloom.plans import annotate as plan
from genoloom.plans import index
from genoloom.sources import cadd, readers, reference
from genoloom.storage import spool


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="genoloom")
    sub = p.add_subparsers(dest="command", required=True)
    for name in ("table", "annotate", "coding-change"):
        c = sub.add_parser(name)
        c.add_argument("input")
        c.add_argument("database")
        c.add_argument("--build", default="hg38")
        c.add_argument("--protocol", default="annotation")
        c.add_argument("--operation", default="g" if name == "coding-change" else "f")
        c.add_argument("--mrna")
        c.add_argument("--output", required=True)
        c.add_argument("--vcf-output")
        c.add_argument("--report")
        c.add_argument("--csv", action="store_true")
        c.add_argument("--nastring", default=".")
        c.add_argument("--unsupported", choices=("preserve", "error"), default="preserve")
        c.add_argument("--cadd-require-all", action="store_true")
        c.add_argument("--normalize", choices=("trim", "left-align"), default="trim")
        c.add_argument("--reference")
    c = sub.add_parser("strict")
    c.add_argument("input")
    c.add_argument("database")
    c.add_argument("output")
    c.add_argument("--report")
    c = sub.add_parser("convert")
    c.add_argument("input")
    c.add_argument("output")
    c = sub.add_parser("reduce")
    c.add_argument("input")
    c.add_argument("column")
    c.add_argument("value")
    c.add_argument("output")
    c = sub.add_parser("sequence")
    c.add_argument("input")
    c.add_argument("fasta")
    c.add_argument("output")
    c = sub.add_parser("db")
    c.add_argument("action", choices=("list", "index", "validate", "download", "import-scores", "store-scores", "stats"))
    c.add_argument("path")
    c.add_argument("target", nargs="?")
    c.add_argument("--sha256")
    c.add_argument("--full", action="store_true")
    c.add_argument("--build")
    c.add_argument("--reference")
    return p


def run(args: argparse.Namespace, spark: SparkSession) -> None:
    started = time.time()
    if getattr(args, "input", None) == "-":
        args.input = spool(spark, sys.stdin.buffer)
    genome = reference.read_genome(spark, args.reference) if getattr(args, "reference", None) else None
    if args.command in ("table", "annotate", "coding-change"):
        aligned = args.normalize == "left-align"
        if aligned and genome is None:
            raise ValueError("left-align needs a reference")
        pairs = plan.bind(args.protocol.split(","), args.operation.split(","))
        protocols = []
        for name, op in pairs:
            table, mrna = readers.resolve(args.database, args.build, name, os.path.exists) if args.command == "table" else (args.database, args.mrna)
            protocols.append(plan.open_protocol(spark, name, op, table, mrna, args.build if args.command == "table" else None, genome if aligned else None))
        is_vcf = args.input.removesuffix(".gz").endswith(".vcf")
        headers = readers.vcf_headers(readers.lines(spark, args.input)) if is_vcf else None
        variants = readers.read_variants(spark, args.input)
        if is_vcf:
            variants = variants.drop("extra")
        if aligned:
            variants = left_align.normalize(variants, genome)
        result = plan.annotate(variants, protocols, args.nastring, True, args.unsupported, args.cadd_require_all)
        if args.vcf_output:
            if not is_vcf:
                raise ValueError("an annotated VCF needs a VCF input")
            sinks.write_vcf(result, headers, args.vcf_output)
        sinks.write_table(result, args.output, args.csv)
        if args.report:
            sinks.write_report(result, args.report, started)
    elif args.command == "strict":
        same = {os.path.realpath(x) for x in (args.input, args.database)} & {os.path.realpath(x) for x in (args.output, args.report) if x}
        if same:
            raise ValueError(f"{same.pop()} is both read and written")
        result = plan.strict_filter(spark, args.input, args.database)
        sinks.write_strict(result, args.output)
        if args.report:
            sinks.write_report(result, args.report, started)
    elif args.command == "convert":
        sinks.write_avinput(readers.read_vcf(spark, args.input), args.output)
    elif args.command == "reduce":
        from pyspark.sql import functions as F

        raw = readers.lines(spark, args.input)
        head = raw.filter("line_no = 1").first().value
        names = head.split("\t")
        if args.column not in names:
            raise ValueError(f"no column {args.column}")
        kept = raw.filter((F.col("line_no") > 1) & (F.get(F.split("value", "\t"), F.lit(names.index(args.column))) == args.value))
        from genoloom.storage import publish_lines

        publish_lines(kept, args.output, [head], "line_no")
    elif args.command == "sequence":
        sinks.write_fasta(readers.read_variants(spark, args.input), reference.read_genome(spark, args.fasta), args.output)
    elif args.action == "list":
        print(*sorted(os.path.basename(x) for x in glob.glob(f"{glob.escape(args.path)}/{args.build + '_' if args.build else ''}*.txt")), sep="\n")
    elif args.action == "index":
        os.makedirs(args.target, exist_ok=True)
        index.build_from_file(spark, args.path, args.target, genome)
    elif args.action == "validate":
        index.open_index(spark, args.path, "none" if genome is None else "left-align", args.full, genome)
        print("ok")
    elif args.action == "stats":
        print(json.dumps(index.statistics(readers.parse_filter_db(readers.lines(spark, args.path))[0]), sort_keys=True))
    elif args.action == "store-scores":
        if os.path.exists(args.target):
            raise ValueError("the target exists")
        cadd.store_scores(spark, args.path, args.target, args.build)
    elif args.action == "import-scores":
        if os.path.exists(args.target):
            raise ValueError("the target exists")
        cadd.import_table(spark, args.path).write.parquet(args.target)
    else:
        download(args.path, args.target, args.sha256)


def download(url: str, target: str, sha256: str | None) -> None:
    """Fetch a file, check its hash, and only then give it its name."""
    temp = f"{target}.part"
    with urllib.request.urlopen(url) as src, open(temp, "wb") as out:
        shutil.copyfileobj(src, out)
    with open(temp, "rb") as f:
        got = hashlib.file_digest(f, "sha256").hexdigest()
    if sha256 and got != sha256.lower():
        os.remove(temp)
        raise ValueError(f"the hash is {got}")
    os.replace(temp, target)


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    spark = SparkSession.builder.appName("genoloom").getOrCreate()
    try:
        run(args, spark)
    except Exception as e:  # noqa: BLE001
        print(f"error: {e}", file=sys.stderr)
        return 1 if args.command == "strict" else 2
    return 0


if __name__ == "__main__":
    sys.exit(main())
