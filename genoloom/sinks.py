"""Writers of annotated tables, VCFs, variant tables, FASTA and run reports."""

from __future__ import annotations

import json
import os
import time
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from genoloom.functions.alleles import avinput_fields
from genoloom.functions.strings import csv_field, strict_field
from genoloom.plans.annotate import Annotated, report, vcf_lines
from genoloom.sources.reference import fasta_records
from genoloom.storage import publish_lines


def table_lines(result: Annotated, csv: bool = False) -> tuple[list[str], DataFrame]:
    """Header lines and (row_id, value): CSV quotes where it must, TSV never."""
    by = "," if csv else "\t"
    cells = [csv_field(F.col(c)) if csv else F.col(c) for c in result.columns]
    return [by.join(result.headers)], result.rows.select("row_id", F.concat_ws(by, *cells).alias("value"))


def write_table(result: Annotated, path: str, csv: bool = False) -> None:
    header, lines = table_lines(result, csv)
    publish_lines(lines, path, header, "row_id")


def write_strict(result: Annotated, path: str) -> None:
    """The strict table: bare column names, no status, quotes where a field needs them."""
    bare = {c: n for p, cols in result.ranges for c, n in zip(cols, p.names)}
    keep = [(c, bare.get(c, h)) for c, h in zip(result.columns, result.headers) if h != "AnnotationStatus"]
    lines = result.rows.select("row_id", F.concat_ws("\t", *[strict_field(F.col(c)) for c, _ in keep]).alias("value"))
    publish_lines(lines, path, ["\t".join(h for _, h in keep)], "row_id")


def info_headers(result: Annotated) -> list[str]:
    from genoloom.functions.strings import info_id

    out = [f'##INFO=<ID=FA_{info_id(p.name)},Number=A,Type=String,Description="{" | ".join(p.headers())}">' for p, _ in result.ranges]
    return [*out, '##INFO=<ID=FA_STATUS,Number=A,Type=String,Description="Annotation status">']


def write_vcf(result: Annotated, headers: list[str], path: str) -> None:
    """An annotated VCF: our INFO headers go in front of the #CHROM line, a value per alternate allele into each record."""
    at = next(i for i, h in enumerate(headers) if h.startswith("#CHROM"))
    publish_lines(vcf_lines(result), path, [*headers[:at], *info_headers(result), *headers[at:]], "record")


def write_avinput(variants: DataFrame, path: str) -> None:
    core = avinput_fields(F.col("output_chrom"), F.col("start"), F.col("end"), F.col("ref"), F.col("alt"))
    extra = [F.array_join("extra", "\t")] if "extra" in variants.columns else []
    lines = variants.select("row_id", F.regexp_replace(F.concat_ws("\t", *core, *extra), "\t$", "").alias("value"))
    publish_lines(lines, path, [], "row_id")


def write_fasta(variants: DataFrame, chunks: DataFrame, path: str) -> None:
    publish_lines(fasta_records(variants, chunks).withColumnRenamed("record", "value"), path, [], "row_id")


def write_report(result: Annotated, path: str, started: float) -> dict:
    """Counters and seconds of a run as JSON, published whole."""
    out = report(result) | {"seconds": round(time.time() - started, 3)}
    temp = f"{path}.{uuid.uuid4().hex}.tmp"
    with open(temp, "w") as f:
        json.dump(out, f, indent=1, sort_keys=True)
    os.replace(temp, path)
    return out
