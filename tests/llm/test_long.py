"""Every operator on a text of over 1 MB, null ids and texts, and ids that repeat with other texts."""

import hashlib
import random
import struct
import zlib

import pytest
from pyspark.sql import functions as F

from genoloom.llm import bpe, decontam, jaccard, quality, rules, secrets, sharding, sufdedup, token_counts
from tests.llm.conftest import prose
from tests.llm.test_corpus import repeats
from tests.llm.test_texts import base, counts

KEY = "qZ8rT2vN5xK9mB4c7Lp0Wy"


@pytest.fixture(scope="module")
def rows():
    rnd = random.Random(21)
    long = prose(rnd, 60_000) + " the api key is " + KEY + "\n" + "z" * 40_000 + "\n" + prose(rnd, 150_000)
    assert len(long) > 1_000_000
    return [(1, long), (2, long[1000:60_000]), (3, long + " more"), (4, "short one"), (4, "other text of one id"), (None, "null id"), (None, None), (5, None), (6, "")]


@pytest.fixture(scope="module")
def table(spark, rows):
    return spark.createDataFrame([(i, t, "x", 0) for i, t in rows], "doc_id long, text string, kept string, slot int").repartition(3).cache()



def test_row_by_row(table, rows):
    got = {(r.doc_id, r.base_sha256, r.n_novel) for r in secrets.digest(secrets.find_secrets(table)).collect()}
    assert got == {(i, hashlib.sha256(base(t).encode()).hexdigest(), (t or "").count(KEY)) for i, t in rows}
    got = sorted([(r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in rules.apply_rules(table, with_text=False).collect()], key=repr)
    assert got == sorted([(i, *counts(t)) for i, t in rows], key=repr)
    got = sorted([(r.doc_id, r.size, r.text_crc32) for r in sharding.shard(table, 8).collect()], key=repr)
    assert got == sorted([(i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows], key=repr)


def test_tokens(table, rows):
    from tokenizers import Tokenizer

    library, c = Tokenizer.from_file(bpe.default_path()), token_counts.load(token_counts.default_path())
    ids = [(i, library.encode(t or "", add_special_tokens=False).ids) for i, t in rows]
    got = sorted([(r.doc_id, r.n_tokens, r.ids_sha256) for r in bpe.encode_documents(table, digest=True).collect()], key=repr)
    assert got == sorted([(i, len(x), hashlib.sha256(struct.pack(f"<{len(x)}I", *x)).hexdigest()) for i, x in ids], key=repr)
    got = sorted([(r.doc_id, r.n_chars, r.n_tokens) for r in token_counts.count_tokens(table.withColumn("edits", F.lit(None).cast("array<struct<start:bigint,deleted:bigint,inserted:string>>")), "edits").collect()], key=repr)
    assert got == sorted([(i, len(t or ""), len(c.encoding.encode_ordinary(t or ""))) for i, t in rows], key=repr)


def test_across_documents(spark, table, rows):
    n = lambda t, k: len({tuple(w[j : j + k]) for w in [(t or "").lower().split()] for j in range(len(w) - k + 1)}) or bool((t or "").split())
    got = sorted([(r.doc_id, r.n_shingles, r.component_id) for r in jaccard.join(table, k=4, percent=85).collect()], key=repr)
    group = {3: 1}
    assert got == sorted([(i, int(n(t, 4)), group.get(i, i)) for i, t in rows], key=repr)
    kept = jaccard.keep_first(table.withColumn("copy", F.lit(1)), k=4, percent=85).collect()
    assert sorted([r.doc_id for r in kept], key=repr) == sorted([i for i, _ in rows if i != 3], key=repr)
    found = decontam.find_leaks(table, spark.createDataFrame([(7, " ".join(rows[0][1].split()[59_000:59_040]))], "item_id long, text string")).collect()
    assert {(r.doc_id, r.similarity) for r in found} == {(1, 1.0), (3, 1.0)}
    got = quality.classify(table, spark.createDataFrame([(1, 1)], "doc_id long, quality int")).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    got = sorted([(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in sufdedup.repeated_spans(table).collect() if r.n_bytes > 100], key=repr)
    want = repeats([(i, t.encode()) for i, t in rows if len(t or "") > 100], 100)
    assert got == sorted([(i, *want[i]) for i in want], key=repr)
