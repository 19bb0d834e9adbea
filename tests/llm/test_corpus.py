"""Operators across documents: decontamination, quality, repeats, similarity, archives."""

import hashlib
import random
import re
import zlib
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from genoloom.llm import decontam, jaccard, losertree, quality, sufdedup, warc
from genoloom.llm.components import components
from tests.llm.conftest import prose

# 2


def test_leaks(spark, docs, none):
    rnd = random.Random(8)
    items = [(i, prose(rnd, 30)) for i in range(6)] + [(90, None), (91, ""), (92, "too short"), (93, "exactly five words right here")]
    swapped = items[1][1].split()
    swapped[7] = swapped[19] = "other"
    planted = [(500, "before " * 30 + items[0][1].upper() + " after" * 30), (501, prose(rnd, 50) + " " + " ".join(swapped)), (502, " ".join(items[2][1].split()[:14]) + prose(rnd, 40)), (503, " ".join(items[3][1].split()[:8])), (504, "say exactly, five WORDS right: here now")]
    rows = docs.select("doc_id", "text").unionByName(spark.createDataFrame([*planted, planted[0]], "doc_id long, text string"))
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit(1))
    got = {(r.doc_id, r.item_id): r for r in decontam.find_leaks(rows, bench).collect()}
    assert set(got) == {(500, 0), (501, 1), (502, 2), (504, 93)}
    assert got[500, 0].similarity == 1.0 and got[500, 0].at_word == 30 and got[501, 1].similarity >= 0.8
    assert decontam.find_leaks(none, bench).count() == 0 and decontam.find_leaks(rows, bench.limit(0)).count() == 0
    assert {r.doc_id for r in decontam.drop_leaks(rows, bench).collect()} == {r.doc_id for r in rows.collect()} - {500, 501, 502, 504}


def test_short_items_are_found_with_every_allowed_substitution(spark):
    """Items of 1 to 13 words, each of their own words, with every choice of as many substituted words as a share of 0.8 leaves, and one more."""
    items, rows, want = [], [], set()
    for n in range(1, 14):
        words = [f"i{n}w{j}" for j in range(n)]
        items.append((n, " ".join(words)))
        allowed = n - -(-8 * n // 10)
        for extra in (0, 1):
            for out in combinations(range(n), allowed + extra):
                rows.append((len(rows), " ".join(["front"] * 30 + ["other" if j in out else w for j, w in enumerate(words)] + ["back"] * 30)))
                want |= set() if extra else {(rows[-1][0], n)}
    rows.append((len(rows), "i4w0 i4w1 i4w2 gap i4w3 i3w0 i3w1 " + "i1w0 " * 100))
    want.add((rows[-1][0], 1))
    got = decontam.find_leaks(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id) for r in got} == want and len(got) == len(want)
    assert [r.at_word for r in got if r.doc_id == rows[-1][0]] == [7]


def leaks(rows, items, window=13, share=0.8):
    """Plain decontamination: every item against every place of every text, word by word."""
    cut = lambda t: re.findall(rb"[0-9A-Za-z\x80-\xff]+", (t or "").lower().encode())
    found = {}
    for i, text in rows:
        w = cut(text)
        for k, item in items:
            x = cut(item)
            n = min(window, len(x))
            best = None
            for d in range(-len(x) + n, len(w) - n + 1) if n else ():
                lo, hi = max(d, 0), min(d + len(x), len(w))
                same = [w[p] == x[p - d] for p in range(lo, hi)]
                for p in range(len(same) - n + 1):
                    s = sum(same[p : p + n])
                    if s >= share * n and (best is None or (s / n, -(lo + p)) > best[0]):
                        best = ((s / n, -(lo + p)), s, n, lo + p)
            if best and (i, k) not in found:
                found[i, k] = (best[0][0], *best[1:])
    return found


def test_leaks_equal_brute_force(spark, docs):
    """Mutated, cut and shifted items in texts, items of all lengths, repeated places that tie, repeated rows, null ids and texts."""
    rnd = random.Random(12)
    items = [(k, prose(rnd, rnd.choice([1, 2, 4, 6, 9, 13, 20, 40]))) for k in range(25)] + [(50, None), (51, "")]
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").dropDuplicates(["doc_id"]).collect() if len(r.text or "") < 4000]
    for n in range(120):
        w = rnd.choice(items[:25])[1].split()
        a = rnd.randrange(max(len(w) - 12, 1))
        w = [x if rnd.random() > 0.12 else "swapped" for x in w[a : a + rnd.choice([13, 25, 60])]]
        rows.append((3000 + n, prose(rnd, rnd.randrange(30)) + " " + " ".join(w) + " " + prose(rnd, rnd.randrange(30)) + (" " + " ".join(w) if n % 9 == 0 else "")))
    d = spark.createDataFrame([*rows, rows[-1], (None, items[5][1] + " " + items[20][1])], "doc_id long, text string").repartition(3)
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = leaks([*rows, (None, items[5][1] + " " + items[20][1])], items)
    got = decontam.find_leaks(d, bench).collect()
    assert {(r.doc_id, r.item_id): (r.similarity, r.n_same, r.n_words, r.at_word) for r in got} == want and len(got) == len(want) > 60
    kept = decontam.drop_leaks(d.withColumn("leaked", F.lit(1)), bench)
    assert kept.columns == ["doc_id", "text", "leaked"]
    assert {r.doc_id for r in kept.collect()} == ({i for i, _ in rows} | {None}) - {i for i, _ in want if i is not None}


# 3


def scores(texts, labels, n_features, folds=5, ridge=1e-3, bins=2048):
    """Plain quality scores: one matrix, one system of equations a fold, one isotonic fit by minimax over blocks."""
    x = np.array([quality.statistics(t) for t in texts.values()])
    omega, phase = quality.draw_features(n_features, 4.0, 7)
    z = np.hstack([np.ones((len(x), 1)), np.cos(np.clip((x - x.mean(0)) / np.where(x.std(0) > 0, x.std(0), 1), -4, 4) @ omega + phase) * (2 / n_features) ** 0.5])
    at = {i: n for n, i in enumerate(texts)}
    fold = {i: zlib.crc32(str(i).encode()) % folds for i in texts}
    use = [i for i in labels if i in at and fold[i]]
    eye = np.diag([0.0] + [1.0] * n_features)

    def solve(ids):
        a, b = z[[at[i] for i in ids]], np.array([labels[i] for i in ids], float)
        return np.linalg.lstsq(a.T @ a + ridge * len(ids) * eye, a.T @ b, rcond=None)[0]

    raw = {i: z[at[i]] @ w for k in range(1, folds) for w in [solve([j for j in use if fold[j] != k])] for i in use if fold[i] == k}
    points: dict[int, list] = {}
    for i in use:
        points.setdefault(int(np.clip((raw[i] + 1) / 3 * bins, 0, bins - 1)), []).append(labels[i])
    b = sorted(points)
    n, total = np.array([len(points[k]) for k in b]), np.array([sum(points[k]) for k in b], float)
    mean = lambda i, j: total[i : j + 1].sum() / n[i : j + 1].sum()
    level = [max(min(mean(i, j) for j in range(k, len(b))) for i in range(k + 1)) for k in range(len(b))]
    groups: dict[float, list] = {}
    for k, v in enumerate(level):
        groups.setdefault(round(v, 12), []).append(k)
    xs = [sum((b[k] + 0.5) / bins * 3 * n[k] - n[k] for k in g) / n[g].sum() for g in groups.values()]
    final = solve(use)
    return {i: float(np.clip(np.interp(z[at[i]] @ final, xs, list(groups)), 0, 1)) for i in texts}


def test_quality_equals_plain_algebra(spark):
    rnd = random.Random(16)
    noisy = lambda n: " ".join(w + rnd.choice(["###", "", "$$$"]) for w in prose(rnd, n).split())
    texts = {i: (prose if i % 3 else noisy)(*([rnd] if i % 3 else []), rnd.randint(20, 150)) for i in range(240)} | {9000: "", 9001: None}
    labels = {i: int(bool(i % 3) ^ (rnd.random() < 0.1)) for i in range(200)}
    d = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    got = quality.classify(d, spark.createDataFrame(list(labels.items()), "doc_id long, quality int"), n_features=32).collect()
    want = scores(texts, labels, 32)
    assert len(got) == len(texts) and max(abs(r.score - want[r.doc_id]) for r in got) < 1e-6
    named = d.select(F.col("text").alias("body"), F.col("doc_id").alias("key"), F.lit(0).alias("text"))
    kept = quality.keep_good(named, spark.createDataFrame(list(labels.items()), "doc_id long, quality int"), id_col="key", text_col="body", n_features=32)
    assert kept.columns == named.columns and {r.key for r in kept.collect()} == {r.doc_id for r in got if r.predicted}


def test_quality(spark, docs, none):
    rnd = random.Random(6)
    good = [prose(rnd, rnd.randint(30, 200)) for _ in range(300)]
    bad = [" ".join(w + rnd.choice(["###", "$$$", "%%%"]) for w in prose(rnd, rnd.randint(30, 200)).split()) for _ in range(150)]
    rows = [(i, t) for i, t in enumerate(good + bad)] + [(9000, None), (9001, ""), (None, "null id")]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < 300), 0) for i in range(450)] + [(None, 1, 0), (5, None, 0)], "doc_id long, quality int, toxic int")
    got = quality.classify(d, labels, n_features=64).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got if r.doc_id is not None)
    held = [r for r in got if r.held_out and r.doc_id is not None and r.doc_id < 450]
    assert np.mean([r.predicted == (r.doc_id < 300) for r in held]) > 0.95
    assert quality.classify(none, labels).count() == 0
    assert {r.score for r in quality.classify(d.limit(5), labels.limit(0)).collect()} == {0.5}
    flipped = labels.withColumn("quality", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, 1 - F.col("quality")).otherwise(F.col("quality")))
    again = {r.doc_id: r.score for r in quality.classify(d, flipped, n_features=64).collect()}
    assert all(abs(again[r.doc_id] - r.score) < 1e-9 for r in got)  # held-out labels teach nothing


@pytest.mark.parametrize("n", [30, 39, 40, 400])
def test_repeated_neighbours_count_in_every_text(n):
    words = [f"w{i}" for i in range(n)]
    words[1::10] = words[::10]  # nine in ten words are distinct
    got = quality.statistics(" ".join(words))[quality.STATS.index("adjacent_repeats")]
    assert got == sum(a == b for a, b in zip(words, words[1:])) / n > 0.09


def test_isotonic_and_kernel():
    rnd = np.random.default_rng(1)
    x, n, s = np.arange(50.0), rnd.integers(1, 5, 50).astype(float), rnd.random(50)
    _, y = quality.isotonic(x, n, s * n)
    assert (np.diff(y) >= 0).all()
    omega, phase = quality.draw_features(4000, 2.0, 3)
    a, b = rnd.normal(size=(2, len(quality.STATS))) / 2
    z = quality.expand(np.stack([a, b]), np.zeros(len(a)), np.ones(len(a)), omega, phase)[:, 1:]
    assert abs(z[0] @ z[1] - np.exp(-((a - b) ** 2).sum() / 8)) < 0.06


# 4


def repeats(rows, length):
    seen, out = set(), {}
    for key, raw in sorted(rows):
        covered = bytearray(len(raw))
        for p in range(len(raw) - length + 1):
            s = raw[p : p + length]
            if s in seen:
                covered[p : p + length] = b"\1" * length
            else:
                seen.add(s)
        kept = bytes(x for x, c in zip(raw, covered) if not c)
        out[key] = (len(raw), sum(covered), sum(1 for i, c in enumerate(covered) if c and not (i and covered[i - 1])), hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("crowd", [False, True])
def test_repeats_equal_brute_force(docs, none, crowd, monkeypatch):
    if crowd:
        monkeypatch.setattr(sufdedup, "GROUP", 2)
    want = repeats(list({r.doc_id: (r.doc_id, (r.text or "").encode()) for r in docs.collect()}.values()), 100)
    got = sufdedup.repeated_spans(docs).collect()
    assert len(got) == docs.count()
    for r in got:
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == want[r.doc_id], r.doc_id
        assert sum(s.end - s.start for s in r.spans) == r.n_removed
    if not crowd:
        assert sufdedup.repeated_spans(none).count() == 0


def test_repeats_of_odd_ids(spark):
    """Null and greatest ids are different documents, null last; rows of one id with other texts are documents in the order of their texts' hash."""
    rnd = random.Random(4)
    x, y, big = prose(rnd, 60), prose(rnd, 60), (1 << 63) - 1
    rows = [(big, x), (None, x), (None, x), (5, y), (5, y + " more"), (5, y), (-3, x[:150])]
    got = sufdedup.repeated_spans(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    removed = sorted((str(r.doc_id), r.n_bytes, r.n_removed) for r in got)
    n, m = len(x.encode()), len(y.encode())
    five = sorted((a, b) for d, a, b in removed if d == "5")
    assert [r for r in removed if r[0] != "5"] == sorted([("-3", 150, 0), (str(big), n, 150), ("None", n, n), ("None", n, n)])
    assert five in ([(m, 0), (m, 0), (m + 5, m)], [(m, m), (m, m), (m + 5, 0)])


def test_repeats_in_a_long_text(spark):
    """A text of over 1 MB that repeats itself, and a short one that repeats a piece of it."""
    rnd = random.Random(8)
    piece = prose(rnd, 40_000)
    raw = (piece + "\n" + "z" * 700_000 + "\n" + piece).encode()
    rows = [(1, raw.decode()), (2, piece[5000:9000])]
    got = {r.doc_id: r for r in sufdedup.repeated_spans(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = repeats([(i, t.encode()) for i, t in rows], 100)
    assert {i: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for i, r in got.items()} == want


def test_loser_trees():
    rnd = random.Random(3)
    runs = [sorted("".join(rnd.choices("ab", k=rnd.randint(1, 9))).encode() for _ in range(rnd.randint(0, 40))) for _ in range(7)]
    coded = []
    for run in runs:
        last, out = b"", []
        for s in run:
            out.append((s, sufdedup.common(last, s, 0)))
            last = s
        coded.append(out)
    order, shared = sufdedup.merge_runs(coded)
    merged = [runs[r][i] for r, i in order]
    assert merged == sorted(sum(runs, [])) == list(losertree.merge(runs))
    assert shared[1:] == [sufdedup.common(a, b, 0) for a, b in zip(merged, merged[1:])]


# 5


def classes(rows, k, percent):
    sets, parent = {}, {}
    low = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})

    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(low))
        sets[i] = frozenset(tuple(w[j : j + k]) for j in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])
        parent[i] = i

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[:n]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {i: (len(sets[i]), find(i)) for i in ids}


@pytest.mark.parametrize("k,percent", [(4, 85), (5, 80)])
def test_similarity_classes_equal_brute_force(spark, docs, none, k, percent, monkeypatch):
    monkeypatch.setattr(jaccard, "TILE", 3)
    rnd = random.Random(k)
    long = prose(rnd, 700).split()
    chain = []
    for i in range(14):  # each is close to the next, the ends are far apart
        chain.append((2000 + i, " ".join(long[i * 12 : 500 + i * 12])))
    d = docs.select("doc_id", "text").unionByName(spark.createDataFrame([*chain, chain[3]], "doc_id long, text string"))
    want = classes({(r.doc_id, r.text) for r in d.collect()}, k, percent)
    got = jaccard.join(d, k=k, percent=percent).collect()
    assert len(got) == d.count()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want
    if k == 4:
        assert jaccard.join(none, k=k, percent=percent).count() == 0
        kept = jaccard.keep_first(d, k=k, percent=percent).collect()
        assert sorted(r.doc_id for r in kept) == sorted({c for _, c in want.values()})


def test_links_across_bands_and_blocks(spark, monkeypatch):
    """Isolated pairs of 9 and 10 members, on either side of a band edge, whose members are all in groups of many blocks."""
    monkeypatch.setattr(jaccard, "TILE", 2)
    rnd = random.Random(3)
    rows = []
    for i in range(60):
        w = rnd.sample([f"w{j}" for j in range(26)], 10)
        rows += [(2 * i, " ".join(w[:9])), (2 * i + 1, " ".join(w))]
    got = jaccard.join(spark.createDataFrame(rows, "doc_id long, text string"), k=1, percent=80).collect()
    want = classes(rows, 1, 80)
    assert sum(want[i][1] != i for i in range(120)) == 60  # the pairs and no other links
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want


@pytest.mark.parametrize("bridge", [False, True])
def test_large_classes_that_meet(spark, monkeypatch, bridge):
    """Two classes of many near copies whose members are a little too far apart, with outliers around both; or one text between that links them."""
    monkeypatch.setattr(jaccard, "PURE", 4)
    monkeypatch.setattr(jaccard, "BLOCK_NODES", (3, 5))
    monkeypatch.setattr(jaccard, "TILE", 5)
    rnd = random.Random(11)
    base = [f"b{i}" for i in range(200)]
    far = [w if i >= 30 else f"f{i}" for i, w in enumerate(base)]  # 170 of 230 words shared: 0.74

    def edited(words, n):
        words = list(words)
        for i in rnd.sample(range(40, 200), n):
            words[i] = f"e{rnd.randrange(10**6)}"
        return " ".join(words)

    texts = [edited(w, n) for w in (base, far) for n in [0, *[3] * 20, *[12] * 12, *[20] * 8]]
    texts += [" ".join(f"f{i}" if i < 15 else w for i, w in enumerate(base))] * bridge
    rows = list(enumerate(texts))
    rnd.shuffle(rows)
    want = classes(rows, 1, 80)
    got = jaccard.join(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), k=1, percent=80).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want
    assert (want[41][1] == 0) == bridge


def test_wide_signatures_bound_the_overlap():
    rnd = np.random.default_rng(9)
    sets = [np.unique(rnd.integers(0, 1 << 64, n, dtype=np.uint64)) for n in (1, 3, 60, 70, 900, 1100, 2000)]
    sets += [np.unique(np.concatenate([s[: len(s) * 9 // 10], rnd.integers(0, 1 << 64, 1 + len(s) // 9, dtype=np.uint64)])) for s in sets]
    wide = jaccard._Wide(sets)
    for i, a in enumerate(sets):
        far = wide.apart(wide.one(i), np.arange(len(sets)))
        assert all(f <= len(np.setxor1d(a, b)) for f, b in zip(far, sets)) and far[i] == 0


def test_signatures_bound_the_overlap():
    rnd = np.random.default_rng(5)
    for n in (5, 300, 900, 5000):
        a = np.unique(rnd.integers(0, 1 << 64, n, dtype=np.uint64))
        b = np.unique(np.concatenate([a[: n // 2], rnd.integers(0, 1 << 64, n // 3, dtype=np.uint64)]))
        x, y = (np.frombuffer(jaccard.signature(s), np.uint8) for s in (a, b))
        size = min(len(x), len(y))
        apart = int(np.bitwise_count(jaccard.fold(x, size) ^ jaccard.fold(y, size)).sum())
        assert (len(a) + len(b) - apart) // 2 >= len(np.intersect1d(a, b))


def test_components(spark):
    links = [(i, i + 1) for i in range(0, 30)] + [(100, 50), (50, 75), (200, 200)]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(31)}, 50: 50, 75: 50, 100: 50}


# 7


def test_archives(spark, tmp_path):
    big, other = "é" * 600, "x" * 1000
    rows = [(i, f"http://www.h{i % 3}.example.com/p?q={i % 5}", h) for i, h in enumerate([big, big, "small", "small", other, None, "", big, other, "x" * 999, "x" * 999])]
    rows += [(7, rows[7][1], big), (50, None, "y\r\n\r\nWARC/1.1\r\n" * 100), (None, "http://[bad", other)]
    d = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, record_type string")
    index = warc.merge_index(warc.write_archives(d, f"file://{tmp_path}/a"), parts=3).orderBy("position").collect()
    keys = [(r.url_key, r.ts, -1 if r.page_id is None else r.page_id) for r in index]
    assert keys == sorted(keys) and [r.position for r in index] == list(range(len(rows)))
    got = warc.read_archives(warc.merge_index(warc.write_archives(d, f"file://{tmp_path}/b")), f"file://{tmp_path}/b").collect()
    assert len(got) == len(rows) and sorted((r.position, r.url_key, r.ts, r.page_id or -1) for r in got) == [(i, k, t, p or -1) for i, (k, t, p) in enumerate(keys)]
    html = {p: (h or "").encode() for p, _, h in rows}
    latest = {}
    for p, h in html.items():
        if len(h) >= 1000 and p is not None:
            latest[h] = max(p, latest.get(h, p))
    for r in got:
        h = html[r.page_id]
        ref = latest.get(h, r.page_id)
        assert (r.payload_bytes, r.payload_digest) == (len(h), hashlib.sha1(h).hexdigest())
        assert (r.record_type, r.refers_to) == (("response", None) if ref == r.page_id else ("revisit", ref))
    assert warc.read_archives(warc.merge_index(warc.write_archives(d.limit(0), f"file://{tmp_path}/c")), f"file://{tmp_path}/c").count() == 0


def test_large_sets_that_share_a_part_gather_no_members(spark, monkeypatch):
    """Sets of 3,000 words that share 1,200 of them: narrow signatures leave room for a link, whole ones don't."""
    seen, real = [], jaccard._group_links
    monkeypatch.setattr(jaccard, "_group_links", lambda rows, *rest: seen.append(sorted(r.n for r in rows.collect())) or real(rows, *rest))
    words = lambda name, n: " ".join(f"{name}{i}" for i in range(n))
    rows = [(i, f"{words('all', 1200)} {words(f'own{i}x', 1800)}") for i in range(8)]
    got = jaccard.join(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), k=1, percent=85).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == [(i, 3000, i) for i in range(8)]
    assert seen == [[]]


def test_candidate_edges_join_what_links():
    """Whatever links is inside one group of edges, be sets small or large, in one block or two."""
    rng = np.random.default_rng(8)
    sets = []
    for n in (3, 40, 700, 2500):
        for _ in range(6):
            whole = rng.integers(0, 2**63, n, dtype=np.uint64)
            sets += [np.unique(np.concatenate([whole[: n - cut], rng.integers(0, 2**63, cut, dtype=np.uint64)])) for cut in (0, n // 20, n // 14, n // 2)]
    node, n, signatures = np.arange(len(sets)) * 7, np.array([len(s) for s in sets]), [jaccard.signature(s) for s in sets]
    for side in (np.full(len(sets), 2), np.arange(len(sets)) % 2):
        a, b = jaccard.candidate_edges(node, node, side, n, signatures, 85)
        group = {int(x): int(x) for x in node}
        for x, y in zip(a.tolist(), b.tolist()):
            old, new = group[y], group[x]
            group = {k: new if v == old else v for k, v in group.items()}
        for i in range(len(sets)):
            for j in range(i):
                both = len(np.intersect1d(sets[i], sets[j]))
                if (side[i] == 2 or side[i] != side[j]) and 100 * both >= 85 * (len(sets[i]) + len(sets[j]) - both):
                    assert group[int(node[i])] == group[int(node[j])]
        assert len(a) < len(sets)


def test_tables_and_shuffles_go_when_used(spark, docs):
    """A stored table leaves no shuffle files; the join removes its tables of sets, nodes and members."""
    import os
    import time

    from genoloom.llm import common

    files = lambda: spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().size()
    before = files()
    table = common.stored(spark.range(5000).selectExpr("id % 97 AS k").groupBy("k").count(), "counts")
    for _ in range(50):
        if files() <= before:
            break
        time.sleep(0.1)
    assert files() <= before and table.count() == 97
    common.discard(table)
    folder = common.shared_dir(spark).removeprefix("file://")
    there = set(os.listdir(folder))
    assert jaccard.join(docs, k=4, percent=85).count() == docs.count()
    assert not {x.split("-")[0] for x in set(os.listdir(folder)) - there} & {"counts", "sets", "nodes", "star", "keys", "members", "edges", "rows"}
