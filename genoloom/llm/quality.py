"""Operator 3: quality classifier.

Random Fourier features approximate a Gaussian kernel over document statistics. Ridge scores come from normal equations that
every partition sums for itself and the driver adds up, one sum per fold, so that each fold also gets a model that never saw
it. Isotonic regression on those out-of-fold scores calibrates the final ones.

Only the text enters a score. A null text counts as empty and is scored like any text. Labels join by doc_id; null ids and null
labels are left out, repeated labels count as often as they appear. Without labels of both kinds every score is the mean label, or 0.5
without any. An empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass
from math import log1p

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from genoloom.llm.common import map_texts, small_batches, stored, table

SYMBOLS = "#*$%&|<>"
STATS = (
    "log_words", "word_length", "symbols", "bars", "exclaims", "upper_words", "digits", "variety", "top_share", "adjacent_repeats",
    "line_repeats", "stops", "commas", "line_words", "wide", "short_words", "shortest_share", "title_words",
)
FOLDS = 5  # fold 0 is held out
LIMIT = 4.0


def statistics(text: str | None) -> list[float]:
    """The document statistics of one whole text, in the order of STATS."""
    text = text or ""
    raw = text.encode()
    words = raw.split()
    n = len(words)
    if not n:
        return [0.0] * len(STATS)
    counts = Counter(words)
    top = max(counts.values())
    lines = [x for x in text.split("\n") if x]
    lengths = Counter(map(len, words))
    chars = sum(k * v for k, v in lengths.items())
    adjacent = sum(map(bytes.__eq__, words, words[1:]))
    upper = title = 0
    for w, c in counts.items():
        if w.isupper():
            upper += c
        elif w.istitle():
            title += c
    return [
        log1p(n), chars / n, sum(map(text.count, SYMBOLS)) / n, text.count("|") / n, text.count("!") / n, upper / n,
        sum(map(raw.count, (b"0", b"1", b"2", b"3", b"4", b"5", b"6", b"7", b"8", b"9"))) / chars, len(counts) / n**0.8, top / n, adjacent / n,
        1 - len(set(lines)) / max(len(lines), 1), text.count(".") / n, text.count(",") / n, log1p(n / max(len(lines), 1)), (len(raw) - len(text)) / len(raw),
        sum(v for k, v in lengths.items() if k <= 3) / n, lengths[1] / n, title / n,
    ]


@dataclass(frozen=True)
class Model:
    """Standardization, random features, ridge weights and the calibration's steps."""

    mean: np.ndarray
    scale: np.ndarray
    omega: np.ndarray
    phase: np.ndarray
    weights: np.ndarray
    steps_x: np.ndarray
    steps_y: np.ndarray

    def raw(self, stats: np.ndarray) -> np.ndarray:
        return expand(stats, self.mean, self.scale, self.omega, self.phase) @ self.weights

    def score(self, stats: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(self.raw(stats), self.steps_x, self.steps_y), 0.0, 1.0)


def draw_features(n_features: int, bandwidth: float, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Frequencies and phases whose cosines approximate exp(-|x-y|^2 / (2 bandwidth^2))."""
    rng = np.random.default_rng(seed)
    return rng.normal(0.0, 1.0 / bandwidth, (len(STATS), n_features)), rng.uniform(0.0, 2 * np.pi, n_features)


def expand(stats: np.ndarray, mean: np.ndarray, scale: np.ndarray, omega: np.ndarray, phase: np.ndarray) -> np.ndarray:
    """Random Fourier features of statistics, with a constant in front."""
    x = np.clip((stats - mean) / scale, -LIMIT, LIMIT)
    z = np.cos(x @ omega + phase) * np.sqrt(2.0 / omega.shape[1])
    return np.hstack([np.ones((len(z), 1)), z])


def isotonic(x: np.ndarray, n: np.ndarray, total: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators over points in ascending x with n rows and a sum of labels each: block centres and means."""
    blocks: list[list[float]] = []
    for a, c, s in zip(x, n, total):
        blocks.append([a * c, c, s])
        while len(blocks) > 1 and blocks[-2][2] * blocks[-1][1] >= blocks[-1][2] * blocks[-2][1]:
            last = blocks.pop()
            blocks[-1] = [p + q for p, q in zip(blocks[-1], last)]
    return np.array([b[0] / b[1] for b in blocks]), np.array([b[2] / b[1] for b in blocks])


def document_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, stats and fold (crc32 of the id's text modulo FOLDS; null ids are in fold 0)."""
    kind = docs.schema[id_col].dataType.simpleString()
    rows = map_texts(docs, {"doc_id": id_col, "text": text_col}, f"doc_id {kind}, stats array<double>", lambda x: {"doc_id": x["doc_id"], "stats": [statistics(t) for t in x["text"]]})
    return rows.withColumn("fold", F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS, F.lit(0)).cast("int"))


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), len(STATS))


def fit(stats: DataFrame, labels: DataFrame, label_col: str = "quality", n_features: int = 256, bandwidth: float = 4.0, ridge: float = 1e-3, fit_rows: int = 200_000, parts: int = 8, bins: int = 2048, seed: int = 7) -> Model:
    """Fit on rows of document_statistics() outside fold 0 that have a label.

    fit_rows bounds the labelled rows of the fit: beyond it, a sample by hash of the id. parts partitions sum the normal equations, so the
    driver gets parts * 4 matrices of n_features^2 whatever the input. bins bounds the points of the calibration.
    """
    spark = stats.sparkSession
    known = labels.select(F.col("doc_id").alias("__id"), F.col(label_col).cast("double").alias("y")).filter("__id is not null and y is not null")
    rows = stats.filter("fold > 0 and doc_id is not null").join(known, F.col("doc_id") == F.col("__id")).select("doc_id", "stats", "fold", "y")
    moments = stats.select(F.count("*").alias("n"), *[f(F.col("stats")[i]).alias(f"{k}{i}") for i in range(len(STATS)) for k, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
    mean = np.array([moments[f"m{i}"] or 0.0 for i in range(len(STATS))])
    scale = np.array([moments[f"s{i}"] or 1.0 for i in range(len(STATS))])
    omega, phase = draw_features(n_features, bandwidth, seed)
    seen = rows.agg(F.count("*").alias("n"), F.avg("y").alias("y")).first()
    if not seen.n or seen.y in (0.0, 1.0):
        return Model(mean, scale, omega, phase, np.zeros(n_features + 1), np.array([0.0]), np.array([0.5 if seen.y is None else seen.y]))
    if seen.n > fit_rows:
        rows = rows.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int((1 << 30) * fit_rows / seen.n))
    rows = stored(rows.repartition(parts), "labelled")

    def sums(batches):
        gram, moment = np.zeros((FOLDS, n_features + 1, n_features + 1)), np.zeros((FOLDS, n_features + 1))
        for b in batches:
            z, y, fold = expand(_matrix(b["stats"]), mean, scale, omega, phase), b["y"].to_numpy(), b["fold"].to_numpy()
            for k in range(1, FOLDS):
                if (at := fold == k).any():
                    gram[k] += z[at].T @ z[at]
                    moment[k] += y[at] @ z[at]
        yield pa.RecordBatch.from_pydict({"gram": [gram[1:].tobytes()], "moment": [moment[1:].tobytes()]})

    gram, moment = np.zeros((FOLDS - 1, n_features + 1, n_features + 1)), np.zeros((FOLDS - 1, n_features + 1))
    for r in rows.coalesce(parts).mapInArrow(sums, "gram binary, moment binary").toLocalIterator():
        gram += np.frombuffer(r.gram).reshape(gram.shape)
        moment += np.frombuffer(r.moment).reshape(moment.shape)
    eye = np.eye(n_features + 1)
    eye[0, 0] = 0.0

    def solve(g: np.ndarray, m: np.ndarray) -> np.ndarray:
        return np.linalg.lstsq(g + ridge * max(g[0, 0], 1.0) * eye, m, rcond=None)[0]

    weights = solve(gram.sum(0), moment.sum(0))
    unseen = [solve(gram.sum(0) - gram[k], moment.sum(0) - moment[k]) for k in range(FOLDS - 1)]

    def bin_up(batches):
        n, total = np.zeros(bins), np.zeros(bins)
        for b in batches:
            z, fold = expand(_matrix(b["stats"]), mean, scale, omega, phase), b["fold"].to_numpy()
            raw = np.choose(fold - 1, [z @ w for w in unseen])
            at = np.clip(((raw + 1) / 3 * bins).astype(int), 0, bins - 1)  # ridge scores of 0/1 labels, with room on both sides
            n += np.bincount(at, minlength=bins)
            total += np.bincount(at, weights=b["y"].to_numpy(), minlength=bins)
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_pydict({"bin": some, "n": n[some], "total": total[some]})

    got = rows.coalesce(parts).mapInArrow(bin_up, "bin bigint, n double, total double").groupBy("bin").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).orderBy("bin").toPandas()
    x, y = isotonic(((got["bin"] + 0.5) / bins * 3 - 1).to_numpy(), got["n"].to_numpy(), got["total"].to_numpy())
    return Model(mean, scale, omega, phase, weights, x, y)


def score(stats: DataFrame, model: Model, threshold: float) -> DataFrame:
    """doc_id, held_out, score and predicted of document_statistics() rows: a narrow pass over numbers."""
    shared = stats.sparkSession.sparkContext.broadcast(model)
    kind = stats.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for b in batches:
            s = shared.value.score(_matrix(b["stats"]))
            yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array(s)], names=["doc_id", "score"])

    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS, F.lit(0)) == 0
    return stats.select("doc_id", "stats").mapInArrow(run, f"doc_id {kind}, score double").select("doc_id", held.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3, **options) -> DataFrame:
    """Fit on the labelled documents and score every one. The texts are read once; their statistics are written to the shared folder."""
    stats = stored(document_statistics(docs, id_col, text_col), "statistics")
    return score(stats, fit(stats, labels, **options), threshold)


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3, **options) -> DataFrame:
    """The rows of docs, all columns, that the classifier scores at threshold or more. Texts are never shuffled."""
    stats = stored(document_statistics(docs, id_col, text_col), "statistics")
    shared = docs.sparkSession.sparkContext.broadcast(fit(stats, labels, **options))
    small_batches(docs.sparkSession)

    def run(batches):
        for b in batches:
            s = np.array([statistics(t) for t in b[text_col].to_pylist()]).reshape(-1, len(STATS))
            yield b.filter(pa.array(shared.value.score(s) >= threshold))

    return docs.mapInArrow(run, docs.schema)


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
