"""Op 3: quality scores. Random Fourier features of document statistics, ridge by summed normal equations, isotonic.

The statistics describe form only (lengths, character classes, repetition), over the whole text; labels, language,
source and ids are no inputs. cos features with Gaussian frequencies approximate a Gaussian kernel on the standardised
statistics. Every partition sums its normal equations for each of four folds, a bounded number of tasks adds them up,
and the driver solves a system whose size depends on ``features`` alone. Scores of rows that a fit has not seen choose
the ridge penalty and feed the isotonic step (pool adjacent violators over a histogram of scores).
"""

from __future__ import annotations

import operator
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import shared

#: Sets of bytes whose share of a text is a statistic.
CLASSES = {
    "upper": range(65, 91),
    "lower": range(97, 123),
    "digit": range(48, 58),
    "beyond_ascii": range(128, 256),
    "space": (9, 10, 11, 12, 13, 32),
    "newline": (10,),
    "stop": b".,;:'\"-()?",
    "shout": b"!",
    "symbol": b"$%&*#@^~<>=_+\\/{}[]`",
    "bar": b"|",
}
_CLASS = np.zeros((256, len(CLASSES)))
for _k, _v in enumerate(CLASSES.values()):
    _CLASS[list(_v), _k] = 1
STATISTICS = ["log_bytes", "log_words", "word_bytes", "distinct_words", "repeated_next", "commonest_word", "capital_words", "distinct_lines", "line_bytes", *(f"share_{k}" for k in CLASSES)]


def statistics(text: str | None) -> list[float]:
    """Statistics of a whole text; a null or empty text has zeros only."""
    raw = (text or "").encode()
    if not raw:
        return [0.0] * len(STATISTICS)
    share = np.sqrt(np.bincount(np.frombuffer(raw, np.uint8), minlength=256) @ _CLASS / len(raw))
    words = raw.split()
    n = max(len(words), 1)
    times = Counter(words)
    same = sum(map(operator.eq, words, words[1:]))
    lines = raw.split(b"\n")
    capital = sum(map(bytes.isupper, words))
    return [
        np.log1p(len(raw)), np.log1p(len(words)), np.log1p(len(raw) / n), np.log(max(len(times), 1) / n) / max(1.0, np.log1p(n)), np.sqrt(same / n),
        np.sqrt(max(times.values(), default=0) / n), np.sqrt(capital / n), len(set(lines)) / len(lines), np.log1p(len(raw) / len(lines)), *share,
    ]


def statistics_table(docs: DataFrame, *, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, text_hash, x array<float>) for each row."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.array([statistics(t.as_py()) for t in b.column(2)], np.float32).reshape(-1, len(STATISTICS))
            flat = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * len(STATISTICS)), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), flat], ["doc_id", "text_hash", "x"])

    shared.bound_batches(docs.sparkSession)
    text = F.col(text_column)
    picked = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("text_hash"), text.alias("text"))
    return picked.mapInArrow(shared.tidy(task), "doc_id long, text_hash long, x array<float>")


def remainder(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 5; a null id counts as remainder 1."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5, F.lit(1))


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    freq: np.ndarray
    phase: np.ndarray
    weights: dict[int, np.ndarray]  # by the fold left out; 0: fitted on all folds
    knots: tuple[np.ndarray, np.ndarray]

    def features(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        phi = np.cos(z @ self.freq + self.phase) * np.sqrt(2.0 / len(self.phase))
        return np.hstack([phi, np.ones((len(x), 1))])

    def raw(self, x: np.ndarray, fold: int = 0) -> np.ndarray:
        return self.features(x) @ self.weights[fold]

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(self.raw(x), *self.knots), 0.0, 1.0)


def isotonic(value: np.ndarray, count: np.ndarray, total: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: knots (score, probability), non-decreasing, of groups in ascending ``value``.

    Each pooled block is one knot at its mean value; a block's probability is shrunk by half a pseudo-row of each label.
    """
    blocks: list[list[float]] = []
    for v, n, y in zip(value, count, total):
        blocks.append([v * n, n, y])
        while len(blocks) > 1 and blocks[-2][2] * blocks[-1][1] >= blocks[-1][2] * blocks[-2][1]:
            b = blocks.pop()
            blocks[-1] = [p + q for p, q in zip(blocks[-1], b)]
    v, n, y = np.array(blocks, float).reshape(-1, 3).T
    return v / n, np.maximum.accumulate((y + 0.5) / (n + 1.0))


def _batches(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for b in batches:
        if b.num_rows:
            x = b.column("x")
            yield b, x.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, width)


def fit(stats: DataFrame, labels: DataFrame, *, label_column: str = "quality", features: int = 256, seed: int = 7, bins: int = 4096, adders: int = 16) -> Model:
    """Fit on labelled rows of ``stats`` whose remainder is not 0.

    Labels other than 0 and 1 are left out; several labels of one id count by their mean. Without usable rows every
    score is 0.5.
    """
    width = len(STATISTICS)
    marks = labels.where(F.col(label_column).isin(0, 1)).groupBy("doc_id").agg(F.avg(F.col(label_column).cast("double")).alias("y"))
    rows = shared.written(stats.join(marks, "doc_id").withColumn("fold", remainder(F.col("doc_id"))).where("fold <> 0").select("x", "y", F.col("fold").cast("long").alias("fold")), "training")
    moments = rows.select(F.count("*").alias("n"), *[f(F.get("x", F.lit(k)).cast("double")).alias(f"{t}{k}") for k in range(width) for t, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
    rng = np.random.default_rng(seed)
    freq = rng.standard_normal((width, features)) / np.sqrt(width)
    phase = rng.uniform(0, 2 * np.pi, features)
    model = Model(np.zeros(width), np.ones(width), freq, phase, {}, (np.array([0.0]), np.array([0.5])))
    size = features + 1
    if not moments.n:
        model.weights = {0: np.zeros(size)}
        return model
    model.mean = np.array([moments[f"m{k}"] for k in range(width)])
    scale = np.array([moments[f"s{k}"] for k in range(width)])
    model.scale = np.where(scale > 1e-9, scale, 1.0)

    def equations(batches):
        sums: dict[int, np.ndarray] = {}
        for b, x in _batches(batches, width):
            phi, y, fold = model.features(x), b.column("y").to_numpy(), b.column("fold").to_numpy()
            for k in np.unique(fold):
                p = np.hstack([phi[fold == k], y[fold == k, None]])
                sums[int(k)] = sums.get(int(k), 0) + p.T @ p
        for k, g in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int64()), pa.array([g.tobytes()], pa.binary())], ["fold", "g"])

    def add(batches):
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for k, g in zip(b.column(0).to_pylist(), b.column(1)):
                sums[k] = sums.get(k, 0) + np.frombuffer(g.as_buffer(), float)
        for k, g in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int64()), pa.array([g.tobytes()], pa.binary())], ["fold", "g"])

    by_fold = {k: np.zeros((size + 1, size + 1)) for k in range(1, 5)}
    for r in rows.mapInArrow(shared.tidy(equations), "fold long, g binary").repartition(adders).mapInArrow(shared.tidy(add), "fold long, g binary").toLocalIterator():
        by_fold[r.fold] += np.frombuffer(r.g, float).reshape(size + 1, size + 1)
    whole = sum(by_fold.values())

    def solve(g: np.ndarray, ridge: float) -> np.ndarray:
        penalty = np.full(size, ridge)
        penalty[-1] = 1e-9
        return np.linalg.solve(g[:size, :size] + np.diag(penalty), g[:size, size])

    def error(g: np.ndarray, w: np.ndarray) -> float:
        v = np.append(w, -1.0)
        return float(v @ g @ v)

    grid = [10.0**e for e in range(-4, 4)]
    ridge = min(grid, key=lambda r: sum(error(g, solve(whole - g, r)) for g in by_fold.values()))
    model.weights = {0: solve(whole, ridge)} | {k: solve(whole - g, ridge) for k, g in by_fold.items()}

    def unseen(batches):
        for b, x in _batches(batches, width):
            fold, s = b.column("fold").to_numpy(), np.empty(len(x))
            for k in np.unique(fold):
                s[fold == k] = model.raw(x[fold == k], int(k))
            at = np.clip(np.floor((s + 0.5) * (bins / 2)), 0, bins - 1).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(s), b.column("y")], ["bin", "s", "y"])

    groups = rows.mapInArrow(shared.tidy(unseen), "bin long, s double, y double").groupBy("bin").agg(F.avg("s").alias("s"), F.count("*").alias("n"), F.sum("y").alias("y")).orderBy("bin").collect()
    model.knots = isotonic(*(np.array([g[c] for g in groups], float) for c in ("s", "n", "y")))
    shared.discard(rows.sparkSession, rows)
    return model


def score_documents(
    docs: DataFrame, labels: DataFrame, *, id_column: str = "doc_id", text_column: str = "text", label_column: str = "quality", threshold: float = 0.3, features: int = 256
) -> DataFrame:
    """(doc_id, held_out, score, predicted, text_hash) for each row; text_hash is xxhash64 of the text.

    score: 0 to 1, higher where label 1 is likelier, non-decreasing in the ridge score. Null and empty texts are
    scored by their zero statistics. Null ids are scored and count as not held out; an empty table gives no rows.
    """
    stats = shared.written(statistics_table(docs, id_column=id_column, text_column=text_column), "statistics")
    model = fit(stats, labels.select("doc_id", label_column), label_column=label_column, features=features)
    width = len(STATISTICS)

    def task(batches):
        for b, x in _batches(batches, width):
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("text_hash"), pa.array(model.score(x))], ["doc_id", "text_hash", "score"])

    scored = stats.mapInArrow(shared.tidy(task), "doc_id long, text_hash long, score double")
    return scored.select("doc_id", (remainder(F.col("doc_id")) == 0).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "text_hash")
