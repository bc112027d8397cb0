"""Quality classifier: random Fourier features of document statistics, ridge scores, isotonic calibration.

The features approximate a Gaussian kernel. The normal equations are sums over documents, so each partition adds up its own and
the sums are added in a tree; likewise the calibration works on counts per score bin. No labelled row reaches the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from hearthline.llm.frames import NO_ID, keep_shuffles_short, stored, table, text_key, texts
from hearthline.llm.words import PLAIN, Hasher, Words, chunks, mix, shingles
from hearthline.plans.catalog import query

WIDTH, RIDGE, BINS, SEED = 192, 1e-3, 1024, 11
_CLASSES = (b"#*$%&|<>", b"!?", b".,;:", bytes(range(0x41, 0x5B)), bytes(range(0x61, 0x7B)), bytes(range(0x30, 0x3A)),
            bytes(range(0x80, 0x100)), b"|", b"\n", b"()[]{}\"'", b"_=/\\@+-~^`")
N_STATS = len(_CLASSES) + 9


def statistics(column: pa.Array) -> np.ndarray:
    """One row of numbers per text: logarithms of its size, shares of characters, repetition. An empty text has zeros."""
    out, hasher = [], Hasher()
    kind = np.zeros((256, len(_CLASSES)), np.float32)
    for i, c in enumerate(_CLASSES):
        kind[list(c), i] = 1
    marks = np.zeros(256, np.float32)
    marks[list(b"!$%&#*|")] = 1
    for _, off, data in chunks(column):
        w = Words(off, data, PLAIN)
        n, size = w.counts().astype(np.float64), np.diff(off).astype(np.float64)
        rows, h = len(n), hasher(w)
        of, many = w.row(), np.maximum(n, 1)
        counts = np.stack([np.concatenate(([0], np.cumsum(kind[data, i], dtype=np.float64)))[off] for i in range(len(_CLASSES))], 1)
        counts = np.diff(counts, axis=0)
        length = (w.end - w.start).astype(np.float64)

        def per_row(v: np.ndarray) -> np.ndarray:
            return np.bincount(of, v, rows) / many

        def fresh(values: np.ndarray, owner: np.ndarray) -> np.ndarray:
            """Distinct values of each row."""
            if not len(values):
                return np.zeros(rows)
            u = np.unique(values ^ mix(owner.astype(np.uint64)), return_index=True)[1]
            return np.bincount(owner[u], minlength=rows).astype(float)

        g, ok = shingles(h, w.first, 3)
        at = np.flatnonzero(ok)
        mean = per_row(length)
        out.append(np.column_stack([
            counts / np.maximum(size, 1)[:, None], np.log1p(n) / 10, np.log1p(size) / 12, mean / 20,
            np.sqrt(np.maximum(0, per_row(length**2) - mean**2)) / 20, per_row(length > 20), per_row(marks[data[w.end - 1]] if len(w.end) else length),
            fresh(h, of) / many, fresh(g[at], of[at]) / np.maximum(np.bincount(of[at], minlength=rows), 1), np.minimum(1, size / np.maximum(1, counts[:, 8] + 1) / 1000)]))
    return np.concatenate(out) if out else np.empty((0, N_STATS))


@dataclass(frozen=True)
class Model:
    mean: np.ndarray
    scale: np.ndarray
    turn: np.ndarray
    shift: np.ndarray
    weight: np.ndarray
    edges: np.ndarray  # raw score bins
    level: np.ndarray  # calibrated score of each bin

    def map(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -6, 6)
        return np.column_stack([np.cos(z @ self.turn + self.shift) * np.sqrt(2 / WIDTH), z, np.ones(len(x))])

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.map(x) @ self.weight

    def score(self, x: np.ndarray) -> np.ndarray:
        """Calibrated levels; within a level the raw score still orders, by a thousandth at most."""
        raw = self.raw(x)
        return 0.999 * self.level[np.searchsorted(self.edges, raw)] + 0.001 * np.clip((raw + 1) / 2, 0, 1)


def isotonic(good: np.ndarray, all_: np.ndarray) -> np.ndarray:
    """Rising shares good / all_ per bin by pooling neighbours that fall; one pseudo-count in each pool keeps off 0 and 1."""
    pools: list[list[float]] = []  # good, all, bins
    for g, a in zip(good.tolist(), all_.tolist()):
        pools.append([g, a, 1])
        while len(pools) > 1 and pools[-2][0] * pools[-1][1] >= pools[-1][0] * pools[-2][1]:
            g2, a2, n2 = pools.pop()
            pools[-1] = [pools[-1][0] + g2, pools[-1][1] + a2, pools[-1][2] + n2]
    # Averages with the pseudo-count can fall again between small pools.
    level = np.concatenate([np.full(int(n), (g + 0.5) / (a + 1)) for g, a, n in pools])
    return np.clip(np.maximum.accumulate(level), 0, 1)


def _add_up(df: DataFrame, part) -> np.ndarray | None:
    """The sum of ``part(batch)`` over all Arrow batches, partition by partition and then in a tree."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            v = part(b)
            total = v if total is None else total + v
        if total is not None:
            yield pa.record_batch({"v": pa.array([total.astype(np.float64).tobytes()], pa.binary())})

    rdd = df.mapInArrow(sums, "v binary").rdd.map(lambda r: np.frombuffer(bytes(r[0]), np.float64).copy())
    rdd = rdd.filter(lambda v: len(v) > 0)
    return None if rdd.isEmpty() else rdd.treeReduce(lambda a, b: a + b, 2)


def _matrix(b: pa.RecordBatch) -> np.ndarray:
    return np.frombuffer(b"".join(b.column("x").to_pylist()), np.float32).reshape(-1, N_STATS).astype(float)


def described(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, key (see text_key), x (statistics as float32 bytes) per row."""

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = statistics(b.column("text")).astype(np.float32)
            yield pa.record_batch({"id": b.column("id"), "key": b.column("key"), "x": pa.array([r.tobytes() for r in x], pa.binary())})

    return texts(docs, id_col, text_col, key=text_key(docs[text_col])).mapInArrow(describe, "id long, key long, x binary")


def fit_quality(labelled: DataFrame) -> Model:
    """From rows (x, label 0/1, calibrate boolean): ridge on those to fit, isotonic levels on those to calibrate.

    Without labelled rows every score is 0.5. If there is only one kind of row, it serves both ends.
    """
    rng = np.random.default_rng(SEED)
    # Widths of the kernel: half the random directions look at coarse, half at fine differences.
    turn = rng.normal(size=(N_STATS, WIDTH)) * np.where(np.arange(WIDTH) % 2, 0.12, 0.35)
    shift = rng.uniform(0, 2 * np.pi, WIDTH)
    m = _add_up(labelled, lambda b: (lambda x: np.concatenate(([len(x)], x.sum(0), (x * x).sum(0))))(_matrix(b)))
    if m is None or m[0] == 0:
        return Model(np.zeros(N_STATS), np.ones(N_STATS), turn, shift, np.zeros(WIDTH + N_STATS + 1), np.empty(0), np.array([0.5]))
    mean = m[1:1 + N_STATS] / m[0]
    scale = np.sqrt(np.maximum(m[1 + N_STATS:] / m[0] - mean**2, 1e-6))
    bare = Model(mean, scale, turn, shift, np.zeros(0), np.empty(0), np.empty(0))
    d = WIDTH + N_STATS + 1

    def normal(b: pa.RecordBatch) -> np.ndarray:
        f, y = bare.map(_matrix(b)), np.array(b.column("label").to_pylist(), float) - 0.5
        return np.concatenate([(f.T @ f).ravel(), f.T @ y, [len(y)]])

    use = labelled.where("not calibrate")
    s = _add_up(use, normal)
    if s is None:
        s = _add_up(labelled, normal)
    weight = np.linalg.solve(s[:d * d].reshape(d, d) + RIDGE * s[-1] * np.eye(d), s[d * d:-1])
    edges = np.linspace(-1, 1, BINS - 1)
    fitted = Model(mean, scale, turn, shift, weight, edges, np.empty(0))

    def counts(b: pa.RecordBatch) -> np.ndarray:
        at, y = np.searchsorted(edges, fitted.raw(_matrix(b))), np.array(b.column("label").to_pylist(), float)
        return np.concatenate([np.bincount(at, y, BINS), np.bincount(at, minlength=BINS)])

    c = _add_up(labelled.where("calibrate"), counts)
    if c is None:
        c = _add_up(labelled, counts)
    return Model(mean, scale, turn, shift, weight, edges, isotonic(c[:BINS], c[BINS:]))


def fold(id_: Column, parts: int) -> Column:
    """crc32 of the id as text, modulo ``parts``; a missing id is empty text."""
    return F.crc32(F.coalesce(id_.cast("string"), F.lit("")).cast("binary")) % parts


def quality_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
                   parts: int = 4, held: int = 2) -> DataFrame:
    """id, key (see text_key), held_out, score per row of ``docs``; labels of held-out ids are never read.

    Labels other than 0 and 1 are ignored; an id with several labels counts with the largest. Of the folds to learn from, the
    last calibrates. A missing text is scored as an empty one. Rows are scored one by one.
    """
    keep_shuffles_short(docs.sparkSession)
    x = stored(described(docs, id_col, text_col), "statistics")
    f = fold(F.col("id"), parts)
    marked = (labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("label"))
              .where(F.col("id").isNotNull() & F.col("label").isin(0, 1) & (f != held)).groupBy("id").agg(F.max("label").alias("label")))
    last = max(i for i in range(parts) if i != held)
    model = fit_quality(stored(x.join(marked, "id").select("x", "label", (f == last).alias("calibrate")), "labelled"))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.record_batch({"id": b.column("id"), "key": b.column("key"), "score": pa.array(model.score(_matrix(b)))})

    return x.mapInArrow(score, "id long, key long, score double").select(
        "id", "key", (fold(F.when(F.col("id") != NO_ID, F.col("id")), parts) == held).alias("held_out"), "score")


@query("op8_quality_classifier")
def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_scores(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))
    return out.select(F.when(F.col("id") != NO_ID, F.col("id")).alias("doc_id"), "held_out", "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))
