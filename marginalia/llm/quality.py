"""Quality classifier: random Fourier features, ridge regression, isotonic calibration.

Documents become a fixed set of statistics of the whole text. Cosines of random
projections of the standardised statistics approximate a Gaussian kernel. The
normal equations of ridge regression are summed per partition and added up by
Spark; only their fixed-size sums reach the driver. A fold of labelled rows kept
out of the fit gives the isotonic curve that turns ridge scores to probabilities.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkit as tk
from .common import bounded_batches, crc_fold, written

FEATURES, GAMMA, RIDGE, BINS, SEED = 192, 0.08, 1e-3, 512, 7
_CLASS = np.zeros(256, np.int8)  # 0 other letters and bytes of longer characters
_CLASS[65:91] = 1
_CLASS[97:123] = 2
_CLASS[48:58] = 3
_CLASS[[32, 9, 10, 11, 12, 13]] = 4
_CLASS[[i for i in range(33, 127) if not chr(i).isalnum()]] = 5
_CLASS[[0x2E, 0x2C]] = 6  # full stops and commas
NAMES = ("bytes", "words", "lines", "word_len", "upper", "lower", "digit", "blank", "mark", "stop", "exclaim", "pipe", "distinct", "repeat", "bigram", "long_word", "short_word", "line_len", "dup_line", "title", "alone_mark", "word_len_sd")


def statistics(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """One row of statistics (NAMES) for each text, from its whole bytes."""
    n = len(off) - 1
    size = np.diff(off)
    ones = np.maximum(size, 1)
    row_of = np.repeat(np.arange(n), size)
    count = lambda mask: np.bincount(row_of[mask], minlength=n)
    kind = _CLASS[data]
    by_kind = np.bincount(row_of * 8 + kind, minlength=8 * n).reshape(n, 8)
    start, end, first = tk.spans(data, off, ~tk.BLANK)
    words = np.diff(first)
    some = np.maximum(words, 1)
    owner = np.repeat(np.arange(n), words)
    length = end - start
    per = lambda values: np.bincount(owner, values, n) / some
    h = tk.span_hashes(data, start, end)

    def share_of_distinct(x: np.ndarray, own: np.ndarray, total: np.ndarray) -> np.ndarray:
        if not len(x):
            return np.ones(n)
        order = np.lexsort((x, own))
        xs, os = x[order], own[order]
        new = np.r_[True, (xs[1:] != xs[:-1]) | (os[1:] != os[:-1])]
        return np.where(total > 0, np.bincount(os[new], minlength=n) / np.maximum(total, 1), 1.0)

    same = np.r_[False, (h[1:] == h[:-1]) & (owner[1:] == owner[:-1])] if len(h) else np.zeros(0, bool)
    pair, pair_own = (tk.rolling(h, 2), owner[:-1]) if len(h) > 1 else (h[:0], owner[:0])
    inside = owner[1:] == owner[:-1] if len(h) > 1 else np.zeros(0, bool)
    feeds = data == 10
    line_inside = np.ones(256, bool)
    line_inside[10] = False
    ls, le, lf = tk.spans(data, off, line_inside)
    lines = np.diff(lf)
    line_own = np.repeat(np.arange(n), lines)
    w_mean = per(length)
    first_kind = kind[start] if len(start) else np.zeros(0, np.int8)
    alone = (length == 1) & (first_kind >= 5)
    return np.column_stack([
        np.log1p(size), np.log1p(words), np.log1p(count(feeds)), w_mean, by_kind[:, 1] / ones, by_kind[:, 2] / ones, by_kind[:, 3] / ones, by_kind[:, 4] / ones, by_kind[:, 5] / ones, by_kind[:, 6] / ones,
        count(data == 33) / some, count(data == 124) / some, share_of_distinct(h, owner, words), per(same), share_of_distinct(pair[inside], pair_own[inside], np.maximum(words - 1, 0)), per(length > 14), per(length < 4),
        np.log1p(size / np.maximum(lines, 1)), share_of_distinct(tk.span_hashes(data, ls, le), line_own, lines), per(first_kind == 1), per(alone), np.sqrt(np.maximum(per(length.astype(float) ** 2) - w_mean**2, 0)),
    ])


def document_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, s): the statistics of each row's text as an array; null and empty texts have those of no text."""
    bounded_batches(docs.sparkSession)

    def run(batches):
        for batch in batches:
            for part in tk.chunks(batch):
                x = statistics(*tk.buffers(part.column("text")))
                s = pa.FixedSizeListArray.from_arrays(pa.array(x.astype(np.float32).ravel()), x.shape[1]).cast(pa.list_(pa.float32()))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), s], names=["doc_id", "s"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, s array<float>")


@dataclass
class QualityModel:
    """Everything a score needs; of fixed size. ``weights`` None: no label to learn from, each score is ``prior``."""

    mean: np.ndarray
    sd: np.ndarray
    freq: np.ndarray
    phase: np.ndarray
    weights: np.ndarray | None
    knots: np.ndarray
    values: np.ndarray
    prior: float

    def features(self, s: np.ndarray) -> np.ndarray:
        z = np.clip((s - self.mean) / self.sd, -6, 6)
        return np.column_stack([np.ones(len(s)), np.sqrt(2 / len(self.phase)) * np.cos(z @ self.freq + self.phase)])

    def raw(self, s: np.ndarray) -> np.ndarray:
        return np.zeros(len(s)) if self.weights is None else self.features(s) @ self.weights

    def score(self, s: np.ndarray) -> np.ndarray:
        if self.weights is None or not len(self.knots):
            return np.full(len(s), self.prior)
        return np.interp(self.raw(s), self.knots, self.values)


def pool_adjacent(total: np.ndarray, positive: np.ndarray) -> np.ndarray:
    """Isotonic regression of positive / total with weights total, by pooling adjacent violators."""
    merged: list[list[float]] = []
    for n, p in zip(total, positive, strict=True):
        merged.append([n, p, 1])
        while len(merged) > 1 and merged[-2][1] * merged[-1][0] >= merged[-1][1] * merged[-2][0]:
            n2, p2, k2 = merged.pop()
            merged[-1] = [merged[-1][0] + n2, merged[-1][1] + p2, merged[-1][2] + k2]
    return np.concatenate([np.full(int(k), p / n) for n, p, k in merged]) if merged else np.zeros(0)


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    return np.asarray(batch.column("s").flatten()).reshape(batch.num_rows, len(NAMES)).astype(np.float64)


def fit_quality(stats: DataFrame, labels: DataFrame, label_col: str = "quality", features: int = FEATURES, gamma: float = GAMMA, ridge: float = RIDGE, seed: int = SEED) -> QualityModel:
    """A model from the labelled rows whose fold isn't 0: folds 1 to 3 fit it, fold 4 calibrates it.

    Rows without a label are left out. A document with several labels counts once
    for each. Without labels of both kinds, every score is the share of label 1 (0.5
    without any).
    """
    y = labels.where(F.col(label_col).isNotNull() & F.col("doc_id").isNotNull() & (crc_fold(F.col("doc_id")) != 0)).select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label_col).cast("double").alias("y"))
    rows = written(stats.join(y, "doc_id").withColumn("fold", crc_fold(F.col("doc_id"))))
    k = len(NAMES)
    moments = rows.agg(F.count("*").alias("n"), F.sum("y").alias("p"), *[F.avg(F.col("s")[i]).alias(f"m{i}") for i in range(k)], *[F.stddev_pop(F.col("s")[i]).alias(f"d{i}") for i in range(k)]).first()
    n, p = moments["n"], moments["p"] or 0.0
    rng = np.random.default_rng(seed)
    mean = np.array([moments[f"m{i}"] or 0.0 for i in range(k)])
    sd = np.array([max(moments[f"d{i}"] or 0.0, 1e-6) for i in range(k)])
    model = QualityModel(mean, sd, rng.normal(size=(k, features)) * np.sqrt(2 * gamma), rng.uniform(0, 2 * np.pi, features), None, np.zeros(0), np.zeros(0), p / n if n else 0.5)
    if not 0 < p < n:
        return model
    width = features + 1
    upper = np.triu_indices(width)

    def normal_equations(batches):
        a, b, rows_seen = np.zeros((width, width)), np.zeros(width), 0
        for batch in batches:
            z, t = model.features(_matrix(batch)), np.asarray(batch.column("y"))
            a += z.T @ z
            b += z.T @ t
            rows_seen += len(t)
        if rows_seen:
            flat = np.concatenate([a[upper], b])
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat), dtype=np.int32)), pa.array(flat)], names=["i", "v"])

    fit = rows.where("fold < 4")
    summed = fit.mapInArrow(normal_equations, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).toArrow()
    if not summed.num_rows:
        return model
    flat = np.zeros(len(upper[0]) + width)
    flat[np.asarray(summed.column("i").combine_chunks())] = np.asarray(summed.column("v").combine_chunks())
    a = np.zeros((width, width))
    a[upper] = flat[: len(upper[0])]
    a = a + np.triu(a, 1).T
    model.weights = np.linalg.solve(a + ridge * max(a[0, 0], 1) * np.eye(width), flat[len(upper[0]) :])

    def binned(batches):
        for batch in batches:
            r = model.raw(_matrix(batch))
            yield pa.RecordBatch.from_arrays([pa.array(np.clip(np.floor((r + 0.5) / 2 * BINS), 0, BINS - 1).astype(np.int32)), pa.array(r), batch.column("y")], names=["bin", "r", "y"])

    def curve(part: DataFrame) -> tuple[np.ndarray, np.ndarray]:
        got = part.mapInArrow(binned, "bin int, r double, y double").groupBy("bin").agg(F.count("*").alias("n"), F.sum("y").alias("p"), F.avg("r").alias("r")).orderBy("bin").toArrow()
        total, positive, knots = (np.asarray(got.column(c).combine_chunks()).astype(float) for c in ("n", "p", "r"))
        return knots, pool_adjacent(total, positive)

    model.knots, model.values = curve(rows.where("fold = 4"))
    if not len(model.knots):
        model.knots, model.values = curve(rows)
    return model


def score_quality(stats: DataFrame, model: QualityModel) -> DataFrame:
    """(doc_id, score) of each row of ``stats``: the calibrated chance of label 1."""

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(model.score(_matrix(batch)))], names=["doc_id", "score"])

    return stats.mapInArrow(run, "doc_id long, score double")


def quality_scores(docs: DataFrame, labels: DataFrame, label_col: str = "quality", threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted) for each row of ``docs``, scored from its whole text.

    Null and empty texts are scored by the statistics of no text. A null id has no
    fold and counts as held out. Repeated rows get the same score each; the statistics
    of a text of any length are made in one task. An empty table gives an empty table.
    """
    stats = written(document_statistics(docs, id_col, text_col))
    scored = score_quality(stats, fit_quality(stats, labels, label_col))
    return scored.select("doc_id", F.coalesce(crc_fold(F.col("doc_id")) == 0, F.lit(True)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
