"""Toxicity by multiple-instance learning: sentences are scored, documents labelled.

A document is a bag of sentences. A sentence's chance of being toxic is logistic
in its hashed words and word beginnings; a document's is the noisy-or of its sentences: one minus the
product of their chances of being clean. The weights are trained from document
labels only, and the same weights then locate the offending sentences.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkit as tk
from .common import bounded_batches, crc_fold

#: Labelled documents, and bytes of text of them all, that the model is fitted on at most.
SAMPLE_DOCUMENTS, SAMPLE_BYTES, DIMENSIONS, EPOCHS, RATE, START = 8_000, 48 << 20, 1 << 18, 120, 0.7, -6.0
#: Words in fewer documents of the sample get no weight. Penalties on the weights' sizes and squares.
MIN_DOCUMENTS, LASSO, RIDGE = 3, 0.5, 0.01
#: Beginnings of words, in bytes, that are features of their own.
PREFIXES = (5, 6, 7, 8)
_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256), 0x27, 0x2A]] = True
_END = np.zeros(256, bool)
_END[[0x2E, 0x21, 0x3F, 10]] = True


def sentences(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of sentences, first sentence of each row, and features: hash slot and sentence.

    A sentence is a maximal stretch without . ! ? or a line feed. A word gives a
    feature for itself and for its first bytes (PREFIXES), so that endings can vary.
    """
    start, end, first = tk.spans(data, off, ~_END)
    ws, we, _ = tk.spans(data, off, _WORD)
    low, owner = tk.LOWER[data], np.searchsorted(start, ws, side="right") - 1
    parts = [(tk.span_hashes(low, ws, we), owner)]
    for k, size in enumerate(PREFIXES):
        longer = we - ws > size
        parts.append((tk.mix(tk.span_hashes(low, ws[longer], ws[longer] + size) + np.uint64(k + 1)), owner[longer]))
    slot = (np.concatenate([h for h, _ in parts]) % np.uint64(DIMENSIONS)).astype(np.int64)
    return start, end, first, slot, np.concatenate([o for _, o in parts])


@dataclass
class ToxicityModel:
    """Weights of features and a bias; ``always`` is every document's score if there was nothing to tell labels apart by."""

    weights: np.ndarray
    bias: float
    always: float | None = None

    def sentence_chances(self, slot: np.ndarray, sentence: np.ndarray, n: int) -> np.ndarray:
        z = self.bias + np.bincount(sentence, self.weights[slot], n) if n else np.zeros(0)
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def noisy_or(chance: np.ndarray, first: np.ndarray) -> np.ndarray:
    """For each bag, from the number of its first instance: the chance that any is positive; 0 for an empty bag."""
    sums = np.r_[0.0, np.cumsum(np.log1p(-np.minimum(chance, 1 - 1e-12)))]
    return -np.expm1(sums[first[1:]] - sums[first[:-1]])


def train(data: np.ndarray, off: np.ndarray, y: np.ndarray, epochs: int = EPOCHS, min_documents: int = MIN_DOCUMENTS) -> ToxicityModel:
    """Weights that maximise the likelihood of the documents' labels, by gradient ascent with adapted steps."""
    _, _, first, slot, sentence = sentences(data, off)
    n = int(first[-1])
    bag = np.repeat(np.arange(len(y)), np.diff(first))
    model = ToxicityModel(np.zeros(DIMENSIONS), START)
    once = np.unique(bag[sentence] * np.int64(DIMENSIONS) + slot) % DIMENSIONS
    often = np.bincount(once, minlength=DIMENSIONS) >= min_documents
    slot, sentence = slot[often[slot]], sentence[often[slot]]
    used = np.flatnonzero(often)
    compact = np.zeros(DIMENSIONS, np.int64)
    compact[used] = np.arange(len(used))
    slot, w = compact[slot], np.zeros(len(used))
    seen_w, seen_b = np.full(len(used), 1e-8), 1e-8
    for _ in range(epochs if n else 0):
        z = model.bias + np.bincount(sentence, w[slot], n)
        p = 1 / (1 + np.exp(-np.clip(z, -40, 40)))
        whole = np.clip(noisy_or(p, first), 1e-9, 1 - 1e-12)
        up = np.where(y > 0.5, (1 - whole) / whole, -1.0)[bag] * p
        g = np.bincount(slot, up[sentence], len(used)) - RIDGE * w
        gb = up.sum()
        seen_w += g * g
        seen_b += gb * gb
        rate = RATE / np.sqrt(seen_w)
        w += rate * g
        w = np.sign(w) * np.maximum(0, np.abs(w) - rate * LASSO)
        model.bias += RATE * gb / np.sqrt(seen_b)
    model.weights[used] = w
    return model


def _sample(docs: DataFrame, labels: DataFrame, label_col: str, id_col: str, text_col: str, documents: int, size: int) -> DataFrame:
    """(text, y) of labelled documents whose fold isn't 0, one row each: in the order of hashed ids, those that fit into ``documents`` and ``size`` bytes."""
    y = labels.where(F.col(label_col).isNotNull() & F.col("doc_id").isNotNull() & (crc_fold(F.col("doc_id")) != 0)).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col(label_col).cast("double")).alias("y"))
    picked = y.orderBy(F.xxhash64("doc_id"), "doc_id").limit(documents)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    sized = texts.select("doc_id", F.octet_length("text").cast("long").alias("size")).join(F.broadcast(picked), "doc_id")  # at most ``documents`` rows of two numbers
    found = sized.groupBy("doc_id", "y").agg(F.min("size").alias("size")).orderBy(F.xxhash64("doc_id"), "doc_id").toArrow()
    taken, held = [], 0
    for i, y_, n in zip(*(found.column(c).to_pylist() for c in ("doc_id", "y", "size")), strict=True):
        if held + n <= size:
            taken.append((i, y_, n))
            held += n
    few = docs.sparkSession.createDataFrame(taken, "doc_id long, y double, size long")
    fits = texts.join(F.broadcast(few), "doc_id").where(F.octet_length("text") == F.col("size"))  # at most ``documents`` rows of three numbers
    return fits.groupBy("doc_id", "y").agg(F.min("text").alias("text"))


def fit_toxicity(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", sample_documents: int = SAMPLE_DOCUMENTS, sample_bytes: int = SAMPLE_BYTES, id_col: str = "doc_id", text_col: str = "text") -> ToxicityModel:
    """A model from at most ``sample_documents`` labelled documents and ``sample_bytes`` of their text, whose fold isn't 0.

    They are picked by size before any text moves, so that the one task that fits
    them gets no more; a document that doesn't fit is left out, and repeated rows of
    an id count once, by their shortest text. With several labels of a document the
    largest counts. If all have one label, that label is every document's score;
    without any label it is 0.
    """
    bounded_batches(docs.sparkSession)
    rows = _sample(docs, labels, label_col, id_col, text_col, sample_documents, sample_bytes)

    def run(batches):
        text, target = [], []
        for batch in batches:
            text.append(batch.column("text").cast(pa.large_string()))
            target.append(np.asarray(batch.column("y")))
        if not text:
            return
        data, off = tk.buffers(pa.chunked_array(text).combine_chunks())
        t = np.concatenate(target)
        if 0 < t.sum() < len(t):
            model = train(data, off, t)
            yield pa.RecordBatch.from_pydict({"weights": [model.weights.astype(np.float32).tobytes()], "bias": [model.bias], "always": pa.array([None], pa.float64())})
        else:
            yield pa.RecordBatch.from_pydict({"weights": [b""], "bias": [0.0], "always": [float(t[0] > 0)]})

    got = rows.repartition(1).sortWithinPartitions(F.xxhash64("doc_id"), "doc_id").select("text", "y").mapInArrow(run, "weights binary, bias double, always double").first()
    if got is None or got["always"] is not None:
        return ToxicityModel(np.zeros(DIMENSIONS), -40.0, got["always"] if got else 0.0)
    return ToxicityModel(np.frombuffer(got["weights"], np.float32).astype(np.float64), got["bias"])


def score_toxicity(docs: DataFrame, model: ToxicityModel, offending: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score, spans) per row: the noisy-or score of the whole text, and the sentences at ``offending`` or more.

    spans is an array of (start, end, score): places in UTF-8 bytes of the text.
    Null and empty texts score 0 (or what the model says of every document). Texts
    of any length are scored whole, in one task each.
    """
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast((model.weights.astype(np.float32), model.bias, model.always))  # DIMENSIONS numbers

    def run(batches):
        m = ToxicityModel(*shared.value)
        for batch in batches:
            for part in tk.chunks(batch):
                data, off = tk.buffers(part.column("text"))
                start, end, first, slot, sentence = sentences(data, off)
                p = m.sentence_chances(slot, sentence, len(start))
                bad = np.flatnonzero(p >= offending)
                rows = np.searchsorted(bad, first)
                base = np.repeat(off[:-1], np.diff(rows))
                spans = pa.StructArray.from_arrays([pa.array(start[bad] - base), pa.array(end[bad] - base), pa.array(p[bad])], names=["start", "end", "score"])
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(noisy_or(p, first) if m.always is None else np.full(part.num_rows, m.always)), pa.ListArray.from_arrays(pa.array(rows.astype(np.int32)), spans)], names=["doc_id", "score", "spans"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, score double, spans array<struct<start:bigint,end:bigint,score:double>>")


def toxicity_scores(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted, spans) for each row of ``docs``; a null id counts as held out.

    Repeated rows get the same score each; other columns are left out, so their names
    can't clash; an empty table gives an empty table.
    """
    scored = score_toxicity(docs, fit_toxicity(docs, labels, label_col, id_col=id_col, text_col=text_col), id_col=id_col, text_col=text_col)
    return scored.select("doc_id", F.coalesce(crc_fold(F.col("doc_id")) == 0, F.lit(True)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "spans")
