"""Line dedup: drop the lines that many documents share.

Lines are normalised and hashed to 128 bits, each document's distinct hashes are
exploded to rows, documents are counted per hash, the hashes over the threshold
are joined back to their documents, and each text is put together again, in
order, from the lines that stay. Only hashes are shuffled for the count; texts
move once, to meet the list of hashes that they lose.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textkit as tk
from .common import bounded_batches, join_hot, written

MIN_DOCUMENTS = 10


def _lines(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of each line; a row has one line more than it has line feeds."""
    feeds = np.flatnonzero(data == 10)
    start, end = np.sort(np.concatenate([off[:-1], feeds + 1])), np.sort(np.concatenate([feeds, off[1:]]))
    per_row = 1 + np.diff(np.searchsorted(feeds, off))
    return start, end, np.repeat(np.arange(len(off) - 1), per_row)


def _keys(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Whether each line has a key at all, and the two halves of the key's hash."""
    solid = np.flatnonzero(~tk.BLANK[data])
    first, past = np.searchsorted(solid, start), np.searchsorted(solid, end)
    has = past > first
    low = tk.LOWER[data]
    s = np.where(has, solid[np.minimum(first, max(len(solid) - 1, 0))] if len(solid) else 0, start)
    e = np.where(has, solid[np.maximum(past - 1, 0)] + 1 if len(solid) else 0, start)
    return has, tk.span_hashes(low, s, e, tk.BASES[0]).view(np.int64), tk.span_hashes(low, s, e, tk.BASES[1]).view(np.int64)


def line_hashes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, a, b): the hash of each different line key of each row that isn't empty."""
    bounded_batches(docs.sparkSession)

    def run(batches):
        for batch in batches:
            for part in tk.chunks(batch):
                data, off = tk.buffers(part.column("text"))
                start, end, row = _lines(data, off)
                has, a, b = _keys(data, start, end)
                row, a, b = row[has], a[has], b[has]
                order = np.lexsort((b, a, row))
                row, a, b = row[order], a[order], b[order]
                new = np.ones(len(row), bool)
                new[1:] = (row[1:] != row[:-1]) | (a[1:] != a[:-1]) | (b[1:] != b[:-1])
                ids = part.column("doc_id").take(pa.array(row[new]))
                yield pa.RecordBatch.from_arrays([ids, pa.array(a[new]), pa.array(b[new])], names=["doc_id", "a", "b"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, a long, b long")


def _without(text: pa.Array, dropped: pa.Array) -> pa.Array:
    n_lines, n_dropped, kept = [], [], []
    batch = pa.RecordBatch.from_arrays([text, dropped], names=["text", "dropped"])
    for part in tk.chunks(batch):
        data, off = tk.buffers(part.column("text"))
        start, end, row = _lines(data, off)
        n = np.bincount(row, minlength=part.num_rows)
        texts = part.column("text").to_pylist()
        lists = part.column("dropped")
        gone = np.zeros(len(row), bool)
        if len(flat := lists.flatten()):
            has, a, b = _keys(data, start, end)
            lost_a, lost_b = (np.asarray(flat.field(k)) for k in (0, 1))
            lost = np.unique(np.rec.fromarrays([lost_a, lost_b]))
            at = np.minimum(np.searchsorted(lost.f0, a), len(lost) - 1)
            gone = has & (lost.f0[at] == a) & (lost.f1[at] == b)
        bad = np.bincount(row[gone], minlength=part.num_rows)
        ends = np.cumsum(n)
        for i in np.flatnonzero(bad):
            lines = texts[i].split("\n")
            stays = ~gone[ends[i] - n[i] : ends[i]]
            texts[i] = "\n".join([lines[k] for k in np.flatnonzero(stays)])
        n_lines.append(n)
        n_dropped.append(bad)
        kept += [t or "" for t in texts]
    whole = lambda parts: pa.array(np.concatenate(parts) if parts else [], pa.int64())
    return pa.StructArray.from_arrays([whole(n_lines), whole(n_dropped), pa.array(kept, pa.string())], names=["n_lines", "n_dropped", "text"])


def drop_common_lines(docs: DataFrame, min_documents: int = MIN_DOCUMENTS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with ``text_col`` cleared of shared lines, and columns n_lines (before) and n_dropped.

    A line's key is the line stripped of blanks (0x20, 0x09-0x0D) at both ends with
    A-Z in lower case. A key of one code point or more that stands in
    ``min_documents`` documents or more loses all its lines in every row; all others
    stay in their order. Documents are different ids: rows that repeat an id count
    once, each row of a null id counts for itself. A null or empty text is one
    empty line and comes back empty; a text that loses all lines comes back empty.
    A text of any length is handled whole, in one task. Other columns pass through;
    ones named n_lines or n_dropped are replaced. An empty table gives an empty table.
    """
    hashes = written(line_hashes(docs, id_col, text_col))
    rows = hashes.count()
    named = hashes.where("doc_id is not null").groupBy("a", "b", "doc_id").agg(F.count("*").alias("r")) if _ids_repeat(docs, id_col) else hashes.where("doc_id is not null").withColumn("r", F.lit(1).cast("long"))
    counted = named.unionByName(hashes.where("doc_id is null").withColumn("r", F.lit(1).cast("long")))
    common = written(counted.groupBy("a", "b").agg(F.count("*").alias("documents"), F.sum("r").alias("n")).where(F.col("documents") >= min_documents).select("a", "b", "n"))
    lost = join_hot(hashes, common, ["a", "b"], rows).groupBy(F.col("doc_id").alias("__id")).agg(F.collect_set(F.struct("a", "b")).alias("__lost"))
    joined = docs.join(lost, docs[id_col].cast("long").eqNullSafe(lost["__id"]), "left")
    rest: list[str | Column] = [docs[c] for c in docs.columns if c not in (text_col, "n_lines", "n_dropped")]
    out = joined.select(*rest, F.arrow_udf(_without, "struct<n_lines:bigint,n_dropped:bigint,text:string>")(docs[text_col].cast("string"), F.col("__lost")).alias("__r"))
    return out.select(*[c for c in docs.columns if c not in (text_col, "n_lines", "n_dropped")], F.col("__r.n_lines").alias("n_lines"), F.col("__r.n_dropped").alias("n_dropped"), F.col("__r.text").alias(text_col))


def _ids_repeat(docs: DataFrame, id_col: str) -> bool:
    """Whether any id has several rows; where none has, lines need no count of different ids."""
    return bool(docs.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("i")).count().where("count > 1").limit(1).count())
