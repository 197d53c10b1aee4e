"""Containment of many strings in many texts, as joins on grams.

Texts are read as bytes. A string's grams are its runs of GRAM bytes (of a shorter
string, the whole). How often each gram stands in the texts is counted, and a string's
rarest gram is its anchor: a text without the anchor doesn't hold the string. Texts give
out the anchors that they hold, which are joined to the strings, and what meets there is
checked byte for byte. Grams that are no anchor leave the tasks only if a map of bits,
of a fixed size, takes them for one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import discard, written

#: Bytes of a gram, bits of the map of grams as a power of two, bytes of text handled at once.
GRAM, MAP_BITS, STEP = 8, 26, 1 << 18
U64 = np.uint64


def _slots(gram: np.ndarray, size: int) -> np.ndarray:
    """The bit of the map that each gram has."""
    x = (gram ^ U64(size)) * U64(0x9E3779B97F4A7C15)
    return (x ^ (x >> U64(32))) * U64(0xD6E8FEB86659FD93) >> U64(64 - MAP_BITS)


def _rolling(col: pa.Array, sizes: list[int]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(size, row, gram) for the runs of ``size`` bytes of each text, a piece at a time."""
    col = col.cast(pa.large_binary())
    off = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1]
    raw = col.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[: off[-1]] if raw is not None else np.zeros(0, np.uint8)
    for start in range(int(off[0]) if len(off) else 0, len(data), STEP):
        for size in sizes:
            piece = data[start : start + STEP + size - 1]
            n = len(piece) - size + 1
            if n <= 0:
                continue
            gram = np.zeros(n, U64)
            for k in range(size):
                gram |= piece[k : n + k].astype(U64) << U64(8 * k)
            at = np.arange(start, start + n)
            row = np.searchsorted(off, at, side="right") - 1
            inside = at + size <= off[row + 1]
            yield size, row[inside], gram[inside]


def _grams_of(strings: DataFrame) -> DataFrame:
    """(a, b, size, gram, slot): the different grams of each string (a, b, claim)."""

    def run(batches):
        for batch in batches:
            col = batch.column("claim")
            length = np.asarray(pc.binary_length(col))
            for size in np.unique(np.minimum(length, GRAM)).tolist():
                own = np.flatnonzero(np.minimum(length, GRAM) == size)
                for _, row, gram in _rolling(col.take(pa.array(own)), [size]):
                    pairs = np.unique(np.rec.fromarrays([own[row], gram]))
                    at, gram = pa.array(pairs["f0"]), np.ascontiguousarray(pairs["f1"])
                    yield pa.RecordBatch.from_arrays([batch.column("a").take(at), batch.column("b").take(at), pa.array(np.full(len(gram), size, np.int32)), pa.array(gram.view(np.int64)), pa.array(_slots(gram, size).view(np.int64))], names=["a", "b", "size", "gram", "slot"])

    return strings.mapInArrow(run, "a long, b long, size int, gram long, slot long").distinct()


def _map_of(grams: DataFrame) -> np.ndarray:
    """The map of bits of ``grams`` (slot): 2**MAP_BITS bits, put together by Spark."""
    words = grams.groupBy(F.shiftright("slot", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(slot & 63 AS INT))")).alias("bits")).toArrow()
    bits = np.zeros(1 << (MAP_BITS - 6), U64)
    bits[np.asarray(words.column("w"))] = np.asarray(words.column("bits")).view(U64)
    return bits


def _marked(bits: np.ndarray, gram: np.ndarray, size: int) -> np.ndarray:
    slot = _slots(gram, size)
    return (bits[slot >> U64(6)] >> (slot & U64(63)) & U64(1)).astype(bool)


def _counts(texts: DataFrame, bits, sizes: list[int]) -> DataFrame:
    """(size, gram, n): how often grams of the map stand in the texts; added up within each piece first."""

    def run(batches):
        for batch in batches:
            for size, _, gram in _rolling(batch.column("text"), sizes):
                values, n = np.unique(gram[_marked(bits.value, gram, size)], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(values), size, np.int32)), pa.array(values.view(np.int64)), pa.array(n)], names=["size", "gram", "n"])

    return texts.select("text").mapInArrow(run, "size int, gram long, n long").groupBy("size", "gram").agg(F.sum("n").alias("n"))


def _held(texts: DataFrame, bits, sizes: list[int], rest: list[str]) -> DataFrame:
    """``rest`` of each text with the different grams of the map that it holds."""
    kinds = dict(texts.dtypes)

    def run(batches):
        for batch in batches:
            for size, row, gram in _rolling(batch.column("text"), sizes):
                some = _marked(bits.value, gram, size)
                pairs = np.unique(np.rec.fromarrays([row[some], gram[some]]))
                at = pa.array(pairs["f0"])
                yield pa.RecordBatch.from_arrays([*(batch.column(c).take(at) for c in rest), pa.array(np.full(len(pairs), size, np.int32)), pa.array(np.ascontiguousarray(pairs["f1"]).view(np.int64))], names=[*rest, "size", "gram"])

    return texts.mapInArrow(run, ", ".join(f"`{c}` {kinds[c]}" for c in rest) + ", size int, gram long")


def containing(claims: DataFrame, texts: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``claims`` (claim and others) beside rows of ``texts`` (text and others) that hold the claim verbatim and agree on ``keys``.

    Columns other than ``keys`` must differ in name. Null or empty claims and null texts
    meet nothing; null keys agree. Three scans of the texts, of any length: to count
    grams, to find anchors, and to check the texts that hold one; only anchors, and what
    Catalyst shuffles for the last join, leave the tasks. An anchor of many texts or
    claims is a skewed key of inner joins, which adaptive execution splits.
    """
    spark = claims.sparkSession
    digest = [F.xxhash64(F.lit(k), "claim").alias(n) for k, n in ((1, "a"), (2, "b"))]
    some = claims.where(F.length("claim") > 0)
    grams = written(_grams_of(some.select("claim").distinct().select("claim", *digest)))
    sizes = sorted(r[0] for r in grams.select("size").distinct().collect())  # 1 to GRAM
    bits = spark.sparkContext.broadcast(_map_of(grams))
    counted = written(_counts(texts, bits, sizes))
    bits.unpersist()
    anchors = written(grams.join(counted, ["size", "gram"]).join(grams.groupBy("a", "b").agg(F.count("*").alias("own")), ["a", "b"]).groupBy("a", "b").agg(F.min(F.struct("n", "size", "gram", "slot")).alias("k"), F.count("*").alias("found"), F.first("own").alias("own")).where("found = own").select("a", "b", "k.size", "k.gram", "k.slot"))  # a string with a gram that no text holds stands nowhere
    bits = spark.sparkContext.broadcast(_map_of(anchors))
    keyed = texts.select(*keys, "text", F.xxhash64("text").alias("t"))
    held = _held(keyed, bits, sizes, [*keys, "t"])
    wanted = some.select(*keys, "claim", *digest).distinct().join(anchors, ["a", "b"])
    same = lambda x, y, extra: [x[c].eqNullSafe(y[c]) for c in keys] + [x[c] == y[c] for c in extra]
    met = written(wanted.join(held, same(wanted, held, ["size", "gram"])).select(*[wanted[c] for c in keys], "claim", "t").distinct())
    bits.unpersist()
    discard(grams, counted, anchors)
    whole = texts.withColumn("t", F.xxhash64("text"))
    hits = whole.join(met, same(whole, met, ["t"])).where(F.contains(whole["text"], met["claim"]))
    hits = hits.select(*[whole[c] for c in texts.columns], met["claim"].alias("__claim"))
    joined = hits.join(some, [hits["__claim"] == some["claim"]] + [hits[c].eqNullSafe(some[c]) for c in keys])
    return joined.select(*[hits[c] for c in texts.columns], *[some[c] for c in claims.columns if c not in keys])
