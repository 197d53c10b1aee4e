"""Byte-level BPE: ranked merges folded over the bytes of distinct words.

Tasks split texts into words and take each batch's distinct ones. Their bytes
stand in one array, and the fold goes over all words at once: look up the rank
of every adjacent pair, merge the first pair of the least rank of each word, and
repeat for the words that changed. Ids of the distinct words then spread to all
their places. Nothing is shuffled. Decoding concatenates the ids' byte pieces.

``fold_merges`` is the same fold with Spark's higher-order functions and the ranks
as a literal; README.md has the figures that keep it from being the main path.
"""

from __future__ import annotations

import base64
import heapq
import json
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textkit as tk
from .common import bounded_batches
from .pretokens import split

#: Bytes of text whose words are folded together; bytes of a word above which merges are found by a heap, as the fold takes quadratic time; maps of the literal.
GROUP_BYTES, LONG_WORD, MAPS = 2 << 20, 192, 16_384
_NONE = np.int64(1) << np.int64(40)


def load_ranks(path: str) -> dict[bytes, int]:
    """Pieces and their ids from a file of lines "base64 id"."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def _literal(ranks: dict[bytes, int]) -> Column:
    maps: list[dict[str, int]] = [{} for _ in range(MAPS)]
    for piece, rank in ranks.items():
        key = piece.hex().upper()
        signed = xxhash.xxh64_intdigest(key.encode(), 42)
        maps[(signed - (1 << 64) if signed >> 63 else signed) % MAPS][key] = rank
    return F.from_json(F.lit(json.dumps(maps)), "array<map<string,int>>")


def _let(value: Column, body) -> Column:
    return F.transform(F.array(value), body)[0]


def fold_merges(word: Column, ranks: dict[bytes, int]) -> Column:
    """Ids of a word's bytes: the adjacent pair of the least rank merges, the first of equals, until no pair has one."""
    table = _literal(ranks)
    rank = lambda piece: F.try_element_at(table[F.pmod(F.xxhash64(piece), F.lit(MAPS)).cast("int")], piece)
    digits = F.hex(word)
    pieces = F.transform(F.sequence(F.lit(0), F.octet_length(word) - 1), lambda i: F.substring(digits, i * 2 + 1, F.lit(2)))

    def merged(p: Column, found: Column) -> Column:
        at = lambda k: F.concat(F.slice(p, 1, k - 1), F.array(F.concat(p[(k - 1).cast("int")], p[k.cast("int")])), F.slice(p, k + 2, F.size(p)))
        least = F.array_min(found)
        return F.when(least.isNull(), F.struct(p.alias("p"), F.lit(True).alias("done"))).otherwise(F.struct(_let(F.array_position(found, least), at).alias("p"), F.lit(False).alias("done")))

    def step(acc: Column, _: Column) -> Column:
        p = acc["p"]
        found = F.zip_with(F.slice(p, 1, F.size(p) - 1), F.slice(p, 2, F.size(p)), lambda a, b: rank(F.concat(a, b)))
        return F.when(acc["done"] | (F.size(p) < 2), acc).otherwise(_let(found, lambda f: merged(p, f)))

    start = F.struct(pieces.alias("p"), F.lit(False).alias("done"))
    folded = F.aggregate(F.sequence(F.lit(1), F.octet_length(word)), start, step)["p"]
    whole = rank(digits)
    return F.when(whole.isNotNull(), F.array(whole)).otherwise(F.transform(folded, rank))


def heap_merges(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same merges with a heap of pairs, for words of any length."""
    if word in ranks:
        return [ranks[word]]
    n = len(word)
    end, prev, dead = list(range(1, n + 1)), list(range(-1, n - 1)), [False] * n
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(word[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, stop = heapq.heappop(heap)
        if dead[i] or end[i] >= n or end[end[i]] != stop or dead[end[i]]:
            continue
        dead[end[i]] = True
        end[i] = stop
        if stop < n:
            prev[stop] = i
        for k in ([prev[i]] if prev[i] >= 0 else []) + [i]:
            if end[k] < n and (r := ranks.get(word[k : end[end[k]]])) is not None:
                heapq.heappush(heap, (r, k, end[end[k]]))
    return [ranks[word[i : end[i]]] for i in range(n) if not dead[i]]


@dataclass
class RankArrays:
    """A vocabulary as sorted arrays: pairs of ids to the id they merge to, hashes of pieces to ids, and ids of single bytes."""

    pairs: np.ndarray
    merged: np.ndarray
    hashes: np.ndarray
    ids: np.ndarray
    byte: np.ndarray


def rank_arrays(ranks: dict[bytes, int]) -> RankArrays:
    pairs = [(ranks[p[:k]] << 32 | ranks[p[k:]], r) for p, r in ranks.items() for k in range(1, len(p)) if p[:k] in ranks and p[k:] in ranks]
    keys = np.array([k for k, _ in pairs], np.int64)
    order = np.argsort(keys)
    flat = np.frombuffer(b"".join(ranks), np.uint8)
    ends = np.cumsum([len(p) for p in ranks])
    h = tk.span_hashes(flat, np.r_[0, ends[:-1]], ends)
    by = np.argsort(h)
    return RankArrays(keys[order], np.array([r for _, r in pairs], np.int64)[order], h[by], np.array(list(ranks.values()), np.int64)[by], np.array([ranks.get(bytes([b]), -1) for b in range(256)], np.int64))


def fold_words(data: np.ndarray, start: np.ndarray, end: np.ndarray, h: np.ndarray, v: RankArrays) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all words, one word after the other, and the number of each word's ids."""
    found = np.minimum(np.searchsorted(v.hashes, h), len(v.hashes) - 1)
    whole = v.hashes[found] == h
    done = [(np.flatnonzero(whole), v.ids[found[whole]])]
    rest = np.flatnonzero(~whole)
    size = (end - start)[rest]
    own = np.repeat(rest, size)
    tok = v.byte[data[np.arange(len(own)) + np.repeat(start[rest] - (np.cumsum(size) - size), size)]]
    while len(tok):
        rank = np.full(len(tok), _NONE)
        same = np.flatnonzero(own[1:] == own[:-1])
        pair = tok[same] << 32 | tok[same + 1]
        at = np.minimum(np.searchsorted(v.pairs, pair), len(v.pairs) - 1)
        rank[same] = np.where(v.pairs[at] == pair, v.merged[at], _NONE)
        first = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
        n = np.diff(np.r_[first, len(own)])
        least = np.repeat(np.minimum.reduceat(rank, first), n)
        live = least < _NONE
        done.append((own[~live], tok[~live]))
        hits = np.flatnonzero((rank == least) & live)
        hits = hits[np.r_[True, own[hits[1:]] != own[hits[:-1]]]] if len(hits) else hits
        tok[hits] = least[hits]
        live[hits + 1] = False
        tok, own = tok[live], own[live]
    owner, ids = (np.concatenate(x) for x in zip(*done, strict=True))
    return ids[np.argsort(owner, kind="stable")], np.bincount(owner, minlength=len(start))


def encode(docs: DataFrame, ranks: dict[bytes, int], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids) of each row: ids as little-endian unsigned 32-bit integers in a binary.

    The same ids as the tokenizer's library gives without special tokens. Null and
    empty texts have no ids. Repeated rows come back each; null ids stay null. A text
    of any length is encoded whole, in one task. An empty table gives an empty table.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    shared = spark.sparkContext.broadcast((rank_arrays(ranks), ranks))  # the vocabulary only

    def run(batches):
        v, by_piece = shared.value
        for batch in batches:
            for part in tk.chunks(batch, size=GROUP_BYTES):
                data, start, first, _ = split(part.column("text"))
                h = tk.span_hashes(data, start[:-1], start[1:])
                distinct, where, word = np.unique(h, return_index=True, return_inverse=True)
                s, e = start[where], start[where + 1]
                short = e - s <= LONG_WORD
                flat, n = fold_words(data, s[short], e[short], distinct[short], v)
                per, at = np.zeros(len(s), np.int64), np.zeros(len(s), np.int64)
                per[short], at[short] = n, np.cumsum(n) - n
                for k in np.flatnonzero(~short):
                    long = heap_merges(data[s[k] : e[k]].tobytes(), by_piece)
                    per[k], at[k] = len(long), len(flat)
                    flat = np.concatenate([flat, np.array(long, np.int64)])
                n_ids = per[word]
                ends = np.cumsum(n_ids)
                out = flat[np.arange(int(n_ids.sum())) + np.repeat(at[word] - (ends - n_ids), n_ids)].astype("<u4")
                bounds = np.r_[0, ends][first]
                binary = pa.Array.from_buffers(pa.large_binary(), part.num_rows, [None, pa.py_buffer(bounds * 4), pa.py_buffer(out)]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(np.diff(bounds)), binary], names=["doc_id", "n_tokens", "ids"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_tokens long, ids binary")


def decode(ids: Column, ranks: dict[bytes, int]) -> Column:
    """The bytes that ids (little-endian unsigned 32-bit integers) stand for: their pieces, one after the other."""
    pieces = [b""] * (max(ranks.values(), default=-1) + 1)
    for piece, rank in ranks.items():
        pieces[rank] = piece

    @F.arrow_udf("binary")
    def run(col: pa.Array) -> pa.Array:
        return pa.array([None if x is None else b"".join(map(pieces.__getitem__, np.frombuffer(x, "<u4").tolist())) for x in col.to_pylist()], pa.binary())

    return run(ids)
