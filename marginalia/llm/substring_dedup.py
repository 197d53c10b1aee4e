"""Substring dedup by fixed-block anchors.

A repeat of 50 words holds a whole block of 25 words that is aligned to multiples
of 25 in the reference document. So aligned blocks are the index, and every
rolling window of 25 words probes it. Blocks and windows are dealt to buckets by
their hash, packed into a few bytes each, and matched there in arrays. Hits are
extended to exact repeats: the 50-word windows around them are dealt in the same
way, each bucket, of which there are as many as the text needs, first learns the smallest document of each window, then marks
those of larger ones; overlapping marks join to maximal repeats. What documents in
one piece of a task's input share is settled there, and one of them stands for all
in the bucket, so a passage that a third of all documents hold fills no bucket.
Rows whose whole word sequence a smaller document has are set aside before that.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkit as tk
from .common import bounded_batches, join_hot, shuffle_partitions, written

WORDS = 50
_MERGE_AT, _GROUP_BYTES = 1 << 20, 4 << 20
#: Text for each partition of dealt blocks or windows, where shuffle partitions would get more, and for each bucket of
#: blocks and of windows. An index holds about 40 bytes a block or window, so about 150 MB of a bucket's blocks; of its
#: windows as much where a fifth of all text is near hits.
PARTITION_BYTES, BLOCK_BUCKET_BYTES, WINDOW_BUCKET_BYTES = 512 << 20, 512 << 20, 128 << 20


_DEALT = "bucket int, kind int, docs int, windows int, data binary"


def _rows(kind: int, bucket: np.ndarray, tag: np.ndarray, row: np.ndarray, pos: np.ndarray, ids: np.ndarray, versions: np.ndarray, out: dict[str, list]) -> None:
    """Adds a row of _DEALT for each bucket, with all of its tags; ``pos`` has a place of each, or the first and length of a run of places in one number."""
    order = np.argsort(bucket, kind="stable")
    b = bucket[order]
    edges = np.flatnonzero(np.r_[True, b[1:] != b[:-1], True]) if len(b) else np.zeros(0, np.int64)
    r, t, p = row[order], tag[order], pos[order]
    for s, e in zip(edges[:-1], edges[1:], strict=True):
        runs = np.flatnonzero(np.r_[True, r[s + 1 : e] != r[s : e - 1]])
        who = r[s:e][runs]
        out["bucket"].append(int(b[s]))
        out["kind"].append(kind)
        out["docs"].append(len(runs))
        out["windows"].append(int(e - s))
        out["data"].append(tk.pack(ids[who], versions[who], np.diff(np.r_[runs, e - s]).astype(np.uint32), t[s:e], p[s:e]))


def _batch(out: dict[str, list]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(out[c], k) for c, k in zip(out, (pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.binary()), strict=True)], names=list(out))


def _runs(row: np.ndarray, pos: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, first place and length of the runs of neighbouring places."""
    order = np.lexsort((pos, row))
    row, pos = row[order], pos[order]
    s = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (pos[1:] != pos[:-1] + 1)]) if len(row) else np.zeros(0, np.int64)
    return row[s], pos[s], np.diff(np.r_[s, len(row)])


def _settled(row: np.ndarray, pos: np.ndarray, ids: np.ndarray, versions: np.ndarray, buckets: int, out: dict[str, list]) -> None:
    """Adds rows of kind 2: places that need no bucket, as runs, dealt by document."""
    row, first, length = _runs(row, pos)
    _rows(2, (tk.mix(ids[row].astype(np.uint64)) % np.uint64(buckets)).astype(np.uint32), length.astype(np.uint32), row, first.astype(np.uint32), ids, versions, out)


def _deal_anchors(data: np.ndarray, off: np.ndarray, ids: np.ndarray, block: int, buckets: int) -> pa.RecordBatch:
    """Every rolling window of ``block`` words as a probe, the aligned ones as the index, with 32 bits beside the bucket; of windows that occur several times here one each, and all their places as hits."""
    start, end, first = tk.spans(data, off, ~tk.BLANK)
    w = tk.rolling(tk.span_hashes(data, start, end), block)
    row = np.repeat(np.arange(len(ids)), np.diff(first))[: len(w)]
    at = np.arange(len(w))
    fine = at + block <= first[1:][row] if len(w) else np.zeros(0, bool)
    w, row, pos = w[fine], row[fine], (at - first[row])[fine] if len(w) else at
    order = np.argsort(w, kind="stable")
    new = np.r_[True, w[order[1:]] != w[order[:-1]]] if len(w) else np.zeros(0, bool)
    group = np.cumsum(new) - 1
    several = np.bincount(group)[group] > 1 if len(w) else new
    aligned = pos[order] % block == 0
    seen = np.flatnonzero(aligned)
    index = order[seen[np.unique(group[seen], return_index=True)[1]]]
    probe = order[new]
    out: dict[str, list] = {c: [] for c in ("bucket", "kind", "docs", "windows", "data")}
    none = np.zeros(len(ids), np.int64)
    bucket, tag = ((w >> np.uint64(32)) % np.uint64(buckets)).astype(np.uint32), (w & np.uint64(0xFFFFFFFF)).astype(np.uint32)
    for kind, keep in ((0, np.sort(index)), (1, np.sort(probe))):
        _rows(kind, bucket[keep], tag[keep], row[keep], pos[keep].astype(np.uint32), ids, none, out)
    _settled(row[order[several]], pos[order[several]], ids, none, buckets, out)
    return _batch(out)


class _Index:
    """Of one bucket: for each tag of an aligned block its smallest and largest document, and a place in it."""

    def __init__(self) -> None:
        self.parts: list[tuple[np.ndarray, ...]] = []
        self.held = 0

    def add(self, tag: np.ndarray, doc: np.ndarray, pos: np.ndarray) -> None:
        self.parts.append((tag, doc, doc, pos, np.ones(len(tag), np.int64)))
        self.held += len(tag)
        if self.held > _MERGE_AT:
            self.merge()

    def merge(self) -> None:
        tag, lo, hi, pos, n = (np.concatenate(x) for x in zip(*self.parts, strict=True)) if self.parts else (np.zeros(0, np.uint64), *[np.zeros(0, np.int64)] * 2, np.zeros(0, np.uint32), np.zeros(0, np.int64))
        order = np.argsort(tag, kind="stable")
        tag, lo, hi, pos, n = tag[order], lo[order], hi[order], pos[order], n[order]
        s = np.flatnonzero(np.r_[True, tag[1:] != tag[:-1]]) if len(tag) else np.zeros(0, np.int64)
        if len(s):
            lo, hi, n = np.minimum.reduceat(lo, s), np.maximum.reduceat(hi, s), np.add.reduceat(n, s)
        self.tag, self.lo, self.hi, self.pos, self.n = tag[s], lo, hi, pos[s], n
        self.parts, self.held = [(self.tag, lo, hi, self.pos, n)], 0

    def ready(self) -> None:
        self.merge()
        self.always = self.n > 1  # in several documents, or at several places of one
        self.shared = np.zeros(len(self.tag), bool)

    def probe(self, tag: np.ndarray, doc: np.ndarray, pos: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(self.tag):
            return doc[:0], pos[:0]
        k = np.minimum(np.searchsorted(self.tag, tag), len(self.tag) - 1)
        m = np.flatnonzero(self.tag[k] == tag)
        k, doc, pos = k[m], doc[m], pos[m]
        hit = self.always[k] | (doc != self.lo[k])
        self.shared[k[hit]] = True
        return doc[hit], pos[hit]

    def smallest(self, tag: np.ndarray) -> np.ndarray:
        """The smallest document of each tag, which all are in the index."""
        return self.lo[np.searchsorted(self.tag, tag)]

    def owners(self) -> tuple[np.ndarray, np.ndarray]:
        own = self.shared & ~self.always
        return self.lo[own], self.pos[own]


def _bucketwise(batches, tag_type: type, probe, settled, finish):
    """Feeds each bucket's kind 0 to an index and then its kind 1 to ``probe``; at its end ``finish``. Kind 2 goes to ``settled``."""
    at, index, probing = None, _Index(), False
    for batch in batches:
        for bucket, kind, docs, windows, data in zip(*(batch.column(c).to_pylist() for c in ("bucket", "kind", "docs", "windows", "data")), strict=True):
            if bucket != at:
                if probing:
                    yield from finish(index)
                at, index, probing = bucket, _Index(), False
            ids, versions, n, tag, pos = tk.unpack(data, (np.int64, docs), (np.int64, docs), (np.uint32, docs), (np.uint32 if kind == 2 else tag_type, windows), (np.uint32, windows))
            if kind == 2:
                yield settled(np.repeat(ids, n), np.repeat(versions, n), pos, tag)
                continue
            if kind == 0:
                index.add(tag, np.repeat(ids, n), pos)
                continue
            if not probing:
                index.ready()
                probing = True
            yield from probe(index, tag, ids, versions, n, pos)
    if probing:
        yield from finish(index)


def _match_anchors(batches):
    def places(doc, pos, length):
        return pa.RecordBatch.from_arrays([pa.array(doc.astype(np.int64)), pa.array(pos.astype(np.int32)), pa.array(length.astype(np.int32))], names=["doc_id", "pos", "length"])

    def rows(doc, pos):
        if len(doc):
            yield places(doc, pos, np.ones(len(doc)))

    return _bucketwise(batches, np.uint32, lambda index, tag, ids, versions, n, pos: rows(*index.probe(tag, np.repeat(ids, n), pos)), lambda doc, versions, pos, length: places(doc, pos, length), lambda index: rows(*index.owners()))


def _mark_repeats(batches):
    def marks(doc, version, pos, length):
        return pa.RecordBatch.from_arrays([pa.array(doc), pa.array(version), pa.array(pos.astype(np.int32)), pa.array(length.astype(np.int32))], names=["doc_id", "version", "pos", "length"])

    def rows(index, tag, ids, versions, n, pos):
        doc, version = np.repeat(ids, n), np.repeat(versions, n)
        bad = index.smallest(tag) < doc
        if bad.any():
            yield marks(doc[bad], version[bad], pos[bad], np.ones(int(bad.sum())))

    return _bucketwise(batches, np.uint64, rows, marks, lambda index: ())


def _to_buckets(dealt: DataFrame, parts: int) -> DataFrame:
    """Rows of _DEALT by bucket, several buckets a partition one after another; a task holds one bucket's index at a time."""
    return dealt.repartitionById(parts, F.col("bucket") % parts).sortWithinPartitions("bucket", "kind")


def anchor_hits(moved: DataFrame, words: int, parts: int, buckets: int) -> DataFrame:
    """(doc_id, pos, length): runs of starts of windows of words // 2 words that equal an aligned block or occur twice nearby; they are candidates only."""
    block = words // 2

    def run(batches):
        for batch in _pieces(batches):
            yield _deal_anchors(*tk.buffers(_texts(batch)), np.asarray(batch.column("doc_id")), block, buckets)

    return _to_buckets(moved.select("doc_id", "z").mapInArrow(run, _DEALT), parts).mapInArrow(_match_anchors, "doc_id long, pos int, length int")


def _digests(words: bytes) -> tuple[int, int]:
    """Two 64-bit hashes of a row's words, as signed numbers."""
    d = xxhash.xxh3_128_digest(words)
    return int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)


def _whole(text: pa.Array) -> pa.Array:
    words = [b" ".join((t or "").encode().split()) for t in text.to_pylist()]
    w = [(*_digests(b), len(b)) for b in words]
    return pa.StructArray.from_arrays([pa.array([x[k] for x in w], pa.int64()) for k in range(3)], names=["version", "check", "size"])


def _squeezed(text: pa.Array) -> pa.Array:
    """The words of each row, joined by one space and compressed, and their first hash."""
    codec = pa.Codec("zstd", compression_level=1)
    z, version = [], []
    for t in text.to_pylist():
        b = b" ".join((t or "").encode().split())
        z.append(len(b).to_bytes(8, "little") + codec.compress(b, asbytes=True))
        version.append(_digests(b)[0])
    return pa.StructArray.from_arrays([pa.array(z, pa.binary()), pa.array(version, pa.int64())], names=["z", "version"])


def _text(data: bytes | None) -> str:
    return "" if data is None else pa.Codec("zstd").decompress(data[8:], int.from_bytes(data[:8], "little"), asbytes=True).decode()


def _pieces(batches):
    """Rows, as many as have about _GROUP_BYTES of text."""
    for batch in batches:
        sizes = np.array([int.from_bytes(z[:8], "little") for z in batch.column("z").to_pylist()], np.int64)
        part = (np.cumsum(sizes) - sizes) // _GROUP_BYTES
        edges = np.flatnonzero(np.r_[True, part[1:] != part[:-1], True]) if len(part) else np.zeros(0, np.int64)
        for s, e in zip(edges[:-1], edges[1:], strict=True):
            yield batch.slice(s, e - s)


def _texts(batch: pa.RecordBatch) -> pa.Array:
    return pa.array([_text(z) for z in batch.column("z").to_pylist()], pa.large_string())


def _covered(runs: list[dict], before: int, length: int, n: int) -> np.ndarray:
    """Which of ``n`` places lie from ``before`` places before a run's start to ``length`` places from its last one on."""
    pos = np.array([x["pos"] for x in runs], np.int64)
    last = pos + np.array([x["length"] for x in runs], np.int64) - 1
    marks = np.zeros(n + 1, np.int64)
    np.add.at(marks, np.clip(pos - before, 0, n), 1)
    np.add.at(marks, np.clip(last + length, 0, n), -1)
    return np.cumsum(marks[:-1]) > 0


def _deal_windows(words: int, buckets: int):
    """The windows of ``words`` words that hold a hit, with 64 bits beside the bucket, which comes from another hash; ones that a smaller document here has are marked at once."""
    block = words // 2

    def run(batches):
        for batch in _pieces(batches):
            places = batch.column("places").to_pylist()
            data, off = tk.buffers(_texts(batch))
            start, end, first = tk.spans(data, off, ~tk.BLANK)
            h1, h2 = (tk.span_hashes(data, start, end, b) for b in tk.BASES)
            k1, k2 = tk.rolling(h1, words), tk.rolling(h2, words, tk.BASES[0])
            rows, at = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for i, hits in enumerate(places):
                n = int(first[i + 1] - first[i]) - words + 1
                if n > 0:
                    s = np.flatnonzero(_covered(hits, words - block, 1, n))
                    at.append(first[i] + s)
                    rows.append(np.full(len(s), i))
            row, k = np.concatenate(rows), np.concatenate(at)
            pos, ids, versions = k - first[row], np.asarray(batch.column("doc_id")), np.asarray(batch.column("version"))
            a, b = k1[k], k2[k]
            order = np.lexsort((ids[row], b, a))
            new = np.r_[True, (a[order[1:]] != a[order[:-1]]) | (b[order[1:]] != b[order[:-1]])] if len(order) else np.zeros(0, bool)
            least = ids[row[order[new]]][np.cumsum(new) - 1] if len(order) else ids[:0]
            lost = ids[row[order]] > least
            bucket = (b % np.uint64(buckets)).astype(np.uint32)
            out: dict[str, list] = {c: [] for c in ("bucket", "kind", "docs", "windows", "data")}
            for kind, keep in ((0, np.sort(order[new])), (1, np.sort(order[~lost]))):
                _rows(kind, bucket[keep], a[keep], row[keep], pos[keep].astype(np.uint32), ids, versions, out)
            _settled(row[order[lost]], pos[order[lost]], ids, versions, buckets, out)
            yield _batch(out)

    return run


def _removed(words: int):
    def run(z: pa.Array, version: pa.Array, marks: pa.Array, copies: pa.Array) -> pa.Array:
        total, gone, kept = [], [], []
        for data, v, m, c in zip(z.to_pylist(), version.to_pylist(), marks.to_pylist(), copies.to_pylist(), strict=True):
            text = _text(data)
            n = text.count(" ") + 1 if text else 0
            own = next((x["runs"] for x in m or () if x["version"] == v), None)
            left = n
            if c and v in c and n >= words:
                text, left = "", 0
            elif own:
                lost = _covered(own, 0, words, n)
                w = [x for x, bad in zip(text.split(" "), lost.tolist(), strict=True) if not bad]
                text, left = " ".join(w), len(w)
            total.append(n)
            gone.append(n - left)
            kept.append(text)
        return pa.StructArray.from_arrays([pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.string())], names=["n_words", "n_removed", "text"])

    return F.arrow_udf(run, "struct<n_words:bigint,n_removed:bigint,text:string>")


def remove_repeats(docs: DataFrame, words: int = WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_removed, text): each row's text without the passages that a smaller id has.

    Words are maximal runs of other bytes than 0x20 and 0x09-0x0D. A word goes if a
    window of ``words`` words that covers it also starts in a row of a smaller id;
    windows are judged on the input. The words that stay are joined by one space.
    Null and empty texts have no words. Rows of a null id neither lose words nor
    make others lose any. Repeated rows are judged against other ids only, each by
    its own text. A text of any length is cut where it is read, and put together again
    in one task. An empty table gives an empty table.
    """
    if words < 2:
        raise ValueError("words must be 2 or more")
    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    wholes = written(rows.where("doc_id is not null").select("doc_id", F.arrow_udf(_whole, "struct<version:bigint,check:bigint,size:bigint>")("text").alias("h")).select("doc_id", "h.version", "h.check", "h.size"))
    total = wholes.agg(F.count("*").alias("rows"), F.coalesce(F.sum("size"), F.lit(0)).alias("size")).first()
    parts = max(shuffle_partitions(docs.sparkSession), -(-total["size"] // PARTITION_BYTES))
    blocks, spans = (parts * max(1, -(-total["size"] // (size * parts))) for size in (BLOCK_BUCKET_BYTES, WINDOW_BUCKET_BYTES))
    firsts = wholes.groupBy("version", "check").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"), F.count("*").alias("n")).where("first < last").select("version", "check", "first", "n")
    copies = join_hot(wholes.drop("size"), firsts, ["version", "check"], total["rows"]).where("doc_id > first").groupBy(F.col("doc_id").alias("copy_id")).agg(F.collect_set("version").alias("copies"))
    moved = rows.select("doc_id", F.arrow_udf(_squeezed, "struct<z:binary,version:bigint>")("text").alias("s")).select("doc_id", "s.version", "s.z").repartition("doc_id")
    kept = moved.where("doc_id is not null").join(copies, moved["doc_id"] == copies["copy_id"], "left").where(~F.coalesce(F.array_contains("copies", F.col("version")), F.lit(False))).select("doc_id", "version", "z")
    run = F.struct("pos", "length")
    places = anchor_hits(kept, words, parts, blocks).groupBy(F.col("doc_id").alias("id")).agg(F.collect_set(run).alias("places"))
    near = kept.join(places, kept["doc_id"] == places["id"]).select("doc_id", "version", "z", "places")
    windows = _to_buckets(near.mapInArrow(_deal_windows(words, spans), _DEALT), parts)
    marked = windows.mapInArrow(_mark_repeats, "doc_id long, version long, pos int, length int")
    by_row = marked.groupBy("doc_id", "version").agg(F.collect_set(run).alias("runs")).groupBy(F.col("doc_id").alias("marked_id")).agg(F.collect_list(F.struct("version", "runs")).alias("marks"))
    out = moved.join(by_row, moved["doc_id"] == by_row["marked_id"], "left").join(copies, moved["doc_id"] == copies["copy_id"], "left").select("doc_id", _removed(words)("z", "version", "marks", "copies").alias("r"))
    return out.select("doc_id", "r.n_words", "r.n_removed", "r.text")
