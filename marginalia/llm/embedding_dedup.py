"""Embedding near-dedup by an epsilon grid order join.

Unit vectors of cosine c lie sqrt(2 - 2c) apart, so a cosine bound is a distance
bound epsilon. Vectors are projected to their leading principal axes, sorted by
grid cells of width epsilon on them, and cut into blocks of consecutive vectors, of
BLOCK_BYTES each. Pairs of blocks whose boxes are over epsilon apart are skipped;
others are joined in one task each, by recursion over halves of the two sequences
with the same test, down to small intervals that are compared exactly in double
precision. A block meets itself where it was written; only pairs of different blocks
are shuffled. Equal vectors are one class with a count; tasks give out each class's
number of links and a spanning forest, never the pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, discard, join_hot, shuffle_partitions, written
from .components import connected

MIN_COSINE, AXES, BLOCK_BYTES, LEAF, AXES_SAMPLE = 0.98, 16, 4 << 20, 128, 4096
#: Above the rounding of distances, so that pruning never loses a link.
SLACK = 1e-9


def unit(rows: np.ndarray) -> np.ndarray:
    """Rows of length one in double precision, without overflow or underflow."""
    x = rows.astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def principal_axes(classes: DataFrame, axes: int = AXES, sample: int = AXES_SAMPLE) -> dict[int, np.ndarray]:
    """For each vector length in a bounded sample, its leading principal axes.

    Any orthonormal axes give right results: the sample only decides how much is skipped.
    """
    got = classes.orderBy(F.xxhash64("label", "embedding")).limit(sample).select("embedding").toArrow().column(0).to_pylist()
    by: dict[int, list] = {}
    for v in got:
        by.setdefault(len(v), []).append(v)
    found = {}
    for n, rows in by.items():
        x = unit(np.array(rows))
        values, vectors = np.linalg.eigh(np.cov(x.T).reshape(n, n) if len(rows) > 1 else np.eye(n))
        found[n] = vectors[:, ::-1][:, :axes]
    return found


def _matrix(col: pa.Array, n: int) -> np.ndarray:
    return np.asarray(col.flatten()).reshape(-1, n)


def _project(rows: np.ndarray, axes: dict[int, np.ndarray], k: int) -> np.ndarray:
    n = rows.shape[1]
    out = unit(rows) @ axes.get(n, np.eye(n)[:, :k])
    return np.pad(out, ((0, 0), (0, k - out.shape[1])))


def near_intervals(p: np.ndarray, q: np.ndarray, eps: float, leaf: int, same: bool) -> Iterator[tuple[int, int, int, int]]:
    """Intervals i:j of p and k:m of q, of ``leaf`` rows at most, that may hold rows within eps: halves are joined unless their boxes are further apart.

    With ``same``, p and q are one sequence and each pair of intervals comes once.
    """
    boxes: dict[tuple[int, int, int], tuple[np.ndarray, np.ndarray]] = {}

    def box(side: int, s: int, e: int) -> tuple[np.ndarray, np.ndarray]:
        if (side, s, e) not in boxes:
            rows = (p, q)[side][s:e]
            boxes[side, s, e] = rows.min(0), rows.max(0)
        return boxes[side, s, e]

    halves = lambda s, e: [(s, e)] if e - s <= leaf else [(s, (s + e) // 2), ((s + e) // 2, e)]
    stack = [(0, len(p), 0, len(q))]
    while stack:
        i, j, k, m = stack.pop()
        if same and i > k:
            continue
        (lo, hi), (lo2, hi2) = box(0, i, j), box(0 if same else 1, k, m)
        gap = np.maximum(0, np.maximum(lo - hi2, lo2 - hi))
        if (gap * gap).sum() > eps * eps + SLACK:
            continue
        if max(j - i, m - k) <= leaf:
            yield i, j, k, m
        else:
            stack += [(*a, *b) for a in halves(i, j) for b in halves(k, m)]


class _Forest:
    """Edges that connect what the links given so far connect."""

    def __init__(self, n: int) -> None:
        self.part, self.a, self.b = np.arange(n), [], []

    def add(self, rows: np.ndarray, cols: np.ndarray) -> None:
        ca, cb = self.part[rows], self.part[cols]
        new = np.flatnonzero(ca != cb)
        if not len(new):
            return
        n = len(self.part)
        _, first = np.unique(ca[new] * n + cb[new], return_index=True)
        up: dict[int, int] = {}

        def root(x: int) -> int:
            while x in up:
                x = up[x]
            return x

        for k in new[first].tolist():
            x, y = root(int(ca[k])), root(int(cb[k]))
            if x != y:
                up[max(x, y)] = min(x, y)
                self.a.append(int(rows[k]))
                self.b.append(int(cols[k]))
        moved = np.arange(n)
        for x in up:
            moved[x] = root(x)
        self.part = moved[self.part]


def _block_links(x: dict, y: dict, basis: dict[int, np.ndarray], axes: int, eps: float, cosine: float, leaf: int) -> Iterator[pa.RecordBatch]:
    """The links between two blocks, or within one: numbers of linked vectors to add up for each class, and edges of a forest."""
    same = x["blk"] == y["blk"]
    sides = [x] if same else [x, y]
    raw = [np.frombuffer(s["vectors"], np.dtype(s["kind"])).reshape(-1, s["size"]) for s in sides]
    ids = np.concatenate([np.frombuffer(s["ids"], np.int64) for s in sides])
    counts = np.concatenate([np.frombuffer(s["counts"], np.int64) for s in sides])
    u, p = [unit(v) for v in raw], [_project(v, basis, axes) for v in raw]
    shift = 0 if same else len(u[0])
    total, forest = np.zeros(len(ids), np.int64), _Forest(len(ids))
    for i, j, k, m in near_intervals(p[0], p[-1], eps, leaf, same):
        hit = u[0][i:j] @ u[-1][k:m].T >= cosine
        if same and i == k:
            hit &= ~np.tri(j - i, dtype=bool)  # each pair once
        rows, cols = np.nonzero(hit)
        if len(rows):
            rows, cols = rows + i, cols + k + shift
            np.add.at(total, rows, counts[cols])
            np.add.at(total, cols, counts[rows])
            forest.add(rows, cols)
    some = total > 0
    yield pa.RecordBatch.from_arrays([pa.array(ids[some]), pa.array(total[some]), pa.nulls(int(some.sum()), pa.int64())], names=["cls", "n_links", "other"])
    if forest.a:
        yield pa.RecordBatch.from_arrays([pa.array(ids[forest.a]), pa.array(np.zeros(len(forest.a), np.int64)), pa.array(ids[forest.b])], names=["cls", "n_links", "other"])


def ordered_blocks(classes: DataFrame, basis: dict[int, np.ndarray], eps: float, axes: int = AXES, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Blocks of consecutive classes in grid order: ids, counts and vectors as bytes, and the box (lo, hi) on the axes."""
    spark = classes.sparkSession
    kind = "<f4" if dict(classes.dtypes)["embedding"] == "array<float>" else "<f8"
    element = "float" if kind == "<f4" else "double"

    def order_keys(batches):
        for batch in batches:
            size = np.asarray(batch.column("size"))
            p = np.zeros((len(size), axes))
            for n in np.unique(size):
                at = np.flatnonzero(size == n)
                p[at] = _project(_matrix(batch.column("embedding").take(pa.array(at)), n), basis, axes)
            p_col = pa.FixedSizeListArray.from_arrays(pa.array(p.ravel()), axes).cast(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("cls", "label", "size", "n", "embedding")), p_col], names=["cls", "label", "size", "n", "embedding", "p"])

    placed = classes.select("cls", "label", F.size("embedding").alias("size"), "n", F.col("embedding").cast(f"array<{element}>").alias("embedding")).mapInArrow(order_keys, f"cls long, label string, size int, n long, embedding array<{element}>, p array<double>")
    cells = [F.floor(F.col("p")[i] / max(eps, 1e-6)) for i in range(axes)]
    order = ["label", "size", *cells, "cls"]
    sequence = placed.repartitionByRange(shuffle_partitions(spark), *order).sortWithinPartitions(*order)

    def block(label: str, size: int, parts: list) -> pa.RecordBatch:
        ids, counts, x = (np.concatenate(c) for c in zip(*parts, strict=True))
        p = _project(x, basis, axes)
        return pa.RecordBatch.from_pydict({"blk": [int(ids[0])], "label": [label], "size": pa.array([size], pa.int32()), "kind": [kind], "lo": [p.min(0).tolist()], "hi": [p.max(0).tolist()], "ids": [ids.astype(np.int64).tobytes()], "counts": [counts.astype(np.int64).tobytes()], "vectors": [np.ascontiguousarray(x, kind).tobytes()]})

    def cut(batches):
        held, key, n = [], None, 0
        for batch in batches:
            label, size = batch.column("label").to_pylist(), np.asarray(batch.column("size"))
            ids, counts = np.asarray(batch.column("cls")), np.asarray(batch.column("n"))
            change = [0, *(i for i in range(1, len(label)) if label[i] != label[i - 1] or size[i] != size[i - 1]), len(label)]
            for s, e in zip(change, change[1:], strict=False):
                if s == e:
                    continue
                if key != (label[s], size[s]) and held:
                    yield block(*key, held)
                    held, n = [], 0
                key, most = (label[s], int(size[s])), max(1, block_bytes // (int(size[s]) * np.dtype(kind).itemsize))
                x = _matrix(batch.column("embedding").slice(s, e - s), size[s])
                while s < e:
                    take = min(e - s, most - n)
                    held.append((ids[s : s + take], counts[s : s + take], x[:take]))
                    s, x, n = s + take, x[take:], n + take
                    if n == most:
                        yield block(*key, held)
                        held, n = [], 0
        if held:
            yield block(*key, held)

    return sequence.mapInArrow(cut, "blk long, label string, size int, kind string, lo array<double>, hi array<double>, ids binary, counts binary, vectors binary")


def near_blocks(blocks: DataFrame, eps: float) -> DataFrame:
    """(x, y): pairs of different blocks, x below y, whose boxes are within eps: boxes meet by cells of width eps on the first axis."""
    boxes = blocks.select("blk", "label", "size", "lo", "hi")
    reach = lambda far: F.explode(F.sequence(F.floor((F.col("lo")[0] - far) / max(eps, 1e-6)), F.floor((F.col("hi")[0] + far) / max(eps, 1e-6))))
    left = boxes.select(F.col("blk").alias("x"), "label", "size", F.col("lo").alias("lo1"), F.col("hi").alias("hi1"), reach(0.0).alias("c"))
    right = boxes.select(F.col("blk").alias("y"), "label", "size", "lo", "hi", reach(eps + SLACK).alias("c"))
    gaps = F.zip_with(F.zip_with("lo1", "hi", lambda a, b: a - b), F.zip_with("lo", "hi1", lambda a, b: a - b), lambda a, b: F.greatest(F.lit(0.0), a, b))
    near = F.aggregate(gaps, F.lit(0.0), lambda s, g: s + g * g) <= eps * eps + SLACK
    return left.join(right, ["label", "size", "c"]).where(near & (F.col("x") != F.col("y"))).select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).distinct()


_LINKS = "cls long, n_links long, other long"


def embedding_links(classes: DataFrame, min_cosine: float = MIN_COSINE, axes: int = AXES, block_bytes: int = BLOCK_BYTES, leaf: int = LEAF) -> DataFrame:
    """(cls, n_links, other) from classes (cls, label, embedding, n): counts of linked vectors to sum, and forest edges cls-other."""
    bounded_batches(classes.sparkSession)
    eps = float(np.sqrt(max(0.0, 2 - 2 * min_cosine)))
    basis = principal_axes(classes, axes)
    blocks = written(ordered_blocks(classes, basis, eps, axes, block_bytes))
    pairs = near_blocks(blocks, eps)

    def within(batches):
        for batch in batches:
            for r in batch.to_pylist():
                yield from _block_links(r, r, basis, axes, eps, min_cosine, leaf)

    def between(batches):
        held = None
        for batch in batches:
            for r in batch.to_pylist():
                if held is None:
                    held = r
                    continue
                if (held["x"], held["y"]) != (r["x"], r["y"]) or held["blk"] == r["blk"]:
                    raise ValueError("blocks of a pair must come together, each once")
                yield from _block_links(held, r, basis, axes, eps, min_cosine, leaf)
                held = None

    data = ["blk", "size", "kind", "ids", "counts", "vectors"]
    sides = pairs.select("x", "y", F.explode(F.array("x", "y")).alias("blk"))
    met = blocks.select(*data).join(sides, "blk").repartition("x", "y").sortWithinPartitions("x", "y", "blk").select("x", "y", *data)
    return blocks.select(*data).mapInArrow(within, _LINKS).union(met.mapInArrow(between, _LINKS))


def embedding_components(vectors: DataFrame, min_cosine: float = MIN_COSINE, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(vec_id, n_links, component_id, kept): for each row the number of others it links to and the smallest id reachable.

    Rows of one label link at a cosine of ``min_cosine`` or more in double
    precision; equal vectors always do. Rows whose label, id or vector is null, and
    vectors that are empty, zero or hold null or non-finite components, link with
    nothing and are their own component (null where the id is null, and then not
    kept). Vectors of different lengths never link. Rows repeated with one id count
    as separate vectors, equal or not: classes of equal vectors have names of their own. Other columns are left out, so their names can't clash. An
    empty table gives an empty table. Rows find their class again by 128 bits of hash.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("string").alias("label"), F.col(vector_col).alias("embedding"))
    finite = F.forall("embedding", lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False))) & F.exists("embedding", lambda x: x != 0)
    able = F.coalesce(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & finite, F.lit(False))
    hashes = [F.xxhash64(F.lit(k), "label", "embedding").alias(f"h{k}") for k in (1, 2)]
    keyed = rows.where(able)
    classes = written(keyed.groupBy("label", "embedding").agg(F.min("vec_id").alias("id"), F.count("*").alias("n")).withColumn("cls", F.monotonically_increasing_id()))
    found = written(embedding_links(classes, min_cosine))
    sums = found.where("other is null").groupBy("cls").agg(F.sum("n_links").alias("linked"))
    parts = connected(found.where("other is not null").select(F.col("cls").alias("a"), F.col("other").alias("b")))
    named = classes.select(*hashes, "cls", "id", "n").join(sums, "cls", "left").join(parts, F.col("cls") == F.col("node"), "left")
    named = written(named.select("h1", "h2", "id", "n", (F.coalesce("linked", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "cls").alias("part")))
    least = named.groupBy("part").agg(F.min("id").alias("component_id"), F.count("*").alias("n"))
    named = join_hot(named.withColumnRenamed("n", "rows"), least, ["part"], named.count()).select("h1", "h2", "n_links", "component_id", F.col("rows").alias("n"))
    discard(found)
    total = classes.agg(F.sum("n")).first()[0] or 0
    linked = join_hot(keyed.select("vec_id", *hashes), written(named), ["h1", "h2"], total).select("vec_id", "n_links", "component_id")
    alone = rows.where(~able).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.union(alone).select("vec_id", "n_links", "component_id", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)).alias("kept"))
