"""SimHash near-dedup over a grid of segment bit counts.

A fingerprint's bits are cut into 32 segments of two; its embedding is the number
of set bits in each segment. The Manhattan distance of two embeddings never
exceeds the Hamming distance of the fingerprints, so it is a lower bound. The
segments are dealt into max_bits + a groups: if the Manhattan distance is at most
max_bits, at least a groups agree in every count, so each pair within that range
shares one of the grid cells that fix a groups. More groups make more cells of a
fingerprint and fewer strangers in each; a follows the number of fingerprints (see
``agreeing``), and no choice of it loses a link. Cells are joined; within them pairs over the range by Manhattan distance are left out, and the others are
verified on the fingerprints. Inside a cell only a spanning forest of the links is
given out. A cell of over BLOCK members first links all that are close to its
smallest member, its star; only the members outside the star then meet the others,
block by block, so that large groups of near copies cost no rows for their pairs.

Texts that share four fifths of their shingles have fingerprints about ten bits
apart, which no grid of 64 bits finds at scale. ``keep_one`` therefore takes
fingerprints as candidates only, beside sketches: minima of the same hashes under
MINIMA permutations, joined on bands of BAND_ROWS of them, and compared over all of
them. Whole sets of shingle hashes then decide within each component of candidates.
"""

from __future__ import annotations

from itertools import accumulate, combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, discard, join_hot, shuffle_partitions, written
from .components import connected

SHINGLE_WORDS, MAX_BITS, SEED, BLOCK = 4, 4, 42, 4096
#: Groups of segments that a cell fixes: at least and at most; and how many strangers can be compared in the time of one row in a cell.
LEAST_AGREE, MOST_AGREE, COMPARED = 4, 12, 32
#: Minima of a sketch, how many make a band, and the least share of common shingles. Two texts of similarity 0.8 share no band in 5 of 100,000 cases.
MINIMA, BAND_ROWS, SIMILARITY = 128, 5, 0.8
#: How far below the wanted share a sketch may be for its text to be a candidate: over four standard errors.
MARGIN = 0.15
#: Bits of the maps that pick candidates' texts and shared cells, as a power of two (8 MB at most, at any size), and bytes of shingle sets in a block.
MAP_BITS, BLOCK_BYTES = 26, 16 << 20
_LANES = np.uint64(0x0001000100010001)


def _majority(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The fingerprint of each row from its shingles' hashes: a bit is set if it is in over half of them."""
    out = np.zeros(len(counts), np.uint64)
    rows = np.flatnonzero(counts)
    if not len(rows):
        return out
    first = (np.cumsum(counts) - counts)[rows]
    pieces = -(-counts[rows] // 0xFFFF)  # the sums below have lanes of 16 bits
    owner = np.repeat(np.arange(len(rows)), pieces)
    start = np.repeat(first, pieces) + 0xFFFF * (np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces))
    for shift in range(16):
        lanes = np.add.reduceat((hashes >> np.uint64(shift)) & _LANES, start)
        for lane in range(4):
            n = np.bincount(owner, (lanes >> np.uint64(16 * lane)) & np.uint64(0xFFFF), len(rows))
            out[rows] |= (2 * n > counts[rows]).astype(np.uint64) << np.uint64(shift + 16 * lane)
    return out


def _shingled(col: pa.Array, words: int):
    """Hashes of the shingles of some rows in a row, and how many each row has; pieces of about 300,000 hashes."""
    digest, hashes, counts = xxhash.xxh64_intdigest, [], []
    for t in col.to_pylist():
        w = (t or "").encode().lower().split()
        if len(w) <= words:
            got = [digest(b" ".join(w), SEED)] if w else []
        else:
            joined = b" ".join(w)
            ends = list(accumulate(map(len, w), lambda a, n: a + n + 1))
            got = [digest(joined[s:e], SEED) for s, e in zip([0, *(x + 1 for x in ends)], ends[words - 1 :], strict=False)]
        hashes += got
        counts.append(len(got))
        if len(hashes) > 300_000:
            yield np.array(hashes, np.uint64), np.array(counts, np.int64)
            hashes, counts = [], []
    yield np.array(hashes, np.uint64), np.array(counts, np.int64)


def fingerprint(text: Column, words: int = SHINGLE_WORDS) -> Column:
    """64-bit SimHash of a text's shingles as a long; a text without words has fingerprint zero."""

    @F.arrow_udf("bigint")
    def run(col: pa.Array) -> pa.Array:
        return pa.array(np.concatenate([_majority(h, n) for h, n in _shingled(col, words)]).view(np.int64))

    return run(text)


def _minima(hashes: np.ndarray, counts: np.ndarray) -> list[bytes | None]:
    """The sketch of each row: 16 bits of the least hash under each permutation; None without shingles."""
    rows = np.flatnonzero(counts)
    out: list[bytes | None] = [None] * len(counts)
    if len(rows):
        first = (np.cumsum(counts) - counts)[rows]
        odd = np.random.default_rng(SEED).integers(1 << 62, 1 << 63, MINIMA).astype(np.uint64) | np.uint64(1)
        least = np.column_stack([np.minimum.reduceat(hashes * f, first) for f in odd]).astype(np.uint16)
        for i, sketch in zip(rows.tolist(), least, strict=True):
            out[i] = sketch.tobytes()
    return out


def _sets(hashes: np.ndarray, counts: np.ndarray) -> list[bytes]:
    """The different shingle hashes of each row, in order."""
    ends = np.cumsum(counts)
    return [np.unique(hashes[e - n : e]).tobytes() for e, n in zip(ends, counts, strict=True)]


def fingerprint_and_sketch(text: Column, words: int) -> Column:
    """Struct of a text's ``fingerprint``, its sketch (null without words) and a digest of its set of shingles, from the same hashes."""

    @F.arrow_udf("struct<fp:bigint,sketch:binary,digest:binary>")
    def run(col: pa.Array) -> pa.Array:
        fps, sketches, digests = [], [], []
        for h, n in _shingled(col, words):
            fps.append(_majority(h, n))
            sketches += _minima(h, n)
            digests += map(xxhash.xxh3_128_digest, _sets(h, n))
        return pa.StructArray.from_arrays([pa.array(np.concatenate(fps).view(np.int64)), pa.array(sketches, pa.binary()), pa.array(digests, pa.binary())], names=["fp", "sketch", "digest"])

    return run(text)


def shingle_set(text: Column, words: int) -> Column:
    """Struct of a text's set of shingle hashes and the set's digest."""

    @F.arrow_udf("struct<shingles:binary,digest:binary>")
    def run(col: pa.Array) -> pa.Array:
        sets = [x for h, n in _shingled(col, words) for x in _sets(h, n)]
        return pa.StructArray.from_arrays([pa.array(sets, pa.binary()), pa.array(map(xxhash.xxh3_128_digest, sets), pa.binary())], names=["shingles", "digest"])

    return run(text)


def agreeing(count: int, max_bits: int = MAX_BITS) -> int:
    """How many groups a cell of the grid fixes, for ``count`` fingerprints: the choice of least work.

    A choice of a groups out of max_bits + a makes a row for each combination, and each
    row meets ``count`` / 2 ** bits strangers, as each segment fixed holds 1.5 bits. With
    four bits, cells of four groups do up to about 500 million fingerprints.
    """

    def work(a: int) -> float:
        return comb(max_bits + a, a) * (1 + count / 2 ** (1.5 * 32 * a / (max_bits + a)) / COMPARED)

    return min(range(LEAST_AGREE, MOST_AGREE + 1), key=work)


def _cell_masks(max_bits: int, agree: int) -> list[int]:
    """Over embeddings packed in two bits a segment: a mask for each choice of ``agree`` groups of segments."""
    groups = [sum(3 << (2 * s) for s in part.tolist()) for part in np.array_split(np.arange(32), max_bits + agree)]
    return [sum(chosen) for chosen in combinations(groups, agree)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _forest(rows: np.ndarray, near) -> list[tuple[int, int]]:
    """Edges that connect what the links among ``rows`` connect, one fewer than a component has members."""
    left, out = rows, []
    while len(left):
        queue, left = [int(left[0])], left[1:]
        while queue and len(left):
            at = queue.pop()
            hit = near(at, left)
            if hit.any():
                found, left = left[hit].tolist(), left[~hit]
                out += [(at, x) for x in found]
                queue += found
    return out


def _close_bits(max_bits: int):
    """Links of fingerprints, given as numbers of places in an array of them: the Manhattan distance of the embeddings leaves out most pairs."""
    odd = np.uint64(0x5555555555555555)

    def measure(fp: np.ndarray):
        fp = fp.view(np.uint64)
        low, high = fp & odd, fp >> np.uint64(1) & odd
        counts = low | high | (low & high) << np.uint64(1)  # 0, 1, 2 as 00, 01, 11: differing bits are the distance of two counts

        def near(i, j):
            hit = np.bitwise_count(counts[i] ^ counts[j]) <= max_bits
            some = np.flatnonzero(hit)
            i, j = np.broadcast_arrays(i, j)
            hit[some] = np.bitwise_count(fp[i[some]] ^ fp[j[some]]) <= max_bits
            return hit

        return near

    return measure


def _alike(similarity: float):
    """Links of sketches by the share of minima that are equal."""

    def measure(sketch: np.ndarray):
        minima = np.frombuffer(b"".join(sketch.tolist()), np.uint16).reshape(-1, MINIMA)
        return lambda i, j: (minima[i] == minima[j]).sum(-1) >= similarity * MINIMA

    return measure


def _share(similarity: float, margin: float):
    """Links of sketches followed by whole shingle sets, by the exact share of common shingles; sketches only leave out what is far below it."""
    width = 2 * MINIMA

    def measure(values: np.ndarray):
        minima = np.frombuffer(b"".join(v[:width] for v in values), np.uint16).reshape(-1, MINIMA)
        sets = [np.frombuffer(v, np.uint64, offset=width) for v in values]

        def near(i, j):
            hit = (minima[i] == minima[j]).sum(-1) >= (similarity - margin) * MINIMA
            i, j = np.broadcast_arrays(i, j)
            for k in np.flatnonzero(hit):
                a, b = sets[i[k]], sets[j[k]]
                both = np.intersect1d(a, b, assume_unique=True).size
                hit[k] = both / (len(a) + len(b) - both) >= similarity
            return hit

        return near

    return measure


def _linker(keys: list[str], node: str, value: str, measure):
    """Forests of the links within each run of equal keys."""
    small = 8

    def edges(group: np.ndarray, nodes: np.ndarray, values: np.ndarray) -> pa.RecordBatch:
        start = np.flatnonzero(np.r_[True, group[1:] != group[:-1]]) if len(group) else np.zeros(0, np.int64)
        size = np.diff(np.r_[start, len(group)])
        near = measure(values)
        a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for lag in range(1, small):
            i = np.flatnonzero((group[lag:] == group[:-lag]) & (np.repeat(size, size)[lag:] <= small))
            i = i[near(i, i + lag)]
            a.append(i)
            b.append(i + lag)
        for s, n in zip(start[size > small], size[size > small], strict=True):
            if pairs := _forest(np.arange(s, s + n), near):
                x, y = np.array(pairs, np.int64).T
                a.append(x)
                b.append(y)
        return pa.RecordBatch.from_arrays([pa.array(nodes[np.concatenate(x)]) for x in (a, b)], names=["a", "b"])

    def run(batches):
        held = None
        for batch in batches:
            cols = [batch.column(k).to_numpy(zero_copy_only=False) for k in (*keys, node, value)]
            cols = cols if held is None else [np.concatenate(x) for x in zip(held, cols, strict=True)]
            if not len(cols[0]):
                continue
            change = np.r_[True, np.logical_or.reduce([k[1:] != k[:-1] for k in cols[: len(keys)]])]
            last = np.flatnonzero(change)[-1]
            held = [c[last:] for c in cols]
            if last:
                yield edges(np.cumsum(change)[:last], cols[-2][:last], cols[-1][:last])
        if held is not None:
            yield edges(np.zeros(len(held[0]), np.int64), held[-2], held[-1])

    return run


def _group_links(rows: DataFrame, keys: list[str], node: str, value: str, measure, block: int, size: Column | None = None, pruned=None) -> DataFrame:
    """(a, b): edges that connect what all links among the ``rows`` of each key would; ``size`` gives a row's bytes.

    ``pruned`` may give rows of the keys in a table, and a few others, more cheaply than a join.

    Keys of one block are linked in one task each. For a larger key each row is first
    compared with the key's smallest node: those that it links are its star. Rows of
    the star meet the blocks of the rest only, and those meet all blocks.
    """
    links = _linker([*keys, "i", "j"], node, value, measure)
    deal = [*keys, "i", "j"]
    linked = lambda live: live.select(*deal, node, value).repartition(*deal).sortWithinPartitions(*deal).mapInArrow(links, "a long, b long")
    parts = F.greatest(F.ceil(F.col("n") / block), F.ceil(F.col("bytes") / BLOCK_BYTES)).cast("int")
    shared = written(rows.groupBy(*keys).agg(F.count("*").alias("n"), F.sum(F.lit(0) if size is None else size).alias("bytes"), F.min(node).alias("first")).where("n > 1").withColumn("parts", parts))
    rows = pruned(shared) if pruned else rows
    out = linked(rows.join(shared.where("parts = 1").select(*keys), keys).withColumns({"i": F.lit(0), "j": F.lit(0)}))
    large = shared.where("parts > 1").drop("bytes")
    total = large.agg(F.sum("n")).first()[0]
    if not total:
        return out.where("a <> b").distinct()

    @F.arrow_udf("boolean")
    def near(x: pa.Array, y: pa.Array) -> pa.Array:
        both = np.concatenate([c.to_numpy(zero_copy_only=False) for c in (x, y)])
        at = np.arange(len(x))
        return pa.array(measure(both)(at, at + len(x)))

    mine = join_hot(rows, large, keys, total).withColumn("own", F.pmod(F.xxhash64(node), F.col("parts")).cast("int"))
    centres = mine.where(F.col(node) == F.col("first")).select(*keys, F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("own"), F.col(value).alias("centre"))
    tagged = written(mine.join(centres, [*keys, "own"]).withColumn("star", near(F.col(value), F.col("centre"))).drop("centre"))
    left = tagged.groupBy(*keys).agg(F.sum((~F.col("star")).cast("long")).alias("r"), F.sum(F.when(~F.col("star"), F.lit(0) if size is None else size)).alias("rb"))
    left = left.withColumn("rest", F.greatest(F.ceil(F.col("r") / block), F.ceil(F.col("rb") / BLOCK_BYTES)).cast("int")).where("r > 0").select(*keys, "rest", F.lit(total).alias("n"))
    own = F.when(F.col("star"), F.col("own")).otherwise(F.col("parts") + F.pmod(F.xxhash64(node), F.col("rest")).cast("int"))
    met = F.when(F.col("star"), F.sequence(F.col("parts"), F.col("parts") + F.col("rest") - 1)).otherwise(F.sequence(F.lit(0), F.col("parts") + F.col("rest") - 1))
    pairs = join_hot(tagged, left, keys, total * 2).withColumn("own", own).withColumn("k", F.explode(met)).withColumns({"i": F.least("own", "k"), "j": F.greatest("own", "k")})
    stars = tagged.where("star").select(F.col("first").alias("a"), F.col(node).alias("b"))
    return out.union(linked(pairs)).union(stars).where("a <> b").distinct()


def _spread(rows: DataFrame, member: str) -> DataFrame:
    """``rows`` over all partitions, as they are few bytes but make many rows; by a hash, since Spark leaves out a repartition by columns that it has grouped by."""
    return rows.repartition(shuffle_partitions(rows.sparkSession), F.xxhash64(member))


def fingerprint_links(fps: DataFrame, max_bits: int = MAX_BITS, block: int = BLOCK, agree: int | None = None) -> DataFrame:
    """(a, b): links between the fingerprints in ``fps`` (columns rep, fp, all different), by rep, that connect what all links would; ``agree`` overrides ``agreeing``."""
    bounded_batches(fps.sparkSession)
    odd = F.lit(0x5555555555555555)
    low, high = F.col("fp").bitwiseAND(odd), F.shiftrightunsigned(F.col("fp"), 1).bitwiseAND(odd)
    packed = low.bitwiseOR(high).bitwiseOR(F.shiftleft(low.bitwiseAND(high), 1))  # the counts of each two bits, as 00, 01, 11
    own = [F.col("packed").bitwiseAND(F.lit(_signed(m))) for m in _cell_masks(max_bits, agree or agreeing(fps.count(), max_bits))]
    spread = _spread(fps.select("rep", "fp"), "rep").withColumn("packed", packed)
    as_rows = lambda df, keep: df.select("rep", "fp", F.explode(keep(F.array(*[F.struct(F.lit(c).alias("combo"), x.alias("cell")) for c, x in enumerate(own)]))).alias("k")).select("k.combo", "k.cell", "rep", "fp")

    def pruned(shared: DataFrame) -> DataFrame:
        """Rows whose cell is in ``shared``, by a map of bits: cells of one fingerprint aren't shuffled again. All rows where the map would be over half full and leave out little."""
        if shared.count() > 1 << (MAP_BITS - 1):
            return as_rows(spread, lambda k: k)
        bits = fps.sparkSession.sparkContext.broadcast(_bit_map(shared.select(_slot("combo", "cell").alias("s"))))

        n = len(own)

        @F.arrow_udf("array<boolean>")
        def hit(slots: pa.Array) -> pa.Array:
            at = slots.flatten().to_numpy(zero_copy_only=False)
            return pa.ListArray.from_arrays(pa.array(np.arange(len(slots) + 1, dtype=np.int32) * n), pa.array((bits.value[at >> 6] >> (at & 63) & 1).astype(bool)))

        live = spread.withColumn("hit", hit(F.array(*[_slot(F.lit(c), x) for c, x in enumerate(own)])))
        return as_rows(live.where(F.array_contains("hit", True)), lambda k: F.transform(F.filter(F.arrays_zip(k.alias("k"), F.col("hit").alias("hit")), lambda x: x["hit"]), lambda x: x["k"]))

    return _group_links(as_rows(spread, lambda k: k), ["combo", "cell"], "rep", "fp", _close_bits(max_bits), block, None, pruned)


def sketch_links(sketches: DataFrame, similarity: float = SIMILARITY, block: int = BLOCK) -> DataFrame:
    """(a, b): links between the different sketches in ``sketches`` (columns rep, sketch), named by rep, that connect what all links would.

    Sketches link if they share a band and ``similarity`` of their minima, which
    estimates the share of common shingles; its standard error is 0.035 at 0.8.
    """
    bounded_batches(sketches.sparkSession)
    band = lambda b: F.xxhash64(b, F.substring("sketch", b * (2 * BAND_ROWS) + 1, F.lit(2 * BAND_ROWS)))
    rows = _spread(sketches, "rep").select("rep", F.explode(F.transform(F.sequence(F.lit(0), F.lit(MINIMA // BAND_ROWS - 1)), band)).alias("band"))
    shared = rows.groupBy("band").agg(F.count("*").alias("n")).where("n > 1").select("band")
    return _group_links(written(rows.join(shared, "band").join(sketches, "rep")), ["band"], "rep", "sketch", _alike(similarity), block)


def simhash_components(docs: DataFrame, words: int = SHINGLE_WORDS, max_bits: int = MAX_BITS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp, component_id): each row's fingerprint and the smallest id reachable by links.

    Fingerprints link at ``max_bits`` or fewer differing bits. Null and empty texts
    have fingerprint zero, which links like any other. Rows of a null id get no
    component and link nothing. Repeated rows share their fingerprint and so their
    component. Texts of any length are taken whole. Other columns are left out, so
    their names can't clash; an empty table gives an empty table.
    """
    bounded_batches(docs.sparkSession)
    fps = written(docs.select(F.col(id_col).cast("long").alias("doc_id"), fingerprint(F.col(text_col).cast("string"), words).alias("fp")))
    classes = _classes(fps)
    named = classes.join(connected(fingerprint_links(classes, max_bits)), F.col("rep") == F.col("node"), "left").select("fp", "n", F.coalesce("component", "rep").alias("component_id"))
    return _named(fps, named, "fp")


def _classes(fps: DataFrame) -> DataFrame:
    return written(fps.where("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n")))


def _named(fps: DataFrame, classes: DataFrame, key: str) -> DataFrame:
    """(doc_id, fp, component_id) of all rows, from the component of each class; null for null ids."""
    rows = fps.select("doc_id", *dict.fromkeys(["fp", key]))
    own = join_hot(rows.where("doc_id is not null"), written(classes), [key], rows.count()).select("doc_id", "fp", "component_id")
    return own.union(rows.where("doc_id is null").select("doc_id", "fp", F.lit(None).cast("long").alias("component_id")))


def _slot(*keys) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(1 << MAP_BITS))


def _bit_map(slots: DataFrame) -> np.ndarray:
    """A map of 2 ** MAP_BITS bits, of which those in column s are set: 8 MB at most, at any size."""
    words = slots.groupBy(F.shiftright("s", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(s & 63 as int))")).alias("bits")).toArrow()
    bits = np.zeros(1 << (MAP_BITS - 6), np.int64)
    bits[words.column("w").to_numpy()] = words.column("bits").to_numpy()
    return bits


def _only(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of ``docs`` (doc_id) with an id in ``ids`` (node), and few others: by a map of bits, so texts aren't shuffled."""
    shared = docs.sparkSession.sparkContext.broadcast(_bit_map(ids.select(_slot("node").alias("s"))))

    @F.arrow_udf("boolean")
    def hit(s: pa.Array) -> pa.Array:
        at = s.to_numpy(zero_copy_only=False)
        return pa.array((shared.value[at >> 6] >> (at & 63) & 1).astype(bool))

    return docs.where(hit(_slot("doc_id")))


def set_links(sets: DataFrame, similarity: float = SIMILARITY, margin: float = MARGIN, block: int = BLOCK) -> DataFrame:
    """(a, b): links within the groups of ``sets`` (columns component, rep, sketch, shingles), by rep, that connect what all links would.

    Sets link if they share ``similarity`` of their union, counted exactly; pairs
    whose sketches are ``margin`` below it aren't counted.
    """
    bounded_batches(sets.sparkSession)
    rows = sets.select("component", "rep", F.concat("sketch", "shingles").alias("value"))
    return _group_links(rows, ["component"], "rep", "value", _share(similarity, margin), block, F.octet_length("value").cast("long"))


def near_copy_components(docs: DataFrame, words: int = SHINGLE_WORDS, max_bits: int = MAX_BITS, similarity: float = SIMILARITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp, component_id) as ``simhash_components``, but linked by the exact share of common shingles, ``similarity`` or more.

    Fingerprints and sketches only give candidates: sketches MARGIN below
    ``similarity``, and fingerprints at most ``max_bits`` apart. Texts without words
    are copies of each other and link to nothing else.
    """
    bounded_batches(docs.sparkSession)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    fps = written(texts.select("doc_id", fingerprint_and_sketch(F.col("text"), words).alias("x")).select("doc_id", "x.fp", "x.sketch", "x.digest"))
    classes = written(fps.where("doc_id is not null").groupBy("digest", "sketch").agg(F.min("doc_id").alias("rep"), F.min("fp").alias("fp"), F.count("*").alias("n")))
    solid = classes.where("sketch is not null")
    by_fp = written(solid.groupBy("fp").agg(F.min("rep").alias("rep"), F.count("*").alias("n")))
    same = join_hot(solid.select("fp", F.col("rep").alias("b")), by_fp.where("n > 1").select("fp", F.col("rep").alias("a"), "n"), ["fp"], solid.count()).where("a <> b").select("a", "b")
    near = written(connected(fingerprint_links(by_fp, max_bits).union(same).union(sketch_links(solid.select("rep", "sketch"), similarity - MARGIN))))
    found = _only(texts.where("doc_id is not null"), near).select("doc_id", shingle_set(F.col("text"), words).alias("x")).select(F.col("doc_id").alias("rep"), "x.digest", "x.shingles")
    members = near.join(solid, F.col("node") == F.col("rep")).select("component", "rep", "digest", "sketch")
    sets = written(members.join(found, ["rep", "digest"]))
    exact = connected(set_links(sets, similarity))
    named = classes.join(exact, F.col("rep") == F.col("node"), "left").select("digest", "n", F.coalesce("component", "rep").alias("component_id"))
    out = _named(fps, named, "digest")
    discard(sets, by_fp, near)
    return out


def keep_one(docs: DataFrame, words: int = SHINGLE_WORDS, max_bits: int = MAX_BITS, similarity: float = SIMILARITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that have the smallest id of their component of near copies; rows of a null id stay.

    Near copies are texts that share ``similarity`` of their shingles of ``words``
    words, counted exactly; fingerprints and sketches give the candidates. Null and
    empty texts are copies of each other, so one of them stays. Repeated rows of the
    id that stays all stay. Texts of any length are taken whole, columns pass through,
    and an empty table gives an empty table.
    """
    gone = near_copy_components(docs, words, max_bits, similarity, id_col, text_col).where("doc_id <> component_id").select(F.col("doc_id").alias("__gone")).distinct()
    return docs.join(gone, docs[id_col].cast("long") == gone["__gone"], "left_anti")
