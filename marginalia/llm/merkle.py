"""Merkle manifest of a dataset as a content-addressed graph.

Every row is a leaf, the digest of its fields. The leaves of a group, in order, are the
bottom of a tree of FANOUT children a node, and the tops of all groups the bottom of
another. What is stored of a node is its record: its digest and its children's digests.
A proof of a leaf is found by descent: requests start at the root with the digits of
their rank in base FANOUT; each step looks a digest up in the records, takes the child
of the next digit and collects the unselected ones. Requests that share a prefix
descend as one row. The collected segments, reversed, lead from the leaf to the root.

Texts never move: leaves are made where rows are read. Ranks come from sorted ranges
and their offsets, so no group meets in one task, and a node is a group of FANOUT rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import crc_fold, discard, shuffle_partitions, written

#: Children of a node, and hex digits of a digest.
FANOUT, HEX = 16, 64
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def leaf_digest(*values: Column) -> Column:
    """SHA-256 over the values: "-" for null, else the number of UTF-8 bytes, a colon and the value."""
    one = lambda s: F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-"))
    return F.sha2(F.concat(*[one(v.cast("string")) for v in values]), 256)


def tampered_text(text: Column) -> Column:
    """The text with A-Z in lower case."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def ranked(rows: DataFrame, *order: str) -> DataFrame:
    """``rows`` with rank, the place from 0 within its tree by ``order``, and n, the rows of its tree; written once.

    Rows are dealt by ranges of tree and order and keep their place in their partition; a
    tree's offset into a partition is the sum of its counts in the ones before, of which
    there are as many as partitions at most.
    """
    keys = ["tree", *order]
    at = F.monotonically_increasing_id()
    source = written(rows)  # read twice: for the bounds of the ranges, and to be dealt
    placed = written(source.repartitionByRange(shuffle_partitions(source.sparkSession), *keys).sortWithinPartitions(*keys).withColumn("at", at))
    placed_part = placed.withColumn("part", F.shiftright("at", 33))
    runs = placed_part.groupBy("tree", "part").agg(F.min("at").alias("first"), F.count("*").alias("c"))
    w = Window.partitionBy("tree")
    before = F.coalesce(F.sum("c").over(w.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = runs.select("tree", "part", (before - F.col("first")).alias("shift"), F.sum("c").over(w).alias("n"))
    out = written(placed_part.join(starts, ["tree", "part"]).withColumn("rank", F.col("at") + F.col("shift")).drop("at", "part", "shift"))
    discard(source, placed)
    return out


def tree_levels(leaves: DataFrame) -> list[DataFrame]:
    """Tables of nodes (tree, rank, n, digest, children) above ``leaves`` (tree, rank, n, digest), from the lowest.

    While a tree has several nodes, each FANOUT consecutive ones become one; children
    are their digests in order, and the digest is that of the children.
    """
    levels, nodes = [], leaves.select("tree", "rank", "n", "digest")
    most = nodes.agg(F.max("n")).first()[0] or 0
    while most > 1:
        run = nodes.where("n > 1").groupBy("tree", F.floor(F.col("rank") / FANOUT).alias("rank")).agg(F.first("n").alias("n"), F.sort_array(F.collect_list(F.struct("rank", "digest"))).alias("of"))
        joined = run.select("tree", "rank", F.ceil(F.col("n") / FANOUT).alias("n"), F.array_join(F.transform("of", lambda x: x["digest"]), "").alias("children"))
        levels.append(written(joined.withColumn("digest", F.sha2("children", 256))))
        nodes, most = levels[-1].select("tree", "rank", "n", "digest"), -(-most // FANOUT)
    return levels


def tops(leaves: DataFrame, levels: list[DataFrame]) -> DataFrame:
    """(tree, height, digest): the single node that each tree ends in."""
    found = None
    for h, nodes in enumerate([leaves, *levels]):
        top = nodes.where("n = 1").select("tree", F.lit(h).alias("height"), "digest")
        found = top if found is None else found.unionByName(top)
    return found


@dataclass
class Manifest:
    """Leaves and levels of the groups' trees; of the tree of their tops, the same. All are tables in the shared folder."""

    leaves: DataFrame
    levels: list[DataFrame]
    groups: DataFrame
    group_levels: list[DataFrame]


def build_manifest(leaves: DataFrame, *order: str) -> Manifest:
    """The manifest of ``leaves`` (group, digest and others), ordered in their group by ``order`` and the digest.

    The null group comes first, others by their UTF-8 bytes; a group is a tree, named by
    "" or the group after an "s". Rows that are equal in all of it are interchangeable.
    """
    named = leaves.withColumn("tree", F.coalesce(F.concat(F.lit("s"), F.col("group")), F.lit("")))
    base = ranked(named, *order, "digest")
    levels = tree_levels(base)
    groups = ranked(tops(base, levels).select(F.lit("").alias("tree"), F.col("tree").alias("name"), "height", "digest"), "name")
    return Manifest(base, levels, groups, tree_levels(groups))


def _parts(children: Column, digit: Column) -> tuple[Column, Column]:
    """The selected child, and the unselected ones in order."""
    at = digit * HEX
    return F.substr(children, at + 1, F.lit(HEX)), F.concat(F.substr(children, F.lit(1), at), F.substr(children, at + HEX + 1))


def _segment(digit: Column, siblings: Column) -> Column:
    return F.array(F.struct(digit.cast("int").alias("digit"), siblings.alias("siblings")))


def _descend(frontier: DataFrame, level: DataFrame, asked: DataFrame) -> DataFrame:
    """One digit down: each digest's record gives the children; those that requests ask for stay, with what they leave aside."""
    records = level.select("digest", "children").distinct()
    digits = F.sequence(F.lit(0), F.floor(F.length("children") / HEX).cast("int") - 1)
    met = frontier.join(records, "digest").withColumn("digit", F.explode(digits))
    child, siblings = _parts(F.col("children"), F.col("digit"))
    down = met.select("tree", (F.col("rank") * FANOUT + F.col("digit")).alias("rank"), child.alias("digest"), F.concat("path", _segment(F.col("digit"), siblings)).alias("path"), *[c for c in ("subroot", "root") if c in met.columns])
    return down.join(asked, ["tree", "rank"], "left_semi")


def prove(manifest: Manifest, requests: DataFrame) -> DataFrame:
    """``requests``, rows of the manifest's leaves, with subroot, root and path: (digit, siblings) of each level from the root down.

    The paths of the lowest nodes meet their requests, FANOUT at most, where the last
    segment is taken: what is shuffled of a path is one for each lowest node.
    """
    up = lambda rows: rows.select("tree", F.floor(F.col("rank") / FANOUT).alias("rank")).distinct()
    asked = [written(up(requests))]
    for _ in manifest.levels[1:]:
        asked.append(up(asked[-1]))
    groups = manifest.groups.join(requests.select(F.col("tree").alias("name")).distinct(), "name", "left_semi")
    asked_groups = [groups.select("tree", "rank")]
    for _ in manifest.group_levels:
        asked_groups.append(up(asked_groups[-1]))
    none = F.array().cast("array<struct<digit:int,siblings:string>>")
    top = tops(manifest.groups, manifest.group_levels)
    frontier = top.select("tree", F.lit(0).cast("long").alias("rank"), "digest", none.alias("path"), F.col("digest").alias("root"))
    for level, wanted in zip(manifest.group_levels[::-1], asked_groups[-2::-1], strict=False):
        frontier = _descend(frontier, level, wanted)
    named = frontier.join(groups.select("rank", "name", "height"), "rank")
    starts = named.select(F.col("name").alias("tree"), F.lit(0).cast("long").alias("rank"), "digest", "path", F.col("digest").alias("subroot"), "root", "height")
    starts = written(starts)
    at = lambda h: starts.where(F.col("height") == h).drop("height")
    below = None
    for h in range(len(manifest.levels), 0, -1):
        below = at(h) if below is None else below.unionByName(at(h))
        if h > 1:
            below = _descend(below, manifest.levels[h - 1], asked[h - 2])
    lone = at(0).withColumn("children", F.lit(None).cast("string"))
    last = lone
    if below is not None:
        last = lone.unionByName(below.join(manifest.levels[0].select("digest", "children").distinct(), "digest"))
    last = last.select(F.col("tree").alias("t"), F.col("rank").alias("r"), "path", "subroot", "root", "children")
    digit = F.col("rank") % FANOUT
    met = requests.join(last, (F.col("tree") == F.col("t")) & (F.floor(F.col("rank") / FANOUT) == F.col("r")))
    whole = F.when(F.col("children").isNull(), F.col("path")).otherwise(F.concat("path", _segment(digit, _parts(F.col("children"), digit)[1])))
    return met.withColumn("path", whole).drop("t", "r", "children")


def proof_digest(path: Column) -> Column:
    """SHA-256 over the siblings from the leaf up, left to right."""
    return F.sha2(F.array_join(F.transform(F.reverse(path), lambda s: s["siblings"]), ""), 256)


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its siblings lead to."""

    def up(digest: Column, s: Column) -> Column:
        at = s["digit"] * HEX
        return F.sha2(F.concat(F.substr(s["siblings"], F.lit(1), at), digest, F.substr(s["siblings"], at + 1)), 256)

    return F.aggregate(F.reverse(path), leaf, up)


def verified_manifest(docs: DataFrame) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) of each row of ``docs`` (the columns FIELDS; others are left out).

    Leaves are grouped by source and ordered by doc_id, null first; rows that repeat a
    doc_id are ordered by their digest, equal ones are leaves each. Rows whose crc32 of
    the doc_id as text divides by 5 are tampered with before folding: A-Z of their text
    in lower case; a null text stays, a null doc_id is never chosen. Nulls in any column
    are values like others. Texts of any length are hashed where they are read; an empty
    table gives an empty table.
    """
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *[F.col(c).cast("string").alias(c) for c in ("source", "lang")], F.col("n_chars").cast("long").alias("n_chars"), F.col("text").cast("string").alias("text"))
    values = [F.col(c) for c in FIELDS]
    changed = F.when(crc_fold(F.col("doc_id")) == 0, leaf_digest(*values[:-1], tampered_text(F.col("text"))))
    m = build_manifest(d.select(F.col("source").alias("group"), "doc_id", leaf_digest(*values).alias("digest"), changed.alias("changed")), "doc_id")
    proved = prove(m, m.leaves)
    found = proved.select("doc_id", F.col("digest").alias("leaf"), "subroot", "root", proof_digest(F.col("path")).alias("proof_sha256"), folded(F.coalesce("changed", "digest"), F.col("path")).alias("folded_root"))
    return found.withColumn("verified", F.col("folded_root") == F.col("root"))
