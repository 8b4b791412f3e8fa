"""Merkle manifest of a table with proofs by pointer jumping, in DataFrame functions.

Every row is a leaf. The leaves of a language, ordered by doc_id, are the lowest level of its tree: FANOUT consecutive nodes become
their parent, level by level, and the trees' subroots, ordered by language, are the leaves of a tree above them. Positions come from one
range sort, so that no task orders a whole language.

A run (the children of one node) is kept once, as the concatenation of its digests; what a child needs of it is what stands before and
behind its own place. Every inner node starts with a pointer to its parent and that one segment. Each round joins the nodes
with themselves, pointer to node: the segments are put together, the distance of the pointers doubles, and nodes whose pointer has
reached the root drop out. At last each leaf joins its parent, whose segments then reach the root.
"""

from __future__ import annotations

import math
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import lower_ascii, stage

FANOUT = 8
#: Bytes of a digest.
SIZE = 32
#: Of every so many rows, by the checksum of doc_id, one is tampered with in the trial.
TRIAL = 3
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: The tree above the languages' trees.
TOP = -1
_NO_PATH = "array<struct<before: binary, after: binary>>"
_ID = ("tree", "level", "idx")


def digest(c: Column) -> Column:
    return F.unhex(F.sha2(c.cast("binary"), 256))


def hexed(c: Column) -> Column:
    return F.lower(F.hex(c))


def leaf_digest(**fields: Column) -> Column:
    """The digest of a row: each of FIELDS as byte count, colon and value, or - for null."""
    parts = [fields[n].cast("string") for n in FIELDS]
    return digest(F.concat(*[F.coalesce(F.concat(F.octet_length(p).cast("string"), F.lit(":"), p), F.lit("-")) for p in parts]))


def leaves(docs: DataFrame) -> DataFrame:
    """(doc_id, lang, leaf, tampered): the rows' digests; tampered, where not null, is that of the row with A-Z of its text lower-cased."""
    own = {n: F.col(n) for n in FIELDS}
    chosen = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(TRIAL)) == 0
    changed = F.when(chosen & F.col("text").isNotNull(), leaf_digest(**(own | {"text": lower_ascii(F.col("text"))})))
    return docs.select("doc_id", "lang", leaf_digest(**own).alias("leaf"), changed.alias("tampered"))


def placed(rows: DataFrame, *order: str) -> DataFrame:
    """rows with place, their position in the whole order from 0 (nulls first); rows that tie are in any order.

    One range sort is written once; positions within its partitions are then moved by the counts of the partitions before, of
    which there is one row a partition.
    """
    turned = stage(rows.withColumn("_turn", F.monotonically_increasing_id()))
    dealt = stage(turned.repartitionByRange(*order, "_turn").sortWithinPartitions(*order, "_turn").drop("_turn").withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", 33).alias("_part")  # as monotonically_increasing_id() is defined
    before = F.coalesce(F.sum("n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = dealt.groupBy(part).agg(F.count("*").alias("n")).select("_part", before.alias("_before"))
    inside = F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    return dealt.withColumn("_part", part).join(F.broadcast(counts), "_part").withColumn("place", F.col("_before") + inside).drop("_part", "_at", "_before")


def parents(nodes: DataFrame) -> DataFrame:
    """The next level of trees of several nodes. nodes: tree, idx, hash, n (nodes of its tree on this level)."""
    up = F.floor(F.col("idx") / FANOUT).alias("idx")
    children = F.transform(F.array_sort(F.collect_list(F.struct("idx", "hash"))), lambda x: hexed(x["hash"]))
    runs = nodes.where("n > 1").groupBy("tree", up).agg(F.array_join(children, "").alias("run"), F.ceil(F.first("n") / FANOUT).alias("n"))
    return runs.select("tree", "idx", digest(F.col("run")).alias("hash"), "n", F.unhex("run").alias("run"))


def segment(run: Column, place: Column) -> Column:
    """What stands in a run before and behind a child."""
    return F.struct(F.substring(run, F.lit(1), place * SIZE).alias("before"), F.substring(run, place * SIZE + SIZE + 1, F.octet_length(run)).alias("after"))


class Manifest(NamedTuple):
    """leaves: doc_id, leaf, tampered, tree, idx, n. levels: the levels above, from 1 on. subroots: tree, level, hash.
    top: the levels above the subroots. root: hex, or None for an empty table."""

    leaves: DataFrame
    levels: list[DataFrame]
    subroots: DataFrame
    top: list[DataFrame]
    root: str | None


def climbed(nodes: DataFrame, most: int) -> list[DataFrame]:
    """All levels above nodes; most: the nodes of the largest tree."""
    out = []
    while most > 1:
        out.append(stage(parents(out[-1] if out else nodes)))
        most = math.ceil(most / FANOUT)
    return out


def build(docs: DataFrame) -> Manifest:
    """All levels of the trees of a table; only the size of the largest tree, the number of trees and the root reach the driver."""
    own = placed(leaves(docs), "lang", "doc_id", "leaf")
    own = stage(own)
    langs = placed(own.groupBy("lang").agg(F.min("place").alias("start"), F.count("*").alias("n")), "lang").withColumnRenamed("place", "tree")
    trees = stage(langs.withColumnRenamed("lang", "_lang"))
    sizes = trees.agg(F.max("n"), F.count("*")).first()
    most, n_trees = sizes[0] or 0, sizes[1]
    held = own.join(trees, F.col("lang").eqNullSafe(F.col("_lang"))).select("doc_id", "leaf", "tampered", "tree", (F.col("place") - F.col("start")).alias("idx"), "n")
    held = stage(held)
    levels = climbed(held.withColumnRenamed("leaf", "hash"), most)
    lone = held.where("n = 1").select("tree", F.lit(0).alias("level"), F.col("leaf").alias("hash"))
    subroots = stage(reduce(DataFrame.unionByName, [lone, *[x.where("n = 1").select("tree", F.lit(i).alias("level"), "hash") for i, x in enumerate(levels, 1)]]))
    top = climbed(subroots.select(F.lit(TOP).cast("long").alias("tree"), F.col("tree").alias("idx"), "hash", F.lit(n_trees).cast("long").alias("n")), n_trees)
    last = (top or [subroots])[-1].select(hexed(F.col("hash"))).first()
    return Manifest(held, levels, subroots, top, last[0] if last else None)


def pointers(m: Manifest) -> DataFrame:
    """(tree, level, idx, segments) of every inner node and lone leaf but the root: what its proof holds from itself to the root, by pointer jumping."""
    place = F.posexplode(F.sequence(F.lit(0), (F.octet_length("run") / SIZE).cast("int") - 1)).alias("p", "q")
    parts = []
    for level, runs in [*enumerate(m.levels[1:], 2), *enumerate(m.top, 1)]:
        of = runs.select("tree", "idx", "run", place)
        child = F.col("idx") * FANOUT + F.col("p")
        up = [F.col("tree").alias("up_tree"), F.lit(level).alias("up_level"), F.col("idx").alias("up_idx")]
        parts.append(of.select("tree", F.lit(level - 1).alias("level"), child.alias("idx"), *up, segment(F.col("run"), F.col("p")).alias("s")))
    if not parts:
        return m.subroots.select("tree", "level", F.lit(0).cast("long").alias("idx"), F.array().cast(_NO_PATH).alias("segments")).limit(0)
    own = reduce(DataFrame.unionByName, parts)
    # the lowest nodes of the tree above are the subroots themselves
    lowest, is_lowest = m.subroots.select(F.col("tree").alias("sub"), F.col("level").alias("sub_level")), (F.col("tree") == TOP) & (F.col("level") == 0)
    named = own.where(is_lowest).join(lowest, F.col("idx") == F.col("sub")).select(F.col("sub").alias("tree"), F.col("sub_level").alias("level"), F.lit(0).cast("long").alias("idx"), "up_tree", "up_level", "up_idx", "s")
    own = own.where(~is_lowest).unionByName(named)
    depth = len(m.levels) - 1 + len(m.top)
    top = (F.lit(TOP), F.lit(len(m.top))) if m.top else (F.lit(0), F.lit(len(m.levels)))
    ups = ("up_tree", "up_level", "up_idx")
    reached = (F.col("up_tree") == top[0]) & (F.col("up_level") == top[1])
    now = own.select(*_ID, *[F.when(~reached, F.col(c)).alias(c) for c in ups], F.array("s").cast(_NO_PATH).alias("segments"))
    distance = 1
    while distance < depth:
        now = stage(now)
        # only nodes that far up are pointed to
        far = now.where((F.col("level") > distance) | (F.col("tree") == TOP)).select(*[F.col(c).alias(u) for c, u in zip(_ID, ups, strict=True)], *[F.col(u).alias(f"_{u}") for u in ups], F.col("segments").alias("more"))
        moved = now.where("up_tree is not null").join(far, list(ups)).select(*_ID, *[F.col(f"_{u}").alias(u) for u in ups], F.concat("segments", "more").alias("segments"))
        now = now.where("up_tree is null").unionByName(moved)
        distance *= 2
    return now.select(*_ID, "segments")


def proofs(docs: DataFrame) -> DataFrame:
    """doc_id, leaf, tampered, subroot (binary), root (hex) and path, the array of (before, after) from the leaf to the root, for each row of docs.

    docs: doc_id, source, lang, n_chars, text; further columns are ignored. Nulls in any of them count as - ; a null language is a
    tree of its own, before the others. Rows with one doc_id follow one another by their digests, equal rows are leaves of their own;
    a null doc_id comes first. An empty table gives an empty one. Segments hold the siblings alone: nothing for a node without.
    """
    m = build(docs)
    has = F.col("n") > 1
    keyed = m.leaves.withColumn("level", F.when(has, 1).otherwise(0)).withColumn("up", F.when(has, F.floor(F.col("idx") / FANOUT)).otherwise(F.lit(0)))
    runs = m.levels[0].select("tree", F.lit(1).alias("level"), F.col("idx").alias("up"), "run") if m.levels else None
    above = stage(pointers(m)).where("level <= 1").withColumnRenamed("idx", "up")
    joined = keyed.join(runs, ["tree", "level", "up"], "left") if runs is not None else keyed.withColumn("run", F.lit(None).cast("binary"))
    joined = joined.join(above, ["tree", "level", "up"], "left").join(m.subroots.select("tree", F.col("hash").alias("subroot")), "tree")
    none = F.array().cast(_NO_PATH)
    first = F.when(has, F.array(segment(F.col("run"), F.pmod(F.col("idx"), F.lit(FANOUT)).cast("int")))).otherwise(none).cast(_NO_PATH)
    return joined.select("doc_id", "leaf", "tampered", "subroot", F.lit(m.root).alias("root"), F.concat(first, F.coalesce("segments", none)).alias("path"))


def folded(leaf: Column, path: Column) -> Column:
    """The root (hex) that a leaf and the siblings on its path give."""
    return F.aggregate(path, hexed(leaf), lambda at, s: F.sha2(F.concat(hexed(s["before"]), at, hexed(s["after"])).cast("binary"), 256))


def manifest(docs: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified, all digests in hex, for each row of docs. Cases as in proofs().

    folded_root rests on the tampered leaf where there is one; a row without doc_id is never tampered with, nor one without text.
    """
    siblings = F.array_join(F.transform("path", lambda s: F.concat(hexed(s["before"]), hexed(s["after"]))), "")
    out = proofs(docs).select("doc_id", hexed(F.col("leaf")).alias("leaf"), hexed(F.col("subroot")).alias("subroot"), "root", F.sha2(siblings.cast("binary"), 256).alias("proof_sha256"), folded(F.coalesce("tampered", "leaf"), F.col("path")).alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
