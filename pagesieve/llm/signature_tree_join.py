"""N-gram Jaccard self-join of documents with signature trees.

A document's set holds its distinct word shingles. Two documents link when
``100 * |A & B| >= percent * |A | B|``; the result names each document's class under these links.

1. Equal sets collapse to one node (64-bit key of the set), so copies cost one row.
2. Cover: a linked pair of sizes up to ``u`` differs in at most ``2 u (100 - p) / (100 + p)`` shingles. The
   shingles of a set are dealt by hash into so many parts and ``SPARE`` more; at least ``SPARE`` parts of a
   linked pair are then equal, and one of them is not empty unless a set has ``SPARE`` empty parts (then
   its empty parts count too). Sets that share a part form a cell, so no link crosses all cells. The number of
   parts grows with the set and with 100 - p; at lower limits, ``cover="minhash"`` takes cells of equal MinHash values
   instead, as many for every set, so many that a linked pair shares none with a chance of at most ``MISS``.
3. Cells that hold different sets are joined to candidate clusters (connected components of leader links). A
   cluster of at most ``BLOCK`` sets is one group; in a larger one, each set is grouped with the smallest of its cells'
   leaders, and groups are dealt into blocks that all hold their leader.
4. Signature trees: the nodes of a block's tree hold OR-combined shingle bitmaps and size ranges. A dual
   traversal drops node pairs whose largest possible overlap is too small, and those already known to be
   connected; the remaining sets are counted exactly, each with all of the other node at once. The links found give verified classes.
5. In the larger clusters, only cells that hold sets of several classes are looked at again, first with their leaders,
   and what is then still open as whole cells. A cell with more than ``BLOCK`` sets outside its main class is crowded. Linked
   sets share three parts (by MinHash all but 3e-9 of pairs at the limit share two cells): they meet in a cell that isn't
   crowded, or share two crowded ones or one and an empty part, so crowded cells are split by pairs of these. What moves grows with the cells that sets share and not with the square of a cluster;
   where an affine plane of the whole cluster, whose lines are blocks, makes fewer seats still, it is taken. Links between
   members of one class cannot change the classes, so nothing is lost.

Shingles and sets are compared by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import boxed, components, stage, unboxed
from .words import mix, windows, word_hashes

SPARE = 3
BLOCK = 128
FANOUT = 4
#: Level of the nodes whose sets are counted together (FANOUT ** LEAVES sets), and words of exact bit rows in a block.
LEAVES, MOST_WORDS = 2, 1 << 22
#: MinHash values in a cell of the second cover, and the greatest chance that it misses a pair at the limit.
MIN_ROWS, MISS = 6, 1e-10
#: Sizes up to which a cover has its own number of parts; each is about 1.35 times the one before.
BANDS = np.unique(np.floor(9 * 1.35 ** np.arange(0, 90)).astype(np.int64))
_M1 = np.uint64(0x9E3779B97F4A7C15)


def shingle_sets(texts: Sequence[str | None], n: int) -> Iterator[np.ndarray]:
    """For each text the sorted hashes of its distinct n-word shingles; A-Z count as a-z."""
    for h in word_hashes(texts, lower=True):
        w = np.sort(windows(h, n))
        yield w[np.concatenate(([True], w[1:] != w[:-1]))] if len(w) else w


def set_key(s: np.ndarray) -> int | None:
    return xxhash.xxh3_64_intdigest(s.tobytes(), seed=len(s)) - (1 << 63) if len(s) else None


def parts_of(band: int, percent: int) -> int:
    return int(2 * BANDS[band] * (100 - percent) // (100 + percent)) + SPARE


@lru_cache(64)
def _part_salt(band: int, parts: int) -> np.ndarray:
    return mix(np.arange(1, parts + 1, dtype=np.uint64) * _M1 + np.uint64(band))


def signatures(s: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """The cells of a set: one for each part, in its own band and in the next if a larger partner may be there.

    The second array holds the cells of its empty parts, whether the first has them or leaves them out.
    """
    found, empty = [np.empty(0, np.uint64)], [np.empty(0, np.uint64)]
    own, last = (int(np.searchsorted(BANDS, n)) for n in (len(s), len(s) * 100 // percent))
    for band in range(own, last + 1):
        k = parts_of(band, percent)
        if k == SPARE:
            continue  # so small that linked sets are equal
        part = ((s >> np.uint64(32)) * np.uint64(k)) >> np.uint64(32)
        sums = np.zeros(k, np.uint64)
        part = part.astype(np.int64)
        np.add.at(sums, part, s)
        filled = np.bincount(part, minlength=k) > 0
        cells = mix(sums + _part_salt(band, k))
        found.append(cells[filled] if k - filled.sum() < SPARE else cells)
        empty.append(cells[~filled])
    return np.concatenate(found).view(np.int64), np.concatenate(empty).view(np.int64)


@lru_cache(8)
def _bands(percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Factors of the MinHash functions, and a salt for each group of MIN_ROWS of them.

    So many groups that a pair at the limit shares none with a chance of at most MISS.
    """
    groups = int(np.ceil(np.log(MISS) / np.log1p(-((percent / 100) ** MIN_ROWS)))) if percent < 100 else 1
    numbers = mix(np.arange(1, groups * (MIN_ROWS + 1) + 1, dtype=np.uint64) * _M1)
    return (numbers[groups:] >> np.uint64(32)).astype(np.uint32) | np.uint32(1), numbers[:groups]


def minhash_signatures(s: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """The cells of a set: one for each group of MinHash values, whatever its size; it has no empty parts."""
    factors, salt = _bands(percent)
    least = np.full(len(factors), 0xFFFFFFFF, np.uint32)
    short = (s >> np.uint64(32)).astype(np.uint32)[:, None]
    for at in range(0, len(short), 512):
        np.minimum(least, (short[at : at + 512] * factors).min(0), out=least)
    rows = least.astype(np.uint64).reshape(-1, MIN_ROWS)
    cells = salt.copy()
    for row in rows.T:
        cells = mix(cells + row * _M1)
    return cells.view(np.int64), np.empty(0, np.int64)


class Tree:
    """Nodes over sets sorted by their smallest shingle: OR bitmaps, size ranges and the most hash collisions."""

    def __init__(self, sets: list[np.ndarray], bits: int):
        words = bits // 64
        self.sets = sets
        maps = np.zeros((len(sets), words), np.uint64)
        for row, s in zip(maps, sets, strict=True):
            at = s & np.uint64(bits - 1)
            np.bitwise_or.at(row, (at >> np.uint64(6)).astype(np.int64), np.uint64(1) << (at & np.uint64(63)))
        size = np.array([len(s) for s in sets], np.int64)
        order = np.argsort([int(s[0]) for s in sets], kind="stable")
        lost = size - np.bitwise_count(maps).sum(1).astype(np.int64)
        self.members = [[int(i)] for i in order]
        self.levels = [(maps[order], size[order], size[order], lost[order])]
        while len(self.levels[-1][0]) > 1:
            m, lo, hi, c = self.levels[-1]
            cut = np.arange(0, len(m), FANOUT)
            self.levels.append((np.bitwise_or.reduceat(m, cut), np.minimum.reduceat(lo, cut), np.maximum.reduceat(hi, cut), np.maximum.reduceat(c, cut)))

    def node(self, level: int, i: int):
        m, lo, hi, c = self.levels[level]
        return m[i], int(lo[i]), int(hi[i]), int(c[i])

    def below(self, level: int, i: int) -> list[int]:
        lo, hi = i * FANOUT**level, min(len(self.sets), (i + 1) * FANOUT**level)
        return [self.members[j][0] for j in range(lo, hi)]


class Classes:
    """Union-find over the sets of one task."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i: int, j: int) -> bool:
        i, j = self.find(i), self.find(j)
        self.up[max(i, j)] = min(i, j)
        return i != j


def bitmap_bits(sets: list[np.ndarray]) -> int:
    return 1 << max(6, int(4 * max(map(len, sets)) - 1).bit_length())


def _may_link(a, b, percent: int) -> bool:
    (ma, loa, hia, ca), (mb, lob, hib, cb) = a, b
    if hia * 100 < lob * percent or hib * 100 < loa * percent:
        return False
    most = min(hia, hib, int(np.bitwise_count(ma & mb).sum()) + min(ca, cb))
    return most * (100 + percent) >= percent * (loa + lob)


def traverse(tree: Tree, known: Classes, percent: int) -> list[tuple[int, int]]:
    """Links that join classes, from a dual traversal of a tree with itself; the tree's sets have the same places in known.

    Pairs of nodes above few sets are counted set by set, each with all that the other node holds of other classes.
    """
    found, overlaps = [], Overlaps(tree.sets)
    todo = [(len(tree.levels) - 1, 0, len(tree.levels) - 1, 0)]
    while todo:
        la, i, lb, j = todo.pop()
        own = la == lb and i == j
        if not own and not _may_link(tree.node(la, i), tree.node(lb, j), percent):
            continue
        left, right = tree.below(la, i), tree.below(lb, j)
        if len({known.find(x) for x in left} | {known.find(y) for y in right}) == 1:
            continue
        if max(la, lb) <= LEAVES:
            for n, x in enumerate(left):
                top = known.find(x)
                others = [y for y in (right[n + 1 :] if own else right) if known.find(y) != top]
                for y in overlaps.linked(x, np.array(others, np.int64), percent).tolist() if others else ():
                    if known.join(x, y):
                        found.append((x, y))
            continue
        widen = lambda level, at: [(level - 1, c) for c in range(at * FANOUT, min((at + 1) * FANOUT, len(tree.levels[level - 1][0])))] if level else [(0, at)]
        for la2, i2 in widen(la, i):
            for lb2, j2 in widen(lb, j):
                if not (own and i2 > j2):
                    todo.append((la2, i2, lb2, j2))
    return found


class Overlaps:
    """Exact sizes of intersections among the sets of one block.

    The block's distinct shingles are numbered, so each set is a row of bits without collisions; a row meets many at once. Where these rows would
    take more than MOST_WORDS words in all, two sets are intersected as they are.
    """

    def __init__(self, sets: list[np.ndarray]):
        self.sets, self.rows = sets, None
        self.sizes = np.array([len(s) for s in sets], np.int64)
        known = np.unique(np.concatenate(sets))
        words = -(-len(known) // 64)
        if words * len(sets) <= MOST_WORDS:
            self.rows = np.zeros((len(sets), words), np.uint64)
            for row, s in zip(self.rows, sets, strict=True):
                at = np.searchsorted(known, s)
                np.bitwise_or.at(row, at >> 6, np.uint64(1) << (at & 63).astype(np.uint64))

    def of(self, x: int, others: np.ndarray) -> np.ndarray:
        if self.rows is None:
            return np.array([len(np.intersect1d(self.sets[x], self.sets[y], assume_unique=True)) for y in others], np.int64)
        return np.bitwise_count(self.rows[others] & self.rows[x]).sum(1, dtype=np.int64)

    def linked(self, x: int, others: np.ndarray, percent: int) -> np.ndarray:
        """Those of others that link with set x."""
        both = self.of(x, others)
        return others[100 * both >= percent * (self.sizes[x] + self.sizes[others] - both)]


COVERS = {"parts": signatures, "minhash": minhash_signatures}


def document_sets(docs: DataFrame, width: int, percent: int, cover: str = "parts") -> DataFrame:
    """(doc_id, n_shingles, set_key, cells, empty) of every row; an empty set has neither key nor cells."""
    cells_of = COVERS[cover]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            sets = list(shingle_sets(b["text"], width))
            cells = [cells_of(s, percent) if len(s) else (None, None) for s in sets]
            yield pd.DataFrame({
                "doc_id": b["doc_id"].astype("Int64"),
                "n_shingles": [len(s) for s in sets],
                "set_key": pd.array([set_key(s) for s in sets], "Int64"),
                "cells": [c for c, _ in cells],
                "empty": [e for _, e in cells],
            })

    return docs.select("doc_id", "text").mapInPandas(run, "doc_id long, n_shingles long, set_key long, cells array<long>, empty array<long>")


def _arrays(texts: DataFrame, width: int) -> DataFrame:
    """texts: (text, set_key, ...): the other columns and the set as bytes, for rows whose text has that set."""
    keep = [c for c in texts.columns if c != "text"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            sets = list(shingle_sets(b["text"], width))
            out = b[keep].assign(shingles=[s.tobytes() for s in sets])
            yield out[[set_key(s) == k for s, k in zip(sets, b["set_key"], strict=True)]]

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in texts.schema if f.name != "text")
    return texts.mapInPandas(run, f"{schema}, shingles binary")


def _tree_links(percent: int):
    """Links that join classes among the sets of one block, by its signature tree."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.drop_duplicates("set_key").sort_values("set_key")
        sets = [np.frombuffer(x, np.uint64) for x in group["shingles"]]
        keys, known, first = group["set_key"].to_numpy(), Classes(len(sets)), {}
        for i, c in enumerate(group["class"]):
            known.join(first.setdefault(c, i), i)
        links = traverse(Tree(sets, bitmap_bits(sets)), known, percent)
        return pd.DataFrame({"a": [keys[i] for i, _ in links], "b": [keys[j] for _, j in links]}, dtype="int64")

    return run


def _linked(dealt: DataFrame, percent: int) -> DataFrame:
    """dealt: (unit, block, set_key, class, shingles): the links found in each block."""
    return stage(dealt.groupBy("unit", "block").applyInPandas(_tree_links(percent), "a long, b long"))


def _blocks(n: Column) -> Column:
    return F.ceil(n / BLOCK).cast("int")


def _block_of(blocks: str | Column) -> Column:
    return F.pmod(F.xxhash64("set_key"), F.col(blocks) if isinstance(blocks, str) else blocks).cast("int")


def jaccard_classes(docs: DataFrame, width: int = 5, percent: int = 80, cover: str = "parts") -> DataFrame:
    """Classes of documents under the links of the module's docstring; cover: parts (exact) or minhash.

    docs: doc_id, text; further columns are ignored. Returns one row for each row of docs: doc_id,
    n_shingles (size of its set) and component_id (smallest doc_id of its class). With fewer words than width,
    the whole sequence is the only shingle. Null, empty and blank texts have an empty set, link with nothing
    and are their own class. Repeated rows and equal texts share a class; rows without doc_id take part but name
    a class only (as null) if none of its rows has one. An empty table gives an empty one.
    """
    celled = stage(document_sets(docs, width, percent, cover))
    cells = celled.select("set_key", F.explode("cells").alias("cell"))
    sets = celled.select("doc_id", "n_shingles", "set_key")
    leaders = cells.groupBy("cell").agg(F.min("set_key").alias("leader"), F.max("set_key").alias("last")).where("leader <> last").select("cell", "leader")
    shared = stage(cells.join(leaders, "cell").select("cell", "set_key", "leader").distinct())
    star = shared.where("set_key <> leader").select(F.col("leader").alias("a"), F.col("set_key").alias("b"))
    firsts = sets.where("set_key is not null").groupBy("set_key").agg(F.min("doc_id").alias("doc_id"))
    wanted = _seats(components(star), star).join(firsts, "set_key")
    # a set whose rows all lack a doc_id is found by a join that takes nulls as equal
    texts = docs.select(F.col("doc_id").alias("own_id"), "text").join(wanted, F.col("own_id").eqNullSafe(F.col("doc_id"))).drop("own_id", "doc_id")
    rows = stage(_arrays(texts, width))
    led = F.when(F.col("led") > 0, F.transform(F.sequence(F.lit(0), F.col("led") - 1), lambda b: F.struct(F.col("set_key").alias("unit"), b.alias("block")))).otherwise(F.array().cast("array<struct<unit:bigint,block:int>>"))
    seats = F.explode(F.concat(F.array(F.struct("unit", "block")), led))
    dealt = rows.select("set_key", F.col("set_key").alias("class"), "shingles", seats.alias("seat")).select("seat.*", "set_key", "class", "shingles")
    links = _linked(dealt, percent)
    large = rows.where("large").select("set_key", "cluster", "shingles").dropDuplicates(["set_key"])
    if not large.isEmpty():
        for found in _reopened(celled, shared, large, links, percent):
            links = links.unionByName(found)
    return _label(sets, components(links))


def _seats(clusters: DataFrame, star: DataFrame) -> DataFrame:
    """(set_key, cluster, unit, block, led, large) of every set in a cluster: its block, and how many blocks it leads besides."""
    sizes = clusters.groupBy("root").agg((F.count("*") > BLOCK).alias("large"))
    named = clusters.join(sizes, "root").select(F.col("node").alias("set_key"), "root", "large")
    homes = star.groupBy(F.col("b").alias("set_key")).agg(F.min("a").alias("home"))
    named = named.join(homes, "set_key", "left").select("set_key", F.col("root").alias("cluster"), "large", F.when(F.col("large"), F.coalesce("home", "set_key")).otherwise(F.col("root")).alias("unit"))
    units = stage(named.groupBy("unit").agg(_blocks(F.count("*")).alias("blocks")))
    led = units.select(F.col("unit").alias("set_key"), F.col("blocks").alias("led"))
    seated = named.join(units, "unit").join(led, "set_key", "left")
    return seated.select("set_key", "cluster", "unit", _block_of("blocks").alias("block"), F.when(F.col("large"), F.coalesce("led", F.lit(0))).otherwise(0).alias("led"), "large")


def _with_classes(held: DataFrame, links: DataFrame) -> DataFrame:
    """held with the class of each set_key under the links."""
    classes = components(links).select(F.col("node").alias("set_key"), "root")
    return held.join(classes, "set_key", "left").withColumn("class", F.coalesce("root", "set_key")).drop("root")


def _open(members: DataFrame, unit: str) -> DataFrame:
    """Units that hold sets of several classes: (unit, leader, leader's class)."""
    ends = members.groupBy(unit).agg(F.min("class").alias("lo"), F.max("class").alias("hi"), F.min(F.struct("set_key", "class")).alias("first"))
    return ends.where("lo <> hi").select(unit, F.col("first.set_key").alias("leader"), F.col("first.class").alias("leader_class"))


def leader_seats(held: DataFrame) -> DataFrame:
    """held: (set_key, class, cell). (unit, block, set_key): every set beside the leaders, of other classes, of its cells."""
    pairs = held.join(_open(held, "cell"), "cell").where("class <> leader_class").select(F.col("leader").alias("unit"), "set_key").distinct()
    pairs = stage(pairs)
    blocks = pairs.groupBy("unit").agg(_blocks(F.count("*")).alias("blocks"))
    heads = blocks.select("unit", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.col("unit").alias("set_key"))
    return pairs.join(blocks, "unit").select("unit", _block_of("blocks").alias("block"), "set_key").unionByName(heads)


def _dealt(members: DataFrame) -> DataFrame:
    """members: (unit, set_key, class). With the class that holds most sets of each unit, the sets in it and those outside."""
    counts = members.groupBy("unit", "class").count()
    sizes = counts.groupBy("unit").agg(F.max_by("class", F.struct("count", "class")).alias("main"), F.max("count").alias("inside"), F.sum("count").alias("total"))
    return members.join(sizes.withColumn("outside", F.col("total") - F.col("inside")).where("outside > 0"), "unit")


def _alike(members: DataFrame) -> DataFrame:
    """(cell, unit) for the cells of members (cell, set_key, class) with several classes; cells of the same sets are one unit."""
    same = members.groupBy("cell").agg(
        F.sum(F.xxhash64("set_key").cast("decimal(20,0)")).alias("sum"), F.bit_xor(F.xxhash64("set_key", F.lit(1))).alias("xor"), F.count("*").alias("n"),
        F.min("class").alias("lo"), F.max("class").alias("hi"),
    )
    same = stage(same.where("lo <> hi"))
    return same.join(same.groupBy("sum", "xor", "n").agg(F.min("cell").alias("unit")), ["sum", "xor", "n"]).select("cell", "unit")


def _in_units(members: DataFrame, alike: DataFrame) -> DataFrame:
    once = alike.where("cell = unit").select("cell")
    return _dealt(members.join(once, "cell").select(F.col("cell").alias("unit"), "set_key", "class"))


@lru_cache(1)
def _orders() -> list[int]:
    """Primes, each at most about a tenth above the one before."""
    out = [2, 3]
    while out[-1] < 10**7:
        n = max(out[-1] + 2, int(out[-1] * 1.1)) | 1
        while any(n % d == 0 for d in range(3, int(n**0.5) + 1, 2)):
            n += 2
        out.append(n)
    return out


def _order(sets: Column) -> Column:
    """Of the plane whose lines hold about 2 * BLOCK of so many sets."""
    orders = F.array(*map(F.lit, _orders())).cast("array<long>")
    return F.array_min(F.filter(orders, lambda q: q * (2 * BLOCK) >= sets))


def plane_seats(members: DataFrame) -> DataFrame:
    """members: (unit, set_key, order). (unit, block, set_key) so that any two sets of a unit meet.

    Sets are points of an affine plane over the numbers below a prime, its lines are the blocks: two points lie on one line, and each point on order + 1
    lines. Pairs of blocks would seat every set nearly twice as often.
    """
    q = F.col("order")
    at = [F.pmod(F.xxhash64("set_key", F.lit(i)), q) for i in (1, 2)]
    lines = F.transform(F.sequence(F.lit(0).cast("long"), q - 1), lambda m: F.concat_ws(":", m.cast("string"), F.pmod(at[1] - m * at[0], q).cast("string")))
    return members.select("unit", F.explode(F.array_append(lines, F.concat(F.lit("v:"), at[0].cast("string")))).alias("block"), "set_key")


def _dense(dealt: DataFrame, clusters: DataFrame) -> DataFrame:
    """(set_key, unit, order) of the clusters whose units (as _dealt() gives them) would seat their sets more often than a plane of the whole cluster.

    Sets of one unit are of one cluster. clusters: (set_key, cluster). Seats are counted from the sizes of the units; none is made for it.
    """
    outer, inner = _blocks(F.col("outside")), _blocks(F.col("inside"))
    own = F.when(F.col("total") <= BLOCK, 1).when(F.col("class") == F.col("main"), outer).otherwise(outer + inner)
    seated = dealt.groupBy("set_key").agg(F.sum(own).alias("seats")).join(clusters, "set_key")
    costs = seated.groupBy("cluster").agg(F.sum("seats").alias("seats"), F.count("*").alias("sets")).withColumn("order", _order(F.col("sets")))
    dense = costs.where((F.col("sets") > BLOCK) & (F.col("seats") > F.col("sets") * (F.col("order") + 1))).select("cluster", "order")
    return stage(seated.join(dense, "cluster").select("set_key", F.col("cluster").alias("unit"), "order"))


def cell_seats(held: DataFrame, parts: DataFrame) -> DataFrame:
    """held: (set_key, class, cell, cluster); parts: (set_key, parts), what a set may share besides its cells. (unit, block, set_key) so
    that any two sets of different classes meet in a block if they share a cell that isn't split, or one that is and a
    second that is too, or one that is and a part. Sets that share any cell that isn't split need no seat for the others.
    In a cluster whose sets share so many cells that the lines of a plane are fewer seats, those are taken."""
    alike = stage(_alike(held))
    first = stage(_in_units(held, alike))
    both, hot = first.where(F.col("outside") <= BLOCK), first.where(F.col("outside") > BLOCK)
    if not hot.isEmpty():
        crowded = alike.join(hot.select("unit").distinct(), "unit").select("cell")
        own = held.join(crowded, "cell").groupBy("set_key", "class").agg(F.sort_array(F.collect_set("cell")).alias("own"))
        own = own.join(parts.dropDuplicates(["set_key"]), "set_key", "left")
        apart = F.array_except(F.coalesce("parts", F.array().cast("array<bigint>")), "own")
        other = lambda i: F.array_union(F.slice("own", i + 2, F.size("own")), apart)
        pairs = F.flatten(F.transform("own", lambda p, i: F.transform(other(i), lambda q: F.xxhash64(F.least(p, q), F.greatest(p, q)))))
        split = stage(own.select("set_key", "class", F.explode(pairs).alias("cell")))
        both = both.unionByName(_in_units(split, _alike(split)))
    both = stage(both)
    dense = _dense(both, held.select("set_key", "cluster").distinct())
    both = both.join(dense.select("set_key"), "set_key", "left_anti")
    outer, inner = _blocks(F.col("outside")), _blocks(F.col("inside"))
    is_main = F.col("class") == F.col("main")
    own = F.when(is_main, outer + _block_of(inner)).otherwise(_block_of(outer))
    others = F.sequence(F.lit(0), F.when(is_main, outer - 1).otherwise(outer + inner - 1))
    met = F.when(F.col("total") <= BLOCK, F.array(F.lit("0"))).otherwise(F.transform(others, lambda o: F.concat_ws(":", F.least(o, own), F.greatest(o, own))))
    return both.select("unit", F.explode(met).alias("block"), "set_key").unionByName(plane_seats(dense))


def _reopened(celled: DataFrame, shared: DataFrame, large: DataFrame, links: DataFrame, percent: int) -> Iterator[DataFrame]:
    """Links in the cells of larger clusters whose sets the links so far leave in several classes."""
    parts = celled.select("set_key", F.col("empty").alias("parts")).where(F.size("parts") > 0)
    for seats_of in (leader_seats, lambda held: cell_seats(held, parts)):
        classes = stage(_with_classes(large.select("set_key", "cluster"), links))
        seats = seats_of(stage(shared.select("cell", "set_key").join(classes, "set_key")))
        found = _linked(seats.join(large.select("set_key", "shingles").join(classes, "set_key"), "set_key").select("unit", "block", "set_key", "class", "shingles"), percent)
        yield found
        links = links.unionByName(found)


def _label(sets: DataFrame, classes: DataFrame) -> DataFrame:
    """One row for each document: a class is named by the smallest doc_id of its sets."""
    first = sets.where("set_key is not null").groupBy("set_key").agg(F.min("doc_id").alias("first_id"))
    rooted = first.join(classes.select(F.col("node").alias("set_key"), "root"), "set_key", "left").withColumn("root", F.coalesce("root", "set_key"))
    names = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    named = rooted.join(names, "root").select("set_key", "component_id")
    return sets.join(named, "set_key", "left").select("doc_id", "n_shingles", F.when(F.col("set_key").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def keep_representatives(docs: DataFrame, width: int = 5, percent: int = 80, cover: str = "parts") -> DataFrame:
    """The documents that name their class: one of each group of near copies stays, in its own columns.

    Of rows that repeat a doc_id, one stays (the smallest text, nulls first). Rows without doc_id cannot name a
    class and all stay. Columns of docs may have any names.
    """
    kept = jaccard_classes(docs, width, percent, cover).where("doc_id = component_id").select("doc_id").distinct()
    rows = boxed(docs).withColumn("doc_id", F.col("row")["doc_id"])
    one = Window.partitionBy("doc_id").orderBy(F.col("row")["text"].asc_nulls_first())
    stay = rows.join(kept, "doc_id", "left_semi").withColumn("turn", F.row_number().over(one)).where("turn = 1")
    return unboxed(stay, docs).unionByName(docs.where("doc_id is null"))
