"""Near-duplicate vectors by sorted projection passes.

Equal vectors of a label are one class first. A class's signature has BITS bits, the signs of random projections. A pass takes the bits
in an order of its own, sorts the classes of a label lexicographically by them, and compares each with the WINDOW that follow it; the
sorted order is cut into blocks that overlap by a window, so no pair depends on partitions. Pairs of close signatures are candidates;
their cosines are computed from the vectors, and verified pairs unite. Bunches of surely close signatures give a chain of candidates and not all
their pairs, so a group of copies costs its size. Two passes come first; the others, whose number follows from the size of the
largest label, leave out pairs that are united already.

The number of links is counted within the united components, exactly: components of up to BLOCK classes in one piece; larger ones by
their centre where all their vectors lie so near to it that any two of them must link, else by pairs of blocks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import components, stage
from .merkle_manifest import placed

LIMIT = 0.93
BITS, WINDOW, BLOCK = 256, 64, 1024
#: Chance that all passes miss a pair right at the limit, at most.
MISS = 0.005
FIRST_PASSES, SEED = 2, 20240611
#: Standard deviations of a signature's distance by which a pair at the limit may look farther, and a sure one nearer.
FAR, SURE = 4.5, 4.5


def passes_for(largest: int, limit: float, window: int = WINDOW, miss: float = MISS) -> int:
    """Passes after which a pair at the limit is missed with a chance of at most miss.

    Two vectors whose signatures agree in as many leading bits as split the largest label into windows are neighbours of a pass.
    """
    agree = 1 - math.acos(limit) / math.pi
    depth = max(0.0, math.log2(max(1, largest) / window))
    met = agree ** (depth + 1)
    return max(FIRST_PASSES, math.ceil(math.log(miss) / math.log(1 - met)) if met < 1 else FIRST_PASSES)


def linkable(vectors: DataFrame, vector: str = "embedding") -> DataFrame:
    """(vec_id, label, vector) of the rows that can link: label and vector not null, some component not zero, all finite."""
    v = F.col(vector).cast("array<double>")
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    own = vectors.select("vec_id", F.col("label").cast("long").alias("label"), v.alias("vector")).where("label is not null and vector is not null")
    return own.where(F.forall("vector", finite) & F.exists("vector", lambda x: x != 0))


def classes(own: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((vec_id, rep), (rep, label, n, vector)): equal vectors of a label as one class, named by its smallest id. vec_id is unique."""
    keyed = stage(own.withColumn("key", F.unhex(F.md5(F.concat_ws(",", F.col("label").cast("string"), F.array_join("vector", ",")).cast("binary")))))
    held = stage(keyed.groupBy("key").agg(F.min("vec_id").alias("rep"), F.first("label").alias("label"), F.count("*").alias("n"), F.first("vector").alias("vector")))
    return keyed.select("vec_id", "key").join(held.select("key", "rep"), "key").select("vec_id", "rep"), held.select("rep", "label", "n", "vector")


def _units(column) -> np.ndarray:
    rows = np.stack([np.asarray(v, np.float64) for v in column])
    rows = rows / np.abs(rows).max(1, keepdims=True)
    return rows / np.sqrt((rows * rows).sum(1, keepdims=True))


def signatures(held: DataFrame, seed: int) -> DataFrame:
    """(rep, label, width, bits): BITS sign bits as bytes; width is the number of components, only vectors of one width compare."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        planes: dict[int, np.ndarray] = {}
        for b in batches:
            width = b["vector"].map(len)
            for d, rows in b.groupby(width, sort=False):
                if d not in planes:
                    planes[d] = np.random.default_rng([seed, d]).standard_normal((d, BITS))
                bits = np.packbits(_units(rows["vector"]) @ planes[d] > 0, axis=1)
                yield pd.DataFrame({"rep": rows["rep"], "label": rows["label"], "width": d, "bits": [x.tobytes() for x in bits]})

    return held.select("rep", "label", "vector").mapInPandas(run, "rep long, label long, width int, bits binary")


def ordered_bits(marks: DataFrame, first: int, last: int, seed: int) -> DataFrame:
    """marks once for each pass, with the bits in the pass's order as code."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        orders = [(p, np.random.default_rng([seed, 1, p]).permutation(BITS)) for p in range(first, last)]
        for b in batches:
            if len(b):
                bits = np.unpackbits(np.stack([np.frombuffer(x, np.uint8) for x in b["bits"]]), axis=1)
                for p, order in orders:
                    yield b.assign(turn=p, code=[x.tobytes() for x in np.packbits(bits[:, order], axis=1)])

    names = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in marks.schema)
    return marks.mapInPandas(run, f"{names}, turn int, code binary")


def _bunches(n: int, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """Components of few nodes, and a forest of the links."""
    up = list(range(n))

    def top(x: int) -> int:
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    forest = []
    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        p, q = top(x), top(y)
        if p != q:
            up[max(p, q)] = min(p, q)
            forest.append((x, y))
    return np.array([top(x) for x in range(n)]), forest


def close_pairs(marks: DataFrame, limit: float, window: int, block: int) -> DataFrame:
    """(a, b): candidates among neighbours in the passes' orders. marks: rep, root, label, width, bits, turn, code; pairs of one root are left out.

    The order of all passes is one; a block takes the last window of the block before along.
    """
    angle = math.acos(limit) / math.pi
    far = BITS * angle + FAR * math.sqrt(BITS * angle * (1 - angle))
    sure = max(2.0, BITS * angle - SURE * math.sqrt(BITS * angle * (1 - angle)))
    at = placed(marks, "turn", "label", "width", "code", "rep")
    own = F.floor(F.col("place") / block)
    also = F.when(F.col("place") % block >= block - window, F.array(own, own + 1)).otherwise(F.array(own))
    dealt = at.select("rep", "root", "label", "width", "turn", "bits", "place", F.explode(also).alias("block"))

    def run(b: pd.DataFrame) -> pd.DataFrame:
        b = b.sort_values("place", ignore_index=True)
        bits = np.stack([np.frombuffer(x, np.uint8) for x in b["bits"]]).view(np.uint64)
        group = b.groupby(["turn", "label", "width"], sort=False).ngroup().to_numpy()
        reps, roots = b["rep"].to_numpy(), b["root"].to_numpy()
        found = []
        for s in range(1, min(window + 1, len(b))):
            distance = np.bitwise_count(bits[:-s] ^ bits[s:]).sum(1, dtype=np.int64)
            i = np.flatnonzero((distance <= far) & (group[:-s] == group[s:]) & (roots[:-s] != roots[s:]))
            found.append(np.stack([i, i + s, distance[i]], axis=1))
        pairs = np.concatenate(found) if found else np.empty((0, 3), np.int64)
        near = pairs[pairs[:, 2] <= sure]
        bunch, forest = _bunches(len(b), near[:, 0], near[:, 1])
        open_ = pairs[(pairs[:, 2] > sure) & (bunch[pairs[:, 0]] != bunch[pairs[:, 1]])]
        out = np.concatenate([np.array(forest, np.int64).reshape(-1, 2), open_[:, :2]])
        return pd.DataFrame({"a": reps[out[:, 0]], "b": reps[out[:, 1]]})

    pairs = dealt.groupBy("block").applyInPandas(run, "a long, b long")
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct()


def cosine(a: Column, b: Column) -> Column:
    """Of arrays of doubles; components are divided by the largest first, so that no square overflows."""
    scaled = lambda v: F.transform(v, lambda x: x / F.array_max(F.transform(v, F.abs)))
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, p: s + p)
    return F.transform(F.array(F.struct(scaled(a).alias("a"), scaled(b).alias("b"))), lambda v: dot(v["a"], v["b"]) / F.sqrt(dot(v["a"], v["a"]) * dot(v["b"], v["b"])))[0]


def verified(pairs: DataFrame, held: DataFrame, limit: float) -> DataFrame:
    """The pairs whose cosine reaches the limit."""
    left, right = (held.select(F.col("rep").alias(c), F.col("vector").alias(f"v{c}")) for c in "ab")
    return pairs.join(left, "a").join(right, "b").where(cosine(F.col("va"), F.col("vb")) >= limit).select("a", "b")


def united(held: DataFrame, limit: float, window: int, block: int, seed: int, miss: float) -> DataFrame:
    """(rep, root) of the classes that some verified pair unites with others."""
    marks = stage(signatures(held, seed))
    largest = marks.groupBy("label", "width").count().agg(F.max("count")).first()[0] or 0
    n = passes_for(largest, limit, window, miss)
    alone = marks.withColumn("root", F.col("rep"))
    links = stage(verified(close_pairs(ordered_bits(alone, 0, FIRST_PASSES, seed), limit, window, block), held, limit))
    if n > FIRST_PASSES:
        roots = components(links).withColumnRenamed("node", "rep")
        known = marks.join(roots, "rep", "left").withColumn("root", F.coalesce("root", "rep"))
        more = verified(close_pairs(ordered_bits(known, FIRST_PASSES, n, seed), limit, window, block), held, limit)
        links = links.unionByName(stage(more))
    return components(links).withColumnRenamed("node", "rep")


_LINKS = "rep long, links long"


def _within(rows: pd.DataFrame, other: pd.DataFrame, limit: float) -> np.ndarray:
    """For each of rows the vectors of other, counted with their copies, whose cosine reaches the limit."""
    return ((_units(rows["vector"]) @ _units(other["vector"]).T) >= limit) @ other["n"].to_numpy()


def small_links(members: DataFrame, limit: float) -> DataFrame:
    """(rep, links) in components of bounded size; they are taken one after the other from partitions sorted by root."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        left = None
        for b in batches:
            left = b if left is None else pd.concat([left, b], ignore_index=True)
            roots = left["root"].to_numpy()
            if len(cut := np.flatnonzero(roots[1:] != roots[:-1])):
                last = int(cut[-1]) + 1
                yield from pieces(left.iloc[:last])
                left = left.iloc[last:].reset_index(drop=True)
        if left is not None:
            yield from pieces(left)

    def pieces(b: pd.DataFrame) -> Iterator[pd.DataFrame]:
        for _, own in b.groupby("root", sort=False):
            yield pd.DataFrame({"rep": own["rep"], "links": _within(own, own, limit)})

    return members.repartition("root").sortWithinPartitions("root").select("root", "rep", "n", "vector").mapInPandas(run, _LINKS)


def large_links(members: DataFrame, limit: float, block: int) -> DataFrame:
    """(rep, links) in components of more than block classes, in blocks of about that size.

    Where all vectors lie within half the limit's angle of the component's centre, all link; this takes sums over blocks. The others
    are compared block by block, each pair of blocks in a task of its own, and only counts leave it.
    """
    at = placed(members.select("root", "rep", "n", "vector"), "root", "rep")
    first = at.groupBy("root").agg(F.min("place").alias("start"), F.count("*").alias("size"), F.sum("n").alias("all"))
    at = stage(at.join(first, "root").withColumn("block", F.floor((F.col("place") - F.col("start")) / block).cast("long")).drop("place", "start"))
    shape = "root long, block long, total array<double>"

    def sums(b: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"root": b["root"][:1], "block": b["block"][:1], "total": [_units(b["vector"]).sum(0)]})

    totals = at.groupBy("root", "block").applyInPandas(sums, shape).select("root", F.posexplode("total").alias("i", "x"))
    centre = totals.groupBy("root", "i").agg(F.sum("x").alias("x")).groupBy("root").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda v: v["x"]).alias("centre"))
    blocks = stage(at.select("root", "block").distinct().join(centre, "root"))
    half = math.acos(limit) / 2 - 1e-6

    def widest(key: tuple, b: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        near = np.clip(_units(b["vector"]) @ _units(c["centre"])[0], -1, 1) if np.any(c["centre"][0]) else np.array([-1.0])
        return pd.DataFrame({"root": [key[0]], "tight": [bool(np.arccos(near).max() <= half)]})

    tight = stage(at.groupBy("root", "block").cogroup(blocks.groupBy("root", "block")).applyInPandas(widest, "root long, tight boolean").groupBy("root").agg(F.min("tight").alias("tight")))
    judged = at.join(tight, "root")
    whole = judged.where("tight").select("rep", F.col("all").alias("links"))
    # each of the others travels to all blocks of its component, from its own block's side
    count = F.ceil(F.col("size") / block)
    sent = judged.where("not tight").withColumn("to", F.explode(F.sequence(F.lit(0).cast("long"), count - 1)))
    # the pair of blocks (x, y), x <= y, has a task: both blocks meet there
    low, high = F.least("block", "to").alias("x"), F.greatest("block", "to").alias("y")
    met = sent.select("root", low, high, "block", "rep", "n", "vector")

    def between(key: tuple, b: pd.DataFrame) -> pd.DataFrame:
        _, x, y = key
        own, other = b[b["block"] == x], b[b["block"] == y]
        if x == y:
            return pd.DataFrame({"rep": own["rep"], "links": _within(own, own, limit)})
        return pd.DataFrame({"rep": pd.concat([own["rep"], other["rep"]]), "links": np.concatenate([_within(own, other, limit), _within(other, own, limit)])})

    return whole.unionByName(met.groupBy("root", "x", "y").applyInPandas(between, _LINKS).groupBy("rep").agg(F.sum("links").alias("links")))


def near_vectors(vectors: DataFrame, limit: float = LIMIT, window: int = WINDOW, block: int = BLOCK, seed: int = SEED, miss: float = MISS, vector: str = "embedding") -> DataFrame:
    """vec_id, n_links, component_id, kept for each row of vectors.

    vectors: vec_id, label and an array of numbers; further columns are ignored. Rows link if their labels are equal and not null, their
    arrays have equal lengths and the cosine in double precision reaches the limit. Null and zero vectors, and those that
    hold null or a number that is not finite, link with nothing and are components of their own. Repeated rows are rows of their own that link
    with one another. A row without vec_id takes part; the smallest known vec_id names its component, which is null where none
    is known. An empty table gives an empty one.
    """
    if not 0.5 <= limit <= 1:
        raise ValueError("limit must be within 0.5 and 1")
    named = stage(vectors.select("vec_id", "label", F.col(vector).alias("embedding")).withColumn("_row", F.monotonically_increasing_id()))
    own = linkable(named.select(F.col("_row").alias("vec_id"), "label", "embedding"))
    rows, held = classes(own)
    rows = stage(rows)
    roots = stage(united(held, limit, window, block, seed, miss))
    sizes = roots.groupBy("root").agg(F.count("*").alias("size"))
    members = stage(held.join(roots, "rep").join(sizes, "root"))
    counted = small_links(members.where(F.col("size") <= block), limit)
    large = members.where(F.col("size") > block)
    if not large.isEmpty():
        counted = counted.unionByName(large_links(large, limit, block))
    # a class's own copies link too; a row is no link of itself
    by_class = held.select("rep", "n").join(counted, "rep", "left").join(roots, "rep", "left").select("rep", (F.coalesce("links", "n") - 1).alias("n_links"), F.coalesce("root", "rep").alias("root"))
    out = named.select("vec_id", "_row").join(rows.select(F.col("vec_id").alias("_row"), "rep"), "_row", "left").join(by_class, "rep", "left")
    out = stage(out.select("vec_id", "_row", F.coalesce("n_links", F.lit(0)).alias("n_links"), "root"))
    names = out.where("root is not null").groupBy("root").agg(F.min("vec_id").alias("least"))
    out = out.join(names, "root", "left").withColumn("component_id", F.when(F.col("root").isNull(), F.col("vec_id")).otherwise(F.col("least")))
    return out.select("vec_id", "n_links", "component_id", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)).alias("kept"))
