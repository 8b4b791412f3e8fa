"""Packing by cutting-stock column generation.

Every document is tokenized, ended by END and cut into full sequences and one rest. The histogram of
piece lengths, in steps of GRAIN tokens, is the demand of a cutting-stock problem whose stock are sequences of a
fixed length. Its linear program (how often each pattern of lengths is used) starts with one pattern a
length; a knapsack dynamic program over the dual prices adds the pattern that pays most until none pays.
The basis is rounded: down first, and the pieces left over go best fit decreasing, all on counts. Pieces are
ranked within their length class and the class's slots are dealt out in rank order, so that only the histogram
and the patterns, whose sizes depend on GRAIN alone, reach the driver.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stage
from .tokens import VOCABULARY, encoder

LENGTH = 2048
GRAIN = 16
#: Relative raise of the demands in the linear program; it moves no rounded count.
SLACK = 1e-9
#: The simplex may take this many rounds for each length; it is known to need about eight.
MOST_ROUNDS = 400


def token_pieces(docs: DataFrame, length: int = LENGTH, vocabulary: str = VOCABULARY, width: int = 0) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens[, ids]): full sequences from the front and the rest.

    width: bytes of an id in ids, 4 or 2, little-endian; without it there is no such column. The checksum is that of four-byte ids.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            own = encoder(vocabulary)
            rows = []
            for doc_id, text in zip(b["doc_id"].astype("Int64"), b["text"], strict=True):
                ids = own.ids(text)
                if width == 2 and int(ids.max()) >> 16:
                    raise ValueError("ids of this vocabulary need four bytes")
                for at in range(0, len(ids), length):
                    cut = ids[at : at + length]
                    kept = (cut.astype(f"<u{width}").tobytes(),) if width else ()
                    rows.append((doc_id, at, len(cut), zlib.crc32(cut), len(ids), *kept))
            out = pd.DataFrame(rows, columns=["doc_id", "start", "length", "ids_crc32", "doc_tokens", *(("ids",) if width else ())])
            yield out.assign(doc_id=out["doc_id"].astype("Int64"))

    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long" + ", ids binary" * bool(width)
    return docs.select("doc_id", "text").mapInPandas(run, schema)


def best_pattern(price: np.ndarray, room: int) -> tuple[float, np.ndarray]:
    """Unbounded knapsack: counts of lengths 1..room with the highest total price; price[i] belongs to length i + 1."""
    value, last = np.zeros(room + 1), np.zeros(room + 1, np.int64)
    for w in range(1, room + 1):
        gains = price[:w] + value[w - 1 :: -1][:w]
        i = int(np.argmax(gains))
        value[w], last[w] = (gains[i], i + 1) if gains[i] > value[w - 1] + 1e-12 else (value[w - 1], 0)
    pattern, w = np.zeros(room, np.int64), room
    while w > 0:
        if last[w]:
            pattern[last[w] - 1] += 1
            w -= last[w]
        else:
            w -= 1
    return float(value[room]), pattern


def inverted(matrix: np.ndarray) -> np.ndarray:
    """The inverse by elimination with the largest pivots.

    Not by LAPACK: the driver shares its cores with Spark's threads, where the spinning threads of a BLAS pool can stall for minutes.
    """
    n = len(matrix)
    work = np.concatenate([matrix.astype(float), np.eye(n)], axis=1)
    for i in range(n):
        best = i + int(np.argmax(np.abs(work[i:, i])))
        if work[best, i] == 0:
            raise ArithmeticError("the basis of the patterns is singular")
        work[[i, best]] = work[[best, i]]
        work[i] /= work[i, i]
        factor = work[:, i].copy()
        factor[i] = 0
        work -= factor[:, None] * work[i]
    return work[:, n:]


def column_generation(demand: np.ndarray, room: int) -> tuple[np.ndarray, np.ndarray]:
    """Basic patterns (columns) and how often each is used, in the linear program that covers the demand.

    A simplex with the basis inverse: each round prices all patterns by one knapsack. It ends when no
    pattern's price exceeds the one sequence that it costs. The demand is raised by multiples of SLACK that differ by length, which
    breaks the ties in which a simplex may go round in circles; after MOST_ROUNDS rounds a length it raises ArithmeticError.
    """
    wanted = np.flatnonzero(demand)
    n = len(wanted)
    # one length a pattern, as often as it fits; that is a diagonal basis
    basis = np.diag(room // (wanted + 1)).astype(float)
    inverse = np.diag(1 / np.diag(basis)) if n else np.zeros((0, 0))
    raised = demand[wanted] * (1 + SLACK * np.arange(1, n + 1))
    used, turn = np.diag(inverse) * raised, 0
    while n:
        price = np.zeros(room)
        price[wanted] = np.maximum(inverse.sum(0), 0)
        value, pattern = best_pattern(price, room)
        if value <= 1 + 1e-7:
            break
        column = pattern[wanted].astype(float)
        change = (inverse * column).sum(1)  # not by BLAS, whose threads are of no use at this size
        limits = np.where(change > 1e-9, used / np.where(change > 1e-9, change, 1), np.inf)
        out = int(np.argmin(limits))
        if not np.isfinite(limits[out]) or turn > MOST_ROUNDS * n:
            raise ArithmeticError(f"the linear program of the patterns does not end: {n} lengths, {turn} rounds, a pattern is worth {value:.9f} sequences")
        step = limits[out]
        used = used - step * change
        used[out] = step
        basis[:, out] = column
        row = inverse[out] / change[out]
        inverse = inverse - change[:, None] * row
        inverse[out] = row
        turn += 1
        if turn % 256 == 0:  # rounding errors add up
            inverse = inverted(basis)
            used = np.maximum((inverse * raised).sum(1), 0)
    patterns = np.zeros((n, room), np.int64)
    patterns[:, wanted] = np.rint(basis.T).astype(np.int64)
    return patterns, np.maximum((inverse * demand[wanted]).sum(1), 0)


def rounded_patterns(demand: np.ndarray, room: int) -> list[tuple[np.ndarray, int]]:
    """(pattern, sequences) whose pieces are exactly the demand: the basis rounded down, then the rest by best fit."""
    patterns, used = column_generation(demand, room)
    left, out = demand.astype(np.int64).copy(), []
    for pattern, x in sorted(zip(patterns, used, strict=True), key=lambda p: -p[1]):
        n = min(int(x + 1e-6), *(left[pattern > 0] // pattern[pattern > 0])) if pattern.any() else 0
        if n > 0:
            out.append((pattern, int(n)))
            left -= pattern * n
    while left.any():
        pattern, free = np.zeros(room, np.int64), room
        while free > 0 and (fits := np.flatnonzero(left[:free] > pattern[:free])).size:
            pattern[fits[-1]] += 1
            free -= int(fits[-1]) + 1
        n = int(min(left[pattern > 0] // pattern[pattern > 0]))
        out.append((pattern, n))
        left -= pattern * n
    return out


def slot_table(patterns: list[tuple[np.ndarray, int]]) -> dict[int, tuple[np.ndarray, ...]]:
    """For each length class: first rank, pieces a sequence, first sequence and place in the pattern, by pattern."""
    slots: dict[int, list[tuple[int, int, int, int]]] = {}
    taken: dict[int, int] = {}
    first = 0
    for pattern, n in patterns:
        place = 0
        for c in np.flatnonzero(pattern)[::-1]:
            m = int(pattern[c])
            slots.setdefault(int(c) + 1, []).append((taken.get(int(c) + 1, 0), m, first, place))
            taken[int(c) + 1] = taken.get(int(c) + 1, 0) + m * n
            place += m
        first += n
    return {c: tuple(np.array(x, np.int64) for x in zip(*rows, strict=True)) for c, rows in slots.items()}


def ranked(pieces: DataFrame) -> DataFrame:
    """Adds rank within the class, from 0. pieces: class, doc_id, start, ids_crc32, length and more.

    A class may hold a large share of all pieces, so ranks are counted within (class, slice) and moved by the
    counts of the slices before; the slices grow with the number of pieces.
    """
    slices = max(64, int(pieces.count() // 10_000))
    dealt = pieces.withColumn("slice", F.pmod(F.xxhash64("doc_id", "start"), F.lit(slices)).cast("int"))
    counts = dealt.groupBy("class", "slice").agg(F.count("*").alias("n"))
    before = Window.partitionBy("class").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    order = Window.partitionBy("class", "slice").orderBy("doc_id", "start", "ids_crc32", "length")
    return dealt.withColumn("own", F.row_number().over(order) - 1).join(counts, ["class", "slice"]).withColumn("rank", F.col("before") + F.col("own")).drop("own", "before", "slice")


def pack(docs: DataFrame, length: int = LENGTH, grain: int = GRAIN, vocabulary: str = VOCABULARY, with_ids: bool = False) -> DataFrame:
    """One row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset[, ids].

    docs: doc_id, text; further columns are ignored. The ids of a document are those of its text and END; each id lies in
    exactly one piece. Pieces of one sequence follow one another from offset 0; the rest of a sequence of
    length tokens is padding, except where what it holds is a power of two. Null and empty texts give the one id END. Repeated
    rows are packed as often as they occur; equal rows are interchangeable. An empty table gives an empty one.
    length must be a multiple of grain.
    """
    pieces = stage(token_pieces(docs, length, vocabulary, 4 * with_ids))
    room = length // grain
    demand = np.zeros(room, np.int64)
    kind = F.ceil(F.col("length") / grain).cast("int")
    for r in pieces.groupBy(kind.alias("class")).count().collect():  # at most room rows
        demand[r["class"] - 1] = r["count"]
    slots = slot_table(rounded_patterns(demand, room))

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            sequence, turn = np.zeros(len(b), np.int64), np.zeros(len(b), np.int64)
            kinds, ranks = b["class"].to_numpy(), b["rank"].to_numpy()
            for c in np.unique(kinds):
                rows = np.flatnonzero(kinds == c)
                from_rank, each, first, at = slots[int(c)]
                k = np.searchsorted(from_rank, ranks[rows], "right") - 1
                inside = ranks[rows] - from_rank[k]
                sequence[rows], turn[rows] = first[k] + inside // each[k], at[k] + inside % each[k]
            yield b.drop(columns=["class", "rank"]).assign(sequence_id=sequence, turn=turn)

    names = pieces.columns
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pieces.schema) + ", sequence_id long, turn long"
    placed = ranked(pieces.withColumn("class", kind)).select(*names, "class", "rank").mapInPandas(place, schema)
    before = Window.partitionBy("sequence_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    offset = F.coalesce(F.sum("length").over(before), F.lit(0)).alias("offset")
    return placed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", offset, *(("ids",) if with_ids else ()))
