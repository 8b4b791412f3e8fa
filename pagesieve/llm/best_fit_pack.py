"""Token-id output: best-fit-decreasing packing of the whole table into binary id matrices.

Every document is tokenized, ended by END and cut at the multiples of a sequence. The histogram of the exact piece lengths
is packed best fit decreasing on counts: longest first, each into the fullest open sequence that still has room, which a segment
tree over free rooms finds; sequences with equal contents are one group. Pieces are ranked within their length, and a
group's slots are dealt out in rank order, so the result does not depend on how the input is split. Only the histogram
and the groups, whose numbers depend on the sequence length alone, reach the driver; full pieces are sequences of their own and
are not shuffled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stage
from .cutting_stock import ranked, token_pieces
from .tokens import VOCABULARY

LENGTH = 2048
#: Little-endian bytes of an id; both vocabularies of 50,000 entries fit into two.
WIDTH = 2
PAD = 0

Group = tuple[list[tuple[int, int]], int]


class CapacityTree:
    """Counts of open sequences by free room, as a segment tree that finds the least room of at least n."""

    def __init__(self, length: int):
        self.leaves = 1 << length.bit_length()
        self.count = [0] * (2 * self.leaves)

    def add(self, room: int, by: int) -> None:
        i = room + self.leaves
        while i:
            self.count[i] += by
            i >>= 1

    def least(self, n: int) -> int | None:
        """The smallest room >= n of an open sequence."""
        i = n + self.leaves
        if self.count[i]:
            return n
        while i > 1:
            if not i & 1 and self.count[i + 1]:
                i += 1
                while i < self.leaves:
                    i = 2 * i if self.count[2 * i] else 2 * i + 1
                return i - self.leaves
            i >>= 1
        return None


def best_fit_decreasing(demand: dict[int, int], length: int) -> list[Group]:
    """(contents, sequences) for so many pieces of each length from 1 to length; contents: (length, pieces) from the longest on.

    A sequence that takes a piece and has room for another of the same length is the fullest with room for it, so each
    takes all it can hold before the next one. At most three groups are new for each length.
    """
    tree, open_by_room, closed = CapacityTree(length), {}, []

    def put(contents: list[tuple[int, int]], sequences: int, room: int) -> None:
        if not sequences:
            return
        if room:
            open_by_room.setdefault(room, []).append((contents, sequences))
            tree.add(room, sequences)
        else:
            closed.append((contents, sequences))

    for size in sorted(demand, reverse=True):
        left = demand[size]
        while left:
            room = tree.least(size)
            if room is None:
                room, contents, there = length, [], left
            else:
                contents, there = open_by_room[room].pop()
                tree.add(room, -there)
            each = room // size
            whole = min(there, left // each)
            put([*contents, (size, each)], whole, room - each * size)
            left, there = left - whole * each, there - whole
            if left and there:  # fewer than each: one sequence takes them
                put([*contents, (size, left)], 1, room - left * size)
                left, there = 0, there - 1
            if contents:
                put(contents, there, room)
    return closed + [g for room in sorted(open_by_room) for g in open_by_room[room]]


_SLOT = "length long, from_rank long, to_rank long, each long, first long, at long"


def slots(groups: list[Group]) -> list[tuple[int, ...]]:
    """(length, from_rank, to_rank, each, first, at): pieces of these ranks go, each in a sequence, to first and on, from offset at."""
    out, taken, first = [], {}, 0
    for contents, sequences in groups:
        at = 0
        for size, each in contents:
            done = taken.get(size, 0)
            taken[size] = done + each * sequences
            out.append((size, done, taken[size], each, first, at))
            at += each * size
        first += sequences
    return out


def _numbers(to: int) -> bytes:
    return b"".join(i.to_bytes(4, "little") for i in range(to + 1))


def packed_matrices(docs: DataFrame, length: int = LENGTH, vocabulary: str = VOCABULARY, width: int = WIDTH) -> DataFrame:
    """One row for each sequence, in no order: ids (length ids of width bytes, padded by PAD), n_tokens, cu_seqlens (0 and the
    end of each segment) and position_ids (from 0 in each segment and in the padding), both of four bytes, all little-endian
    binary; doc_ids and starts of the segments (the segment's place in its document's ids).

    docs: doc_id, text; further columns are ignored. A document's ids end with END; documents longer than a sequence are
    split at its multiples, so every id is written once. Null and empty texts give the one id END. Repeated rows
    are written as often as they occur; equal rows are interchangeable. An empty table gives an empty one. ids of
    width 2 need a vocabulary of at most 65,536 entries; ValueError in the task otherwise.
    """
    pieces = stage(token_pieces(docs, length, vocabulary, width))
    rest = pieces.where(F.col("length") < length)
    demand = {r["length"]: r["count"] for r in rest.groupBy("length").count().collect()}  # at most length rows
    places = docs.sparkSession.createDataFrame(slots(best_fit_decreasing(demand, length)), _SLOT)
    # at most 3 * length groups, whatever the input
    dealt = ranked(rest.withColumn("class", F.col("length"))).join(F.broadcast(places), "length").where("rank >= from_rank AND rank < to_rank")
    turn = F.col("rank") - F.col("from_rank")
    placed = dealt.select((F.col("first") + F.expr("(rank - from_rank) div each")).alias("sequence"), F.struct((F.col("at") + F.pmod(turn, F.col("each")) * F.col("length")).alias("at"), "length", "doc_id", "start", "ids").alias("piece"))
    held = placed.groupBy("sequence").agg(F.array_sort(F.collect_list("piece"), lambda a, b: (a["at"] - b["at"]).cast("int")).alias("pieces")).drop("sequence")
    full = pieces.where(F.col("length") == length).select(F.array(F.struct(F.lit(0).cast("long").alias("at"), "length", "doc_id", "start", "ids")).alias("pieces"))

    table = F.lit(_numbers(length))
    joined = lambda parts: F.aggregate(parts, F.lit(b""), lambda a, x: F.concat(a, x))
    number = lambda n: F.substring(table, (4 * n + 1).cast("int"), F.lit(4))
    count_up = lambda n: F.substring(table, F.lit(1), (4 * n).cast("int"))
    total = F.aggregate("pieces", F.lit(0).cast("long"), lambda a, p: a + p["length"])
    out = held.unionByName(full).withColumn("n_tokens", total.cast("int"))
    ends = F.concat(F.transform("pieces", lambda p: p["at"]), F.array(F.col("n_tokens").cast("long")))
    runs = F.concat(F.transform("pieces", lambda p: p["length"]), F.array((F.lit(length) - F.col("n_tokens")).cast("long")))
    return out.select(
        F.rpad(joined(F.col("pieces.ids")), width * length, F.lit(PAD.to_bytes(width, "little"))).alias("ids"), "n_tokens",
        joined(F.transform(ends, number)).alias("cu_seqlens"), joined(F.transform(runs, count_up)).alias("position_ids"),
        F.col("pieces.doc_id").alias("doc_ids"), F.col("pieces.start").alias("starts"),
    )
