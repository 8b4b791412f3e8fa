"""Ranked lexical search by presence masks.

One pass over the documents keeps, for each, the number of its terms and the query terms in it with their counts; document frequencies
and the corpus' sizes are sums over that table. Then each task takes its documents in blocks. For every term of the items a block has the
bitmap of the documents that hold it; or-ing an item's bitmaps, each shifted to the term's place, gives every document's mask of matched terms. All
documents of one mask share a maximum score: the sum, over the mask's terms, of the most that a term adds to any document of
the block. Distinct masks are evaluated by descending maximum, and an item is finished once its worst kept score exceeds the next maximum. What is kept
goes along from block to block, so that later blocks end early; a task gives at most the wanted number of documents an item.

Items are a stated set of queries. They are taken in groups of ITEMS, whose terms alone go to the tasks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from functools import reduce
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stage
from .words import word_hashes

BEST, ITEMS = 10, 2_000
#: Documents of a block, and masks that are evaluated together.
BLOCK, STEP = 8_192, 64
#: Bytes of a term: ASCII letters and digits and all beyond ASCII.
TERM = np.array([b > 127 or chr(b).isalnum() for b in range(256)], np.uint8)
_HELD = "doc_id long, n long, terms array<int>, counts array<int>"
_FOUND = "item_id long, doc_id long, score long"


def impact(count: np.ndarray, m: np.ndarray) -> np.ndarray:
    return (1_000_000_000 * count) // (1000 * count + 8 * m)


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


class Items(NamedTuple):
    """known: the sorted hashes of all terms. of: for each item its id, the places of its terms in known, and how often it repeats each."""

    known: np.ndarray
    of: list[tuple[int, np.ndarray, np.ndarray]]


def items_of(ids: Sequence, texts: Sequence) -> Items:
    each = [np.unique(h, return_counts=True) for h in word_hashes(texts, True, TERM)]
    known = np.unique(np.concatenate([np.empty(0, np.uint64), *[e[0] for e in each]]))
    return Items(known, [(i, np.searchsorted(known, h), c) for i, (h, c) in zip(ids, each, strict=True)])


def matched_terms(docs: DataFrame, known: np.ndarray) -> DataFrame:
    """(doc_id, n, terms, counts) of the documents with at least one term; terms are places in known."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for doc_id, hashes in zip(b["doc_id"].astype("Int64"), word_hashes(b["text"], True, TERM), strict=True):
                if len(hashes):
                    at = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
                    terms, counts = np.unique(at[known[at] == hashes], return_counts=True)
                    rows.append((doc_id, len(hashes), terms.astype(np.int32), counts.astype(np.int32)))
            out = pd.DataFrame(rows, columns=["doc_id", "n", "terms", "counts"])
            yield out.assign(doc_id=out["doc_id"].astype("Int64"))

    return docs.select("doc_id", "text").mapInPandas(run, _HELD)


def document_counts(held: DataFrame, n_terms: int) -> np.ndarray:
    """How many documents hold each term; each task sends one row a term at most."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(n_terms, np.int64)
        for b in batches:
            if len(b):
                total += np.bincount(np.concatenate(b["terms"].to_numpy()).astype(np.int64), minlength=n_terms)
        (at,) = np.nonzero(total)
        yield pd.DataFrame({"term": at, "df": total[at]})

    out = np.zeros(n_terms, np.int64)
    for r in held.select("terms").mapInPandas(run, "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).toLocalIterator():
        out[r["term"]] = r["df"]
    return out


class _Block(NamedTuple):
    """docs: ids. at, start: the documents of each term, term by term. terms, add, first: each document's terms and what they add
    without their weight, document by document. most: the most that a term adds."""

    docs: np.ndarray
    at: np.ndarray
    start: np.ndarray
    terms: np.ndarray
    add: np.ndarray
    first: np.ndarray
    most: np.ndarray


def block_of(b: pd.DataFrame, n_terms: int, n_docs: int, n_all: int) -> _Block:
    m = 25 + (75 * b["n"].to_numpy(np.int64) * n_docs) // n_all
    sizes = b["terms"].map(len).to_numpy(np.int64)
    terms = np.concatenate([np.empty(0, np.int32), *b["terms"]]).astype(np.int64)
    counts = np.concatenate([np.empty(0, np.int32), *b["counts"]]).astype(np.int64)
    rows = np.repeat(np.arange(len(b)), sizes)
    add = impact(counts, m[rows])
    order = np.argsort(terms, kind="stable")
    most = np.zeros(n_terms, np.int64)
    np.maximum.at(most, terms, add)
    return _Block(b["doc_id"].to_numpy(), rows[order], np.searchsorted(terms[order], np.arange(n_terms + 1)), terms, add, np.concatenate([[0], np.cumsum(sizes)]), most)


def scores_of(block: _Block, chosen: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """The scores of some documents. weights: of every known term, 0 for those that the item doesn't hold."""
    sizes = block.first[chosen + 1] - block.first[chosen]
    ends = np.cumsum(sizes)
    places = np.arange(ends[-1]) + np.repeat(block.first[chosen] - (ends - sizes), sizes)
    sums = np.concatenate([[0], np.cumsum(weights[block.terms[places]] * block.add[places])])
    return sums[ends] - sums[ends - sizes]


def masks_of(block: _Block, terms: np.ndarray) -> np.ndarray:
    """For each document of the block the mask of the item's terms that it holds, in words of 64 bits."""
    masks = np.zeros((len(block.docs), -(-max(1, len(terms)) // 64)), np.uint64)
    for j, t in enumerate(terms):
        masks[block.at[block.start[t] : block.start[t + 1]], j // 64] |= np.uint64(1 << (j % 64))
    return masks


def best_of_block(block: _Block, terms: np.ndarray, weights: np.ndarray, kept: list[tuple[int, int]], best: int) -> list[tuple[int, int]]:
    """The best (-score, doc_id) of those kept so far and of the block. weights: of the item's terms, repeats included."""
    masks = masks_of(block, terms)
    groups, of = np.unique(masks, axis=0, return_inverse=True) if masks.shape[1] > 1 else np.unique(masks[:, 0], return_inverse=True)
    groups, of = groups.reshape(len(groups), -1), of.reshape(-1)
    worth = weights * block.most[terms]
    maximum = np.zeros(len(groups), np.int64)
    for j, w in enumerate(worth):
        maximum += np.where(groups[:, j // 64] >> np.uint64(j % 64) & np.uint64(1), w, 0)
    order = np.argsort(-maximum, kind="stable")
    known = np.zeros(len(block.most), np.int64)
    known[terms] = weights
    members, first = np.argsort(of, kind="stable"), np.searchsorted(np.sort(of), np.arange(len(groups) + 1))
    for at in range(0, len(order), STEP):
        # a document of the same score and a smaller id may still take the last place
        if maximum[order[at]] <= 0 or len(kept) == best and maximum[order[at]] < -kept[-1][0]:
            break
        chosen = np.concatenate([members[first[g] : first[g + 1]] for g in order[at : at + STEP]])
        found = [(-int(x), _place(block.docs[i])) for i, x in zip(chosen, scores_of(block, chosen, known), strict=True) if x > 0 and (len(kept) < best or x >= -kept[-1][0])]
        kept = sorted(kept + found)[:best]
    return kept


#: A row without doc_id comes behind all others of its score.
_LAST = 1 << 63


def _place(doc_id) -> int:
    return _LAST if pd.isna(doc_id) else int(doc_id)


def ranked_group(docs: DataFrame, items: Items, best: int, block: int) -> DataFrame:
    """(item_id, doc_id, score): the best documents of each task."""
    n_terms = len(items.known)
    held = stage(matched_terms(docs, items.known))
    sums = held.agg(F.count("*"), F.sum("n")).first()
    n_docs, n_all = sums[0], sums[1] or 1
    df = document_counts(held, n_terms)
    weights = np.array([weight(n_docs, int(x)) for x in df], np.int64)
    of = [(i, terms, counts * weights[terms]) for i, terms, counts in items.of]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept: list[list[tuple[int, int]]] = [[] for _ in of]
        for b in _blocks(batches, block):
            own = block_of(b, n_terms, n_docs, n_all)
            for k, (_, terms, w) in enumerate(of):
                if len(terms):
                    kept[k] = best_of_block(own, terms, w, kept[k], best)
        rows = [(i, d if d != _LAST else None, -s) for (i, _, _), found in zip(of, kept, strict=True) for s, d in found]
        out = pd.DataFrame(rows, columns=["item_id", "doc_id", "score"])
        yield out.assign(item_id=out["item_id"].astype("Int64"), doc_id=out["doc_id"].astype("Int64"))

    return held.mapInPandas(run, _FOUND)


def _blocks(batches: Iterator[pd.DataFrame], size: int) -> Iterator[pd.DataFrame]:
    held, n = [], 0
    for b in batches:
        for at in range(0, len(b), size):
            held.append(b.iloc[at : at + size])
            n += len(held[-1])
            if n >= size:
                yield pd.concat(held, ignore_index=True)
                held, n = [], 0
    if n:
        yield pd.concat(held, ignore_index=True)


def search(docs: DataFrame, items: DataFrame, best: int = BEST, block: int = BLOCK, group: int = ITEMS) -> DataFrame:
    """item_id, rank, doc_id, score: the best documents above score 0 for each row of items.

    docs: doc_id, text; items: item_id, text; further columns are ignored. Null and empty texts have no terms; an item without terms has
    no row. Rows that repeat a doc_id are ranked each; of equal scores the smaller doc_id comes first, a null one last. Items that repeat an item_id, or
    have none, are searched as one of its rows (the smallest text). An empty table on either side gives an empty one. Terms compare by 64-bit hashes.
    """
    asked = items.select("item_id", "text").where("text is not null").groupBy("item_id").agg(F.min("text").alias("text"))
    found, ids, texts = [], [], []
    rows = asked.orderBy("item_id").toLocalIterator()
    for r in rows:
        ids.append(r["item_id"])
        texts.append(r["text"])
        if len(ids) == group:
            found.append(_group(docs, ids, texts, best, block))
            ids, texts = [], []
    found.append(_group(docs, ids, texts, best, block))
    order = Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return reduce(DataFrame.unionByName, found).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= best).select("item_id", "rank", "doc_id", "score")


def _group(docs: DataFrame, ids: list, texts: list, best: int, block: int) -> DataFrame:
    items = items_of(ids, texts)
    if not len(items.known):
        return docs.sparkSession.createDataFrame([], _FOUND)
    return ranked_group(docs, items, best, block)
