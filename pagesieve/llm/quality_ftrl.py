"""Quality classifier: logistic regression on hashed word n-grams, trained by follow-the-regularised-leader.

Tokens are lower-cased runs of word characters and runs of other signs. A document's features are its one-
and two-token hashes, each weighing 1 / sqrt(number of tokens). Training takes at most SAMPLE labelled
documents (those whose hashed doc_id is smallest), dealt into SHARDS; each shard runs FTRL-proximal over its
rows, and the shards' weights are averaged. Scores are sparse dot products.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .words import windows, word_hashes

BITS = 18
SAMPLE, SHARDS, EPOCHS = 12_000, 6, 3
ALPHA, BETA, L1, L2 = 0.3, 1.0, 0.02, 0.1

_ALL = np.arange(256)
_WORDS = (_ALL >= 128) | ((_ALL >= 48) & (_ALL <= 57)) | ((_ALL >= 65) & (_ALL <= 90)) | ((_ALL >= 97) & (_ALL <= 122))
#: Classes of bytes: white space and controls, word characters (all of other scripts among them), signs.
_CLASSES = np.where(_ALL <= 32, 0, np.where(_WORDS, 1, 2)).astype(np.uint8)


def features(texts, bits: int = BITS) -> Iterator[np.ndarray]:
    """For each text the feature numbers of its tokens and token pairs, with repeats."""
    mask = np.uint64((1 << bits) - 1)
    for h in word_hashes(texts, lower=True, classes=_CLASSES):
        yield (np.concatenate([h, windows(h, 2)[: max(0, len(h) - 1)]]) & mask).astype(np.int64)


def _sigmoid(x: float) -> float:
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def margin(weights: np.ndarray, ids: np.ndarray) -> float:
    """weights[-1] is the bias."""
    return float(weights[-1] + weights[ids].sum() / np.sqrt(max(1, len(ids))))


def ftrl(rows: list[tuple[np.ndarray, int]], bits: int, epochs: int, positive_weight: float) -> np.ndarray:
    """Weights after FTRL-proximal over the rows, in their order, epochs times."""
    n, z = np.zeros((1 << bits) + 1), np.zeros((1 << bits) + 1)
    bias = len(n) - 1

    def weight(i: np.ndarray) -> np.ndarray:
        free = np.sign(z[i]) * np.maximum(np.abs(z[i]) - L1, 0)
        return -free / ((BETA + np.sqrt(n[i])) / ALPHA + L2)

    packed = []
    for ids, y in rows:
        i, c = np.unique(ids, return_counts=True)
        packed.append((np.append(i, bias), np.append(c / np.sqrt(max(1, len(ids))), 1.0), y))
    for _ in range(epochs):
        for i, x, y in packed:
            w = weight(i)
            g = (_sigmoid(w @ x) - y) * x * (positive_weight if y else 1.0)
            change = (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / ALPHA
            z[i] += g - change * w
            n[i] += g * g
    return weight(np.arange(len(n)))


def train(labelled: DataFrame, shards: int = SHARDS, bits: int = BITS, epochs: int = EPOCHS) -> np.ndarray:
    """Averaged weights of the shards. labelled: doc_id, text, label (0 or 1); rows with nulls in doc_id or label are left out.

    The driver gets one array of fixed size from each shard. Without rows all weights are 0.
    """

    def fit(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["turn", "text"])
        rows = list(zip(features(group["text"], bits), group["label"].astype(int), strict=True))
        ones = sum(y for _, y in rows)
        balance = min(1.0, (len(rows) - ones) / ones) if ones else 1.0
        w = ftrl(rows, bits, epochs, balance**0.5)
        return pd.DataFrame({"weights": [w.astype("<f4").tobytes()]})

    turn = F.xxhash64("doc_id")
    chosen = labelled.where("doc_id is not null and label is not null").select(turn.alias("turn"), "text", F.col("label").cast("int").alias("label"))
    shard = F.pmod(F.col("turn"), F.lit(shards)).cast("int")
    found = chosen.withColumn("shard", shard).groupBy("shard").applyInPandas(fit, "weights binary").collect()
    arrays = [np.frombuffer(r["weights"], "<f4") for r in found]
    return np.mean(arrays, axis=0) if arrays else np.zeros((1 << bits) + 1, np.float32)


def score(docs: DataFrame, weights: np.ndarray, bits: int = BITS) -> DataFrame:
    """(doc_id, score) for each row of docs; null and empty texts get the score of the bias."""
    shared = docs.sparkSession.sparkContext.broadcast(weights.astype(np.float32))  # 2**bits numbers, whatever the input

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        w = shared.value
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"].astype("Int64"), "score": [_sigmoid(margin(w, ids)) for ids in features(b["text"], bits)]})

    return docs.select("doc_id", "text").mapInPandas(run, "doc_id long, score double")


def held_out() -> Column:
    """True for rows whose labels training may not see; a missing doc_id is held out."""
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3)) == 1, F.lit(True))


def classify(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score and predicted for each row of docs.

    docs: doc_id, text; labels: doc_id, quality; further columns are ignored. Of repeated labels of a doc_id the
    largest counts; of repeated documents each is a training row. Labels that are null or lack a document are
    left out. Without labels every score is 0.5. An empty table gives an empty one.
    """
    known = labels.where(~held_out()).where("quality is not null").groupBy("doc_id").agg(F.max("quality").alias("label"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)  # the documented sample of labelled rows
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # at most sample rows of two numbers
    weights = train(rows)
    scored = score(docs, weights)
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
