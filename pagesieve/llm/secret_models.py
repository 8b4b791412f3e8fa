"""Secret scans: patterns, and character Markov models of random strings and ordinary identifiers.

Labelled samples are the corpus's own: values of the base patterns are random strings, all other long
identifiers are ordinary. Both give a first-order Markov model over a fixed alphabet (counts of character
pairs over all documents, with add-one smoothing). A long token is a secret if its log-likelihood ratio per
character is above a threshold and it mixes letters and digits.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = ("assign", "access", "hex")
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
_HEX = re.compile(r"[0-9a-f]{16,}")
_IDENTIFIER = re.compile(r"[A-Za-z0-9+/_.=-]{12,}")
MIN_LENGTH, MIN_RATIO = 20, 0.7
#: Weight of the single-character model in rows of the pair model.
BACKOFF = 100.0
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_.=-"
SIZE = len(ALPHABET) + 1
_CODE = np.zeros(256, np.int64)
_CODE[np.frombuffer(ALPHABET.encode(), np.uint8)] = np.arange(1, SIZE)

Span = tuple[str, int, int]


def base_spans(text: str | None) -> list[Span]:
    """(kind, start, end) in code points, by start, then kind; of each kind leftmost and without overlaps.

    A match of assign spans keyword and value; those with a value under 12 characters are dropped.
    """
    if not text:
        return []
    out = [("assign", *m.span()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 12]
    out += [("access", *m.span()) for m in _ACCESS.finditer(text)]
    out += [("hex", *m.span()) for m in _HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0])))


def _value(text: str, span: Span) -> str:
    kind, a, b = span
    return _ASSIGN.match(text, a)[2] if kind == "assign" else text[a:b]


def identifiers(text: str, taken: list[Span]) -> Iterator[tuple[int, int]]:
    """Long identifiers outside the given spans."""
    at, spans = 0, sorted((a, b) for _, a, b in taken)
    for m in _IDENTIFIER.finditer(text):
        while at < len(spans) and spans[at][1] <= m.start():
            at += 1
        if at == len(spans) or spans[at][0] >= m.end():
            yield m.span()


def pair_counts(tokens: list[str]) -> np.ndarray:
    """Counts of (character before, character); the first character of a token follows 0."""
    if not tokens:
        return np.zeros(SIZE * SIZE, np.int64)
    codes = _CODE[np.frombuffer(("\0" + "\0".join(tokens)).encode(), np.uint8)]
    pair = codes[:-1] * SIZE + codes[1:]
    return np.bincount(pair[codes[1:] > 0], minlength=SIZE * SIZE)


def train(docs: DataFrame) -> np.ndarray:
    """Log-likelihood ratios (random against ordinary) of every character pair, as a SIZE x SIZE array.

    Only the sums of pair counts, at most 2 * SIZE**2 rows, reach the driver.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums = np.zeros((2, SIZE * SIZE), np.int64)
        for b in batches:
            secret, plain = [], []
            for t in b["text"]:
                if t:
                    spans = base_spans(t)
                    secret += [_value(t, s) for s in spans]
                    plain += [t[a:e] for a, e in identifiers(t, spans)]
            sums += [pair_counts(secret), pair_counts(plain)]
        label, pair = np.nonzero(sums)
        yield pd.DataFrame({"label": label, "pair": pair, "n": sums[label, pair]})

    rows = docs.select("text").mapInPandas(run, "label long, pair long, n long").groupBy("label", "pair").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros((2, SIZE, SIZE))
    for r in rows:
        counts[r["label"], r["pair"] // SIZE, r["pair"] % SIZE] += r["n"]
    counts = counts[:, :, 1:]
    single = counts.sum(1) + 0.5
    single /= single.sum(1, keepdims=True)
    counts = np.maximum(counts - 1, 0)  # a pair seen once may be the very token that is scored
    pairs = (counts + BACKOFF * single[:, None, :]) / (counts.sum(2, keepdims=True) + BACKOFF)
    logs = np.log(pairs)
    return np.concatenate([np.zeros((SIZE, 1)), logs[0] - logs[1]], axis=1)


def ratio(model: np.ndarray, token: str) -> float:
    """Log-likelihood ratio per character."""
    codes = _CODE[np.frombuffer(token.encode(), np.uint8)]
    return float(model[np.append(0, codes[:-1]), codes].mean()) if len(codes) else 0.0


def model_spans(model: np.ndarray, text: str, base: list[Span], min_length: int, min_ratio: float) -> list[Span]:
    out = []
    for a, b in identifiers(text, base):
        token = text[a:b]
        if b - a >= min_length and any(map(str.isdigit, token)) and any(map(str.isalpha, token)) and ratio(model, token) >= min_ratio:
            out.append(("random", a, b))
    return out


def find(docs: DataFrame, min_length: int = MIN_LENGTH, min_ratio: float = MIN_RATIO) -> DataFrame:
    """doc_id, base and spans (kind:start:end by start, then kind, joined by commas; spans has those of kind random too).

    docs: doc_id, text; further columns are ignored. Null and empty texts have no spans. Without labelled samples
    (an empty table, no base matches) the missing model is the even one of the smoothing. Repeated rows get
    equal results and count in training as often as they occur. An empty table gives an empty one.
    """
    model = train(docs)
    order = (*KINDS, "random")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            base, full = [], []
            for t in b["text"]:
                own = base_spans(t)
                more = model_spans(model, t, own, min_length, min_ratio) if t else []
                every = sorted(own + more, key=lambda s: (s[1], order.index(s[0])))
                base.append(",".join(f"{k}:{a}:{e}" for k, a, e in own))
                full.append(",".join(f"{k}:{a}:{e}" for k, a, e in every))
            yield pd.DataFrame({"doc_id": b["doc_id"].astype("Int64"), "base": base, "spans": full})

    return docs.select("doc_id", "text").mapInPandas(run, "doc_id long, base string, spans string")


def kind_count(parts: Column, kind: str) -> Column:
    return F.size(F.filter(parts, lambda x: x.startswith(f"{kind}:"))).cast("long")


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, counts by base kind, base_sha256 and spans for each row of docs."""
    parts = F.split("base", ",")
    counts = [kind_count(parts, k).alias(f"n_{k}") for k in KINDS]
    return find(docs).select("doc_id", *counts, F.sha2(F.col("base").cast("binary"), 256).alias("base_sha256"), "spans")
