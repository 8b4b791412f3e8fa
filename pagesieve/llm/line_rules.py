"""Quality rules: per-document base rules and cross-document line frequency.

Lines are normalised (A-Z to a-z, white space to one blank, digit runs to 0) and hashed. For each host the distinct documents
that hold a line are counted; a line above the limit is removed from all of them. Documents that keep too small a share of
their words are rejected.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import boxed, row_key, stage, unboxed
from .words import windows, word_hashes

MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
#: Documents of a host that may hold a line.
MAX_DOCS = 20
MIN_LEFT_PERCENT = 30
#: Parts of a key in the join of lines with the frequent ones: a line may stand in a third of all documents.
SALTS = 16
_WHITE, _SYMBOLS = " \t\n\x0b\x0c\r", "#*$%&|<>"
_BLANKS, _DIGITS = re.compile(r"[ \t-\r]+"), re.compile(r"[0-9]+")
_UPPER_TO_LOWER = {i: i + 32 for i in range(65, 91)}


def normalised(line: str) -> str:
    return _DIGITS.sub("0", _BLANKS.sub(" ", line.translate(_UPPER_TO_LOWER))).strip(" ")


def line_hash(line: str) -> int:
    return xxhash.xxh3_64_intdigest(normalised(line).encode("utf-8", "surrogatepass")) - (1 << 63)


def repeated_words(h: np.ndarray) -> int:
    """Words inside 3-word windows that occur at least twice."""
    if len(h) < 4:
        return 0
    w = windows(h, 3)
    s = np.sort(w)
    twice = s[1:][s[1:] == s[:-1]]
    if not len(twice):
        return 0
    hit = np.isin(w, twice)
    covered = np.zeros(len(h), bool)
    for i in range(3):
        covered[i : i + len(w)] |= hit
    return int(covered.sum())


def _key():
    """Equal rows have equal keys; results of equal rows are equal."""
    return row_key(F.col("doc_id"), F.col("source"), F.col("text"))


_MEASURES = "key binary, doc_id long, host string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, hashes array<long>, words array<int>"


def measure(docs: DataFrame) -> DataFrame:
    """One row for each document: base measures, and its distinct line hashes with the words in these lines."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for key, doc_id, host, text, h in zip(b["key"], b["doc_id"].astype("Int64"), b["source"], b["text"], word_hashes(b["text"]), strict=True):
                text = text or ""
                lines = [x for x in text.split("\n") if x.strip(_WHITE)]
                found: dict[int, int] = {}
                for x in lines:
                    k = line_hash(x)
                    found[k] = found.get(k, 0) + len(x.encode("utf-8", "surrogatepass").split())
                chars = len(text) - sum(map(text.count, _WHITE))
                rows.append((key, doc_id, host or "", len(h), chars, sum(map(text.count, _SYMBOLS)), len(lines) - len(set(lines)), repeated_words(h), list(found), list(found.values())))
            out = pd.DataFrame(rows, columns=[x.split()[0] for x in _MEASURES.split(", ")])
            yield out.assign(doc_id=out["doc_id"].astype("Int64"))

    return docs.select("doc_id", "source", "text").withColumn("key", _key()).mapInPandas(run, _MEASURES)


def frequent_lines(measures: DataFrame, max_docs: int) -> DataFrame:
    """(host, hash) of the lines in more than max_docs distinct documents of a host; rows without doc_id differ by their key."""
    who = F.coalesce("doc_id", F.xxhash64("key")).alias("who")
    held = measures.select("host", who, F.explode("hashes").alias("hash")).distinct()
    return held.groupBy("host", "hash").agg(F.count("*").alias("docs")).where(F.col("docs") > max_docs).select("host", "hash")


def removed_lines(measures: DataFrame, frequent: DataFrame) -> DataFrame:
    """(key, removed_words, removed): what each document loses; documents that lose nothing have no row.

    Every frequent line stands in many documents, so SALTS copies of it are fewer than the lines.
    """
    lines = measures.select("key", "host", F.explode(F.arrays_zip("hashes", "words")).alias("x"), F.pmod(F.xxhash64("key"), F.lit(SALTS)).alias("salt"))
    lines = lines.select("key", "host", "salt", F.col("x.hashes").alias("hash"), F.col("x.words").alias("n"))
    salted = frequent.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    lost = lines.join(salted, ["host", "hash", "salt"]).select("key", "hash", "n")
    once = lost.repartition("key").dropDuplicates(["key", "hash"])  # equal rows share a key
    return once.groupBy("key").agg(F.sum("n").alias("removed_words"), F.collect_list("hash").alias("removed"))


def judge(docs: DataFrame, max_docs: int = MAX_DOCS, min_left_percent: float = MIN_LEFT_PERCENT) -> DataFrame:
    """key, doc_id, base measures, removed_words, removed (line hashes), base_failed and kept for each row of docs.

    docs: doc_id, text, source (the host); further columns are ignored. Null and empty texts have no words and fail the base
    rules. A null source is the host ''. Rows that repeat a doc_id count as one document of their host, rows without a doc_id
    as one if their texts are equal. An empty table gives an empty one.
    """
    measures = stage(measure(docs))
    lost = removed_lines(measures, frequent_lines(measures, max_docs))
    out = measures.drop("hashes", "words", "host").join(lost, "key", "left").withColumn("removed_words", F.coalesce("removed_words", F.lit(0)))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    left = 100 * (F.col("n_words") - F.col("removed_words")) >= min_left_percent * F.col("n_words")
    return out.withColumn("base_failed", failed).withColumn("kept", ~failed & left)


def apply_rules(docs: DataFrame, **limits) -> DataFrame:
    """The kept documents in the columns of docs, without their removed lines; n_chars follows the text if there is one.

    Cases as in judge(); repeated rows stay repeated. Columns of docs may have any names.
    """
    verdicts = judge(docs, **limits).where("kept").select("key", F.coalesce("removed", F.array().cast("array<long>")).alias("removed")).dropDuplicates(["key"])
    keyed = boxed(docs).withColumn("key", row_key(*[F.col("row")[c] for c in ("doc_id", "source", "text")]))
    kept = keyed.join(verdicts, "key").withColumn("text", F.col("row")["text"])

    @F.pandas_udf("string")
    def without(text: pd.Series, removed: pd.Series) -> pd.Series:
        def cut(t: str, gone) -> str:
            gone = set(gone)
            return "\n".join(x for x in t.split("\n") if not x.strip(_WHITE) or line_hash(x) not in gone)

        return pd.Series([t if t is None or not len(r) else cut(t, r) for t, r in zip(text, removed, strict=True)])

    # only texts that lose a line pass through Python
    whole, cut = kept.where("size(removed) = 0"), kept.where("size(removed) > 0").withColumn("text", without("text", "removed"))
    return unboxed(whole.unionByName(cut), docs, F.col("text"), F.size("removed") > 0)
