"""Personal data: patterns, and information-theoretic sanitisation of what reveals them.

Protected entities are the base spans (email, ip, card, phone), by normalised value. Terms are the runs of letters
of their documents. Over the whole corpus, with N documents, the share of an entity's information that a term gives is

    log(N * p / docs(entity)) / log(N / docs(entity)),    p = docs(entity with term) / docs(term).

All terms that stand in a document with an entity are rated. Many pairs are, and most meet by chance, so a share counts as g or
more only if it is at least g with confidence 1 - 1 / pairs: with p0 = (N / docs(entity)) ** (g - 1), the p of share g,
docs(term) * KL(p, p0) must reach log(pairs) (Chernoff's bound for p, corrected for the number of pairs). At GENERALISE a
term's places in all documents are generalised, at REMOVE removed.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import boxed, row_key, stage, unboxed
from .words import encoded, pieces, run_hashes, word_hashes

KINDS = ("email", "ip", "card", "phone")
GENERALISE, REMOVE = 0.6, 0.9
#: Bits of the filter through which terms pass before they are joined.
BITS = 24
#: Up to so many disclosing terms tasks hold all of them (nine bytes each); more are joined with the terms of each document.
HELD = 1 << 20
#: Parts of a key in the join of pairs with their entities: one address may stand in a third of all documents.
SALTS = 16
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]+")
_TERM = re.compile(r"[A-Za-z\u0080-\U0010ffff]+")
#: The same for bytes: ASCII letters, and all bytes of other characters.
_LETTERS = np.array([b >= 128 or chr(b).isalpha() for b in range(256)], np.uint8)
_MAYBE = "[0-9@]"

Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    back = [int(x) for x in reversed(digits)]
    return (sum(back[::2]) + sum(sum(divmod(2 * x, 10)) for x in back[1::2])) % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Each @ with what may stand before and after it, in time proportional to the text."""
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            end = m.end()
            yield start, end
        at = text.find("@", max(at + 1, end))


def base_spans(text: str | None) -> list[Span]:
    """(kind, start, end) in code points by kind, then start; of each kind leftmost and without overlaps."""
    if not text:
        return []
    out = [("email", a, b) for a, b in emails(text)]
    out += [("ip", *m.span()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", *m.span()))
    out += [("phone", *m.span()) for m in _PHONE.finditer(text) if 9 <= len(_NOT_DIGIT.sub("", m[0])) <= 15]
    return out


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def _entity(text: str, span: Span) -> int:
    kind, a, b = span
    value = text[a:b].lower() if kind == "email" else text[a:b] if kind == "ip" else _NOT_DIGIT.sub("", text[a:b])
    return xxhash.xxh3_64_intdigest(f"{kind}:{value}") - (1 << 63)


def _term_key(term: str) -> int:
    return int(run_hashes(encoded(term, lower=True), _LETTERS)[0].view(np.int64)[0])


def masked(text: str, spans: list[Span]) -> str:
    """The text with zeros in place of its spans."""
    parts, at = [], 0
    for a, b in sorted((a, b) for _, a, b in spans):
        if b > at:
            parts += [text[at : max(at, a)], "0" * (b - max(at, a))]
            at = b
    return "".join(parts) + text[at:]


def term_keys(texts) -> Iterator[np.ndarray]:
    """For each text the keys of its terms, each once; A-Z count as a-z. Null counts as empty."""
    for h in word_hashes(list(texts), lower=True, classes=_LETTERS):
        yield np.unique(h.view(np.int64))


def _key(row: Column | None = None) -> Column:
    return row_key(*[F.col(c) if row is None else row[c] for c in ("doc_id", "text")])


_BASE = "key binary, doc_id long, base string, entities array<long>, terms array<long>"


def find_base(docs: DataFrame) -> DataFrame:
    """key, doc_id, base (spans as one string), and the distinct entities and terms of each row with spans; texts without digit or @ skip Python."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            spans = [base_spans(t) for t in b["text"]]
            entities = [list({_entity(x, y) for y in s}) for x, s in zip(b["text"], spans, strict=True)]
            terms = term_keys(masked(x, s) if s else "" for x, s in zip(b["text"], spans, strict=True))
            yield pd.DataFrame({"key": b["key"], "doc_id": b["doc_id"].astype("Int64"), "base": [joined(s) for s in spans], "entities": entities, "terms": list(terms)})

    keyed = docs.select("doc_id", "text").withColumn("key", _key())
    maybe = F.coalesce(F.col("text").rlike(_MAYBE), F.lit(False))
    none = F.lit(None).cast("array<long>")
    plain = keyed.where(~maybe).select("key", "doc_id", F.lit("").alias("base"), none.alias("entities"), none.alias("terms"))
    return keyed.where(maybe).select("key", "doc_id", "text").mapInPandas(run, _BASE).unionByName(plain)


def term_filter(terms: DataFrame) -> np.ndarray:
    """A bit for each value of the low BITS bits of term_key; at most 2 ** BITS / 64 numbers reach the driver."""
    low = F.col("term_key").bitwiseAND(F.lit((1 << BITS) - 1))
    mask = F.expr(f"shiftleft(1L, cast(term_key & 63 AS int))")
    rows = terms.groupBy(F.shiftright(low, 6).alias("word")).agg(F.bit_or(mask).alias("mask")).toPandas()
    out = np.zeros(1 << (BITS - 6), np.int64)
    out[rows["word"].to_numpy(np.int64)] = rows["mask"].to_numpy(np.int64)
    return out


def _passing(keys: np.ndarray, bits: np.ndarray) -> np.ndarray:
    at = keys & np.int64((1 << BITS) - 1)
    return keys[(bits[at >> 6] >> (keys & 63)) & 1 == 1]


def term_documents(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(term_key, docs): in how many rows of docs each of the wanted terms occurs. Tasks count first, so a term is one row of a task."""
    bits = docs.sparkSession.sparkContext.broadcast(term_filter(wanted))  # a fixed size

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen = np.empty(0, np.int64), np.empty(0, np.int64)
        for b in batches:
            found = [_passing(k, bits.value) for k in term_keys(b["text"])]
            keys, at = np.unique(np.concatenate([seen[0], *found]), return_inverse=True)
            n = np.bincount(at, np.concatenate([seen[1], np.ones(sum(map(len, found)), np.int64)]), len(keys)).astype(np.int64)
            seen = keys, n
            if len(keys) > 1 << 20:
                yield pd.DataFrame({"term_key": keys, "n": n})
                seen = np.empty(0, np.int64), np.empty(0, np.int64)
        yield pd.DataFrame({"term_key": seen[0], "n": seen[1]})

    counts = docs.select("text").mapInPandas(run, "term_key long, n long").groupBy("term_key").agg(F.sum("n").alias("docs"))
    return counts.join(wanted, "term_key", "left_semi")


def once(docs: DataFrame, base: DataFrame) -> tuple[DataFrame, int]:
    """docs with each distinct (doc_id, text) once, and their number. base: the keys of all rows."""
    rows = base.count()
    distinct = base.select("key").distinct().count()
    if rows == distinct:
        return docs, rows
    again = base.groupBy("key").count().where("count > 1").select("key")
    keyed = docs.select("doc_id", "text").withColumn("key", _key())
    return keyed.join(again, "key", "left_anti").unionByName(keyed.join(again, "key", "left_semi").dropDuplicates(["key"])).select("doc_id", "text"), distinct


def divergence(p: Column, q: Column) -> Column:
    """KL of Bernoulli shares p and q, 0 < q < 1."""
    rest = F.when(p < 1, (1 - p) * F.log((1 - p) / (1 - q))).otherwise(F.lit(0.0))
    return p * F.log(p / q) + rest


def disclosing_terms(docs: DataFrame, base: DataFrame, generalise: float = GENERALISE, remove: float = REMOVE) -> DataFrame:
    """(term_key, remove) of the terms whose share of some entity's information is at least generalise, and whether it is at least remove."""
    single, total = once(docs, base)
    held = base.where("size(entities) > 0").select("key", "entities", "terms").dropDuplicates(["key"])
    entities = held.select(F.explode("entities").alias("entity")).groupBy("entity").agg(F.count("*").alias("of_entity"))
    each = held.select("entities", F.explode("terms").alias("term_key")).select(F.explode("entities").alias("entity"), "term_key")
    pairs = stage(each.groupBy("entity", "term_key").agg(F.count("*").alias("both")))
    confidence = math.log(max(2, pairs.count()))
    # the most that so many common documents can reach: all of the term's, and an entity in no others
    least = confidence / ((1 - generalise) * math.log(max(2, total)))
    salted = entities.where(F.col("of_entity") >= least).withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    often = pairs.where(F.col("both") >= least).withColumn("salt", F.pmod("term_key", F.lit(SALTS)))
    rest = F.log(F.lit(float(total)) / F.col("of_entity"))
    candidates = stage(often.join(salted, ["entity", "salt"]).where((F.col("of_entity") < total) & (F.col("both") * (1 - generalise) * rest >= confidence)).select("term_key", "both", "of_entity"))
    terms = candidates.select("term_key").distinct()
    known = term_documents(single, terms) if not candidates.isEmpty() else terms.withColumn("docs", F.lit(0).cast("long"))
    rated = candidates.join(known, "term_key")
    share = F.least(F.lit(1.0), F.col("both") / F.col("docs"))

    def reaches(g: float) -> Column:
        low = F.exp((g - 1) * rest)
        return (share > low) & (F.col("docs") * divergence(share, low) >= confidence)

    return rated.where(reaches(generalise)).groupBy("term_key").agg(F.max(reaches(remove)).alias("remove"))


Terms = tuple[np.ndarray, np.ndarray]  # sorted keys, and whether each is removed


def held_terms(disclosing: DataFrame) -> Terms | None:
    """All disclosing terms, if there are at most HELD of them."""
    if disclosing.count() > HELD:
        return None
    rows = disclosing.orderBy("term_key").toPandas()
    return rows["term_key"].to_numpy(np.int64), rows["remove"].to_numpy(bool)


def document_terms(docs: DataFrame, disclosing: DataFrame) -> DataFrame:
    """(key, keys, gone): the terms to generalise or remove in each document that holds any, sorted; for more than HELD terms."""
    bits = docs.sparkSession.sparkContext.broadcast(term_filter(disclosing))  # a fixed size

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = [_passing(k, bits.value) for k in term_keys(b["text"])]
            some = np.array([len(x) > 0 for x in found], bool)
            yield pd.DataFrame({"key": b["key"][some], "terms": pd.Series([x for x in found if len(x)], b.index[some], object)})

    own = docs.where("text is not null").select(_key().alias("key"), "text").mapInPandas(run, "key binary, terms array<long>").select("key", F.explode("terms").alias("term_key"))
    found = own.join(disclosing, "term_key").groupBy("key").agg(F.array_sort(F.collect_set(F.struct("term_key", "remove"))).alias("terms"))
    return stage(found.select("key", F.col("terms.term_key").alias("keys"), F.col("terms.remove").alias("gone")))


def term_spans(text: str | None, terms: Terms) -> list[tuple[int, int, bool]]:
    """(start, end, whether it is removed) of the places of these terms, in code points."""
    keys, gone = terms
    out, at = [], 0
    if not text or not len(keys):
        return out
    for data in pieces(encoded(text, lower=True)):
        hashes, starts = run_hashes(data, _LETTERS)
        found = np.minimum(np.searchsorted(keys, hashes.view(np.int64)), len(keys) - 1)
        hit = keys[found] == hashes.view(np.int64)
        firsts = (np.frombuffer(data, np.uint8) & 0xC0) != 0x80
        before = np.cumsum(firsts)
        for start, k in zip(at + before[starts[hit]] - 1, found[hit], strict=True):
            out.append((int(start), _TERM.match(text, start).end(), bool(gone[k])))
        at += int(firsts.sum())
    return out


def general_form(word: str) -> str:
    """The coarser class of a term: an acronym, a name, or any other term."""
    return "[ACRONYM]" if len(word) > 1 and word.isupper() else "[NAME]" if word[:1].isupper() else "[TERM]"


def sanitised(text: str, spans: list[Span], terms: list[tuple[int, int, bool]]) -> str:
    """Base spans become [KIND]; terms outside them their general form or nothing; the first of overlapping spans wins."""
    cuts = [(a, b, f"[{k.upper()}]") for k, a, b in spans]
    cuts += [(a, b, "" if gone else general_form(text[a:b])) for a, b, gone in terms]
    out, at = [], 0
    for a, b, new in sorted(cuts, key=lambda c: (c[0], -c[1])):
        if a >= at:
            out += [text[at:a], new]
            at = b
    return "".join(out) + text[at:]


def _disclosing(docs: DataFrame, generalise: float) -> tuple[DataFrame, DataFrame]:
    base = stage(find_base(docs))
    return base, stage(disclosing_terms(docs, base, generalise))


def find(docs: DataFrame, generalise: float = GENERALISE) -> DataFrame:
    """doc_id, base (base spans) and terms (spans of disclosing terms, kind term), each as kind:start:end, joined by commas.

    docs: doc_id, text; further columns are ignored. Null and empty texts have no spans. Rows with equal doc_id and text count as one document in the
    corpus statistics, and get equal results. An empty table gives an empty one.
    """
    base, disclosing = _disclosing(docs, generalise)
    held = held_terms(disclosing)
    keyed = docs.where("text is not null").select(_key().alias("key"), "text")
    wanted = keyed if held else keyed.join(document_terms(docs, disclosing), "key")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            own = [held] * len(b) if held else zip(b["keys"], b["gone"], strict=True)
            spans = pd.Series([joined([("term", a, e) for a, e, _ in term_spans(t, x)]) for t, x in zip(b["text"], own, strict=True)], b.index, object)
            yield pd.DataFrame({"key": b["key"], "terms": spans})[spans != ""]

    texts = wanted.mapInPandas(run, "key binary, terms string").dropDuplicates(["key"])
    return base.select("key", "doc_id", "base").join(texts, "key", "left").select("doc_id", "base", F.coalesce("terms", F.lit("")).alias("terms"))


def sanitise(docs: DataFrame, generalise: float = GENERALISE) -> DataFrame:
    """docs with sanitised texts; n_chars follows the text if there is one. Cases as in find(); columns of docs may have any names."""
    _, disclosing = _disclosing(docs, generalise)
    held = held_terms(disclosing)

    def clean(text: str | None, terms: Terms) -> str | None:
        return text and sanitised(text, base_spans(text), term_spans(text, terms))

    @F.pandas_udf("string")
    def with_held(text: pd.Series) -> pd.Series:
        return pd.Series([clean(t, held) for t in text], dtype=object)

    @F.pandas_udf("string")
    def with_own(text: pd.Series, keys: pd.Series, gone: pd.Series) -> pd.Series:
        none = np.empty(0, np.int64), np.empty(0, bool)
        return pd.Series([clean(t, none if k is None else (k, g)) for t, k, g in zip(text, keys, gone, strict=True)], dtype=object)

    rows = boxed(docs).withColumn("old", F.col("row")["text"])
    if held:
        may = F.lit(True) if len(held[0]) else F.coalesce(F.col("old").rlike(_MAYBE), F.lit(False))
        rows = rows.withColumn("may", may)
        new = with_held("old")
    else:
        rows = rows.withColumn("key", _key(F.col("row"))).join(document_terms(docs, disclosing), "key", "left")
        rows = rows.withColumn("may", F.coalesce(F.col("old").rlike(_MAYBE), F.lit(False)) | F.col("keys").isNotNull())
        new = with_own("old", "keys", "gone")
    # texts that hold nothing to replace skip Python
    done = rows.where("not may").withColumn("text", F.col("old")).unionByName(rows.where("may").withColumn("text", new))
    return unboxed(done, docs, F.col("text"), ~F.col("text").eqNullSafe(F.col("old")))


def kind_count(parts: Column, kind: str) -> Column:
    return F.size(F.filter(parts, lambda x: x.startswith(f"{kind}:"))).cast("long")


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, counts by kind, base_sha256 and spans for each row of docs."""
    parts = F.split("base", ",")
    counts = [kind_count(parts, k).alias(f"n_{k}") for k in KINDS]
    spans = F.concat_ws(",", F.when(F.col("base") != "", F.col("base")), F.when(F.col("terms") != "", F.col("terms"))).alias("spans")
    return find(docs).select("doc_id", *counts, F.sha2(F.col("base").cast("binary"), 256).alias("base_sha256"), spans)
