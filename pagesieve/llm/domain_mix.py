"""Mixing sources to target weights, by DataFrame functions only.

Domains are soft. A Bernoulli naive Bayes model of the labelled rows (presence of the TERMS most telling words
and of binned text measures) gives every document posteriors of the domains clean, low and toxic. Nonnegative document rates
are then fitted: with n tokens and posteriors p of each document, the expected totals of domain k, sum(rate * n * p[k]), shall
equal its target. With e for what they miss, projected gradient descent starts at rate 1 and lessens the weighted squares e' G^-1 e,
where G = sum(n p p'). Rates are measured by sum(n * rate ** 2); this metric is diagonal, so the projection on the bounds of the
rates cuts each off by itself, and the gradient of a document is p' G^-1 e, whose Lipschitz constant is 1: full steps
converge. A step needs only the sums over all documents, and rates are expressions over the steps' slopes, so each step is one
aggregation. Steps go on until the targets are met or the rates stand still.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import boxed, row_key, stage, unboxed

DOMAINS = ("clean", "low", "toxic")
#: Shares of tokens that the query asks for.
TARGETS = {"clean": 0.9, "low": 0.05, "toxic": 0.05}
SAMPLE, TERMS, BLOCK = 6_000, 160, 4
#: The targets are met at this share of all tokens; rates stand still at this root mean square of their last change.
MET, STILL = 1e-4, 1e-5
MOST_STEPS = 2_000
#: Least chi-square statistic of a telling term (two degrees of freedom).
CHI = 25.0
_SIGNS = "#*$%&|<>"


def domain_of(quality: Column, toxic: Column) -> Column:
    return F.when(toxic == 1, F.lit(2)).when(quality == 0, F.lit(1)).when(quality == 1, F.lit(0))


def _bin(name: str, share: Column, *edges: float) -> Column:
    """A word that names the bin of a number."""
    level = sum((F.when(share >= e, F.lit(1)).otherwise(F.lit(0)) for e in edges), F.lit(0))
    return F.concat(F.lit(f"={name}:"), level.cast("string"))


def words_of(text: Column) -> Column:
    """Lower-cased words without the usual signs between them."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[ \n\t.,;:!?|]+"), lambda w: w != "")


def with_measures(docs: DataFrame) -> DataFrame:
    """Adds _measures, the binned measures of text, as words.

    What is used more than once is a column of its own: Spark leaves such columns apart, while an interpreted expression (any with a
    lambda) would make the same thing again at each of its places. Signs and capitals are taken out in one pass and told apart in what that leaves."""
    text = F.coalesce("text", F.lit(""))
    size = F.greatest(F.length(text), F.lit(1))
    out = docs.withColumns({"_marks": F.regexp_replace(text, f"[^A-Z{_SIGNS}]+", ""), "_lines": F.split(text, "\n")})
    out = out.withColumn("_upper", F.length(F.regexp_replace("_marks", f"[{_SIGNS}]+", "")))
    shares = {"_signs": (F.length("_marks") - F.col("_upper")) / size, "_capitals": F.col("_upper") / size, "_repeats": F.size("_lines") / F.size(F.array_distinct("_lines")), "_length": F.length(text)}
    binned = F.array(
        _bin("signs", F.col("_signs"), 0.005, 0.02, 0.1),
        _bin("capitals", F.col("_capitals"), 0.005, 0.05, 0.3),
        _bin("repeats", F.col("_repeats"), 1.2, 2.0, 4.0),
        _bin("length", F.col("_length"), 50, 200, 1000, 10000),
    )
    return out.withColumns(shares).withColumn("_measures", binned).drop("_marks", "_lines", "_upper", *shares)


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, terms: int = TERMS) -> tuple[list[float], dict[str, list[float]]]:
    """(base, weights): log posteriors are base[k] plus weights[term][k] over the terms that a document has.

    Learns from at most sample labelled documents, those whose hashed doc_id is smallest. At most terms rows and one row
    of sums reach the driver. Without labels all domains are alike.
    """
    known = labels.where("doc_id is not null").withColumn("k", domain_of(F.col("quality"), F.col("toxic"))).where("k is not null").groupBy("doc_id").agg(F.max("k").alias("k"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)  # the documented sample of labelled rows
    own = with_measures(docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id"))
    rows = stage(own.select("k", F.concat(F.array_distinct(words_of(F.col("text"))), "_measures").alias("terms")))
    counts = {r["k"]: r["n"] for r in rows.groupBy("k").agg(F.count("*").alias("n")).collect()}
    n = [counts.get(k, 0) for k in range(len(DOMAINS))]
    per = [F.count_if(F.col("k") == k).alias(f"c{k}") for k in range(len(DOMAINS))]
    found = rows.select("k", F.explode("terms").alias("term")).where("term <> ''").groupBy("term").agg(*per)
    rate = [(F.col(f"c{k}") + 0.5) / (n[k] + 1.0) for k in range(len(DOMAINS))]
    mean = (F.expr(" + ".join(f"c{k}" for k in range(len(DOMAINS)))) + 0.5) / (sum(n) + 1.0)
    chi = sum(((r - mean) * (r - mean) * n[k] / (mean * (1 - mean)) for k, r in enumerate(rate)), F.lit(0.0))
    best = found.withColumn("chi", chi).where(F.col("chi") >= CHI).orderBy(F.desc("chi"), "term").limit(terms).collect()
    base = [math.log((x + 1) / (sum(n) + len(n))) for x in n]
    weights = {}
    for r in best:
        p = [(r[f"c{k}"] + 0.5) / (n[k] + 1.0) for k in range(len(DOMAINS))]
        weights[r["term"]] = [math.log(x / (1 - x)) for x in p]
        base = [b + math.log(1 - x) for b, x in zip(base, p, strict=True)]
    return base, weights


def with_posteriors(docs: DataFrame, base: list[float], weights: dict[str, list[float]]) -> DataFrame:
    """Adds p_<domain>. docs: text, _words. Every step is a column of its own, so that no text is split more than once."""
    zero = F.array(*[F.lit(float(b)) for b in base])
    logs = zero
    if weights:
        known = F.array(*[F.lit(w) for w in weights])
        table = F.create_map(*[x for w, v in weights.items() for x in (F.lit(w), F.array(*[F.lit(float(y)) for y in v]))])
        own = F.array_distinct(F.filter("_words", lambda w: w.isin(*weights)))  # few are left to be told apart
        docs = with_measures(docs).withColumn("_present", F.concat(own, F.array_intersect("_measures", known))).drop("_measures")
        logs = F.aggregate("_present", zero, lambda a, w: F.zip_with(a, F.element_at(table, w), lambda x, y: x + y))
    out = docs.withColumn("_logs", logs).withColumn("_most", F.array_max("_logs"))
    out = out.withColumn("_powers", F.array(*[F.exp(F.col("_logs")[k] - F.col("_most")) for k in range(len(DOMAINS))]))
    total = sum((F.col("_powers")[k] for k in range(len(DOMAINS))), F.lit(0.0))
    return out.select("*", *[(F.col("_powers")[k] / total).alias(f"p_{d}") for k, d in enumerate(DOMAINS)]).drop("_present", "_logs", "_most", "_powers")


def expected(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, key, n_tokens (words) and p_<domain> for each row of docs."""
    base, weights = train(docs, labels)
    own = docs.select("doc_id", "text", row_key(F.col("doc_id"), F.col("text")).alias("key"), words_of(F.col("text")).alias("_words"))
    own = with_posteriors(own.withColumn("n_tokens", F.size("_words").cast("long")), base, weights)
    return own.select("doc_id", "key", "n_tokens", *[f"p_{d}" for d in DOMAINS])


def fit_rates(mass: DataFrame, targets: dict[str, float], total: float | None = None, most: float | None = None, fixed: Column | None = None) -> DataFrame:
    """Adds rate to rows with n_tokens and p_<domain>.

    targets: shares of the domains. total: tokens of the result; by default the tokens of mass. most: highest rate.
    fixed: rows whose rate stays 1. A step's residuals (a number for each domain) are all that reaches the driver; every BLOCK
    steps the rates are written to the shared folder, so expressions stay short. Targets that the bounds do not allow
    are met as nearly as they can be. ArithmeticError after MOST_STEPS.
    """
    k = len(DOMAINS)
    p = [F.col(f"p_{d}") for d in DOMAINS]
    n = F.col("n_tokens")
    free = F.lit(1.0) if fixed is None else F.when(fixed, F.lit(0.0)).otherwise(F.lit(1.0))
    share = [targets[d] / sum(targets.values()) for d in DOMAINS]
    first = mass.agg(*[F.sum(n * x).alias(f"s{i}") for i, x in enumerate(p)], *[F.sum(free * n * p[i] * p[j]).alias(f"g{i}{j}") for i in range(k) for j in range(k)]).first()
    sums = [first[f"s{i}"] or 0.0 for i in range(k)]
    if total is None:
        total = sum(sums)
    wanted = [s * total for s in share]
    size = max(sum(sums), 1e-9)
    gram = [[(first[f"g{i}{j}"] or 0.0) / size + (1e-6 if i == j else 0.0) for j in range(k)] for i in range(k)]
    rates = mass.withColumn("rate", F.lit(1.0)).withColumn("last", F.lit(0.0))
    rate, last = F.col("rate"), F.col("last")
    for turn in range(MOST_STEPS):
        got = rates.agg(*[F.sum(n * x * rate).alias(f"s{i}") for i, x in enumerate(p)], F.sum(n * (rate - last) * (rate - last)).alias("moved")).first()
        off = [((got[f"s{i}"] or 0.0) - wanted[i]) / size for i in range(k)]
        if max(map(abs, off)) < MET or math.sqrt((got["moved"] or 0.0) / size) < STILL:
            return rates.withColumn("rate", rate).drop("last")
        slope = solved(gram, off)
        last, rate = rate, F.greatest(F.lit(0.0), rate - free * sum((x * y for x, y in zip(p, slope, strict=True)), F.lit(0.0)))
        if most is not None:
            rate = F.least(F.lit(float(most)), rate)
        if turn % BLOCK == BLOCK - 1:
            rates, rate, last = stage(rates.withColumns({"rate": rate, "last": last})), F.col("rate"), F.col("last")
    raise ArithmeticError("the rates do not settle")


def solved(a: list[list[float]], b: list[float]) -> list[float]:
    """x of a x = b for a small positive definite matrix."""
    a, b = [list(r) for r in a], list(b)
    for i in range(len(b)):
        for j in range(i + 1, len(b)):
            f = a[j][i] / a[i][i]
            a[j] = [x - f * y for x, y in zip(a[j], a[i], strict=True)]
            b[j] -= f * b[i]
    x = [0.0] * len(b)
    for i in reversed(range(len(b))):
        x[i] = (b[i] - sum(a[i][j] * x[j] for j in range(i + 1, len(b)))) / a[i][i]
    return x


def mix(docs: DataFrame, labels: DataFrame, targets: dict[str, float] | None = None) -> DataFrame:
    """doc_id, n_tokens, p_<domain> and rate for each row of docs.

    docs: doc_id, text; labels: doc_id, quality, toxic; further columns are ignored. Rates are how often a document is to be used, so that the
    expected tokens of the domains stand in the targets' proportion. Null and empty texts have no tokens. Labels with nulls, or
    without a document, are left out; of repeated labels the largest domain number counts. Without labels all posteriors are alike.
    Repeated rows get equal rates. An empty table gives an empty one.
    """
    return fit_rates(stage(expected(docs, labels)), targets or TARGETS).drop("key")


def thin(docs: DataFrame, labels: DataFrame, targets: dict[str, float] | None = None) -> DataFrame:
    """The documents that stay when rates are limited to 1 and rounded by each row's hash, in the columns of docs.

    The result has as many tokens as the first domain of DOMAINS allows without repeats: the documents most likely of
    it keep rate 1, while the others are thinned to their domains' targets. A row stays if its rate exceeds a number in (0, 1) that its
    doc_id and text give. Cases as in mix(); columns of docs may have any names.
    """
    targets = targets or TARGETS
    mass = stage(expected(docs, labels))
    main = F.col(f"p_{DOMAINS[0]}")
    have = mass.agg(F.sum(F.col("n_tokens") * main).alias("s")).first()["s"] or 0.0
    fixed = main >= F.greatest(*[F.col(f"p_{d}") for d in DOMAINS[1:]])
    fitted = fit_rates(mass, targets, total=have / (targets[DOMAINS[0]] / sum(targets.values())), most=1.0, fixed=fixed)
    luck = (F.pmod(F.xxhash64("key"), F.lit(1_000_000)) + 0.5) / 1_000_000
    stay = fitted.where((F.col("rate") > luck) | (F.col("n_tokens") == 0)).select("key").distinct()
    keyed = boxed(docs).withColumn("key", row_key(F.col("row")["doc_id"], F.col("row")["text"]))
    return unboxed(keyed.join(stay, "key", "left_semi"), docs)
