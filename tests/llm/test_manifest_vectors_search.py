"""The Merkle manifest, near vectors and ranked search against plain versions of themselves."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from pagesieve.llm import mask_search, merkle_manifest, projection_passes

DOCS = "doc_id long, source string, lang string, n_chars long, text string, tree long, level int, idx long, n long, root string, place long, `a.b` int"
EXTRA = (7, 1, 2, 3, "r", 4, 5)


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def levels_of(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([digest(*out[-1][i : i + 8]) for i in range(0, len(out[-1]), 8)])
    return out


def siblings(levels, i):
    for level in levels[:-1]:
        run = level[i // 8 * 8 : i // 8 * 8 + 8]
        yield run[: i % 8], run[i % 8 + 1 :]
        i //= 8


def plain_manifest(rows):
    def leaf(r, text):
        return digest(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (r["doc_id"], r["source"], r["lang"], r["n_chars"], text)))

    trees = []
    for lang in sorted({r["lang"] for r in rows}, key=lambda x: (x is not None, (x or "").encode())):
        own = sorted((r["doc_id"] is not None, r["doc_id"] or 0, leaf(r, r["text"]), i) for i, r in enumerate(rows) if r["lang"] == lang)
        trees.append((own, levels_of([x[2] for x in own])))
    top = levels_of([t[-1][0] for _, t in trees])
    out = []
    for k, (own, tree) in enumerate(trees):
        for at, (_, _, own_leaf, i) in enumerate(own):
            path, doc_id, text = [*siblings(tree, at), *siblings(top, k)], rows[i]["doc_id"], rows[i]["text"]
            now = leaf(rows[i], lower(text)) if doc_id is not None and text is not None and zlib.crc32(str(doc_id).encode()) % 3 == 0 else own_leaf
            for before, behind in path:
                now = digest(*before, now, *behind)
            out.append((doc_id, own_leaf, tree[-1][0], top[-1][0], digest(*(x for p in path for part in p for x in part)), now, now == top[-1][0]))
    return sorted(out, key=repr)


MANIFESTS = {
    "one row": [(1, "s", "en", 3, "One")],
    "two languages, one row each": [(3, "s", None, 3, "One"), (4, "s", "en", 3, "Two")],
    "nine rows": [(i, "s", "en", None, f"Text {i}") for i in range(9)],
    "nulls, empties, ties, repeats": [(i % 11 if i % 5 else None, None if i % 3 else "", ["en", None, "", "é", "z"][i % 5], None if i % 7 else i, [None, "", "ABC", "Ünï"][i % 4]) for i in range(150)],
    "ten languages": [(i, "s", str(i % 10), 1, "A") for i in range(90)],
    "very long": [(0, "s", "en", 1, "A very long text. " * 300_000), (1, "s", "en", 1, "x")],
}


@pytest.mark.parametrize("name", MANIFESTS)
def test_manifest(spark, name):
    docs = spark.createDataFrame([(*r, *EXTRA) for r in MANIFESTS[name]], DOCS).repartition(3)
    got = sorted((tuple(r) for r in merkle_manifest.manifest(docs).collect()), key=repr)
    assert got == plain_manifest([r.asDict() for r in docs.collect()])


def test_manifest_of_nothing(spark):
    assert merkle_manifest.manifest(spark.createDataFrame([], DOCS)).count() == 0


def test_manifest_finds_tampering(spark):
    """A row is verified where tampering left it as it is, and nowhere else."""
    docs = spark.createDataFrame([(i, "s", "en", 1, "Capital" if i % 2 else "small", *EXTRA) for i in range(80)], DOCS)
    for r in merkle_manifest.manifest(docs).collect():
        assert r["verified"] == (r["doc_id"] % 2 == 0 or zlib.crc32(str(r["doc_id"]).encode()) % 3 != 0)


VECTORS = "vec_id long, embedding array<double>, label int, rep long, root long, n long, block long, size long, `a.b` int"


def plain_links(rows, limit=0.93):
    """(links, smallest id of the component) by row; rows: (vec_id, vector, label)."""
    good = [v is not None and None not in v and all(map(math.isfinite, v)) and any(v) and y is not None for _, v, y in rows]
    links, up = [0] * len(rows), list(range(len(rows)))
    scaled = [np.array(v) / max(map(abs, v)) if g else None for (_, v, _), g in zip(rows, good, strict=True)]
    unit = [None if v is None else v / np.linalg.norm(v) for v in scaled]
    for i in range(len(rows)):
        for j in range(i):
            if good[i] and good[j] and rows[i][2] == rows[j][2] and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= limit:
                links[i] += 1
                links[j] += 1
                a, b = up[i], up[j]
                up = [min(a, b) if x in (a, b) else x for x in up]
    least = {u: min((r[0] for r, x in zip(rows, up, strict=True) if x == u and r[0] is not None), default=None) for u in set(up)}
    return sorted(((r[0], n, least[u]) for r, n, u in zip(rows, links, up, strict=True)), key=repr)


def near(spark, rows, **limits):
    table = spark.createDataFrame([(*r, 1, 2, 3, 4, 5, 6) for r in rows], VECTORS).repartition(3)
    out = projection_passes.near_vectors(table, **limits).collect()
    assert all(r["kept"] == (r["vec_id"] is not None and r["vec_id"] == r["component_id"]) for r in out)
    return sorted(((r["vec_id"], r["n_links"], r["component_id"]) for r in out), key=repr)


def test_vectors_that_cannot_link(spark):
    nan, inf = float("nan"), float("inf")
    odd = [None, [], [0.0, 0.0], [1.0, None], [nan, 1.0], [inf, 1.0], [1.0, 0.0], [1.0, 0.0, 0.0], [2.0, 0.0], [1e300, 1e290], [-1.0, 0.0], [1e-300, 0.0]]
    rows = [(i, v, None if i == 40 else 1) for i, v in enumerate(odd)] + [(20, [1.0, 0.0], None), (21, [1.0, 0.0], 2), (6, [1.0, 0.0], 1), (None, [1.0, 0.0], 1), (None, [0.0, 1.0], 1)]
    assert near(spark, rows) == plain_links(rows)
    assert near(spark, []) == []


def test_groups_beyond_window_and_block(spark):
    """Copies, tight and loose groups of near copies, chains: each larger than a window and a block."""
    rng = np.random.default_rng(7)
    centres = rng.standard_normal((4, 32))
    centres /= np.linalg.norm(centres, axis=1)[:, None]
    turn = [[math.cos(x), math.sin(x), *[0.0] * 30] for x in np.arange(0, 3, 0.3)]
    parts = [centres[0] + 0.02 * rng.standard_normal((120, 32)), centres[1] + 0.045 * rng.standard_normal((120, 32)), np.repeat(centres[2:3], 60, 0), np.array(turn), rng.standard_normal((100, 32))]
    rows = [(i, x.tolist(), i % 2) for i, x in enumerate(np.concatenate(parts))]
    want = plain_links(rows)
    assert near(spark, rows, window=8, block=24) == want
    assert near(spark, rows) == want
    degrees = [n for _, n, _ in want]
    assert max(degrees) >= 59 and any(0 < n < 59 for n in degrees[120:240])


def test_recall_at_the_limit(spark):
    """Pairs between the limit and 0.95 in a label of 4,000; none below the limit."""
    rng = np.random.default_rng(3)
    base = rng.standard_normal((2000, 64))
    base /= np.linalg.norm(base, axis=1)[:, None]
    away = rng.standard_normal((2000, 64))
    away -= (away * base).sum(1)[:, None] * base
    away /= np.linalg.norm(away, axis=1)[:, None]
    c = np.concatenate([rng.uniform(0.9301, 0.95, 1500), rng.uniform(0.9, 0.9299, 500)])[:, None]
    rows = [(i, x.tolist(), 0) for i, x in enumerate(np.concatenate([base, c * base + np.sqrt(1 - c * c) * away]))]
    found = {i: (n, root) for i, n, root in near(spark, rows)}
    assert all(found[i] == (0, i) and found[i + 2000] == (0, i + 2000) for i in range(1500, 2000))
    assert sum(found[i + 2000] == (1, i) for i in range(1500)) >= 0.99 * 1500


def test_passes_grow():
    sizes = [projection_passes.passes_for(n, 0.93) for n in (0, 64, 10**4, 10**6, 10**9)]
    assert sizes == sorted(sizes) and sizes[0] >= 2 and sizes[-1] < 250


TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def plain_search(docs, items, best=10):
    held = [(i, Counter(TERM.findall(lower(t or "")))) for i, t in docs]
    held = [(i, c, sum(c.values())) for i, c in held if c]
    n, total, df = len(held), sum(x[2] for x in held), Counter(w for _, c, _ in held for w in c)
    out = []
    for item, text in items:
        terms, scores = TERM.findall(lower(text)), []
        w = {t: math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) for t in set(terms)}
        for i, c, own in held:
            m = 25 + (75 * own * n) // total
            score = sum(w[t] * ((10**9 * c[t]) // (1000 * c[t] + 8 * m)) for t in terms if t in c)
            if score > 0:
                scores.append((-score, i is None, i or 0))
        out += [(item, k, None if none else i, -s) for k, (s, none, i) in enumerate(sorted(scores)[:best], 1)]
    return sorted(out, key=repr)


def searched(spark, docs, items, **sizes):
    d = spark.createDataFrame([(*r, 1, 2, 3, 4, 5) for r in docs], "doc_id long, text string, n long, terms int, counts int, score long, `a.b` int").repartition(3)
    q = spark.createDataFrame([(*r, 1, 2) for r in items], "item_id long, text string, rank int, doc_id long")
    return sorted((tuple(r) for r in mask_search.search(d, q, **sizes).collect()), key=repr)


def test_search_of_odd_rows(spark):
    docs = [(0, None), (1, ""), (2, " .,;"), (3, "Alpha beta"), (4, "alpha BETA"), (4, "alpha beta"), (None, "alpha beta"), (5, "ümlaut Ümlaut 7up"), (6, "alpha " * 1_000_000), (7, "gamma-beta_delta"), (8, "beta")]
    docs += [(i, f"filler{i % 3} alpha") for i in range(20, 60)]
    items = [(0, "ALPHA beta beta"), (1, "ümlaut delta"), (2, "unknown words"), (4, "..."), (5, "filler0 filler1 filler2"), (6, " ".join(f"t{i}" for i in range(130)) + " gamma alpha")]
    want = plain_search(docs, items)
    for sizes in ({}, {"block": 4}, {"group": 2, "block": 7}):
        assert searched(spark, docs, items + [(9, None), (10, "")], **sizes) == want
    assert searched(spark, docs, items, best=3) == plain_search(docs, items, 3)
    assert searched(spark, [], items) == [] and searched(spark, docs, []) == []


def test_search_ends_early(spark, monkeypatch):
    """Few documents are scored, and they are the best ones."""
    rng = np.random.default_rng(2)
    docs = [(i, " ".join(f"w{x}" for x in rng.zipf(1.4, 60) if x < 500)) for i in range(3000)]
    items = [(k, " ".join(f"w{x}" for x in rng.integers(1, 120, 25))) for k in range(12)]
    scored, plain = [], mask_search.scores_of
    known = mask_search.items_of([i for i, _ in items], [t for _, t in items])
    monkeypatch.setattr(mask_search, "scores_of", lambda b, chosen, w: scored.append(len(chosen)) or plain(b, chosen, w))
    import pandas as pd

    held = mask_search.matched_terms(spark.createDataFrame(docs, "doc_id long, text string"), known.known).toPandas()
    df = np.bincount(np.concatenate(held["terms"].to_numpy()), minlength=len(known.known))
    weights = np.array([mask_search.weight(len(held), int(x)) for x in df])
    block = mask_search.block_of(pd.DataFrame(held), len(known.known), len(held), int(held["n"].sum()))
    got = []
    for i, terms, counts in known.of:
        found = mask_search.best_of_block(block, terms, counts * weights[terms], [], 10)
        got += [(i, k, d, -s) for k, (s, d) in enumerate(found, 1)]
    assert sorted(got, key=repr) == plain_search(docs, items)
    assert sum(scored) < 0.5 * 12 * len(held)
