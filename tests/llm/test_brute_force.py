"""Operators against plain versions of themselves."""

import hashlib
import re
import threading
import zlib
from functools import lru_cache
from itertools import combinations
from unittest import mock

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from pagesieve.llm import best_fit_pack, cutting_stock, disclosure, domain_mix, jpeg_media, license_rules, quality_ftrl, secret_models, signature_tree_join, tokens, words

DATA = "/root/testdata/sf0.001"


def docs_of(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def jaccard_classes(texts, n, percent):
    sets = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        sets.append({tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set())
    up = list(range(len(texts)))
    for i, j in combinations(range(len(texts)), 2):
        if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
            a, b = up[i], up[j]
            up = [min(a, b) if x in (a, b) else x for x in up]
    return [len(s) for s in sets], up


@pytest.mark.parametrize(("percent", "cover"), [(80, "parts"), (90, "parts"), (80, "minhash"), (100, "minhash")])
def test_jaccard_join(spark, percent, cover):
    rng = np.random.default_rng(percent)
    texts = []
    for size in (2, 5, 12, 40, 200, 700):
        base = [f"w{x}" for x in rng.integers(0, 5000, size)]
        for _ in range(25):
            copy = list(base)
            for at in rng.integers(0, size, rng.integers(0, max(2, size // 25))):
                copy[at] = f"n{rng.integers(0, 9)}"
            texts.append(" ".join(copy))
    texts += [None, "", " ", "w", texts[3].upper()]
    out = signature_tree_join.jaccard_classes(docs_of(spark, texts), 3, percent, cover).orderBy("doc_id").collect()
    sizes, classes = jaccard_classes(texts, 3, percent)
    assert [r["n_shingles"] for r in out] == sizes and [r["component_id"] for r in out] == classes


@pytest.mark.parametrize("percent", [50, 80])
def test_minhash_cells_agree_as_often_as_sets_overlap(percent):
    """The share of equal cells is the similarity to the power of the values in a cell; equal sets have equal cells."""
    rng = np.random.default_rng(5)
    same = total = 0
    for _ in range(40):
        pool = rng.integers(0, 1 << 63, 900).astype(np.uint64) * np.uint64(2)
        a, b = np.sort(pool[:850]), np.sort(pool[50:])
        x, y = (signature_tree_join.minhash_signatures(s, percent)[0] for s in (a, b))
        same, total = same + int((x == y).sum()), total + len(x)
        assert np.array_equal(x, signature_tree_join.minhash_signatures(a.copy(), percent)[0])
    assert abs(same / total - (800 / 900) ** signature_tree_join.MIN_ROWS) < 0.05


def test_jaccard_join_of_large_clusters(spark, monkeypatch):
    """Clusters of several blocks, whose sets form chains and classes of their own."""
    monkeypatch.setattr(signature_tree_join, "BLOCK", 8)
    base = [f"b{i}" for i in range(120)]
    texts = [" ".join(base[: 120 - i] + [f"x{j}" for j in range(i)]) for i in range(60)] + [" ".join(base[i % 7 :] + [f"y{i}"] * (i % 5)) for i in range(60)]
    out = signature_tree_join.jaccard_classes(docs_of(spark, texts), 3, 90).orderBy("doc_id").collect()
    assert [r["component_id"] for r in out] == jaccard_classes(texts, 3, 90)[1]


@pytest.mark.parametrize(("percent", "cover", "notice"), [(90, "parts", 12), (80, "parts", 30), (80, "minhash", 60)])
def test_jaccard_join_of_texts_with_one_notice(spark, monkeypatch, percent, cover, notice):
    """Texts that share a notice, in groups near the limit: cells of many sets in many classes."""
    monkeypatch.setattr(signature_tree_join, "BLOCK", 4)
    rng = np.random.default_rng(notice)
    shared, texts = [f"s{i}" for i in range(notice)], []
    for group in range(25):
        own = [f"g{group}_{i}" for i in range(int(rng.integers(6, 40)))]
        for _ in range(6):
            copy = list(own)
            for at in rng.integers(0, len(own), rng.integers(0, 3)):
                copy[at] = f"n{rng.integers(0, 999)}"
            texts.append(" ".join(shared + copy))
    out = signature_tree_join.jaccard_classes(docs_of(spark, texts), 3, percent, cover).orderBy("doc_id").collect()
    assert [r["component_id"] for r in out] == jaccard_classes(texts, 3, percent)[1]


@pytest.mark.parametrize("words_allowed", [0, 1 << 22])
def test_trees_find_all_links(monkeypatch, words_allowed):
    """Classes of a block against all pairs, by rows of bits and by plain intersection, from single sets and from known classes."""
    monkeypatch.setattr(signature_tree_join, "MOST_WORDS", words_allowed)
    rng = np.random.default_rng(9)
    for n in (1, 2, 17, 90):
        bases = [np.unique(rng.integers(0, 2**63, rng.integers(1, 120)).astype(np.uint64)) for _ in range(6)]
        sets = [np.unique(np.concatenate([b[rng.random(len(b)) > 0.06], rng.integers(0, 2**63, rng.integers(0, 3)).astype(np.uint64), b[:1]])) for b in (bases[i % 6] for i in range(n))]
        known, plain = signature_tree_join.Classes(n), list(range(n))
        for a, b in [(0, n - 1)] * (n > 2):
            known.join(a, b)
            plain = [min(a, b) if x in (a, b) else x for x in plain]
        for i, j in combinations(range(n), 2):
            both = len(np.intersect1d(sets[i], sets[j]))
            if 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                a, b = plain[i], plain[j]
                plain = [min(a, b) if x in (a, b) else x for x in plain]
        links = signature_tree_join.traverse(signature_tree_join.Tree(sets, signature_tree_join.bitmap_bits(sets)), known, 80)
        assert [known.find(i) for i in range(n)] == plain
        assert all(100 * len(np.intersect1d(sets[i], sets[j])) >= 80 * len(np.union1d(sets[i], sets[j])) for i, j in links)


def test_sets_of_one_cluster_move_in_proportion(spark):
    """20,000 sets in one cluster, a chain in which all share a cell and no two are linked: a few seats for each."""
    seats = []
    for n in (5_000, 20_000):
        held = spark.range(n).selectExpr("id as set_key", "id as class", "explode(array(-1L, id * 10, (id + 1) * 10)) as cell", "0L as cluster")
        parts = held.groupBy("set_key").agg(F.collect_list("cell").alias("parts"))
        seats.append([signature_tree_join.leader_seats(held).count(), signature_tree_join.cell_seats(held, parts).count()])
    for few, many in zip(*seats, strict=True):
        assert many < 4.1 * few and many < 5 * 20_000


def test_sets_that_share_crowded_cells_meet(spark, monkeypatch):
    """Any two sets of different classes that share three parts, empty ones counted, meet in a block."""
    monkeypatch.setattr(signature_tree_join, "BLOCK", 4)
    rng = np.random.default_rng(11)
    cells = {k: sorted({int(c) for c in rng.integers(1, 9, 5)}) for k in range(40)}
    empty = {k: sorted({int(c) for c in rng.integers(20, 22, 2)}) for k in range(40)}
    held = spark.createDataFrame([(k, k % 25, c) for k, own in cells.items() for c in own], "set_key long, class long, cell long").withColumn("cluster", F.lit(1))
    parts = spark.createDataFrame(list(empty.items()), "set_key long, parts array<long>")
    blocks = {}
    for r in signature_tree_join.cell_seats(held, parts).collect():
        blocks.setdefault((r["unit"], r["block"]), set()).add(r["set_key"])
    met = {pair for b in blocks.values() for pair in combinations(sorted(b), 2)}
    for x, y in combinations(range(40), 2):
        both = set(cells[x]) & set(cells[y])
        if x % 25 != y % 25 and both and len(both) + len(set(empty[x]) & set(empty[y])) >= 3:
            assert (x, y) in met


def test_sets_of_a_dense_cluster_meet_in_a_plane(spark, monkeypatch):
    """300 sets, each in many of 40 cells: a plane of order 17, in which any two meet. A sparse cluster keeps its cells."""
    monkeypatch.setattr(signature_tree_join, "BLOCK", 10)
    rng = np.random.default_rng(4)
    rows = [(k, k, int(c), 0) for k in range(300) for c in rng.choice(40, 25, replace=False)] + [(k, k, 1000 + k // 2, 1) for k in range(300, 340)] + [(k, k, 1000 + (k + 1) // 2, 1) for k in range(300, 340)]
    held = spark.createDataFrame(rows, "set_key long, class long, cell long, cluster long")
    seats = signature_tree_join.cell_seats(held, held.groupBy("set_key").agg(F.array().cast("array<bigint>").alias("parts"))).collect()
    assert sum(r["set_key"] < 300 for r in seats) == 300 * 18 and sum(r["set_key"] >= 300 for r in seats) <= 80
    blocks = {}
    for r in seats:
        blocks.setdefault((r["unit"], r["block"]), set()).add(r["set_key"])
    met = {pair for b in blocks.values() for pair in combinations(sorted(b), 2)}
    assert all(pair in met for pair in combinations(range(300), 2)) and (300, 301) in met and (301, 302) in met


def test_word_hashes_do_not_depend_on_pieces(monkeypatch):
    texts = ["a bb  ccc\n" * 50, None, "", "éé ü", "x" * 500 + " y"]
    whole = [h.tolist() for h in words.word_hashes(texts)]
    monkeypatch.setattr(words, "PIECE", 64)
    assert [h.tolist() for h in words.word_hashes(texts)] == whole
    assert [len(h) for h in whole] == [len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for t in texts]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.binary(min_size=1, max_size=700), min_size=1, max_size=4))
def test_jpeg_round_trip(parts):
    payloads = [p + b" " * (-len(p) % 192) for p in parts]
    for payload, (feature, thumb) in zip(payloads, jpeg_media.describe([jpeg_media.stored(p) for p in payloads]), strict=True):
        assert thumb.tobytes() == payload and feature.startswith(f"1536x{len(payload) // 24}:")


def test_thumbnail_hashes_cover_all_samples():
    """Block means against plain ones; samples off the grid of block corners change the hashes."""
    rng = np.random.default_rng(7)
    for shape in ((40, 64), (9, 192), (3, 24), (1, 192)):
        thumb = rng.integers(0, 256, shape).astype(np.uint8)
        for n in (8, 9):
            r, c = ([i * m // k for i in range(k)] + [m] for m, k in zip(shape, (8, n), strict=True))
            plain = [[thumb[a : max(b, a + 1), x : max(y, x + 1)].mean() for x, y in zip(c, c[1:], strict=False)] for a, b in zip(r, r[1:], strict=False)]
            assert np.allclose(jpeg_media.block_means(thumb, 8, n), plain)
    flat = np.full((80, 144), 100, np.uint8)
    other = flat.copy()
    other[1:9, 1:15] = 255
    assert jpeg_media.thumbnail_hashes(flat) != jpeg_media.thumbnail_hashes(other)


def test_jpeg_with_alternating_coefficients():
    """A hand-made scan: two components, two luminance blocks an MCU, AC symbols and a restart."""
    frame = jpeg_media.Frame(width=16, height=16, parts=[(1, 2, 1, 0), (2, 1, 1, 0)], quantisers={0: 8}, interval=1)
    frame.tables = {0: ([0, 3], [0, 2, 3]), 16: ([1, 2], [0x00, 0x12, 0xF0])}
    frame.scan = [(0, 0, 16), (1, 0, 16)]
    dc = {0: "00", 2: "01", 3: "10"}
    first = dc[3] + "101" + "10" + "11" + "0" + dc[2] + "01" + "0" + dc[0] + "11" + "0"  # 5, AC run of one; -2; 0 and 16 zeros
    second = dc[0] + "0" + dc[3] + "111" + "0" + dc[0] + "0"
    pack = lambda bits: bytes(int((bits + "1" * (-len(bits) % 8))[i : i + 8], 2) for i in range(0, len(bits), 8))
    frame.data = np.frombuffer(pack(first).replace(b"\xff", b"\xff\x00") + b"\xff\xd0" + pack(second).replace(b"\xff", b"\xff\x00"), np.uint8)
    assert jpeg_media.thumbnails([frame])[0].tolist() == [[133, 131], [128, 135]]


def test_jpeg_query_columns(spark):
    texts = ["abc", None, "x" * 192, "x" * 193]
    out = jpeg_media.media_columns(docs_of(spark, texts), with_media=True).orderBy("doc_id").collect()
    for r, t in zip(out, texts, strict=True):
        payload = (t or "").encode()
        payload += b" " * (max(192, -(-len(payload) // 192) * 192) - len(payload))
        assert (r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
        assert r["media_sha256"] == hashlib.sha256(r["media"]).hexdigest() and r["media_bytes"] == len(r["media"])


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab A\n\té's12.,…中\r　<|endoftext|>", max_size=40))
def test_ids_are_those_of_tokenizers(text):
    import public_tokenizers

    if not hasattr(test_ids_are_those_of_tokenizers, "own"):
        test_ids_are_those_of_tokenizers.own = Tokenizer.from_file(public_tokenizers.path(tokens.VOCABULARY))
    wanted = test_ids_are_those_of_tokenizers.own.encode(text, add_special_tokens=False).ids
    assert tokens.encoder().ids(text).tolist() == [*wanted, tokens.END]


def test_added_tokens_are_those_of_tokenizers():
    import public_tokenizers

    own = Tokenizer.from_file(public_tokenizers.path(tokens.VOCABULARY))
    for text in ("a<|endoftext|>b", "<|endoftext|>", "a  <|endoftext|>  b\n<|endoftext|><|endoftext|>", "<|endoftext|", "no such token"):
        assert tokens.encoder().ids(text).tolist() == [*own.encode(text, add_special_tokens=False).ids, tokens.END]
    assert tokens.encoder().ids("a<|endoftext|>b").tolist() == [64, 50256, 65, tokens.END]


def test_long_runs_of_one_character():
    """Runs of five million go through; shorter ones around the limit give the ids of tokenizers."""
    import public_tokenizers

    own = Tokenizer.from_file(public_tokenizers.path(tokens.VOCABULARY))
    for c in " \n\ta　":
        assert len(tokens.encoder().ids(f"w{c * 5_000_000}w")) > 1_000_000
        for n in (tokens.LONG - 1, tokens.LONG, tokens.LONG + 1):
            for text in (f"w{c * n}w", c * n, f"{c * n}<|endoftext|>{c * n}.{c * n}"):
                assert tokens.encoder().ids(text).tolist() == [*own.encode(text, add_special_tokens=False).ids, tokens.END]


def all_patterns(room, least=1):
    yield ()
    for n in range(least, room + 1):
        for rest in all_patterns(room - n, n):
            yield (n, *rest)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 30), min_size=10, max_size=10))
def test_column_generation(demand):
    """The linear program's value against its dual over all patterns, and the sequences of the rounded one against that value."""
    demand = np.array(demand)
    patterns, used = cutting_stock.column_generation(demand, 10)
    wanted = np.flatnonzero(demand)
    assert np.allclose(patterns.T @ used, demand, atol=1e-6) and (used >= 0).all()
    price = dict(zip(wanted + 1, np.linalg.solve(patterns[:, wanted].astype(float), np.ones(len(wanted))) if len(wanted) else (), strict=True))
    assert all(sum(price.get(n, 0) for n in p) <= 1 + 1e-6 for p in all_patterns(10)) and all(y >= -1e-6 for y in price.values())
    assert abs(sum(price[n] * demand[n - 1] for n in price) - used.sum()) < 1e-6
    rounded = cutting_stock.rounded_patterns(demand, 10)
    assert (sum((p * n for p, n in rounded), np.zeros(10, int)) == demand).all()
    assert all((p * np.arange(1, 11)).sum() <= 10 for p, _ in rounded)
    assert sum(n for _, n in rounded) <= np.ceil(used.sum() - 1e-6) + 1


def test_column_generation_beside_spark(spark):
    """More than 256 rounds in the driver of a session that is at work, so that the basis is inverted afresh."""
    matrix = np.random.default_rng(5).random((90, 90))
    assert np.allclose(cutting_stock.inverted(matrix) @ matrix, np.eye(90), atol=1e-9)
    with pytest.raises(ArithmeticError):
        cutting_stock.inverted(np.ones((3, 3)))
    rounds, plain = [], cutting_stock.best_pattern
    demand = (np.random.default_rng(1).pareto(1.1, 128) * 50).astype(np.int64) + 1
    busy = threading.Thread(target=lambda: spark.range(40_000_000).selectExpr("sum(hash(id))").collect())
    busy.start()
    with mock.patch.object(cutting_stock, "best_pattern", lambda *a: rounds.append(1) or plain(*a)):
        patterns, used = cutting_stock.column_generation(demand, 128)
    busy.join()
    assert len(rounds) > 256 and np.allclose(patterns.T @ used, demand, rtol=1e-6)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.floats(0, 1), min_size=6, max_size=6))
def test_knapsack(price):
    value, pattern = cutting_stock.best_pattern(np.array(price), 6)
    assert (pattern * np.arange(1, 7)).sum() <= 6 and abs(pattern @ price - value) < 1e-9
    assert abs(value - max(sum(price[n - 1] for n in p) for p in all_patterns(6))) < 1e-9


def test_packed_ids(spark):
    texts = ["one two three " * k for k in (1, 30, 700, 2000)] + ["", None, " " * 600_000 + "x" + "\n" * 600_000]
    docs = docs_of(spark, texts)
    for r in cutting_stock.pack(docs, with_ids=True).collect():
        ids = tokens.encoder().ids(texts[r["doc_id"]])
        cut = ids[r["start"] : r["start"] + r["length"]].tobytes()
        assert bytes(r["ids"]) == cut and r["ids_crc32"] == zlib.crc32(cut) and r["doc_tokens"] == len(ids)
    seen = {}
    for r in best_fit_pack.packed_matrices(docs).collect():
        ids, ends, position = (np.frombuffer(r[c], t) for c, t in (("ids", "<u2"), ("cu_seqlens", "<u4"), ("position_ids", "<u4")))
        assert len(ids) == len(position) == 2048 and ends[0] == 0 and ends[-1] == r["n_tokens"] and not ids[ends[-1] :].any()
        assert position[ends[-1] :].tolist() == list(range(2048 - ends[-1]))
        for k, (doc_id, at) in enumerate(zip(r["doc_ids"], r["starts"], strict=True)):
            a, b = ends[k : k + 2]
            seen.setdefault(doc_id, {})[at] = ids[a:b].tolist()
            assert position[a:b].tolist() == list(range(b - a))
    assert {i: sum((x[k] for k in sorted(x)), []) for i, x in seen.items()} == {i: tokens.encoder().ids(t).tolist() for i, t in enumerate(texts)}


def plain_best_fit(lengths, length):
    bins = []
    for n in sorted(lengths, reverse=True):
        fits = [b for b in bins if length - sum(b) >= n]
        max(fits, key=sum).append(n) if fits else bins.append([n])
    return bins


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 40), max_size=80))
def test_best_fit(lengths):
    """Free rooms are those of piece by piece best fit decreasing; slots give every piece one place."""
    demand = {n: lengths.count(n) for n in lengths}
    groups = best_fit_pack.best_fit_decreasing(demand, 40)
    assert sorted(sum(n * k for n, k in c) for c, s in groups for _ in range(s)) == sorted(map(sum, plain_best_fit(lengths, 40)))
    rows = best_fit_pack.slots(groups)
    for n in demand:
        assert [r for a, b in sorted(r[1:3] for r in rows if r[0] == n) for r in range(a, b)] == list(range(demand[n]))
    used = sorted((first + (r - a) // each, at + (r - a) % each * n, n) for n, a, b, each, first, at in rows for r in range(a, b))
    assert all(x[0] != y[0] or x[1] + x[2] == y[1] for x, y in zip(used, used[1:], strict=False)) and all(at + n <= 40 for _, at, n in used)


def test_packed_matrices_do_not_depend_on_the_split(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    some = [sorted(map(str, best_fit_pack.packed_matrices(docs.repartition(n)).collect())) for n in (2, 64)]
    assert some[0] == some[1]


SECRET = st.text(alphabet="paswordtkenapi_y=:\"' -AKI0123456789abcdef/", max_size=120)


@settings(max_examples=300, deadline=None)
@given(SECRET)
def test_secret_base(text):
    plain = [("assign", m.start(), m.end()) for m in re.finditer(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text) if len(m[2]) >= 12]
    plain += [("access", *m.span()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    plain += [("hex", *m.span()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]
    assert secret_models.base_spans(text) == sorted(plain, key=lambda s: (s[1], ("assign", "access", "hex").index(s[0])))


def test_secret_models(spark):
    rng = np.random.default_rng(1)
    some = lambda n: "".join(rng.choice(list("ABCDEFGHJKMNPQRSTUVWXYZabcdefghjkmnpqrstuvwxyz23456789"), n))
    texts = [f"password={some(24)} and some_ordinary_identifier_name plus internationalisation" for _ in range(200)]
    texts += [f"key {some(32)} here", "another_ordinary_identifier_2_name here"]
    out = secret_models.find(docs_of(spark, texts)).orderBy("doc_id").collect()
    assert out[200]["spans"] == "random:4:36" and out[201]["spans"] == "" and all(r["spans"] == r["base"] != "" for r in out[:200])


PERSONAL = st.text(alphabet="ab1234567890@@..--+()  ,", max_size=80)


@settings(max_examples=400, deadline=None)
@given(PERSONAL)
def test_personal_base(text):
    plain = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    plain += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = [int(c) for c in m[0] if c.isdigit()]
        if 13 <= len(d) <= 19 and sum(x if i % 2 == 0 else 2 * x - 9 * (x > 4) for i, x in enumerate(reversed(d))) % 10 == 0:
            plain.append(("card", *m.span()))
    plain += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= sum(c.isdigit() for c in m[0]) <= 15]
    assert disclosure.base_spans(text) == plain


def test_disclosing_terms(spark):
    rng = np.random.default_rng(2)
    filler = lambda: " ".join(f"{'abcdefgh'[i]}{'ijklmnop'[j]}quo" for i, j in rng.integers(0, 8, (12, 2)))
    texts = [f"{filler()} Quintessa writes from q.v@mail.example.org {filler()}" for _ in range(6)] + [f"{filler()} writes {filler()}" for _ in range(300)]
    out = disclosure.find(docs_of(spark, texts)).orderBy("doc_id").collect()
    for r, t in zip(out, texts, strict=True):
        at = t.find("Quintessa")
        assert (f"term:{at}:{at + 9}" in r["terms"].split(",")) == (at >= 0) and (at >= 0 or r["terms"] == "")
    clean = disclosure.sanitise(docs_of(spark, texts)).where("doc_id < 6").collect()
    assert all("Quintessa" not in r["text"] and "[EMAIL]" in r["text"] for r in clean)


def test_terms_of_rare_entities(spark):
    """An entity met once, and one always in the same words, have disclosing terms; words that stand anywhere are none."""
    texts = ["the mail of Quintessa is q.v@mail.example.org here"] + ["Regards, Zebedee Smith, z.s@mail.example.org"] * 4 + ["the regards of smith is mail here"] * 400
    out = disclosure.find(docs_of(spark, texts)).orderBy("doc_id").collect()
    words = [{t[int(x.split(":")[1]) : int(x.split(":")[2])] for x in r["terms"].split(",") if x} for r, t in zip(out, texts, strict=True)]
    assert words[:5] == [{"Quintessa"}] + [{"Zebedee"}] * 4 and not any(words[5:])


def test_terms_in_all_documents(spark):
    """A term far from its entity, also in a document that has neither digit nor @."""
    far = "the regards of smith is mail here " * 30
    texts = [f"Quintessa and {far} q.v@mail.example.org"] * 3 + ["Quintessa called"] + ["and called the regards of smith is mail here"] * 400
    out = disclosure.find(docs_of(spark, texts)).orderBy("doc_id").collect()
    assert [r["terms"] for r in out] == ["term:0:9"] * 4 + [""] * 400
    clean = disclosure.sanitise(docs_of(spark, texts)).where("doc_id < 4").orderBy("doc_id").collect()
    assert [r["text"] for r in clean] == [f"[NAME] and {far} [EMAIL]"] * 3 + ["[NAME] called"]


def license_base(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    places = [(i, label) for p, label in license_rules.BASE_PHRASES.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
    at = [i for i, _ in places]
    return len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in places}))


def unwrapped(text):
    return re.sub("[\x20\x09-\x0d]+", " ", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


@lru_cache(1)
def plain_rules():
    return [(label, re.compile(regex), level) for label, regex, _, level, _ in license_rules.rules()]


def license_spans(text):
    """Matches that stay, each compared with each; without the gate, and with the rules' keywords left aside."""
    own = sorted({(m.start(), m.end(), label, level) for label, regex, level in plain_rules() for m in regex.finditer(text)})
    found = []
    for a, b, label, level in own:
        others = [o for o in own if o != (a, b, label, level)]
        inside = any(o[3] >= level and o[0] <= a and b <= o[1] and ((o[1] - o[0], o[3]) > (b - a, level) or ((o[1] - o[0], o[3]) == (b - a, level) and o[2] < label)) for o in others)
        if not inside and not any(o[3] > level and o[0] < b and a < o[1] for o in others):
            found.append((a, b, label))
    return sorted(found)


def test_licenses(spark):
    texts = [
        "CC by, cc-BY; cc by 4.0 CC BY-NC-SA 4.0", "GNU General Public License, version 3 or later\nGPL", "all  rights\nreserved", None, "", "x cc bye", "é all rights reserved é",
        "Licensed under the Apache License, Version 2.0.\nReleased under the MIT License. Copyright (c) 2020", "SPDX-License-Identifier: GPL-2.0-or-later", "https://creativecommons.org/licenses/by-sa/4.0/",
        "Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License. see the LICENSE file",
    ]
    docs = docs_of(spark, texts)
    for r, t in zip(license_rules.scan(docs).orderBy("doc_id").collect(), texts, strict=True):
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == license_base(t)
    ids = {r["key"]: r["doc_id"] for r in license_rules.base_places(docs).collect()}
    got = {}
    for r in license_rules.detections(license_rules.unwrapped(docs, license_rules.rules())).collect():
        got.setdefault(ids[r["key"]], set()).add((r["start"], r["end"], r["label"]))
    for i, t in enumerate(texts):
        assert sorted(got.get(i, ())) == license_spans(unwrapped(t))
    assert 200 < len(license_rules.rules())


def example(regex):
    """The shortest text that a rule's regex matches, without optional parts."""
    import re._parser as parser

    def text(parts):
        out = ""
        for op, value in parts:
            match str(op):
                case "LITERAL":
                    out += chr(value)
                case "IN":
                    kind, first = value[0]
                    out += chr(first if str(kind) == "LITERAL" else first[0])
                case "MAX_REPEAT":
                    out += text(value[2]) * value[0]
                case "SUBPATTERN":
                    out += text(value[3])
                case "BRANCH":
                    out += text(value[1][0])
                case name:
                    assert name == "ASSERT_NOT", name
        return out

    return text(parser.parse(regex))


def test_each_license_rule(spark):
    """Every rule alone, on a text that holds its match only, and wrapped between other words."""
    table = license_rules.rules()
    texts = [example(regex) for _, regex, _, _, _ in table]
    for t, (_, regex, words, _, _) in zip(texts, table, strict=True):
        assert re.search(regex, t) and all(w in t for w in words), (t, words)
    wrapped = ["Some words\n" + t.upper().replace(" ", "\n \t") + "\nand more" for t in texts]
    more = ["Terms: BSD-3-Clause", "BSD 2-Clause", "bsd-4-clause"]
    out = license_rules.scan(docs_of(spark, texts + wrapped + more)).orderBy("doc_id").collect()
    for r, t, rule in zip(out, texts + wrapped, table + table, strict=False):
        spans = license_spans(unwrapped(t))
        assert set(r["labels"].split(",")) == {x[2] for x in spans} | set(filter(None, r["base_labels"].split(","))) and r["labels"], t
        assert r["score"] >= 0.3 and (rule[0] in r["labels"].split(",") or any(b - a >= len(example(rule[1])) for a, b, _ in spans))
    assert [(r["labels"], r["score"]) for r in out[2 * len(texts) :]] == [("bsd-3-clause", 0.8), ("bsd-2-clause", 0.8), ("bsd-4-clause", 0.8)]


def test_license_texts(spark):
    """Notices in the wording of the licences themselves."""
    mit = """Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED."""
    gpl = """This program is free software: you can redistribute it and/or modify
    it under the terms of the GNU General Public License as published by the Free Software
    Foundation, either version 3 of the License."""
    mpl = "If a copy of the MPL was not distributed with this file, You can obtain one at x"
    out = license_rules.scan(docs_of(spark, [mit, gpl, mpl, "He accepted by mail; the warranty of success."])).orderBy("doc_id").collect()
    assert [r["labels"] for r in out] == ["mit", "gpl", "mpl-2.0", ""]


def test_wrapped_licenses(spark):
    """Whole texts against the plain version on whole texts."""
    texts = [
        "GNU General Public\nLicense, version 3", "licensed under the\n    Apache License,\tVersion 2.0", "Creative  Commons\r\nAttribution 4.0", "all  rights\nreserved", "released\nunder the MIT\n\nLicense",
        "x" * 3000 + "\nMozilla\x0bPublic License\n\n2.0 " + "word\n" * 3000, "mit\u00a0license", "see\nthe license\nGPL\nv2 or\nlater", "CC\nBY", "no notice\nhere", None,
    ]
    for r, t in zip(license_rules.scan(docs_of(spark, texts)).orderBy("doc_id").collect(), texts, strict=True):
        spans = license_spans(unwrapped(t))
        assert r["labels"] == ",".join(sorted({x[2] for x in spans} | set(filter(None, r["base_labels"].split(",")))))
        assert r["doc_id"] > 1 or r["labels"] == ("gpl,gpl-3.0", "apache-2.0")[r["doc_id"]]


def test_license_plan_is_native(spark):
    plan = license_rules.scan(docs_of(spark, ["x"]))._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


def test_quality_on_held_out_rows(spark):
    docs, labels = (spark.read.parquet(f"{DATA.replace('0.001', '0.01')}/{t}.parquet") for t in ("documents", "labels"))
    out = quality_ftrl.classify(docs, labels).join(labels, "doc_id").where("held_out").toPandas()
    assert (out["predicted"] == out["quality"]).mean() > 0.9
    assert out["score"].between(0, 1).all()


def test_rates_meet_the_targets(spark):
    rng = np.random.default_rng(3)
    p = rng.dirichlet([0.3] * 3, 400)
    rows = [(int(n), *map(float, x)) for n, x in zip(rng.integers(1, 900, 400), p, strict=True)]
    mass = spark.createDataFrame(rows, "n_tokens long, " + ", ".join(f"p_{d} double" for d in domain_mix.DOMAINS))
    out = domain_mix.fit_rates(mass, {"clean": 0.5, "low": 0.3, "toxic": 0.2}).toPandas()
    got = np.array([(out["rate"] * out["n_tokens"] * out[f"p_{d}"]).sum() for d in domain_mix.DOMAINS])
    assert (out["rate"] >= 0).all() and np.allclose(got / got.sum(), [0.5, 0.3, 0.2], atol=0.001)
    # the same steps in numpy
    n, rate, last = out["n_tokens"].to_numpy(float), np.ones(400), np.zeros(400)
    q = out[[f"p_{d}" for d in domain_mix.DOMAINS]].to_numpy()
    size = n.sum()
    gram = (q * n[:, None]).T @ q / size + 1e-6 * np.eye(3)
    while abs(off := (n * rate) @ q / size - np.array([0.5, 0.3, 0.2])).max() >= domain_mix.MET and np.sqrt((n * (rate - last) ** 2).sum() / size) >= domain_mix.STILL:
        last, rate = rate, np.maximum(0, rate - q @ np.linalg.solve(gram, off))
    assert np.allclose(rate, out["rate"], atol=1e-6)


def test_rates_that_cannot_meet_the_targets(spark):
    """Bounded rates: no other rates have smaller weighted squares (the conditions of the optimum hold for each row)."""
    rng = np.random.default_rng(4)
    rows = [(int(n), *map(float, x)) for n, x in zip(rng.integers(1, 900, 60), rng.dirichlet([0.3] * 3, 60), strict=True)]
    mass = spark.createDataFrame(rows, "n_tokens long, " + ", ".join(f"p_{d} double" for d in domain_mix.DOMAINS))
    out = domain_mix.fit_rates(mass, {"clean": 0.97, "low": 0.02, "toxic": 0.01}, most=1.0).toPandas()
    n, rate, q = out["n_tokens"].to_numpy(float), out["rate"].to_numpy(), out[[f"p_{d}" for d in domain_mix.DOMAINS]].to_numpy()
    gram = (q * n[:, None]).T @ q / n.sum() + 1e-6 * np.eye(3)
    slope = q @ np.linalg.solve(gram, (n * rate) @ q / n.sum() - np.array([0.97, 0.02, 0.01]))
    assert (slope[rate >= 1] <= 1e-3).all() and (slope[rate <= 0] >= -1e-3).all() and np.allclose(slope[(rate > 0) & (rate < 1)], 0, atol=1e-3)


def plain_bayes(rows, sample_terms):
    """Log posteriors of a Bernoulli model, written out. rows: (domain, set of terms)."""
    n = [sum(k == d for d, _ in rows) for k in range(3)]
    share = {t: [(sum(k == d and t in own for d, own in rows) + 0.5) / (n[k] + 1) for k in range(3)] for t in sample_terms}

    def logs(own):
        return [np.log((n[k] + 1) / (sum(n) + 3)) + sum(np.log(share[t][k] if t in own else 1 - share[t][k]) for t in sample_terms) for k in range(3)]

    return logs


def test_posteriors(spark):
    rng = np.random.default_rng(6)
    words = [f"{a}{b}" for a in "abcdef" for b in "ghijkl"]
    texts = [" ".join(rng.choice(words[k * 8 : k * 8 + 20], 12)) for k in rng.integers(0, 3, 300)]
    kinds = [0 if t.split()[0] in words[:12] else 1 if t.split()[0] in words[12:24] else 2 for t in texts]
    labels = spark.createDataFrame([(i, int(k == 0), int(k == 2)) for i, k in enumerate(kinds[:200])], "doc_id long, quality int, toxic int")
    docs = docs_of(spark, texts)
    base, weights = domain_mix.train(docs, labels)
    assert weights
    logs = plain_bayes([(k, set(t.split())) for k, t in zip(kinds[:200], texts, strict=False)], [w for w in weights if not w.startswith("=")])
    binned = [w for w in weights if w.startswith("=")]
    assert not binned  # all texts are alike in their measures
    for r in domain_mix.expected(docs, labels).collect():
        own = np.array(logs(set(texts[r["doc_id"]].split())))
        assert np.allclose([r[f"p_{d}"] for d in domain_mix.DOMAINS], np.exp(own - own.max()) / np.exp(own - own.max()).sum(), atol=1e-9)


def plain_measures(text):
    """The names of a text's bins, written out."""
    t = text or ""
    size, lines = max(len(t), 1), t.split("\n")
    shares = {"signs": sum(c in "#*$%&|<>" for c in t) / size, "capitals": sum("A" <= c <= "Z" for c in t) / size, "repeats": len(lines) / len(set(lines)), "length": len(t)}
    edges = {"signs": (0.005, 0.02, 0.1), "capitals": (0.005, 0.05, 0.3), "repeats": (1.2, 2.0, 4.0), "length": (50, 200, 1000, 10000)}
    return [f"={k}:{sum(x >= e for e in edges[k])}" for k, x in shares.items()]


def test_posteriors_with_measures(spark):
    texts = [None, "", "\n\n", "ABC#*", "É\U0001f600Ä|<>& \U0001f600", "A" + "b" * 199, "#" + "x y" * 66, "a\nb\na\nb\na\na", "Good bad, GOOD bad", "x" * 10000, "##$$A%%B" * 130, "\r\n a\r\nA", "=signs:0 good"]
    weights = {"good": [1.0, -1.0, 0.5], "bad": [-0.5, 0.25, 2.0]} | {f"={k}:{i}": [0.1 * i, 0.3 - 0.2 * j, -0.05 * i * j] for j, k in enumerate(("signs", "capitals", "repeats", "length")) for i in (0, 1, 3)}
    base = [0.1, -0.2, 0.3]
    docs = docs_of(spark, texts).withColumn("_words", domain_mix.words_of(F.col("text")))
    assert [r["_measures"] for r in domain_mix.with_measures(docs).orderBy("doc_id").collect()] == [plain_measures(t) for t in texts]
    for r in domain_mix.with_posteriors(docs, base, weights).collect():
        own = {w for w in re.split("[ \n\t.,;:!?|]+", (texts[r["doc_id"]] or "").lower()) if w} | set(plain_measures(texts[r["doc_id"]]))
        powers = np.exp(np.array(base) + sum((np.array(weights[w]) for w in own & set(weights)), np.zeros(3)))
        assert np.allclose([r[f"p_{d}"] for d in domain_mix.DOMAINS], powers / powers.sum(), atol=1e-12)


def test_measures_are_made_once(spark):
    """The plan for all documents runs each pattern over a text once: one split into words, one into lines, one removal, one in what that leaves."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    plan = domain_mix.with_posteriors(docs.select("text", domain_mix.words_of(F.col("text")).alias("_words")), [0.0] * 3, {"good": [1.0, 0.0, 0.0], "=signs:0": [0.0, 1.0, 0.0]})
    text = plan.select("p_clean", F.size("_words"))._jdf.queryExecution().executedPlan().toString()
    assert (text.count("regexp_replace("), text.count("split(")) == (2, 2)


def test_posteriors_of_held_out_rows(spark):
    docs, labels = (spark.read.parquet(f"{DATA.replace('0.001', '0.01')}/{t}.parquet") for t in ("documents", "labels"))
    out = domain_mix.expected(docs, labels.where("doc_id % 2 = 0")).join(labels.where("doc_id % 2 = 1"), "doc_id").toPandas()
    domain = np.where(out["toxic"] == 1, 2, np.where(out["quality"] == 0, 1, 0))
    found = out[[f"p_{d}" for d in domain_mix.DOMAINS]].to_numpy().argmax(1)
    assert len(out) > 50 and (found == domain).mean() > 0.9


def test_ftrl():
    """The vectorised trainer against one that goes coordinate by coordinate."""
    rng = np.random.default_rng(8)
    rows = [(rng.integers(0, 32, rng.integers(0, 20)), int(rng.integers(0, 2))) for _ in range(60)]
    got = quality_ftrl.ftrl(rows, 5, 2, 0.7)
    z, n = [0.0] * 33, [0.0] * 33

    def weight(i):
        if abs(z[i]) <= quality_ftrl.L1:
            return 0.0
        return -(z[i] - np.sign(z[i]) * quality_ftrl.L1) / ((quality_ftrl.BETA + n[i] ** 0.5) / quality_ftrl.ALPHA + quality_ftrl.L2)

    for _ in range(2):
        for ids, y in rows:
            x = {int(i): (ids == i).sum() / max(1, len(ids)) ** 0.5 for i in ids} | {32: 1.0}
            w = {i: weight(i) for i in x}
            error = 1 / (1 + np.exp(-sum(w[i] * v for i, v in x.items()))) - y
            for i, v in x.items():
                g = error * v * (0.7 if y else 1.0)
                z[i] += g - ((n[i] + g * g) ** 0.5 - n[i] ** 0.5) / quality_ftrl.ALPHA * w[i]
                n[i] += g * g
    assert np.allclose(got, [weight(i) for i in range(33)], atol=1e-9)


def test_markov_ratios(spark):
    """The ratio of every token against counts and logarithms written out."""
    texts = ["secret = aB3xK9qLmZ7w and plain_identifier_name", "token: zzYYxx112233QQ", "another_long_identifier, more.identifiers.here", None, ""]
    model = secret_models.train(docs_of(spark, texts))
    kinds = [[], []]
    for t in texts:
        base = secret_models.base_spans(t)
        kinds[0] += [secret_models._value(t, x) for x in base]
        kinds[1] += [t[a:b] for a, b in secret_models.identifiers(t or "", base)]
    pairs = [{}, {}]
    for k in (0, 1):
        for token in kinds[k]:
            for a, b in zip("\0" + token, token, strict=False):
                pairs[k][a, b] = pairs[k].get((a, b), 0) + 1

    def log(k, a, b):
        single = lambda c: (sum(n for (_, y), n in pairs[k].items() if y == c) + 0.5) / (sum(pairs[k].values()) + 0.5 * len(secret_models.ALPHABET))
        row = sum(max(0, n - 1) for (x, _), n in pairs[k].items() if x == a)
        return np.log((max(0, pairs[k].get((a, b), 0) - 1) + secret_models.BACKOFF * single(b)) / (row + secret_models.BACKOFF))

    for token in (*kinds[0], *kinds[1], "x1=/+"):
        plain = np.mean([log(0, a, b) - log(1, a, b) for a, b in zip("\0" + token, token, strict=False)])
        assert abs(secret_models.ratio(model, token) - plain) < 1e-9


def disclosing(texts):
    """Terms over the two shares, by counting in plain loops."""
    ids = sorted({(i, t) for i, t in texts if t is not None}, key=str)
    spans = {x: disclosure.base_spans(x[1]) for x in ids}
    own = {x: {w.lower() for w in disclosure._TERM.findall(disclosure.masked(x[1], spans[x]))} for x in ids}
    every = {x: {w.lower() for w in disclosure._TERM.findall(x[1])} for x in ids}
    entity = {x: {disclosure._entity(x[1], s) for s in spans[x]} for x in ids}
    total = len({(i, t) for i, t in texts})
    pairs = {(e, t) for x in ids for e in entity[x] for t in own[x]}
    out = {}
    for e, t in pairs:
        k, n, both = sum(e in entity[x] for x in ids), sum(t in every[x] for x in ids), sum(e in entity[x] and t in own[x] for x in ids)
        for g in (disclosure.GENERALISE, disclosure.REMOVE):
            p, low = both / n, (total / k) ** (g - 1)
            if k < total and p > low and n * (p * np.log(p / low) + ((1 - p) * np.log((1 - p) / (1 - low)) if p < 1 else 0)) >= np.log(max(2, len(pairs))):
                out[t] = max(out.get(t, False), g == disclosure.REMOVE)
    return out


@pytest.mark.parametrize("held", [1 << 20, 0])
def test_terms_are_found_either_way(spark, monkeypatch, held):
    """Terms that tasks hold and terms that are joined give the same spans, those of plain counting; offsets in code points."""
    monkeypatch.setattr(disclosure, "HELD", held)
    monkeypatch.setattr(words, "PIECE", 64)
    texts = [f"éé {i}x ümlaut quintessa, {'a b c ' * 40}QUINTESSA_1 q.v@mail.example.org" for i in range(4)] + ["and quintessa 中 called"] + ["the a b c éé x 中 is called ümlaut"] * 300 + [None, ""]
    docs = docs_of(spark, texts)
    wanted = {t.encode().lower().decode() for t in disclosing(list(enumerate(texts)))}
    assert wanted == {"quintessa"}
    for r in disclosure.find(docs).collect():
        t = texts[r["doc_id"]] or ""
        plain = [f"term:{m.start()}:{m.end()}" for m in disclosure._TERM.finditer(t) if m[0].encode().lower().decode() in wanted]
        assert r["terms"] == ",".join(plain)
    for r in disclosure.sanitise(docs).collect():
        t = texts[r["doc_id"]]
        assert r["text"] == (t and t.replace("q.v@mail.example.org", "[EMAIL]").replace("quintessa", "[TERM]").replace("QUINTESSA", "[ACRONYM]"))


def test_shares_of_information(spark):
    """The terms and their degree against plain counting; repeated rows change neither."""
    rng = np.random.default_rng(9)
    word = lambda: "".join(rng.choice(list("abcdefg"), 2))
    rows = [(i, " ".join([word() for _ in range(8)] + ([f"name{'xyz'[i % 3]} {'xyz'[i % 3]}@mail.example.org"] if i % 4 == 0 else []) + (["namex"] if i % 50 == 1 else []))) for i in range(160)]
    for texts in (rows, rows + rows[:1] * 49 + [(None, None), (200, "")]):
        docs = spark.createDataFrame(texts, "doc_id long, text string")
        base = disclosure.stage(disclosure.find_base(docs))
        got = {r["term_key"]: r["remove"] for r in disclosure.disclosing_terms(docs, base).collect()}
        wanted = disclosing(texts)
        assert wanted and got == {disclosure._term_key(t): r for t, r in wanted.items()}
        if texts is rows:
            first = got
    assert set(first) & set(got)
