"""Nulls, empty and long texts, repeats, empty tables and clashing columns for every operator."""

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from pagesieve.llm import best_fit_pack, cutting_stock, disclosure, domain_mix, jpeg_media, license_rules, line_rules, quality_ftrl, queries, secret_models, signature_tree_join
from pagesieve.llm.common import drop_stages, drop_stages_since, shared_dir, stage, stages_written

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key long, cell long, class int, label int, low string, rate double, weights string, removed string, terms int, _key long, _turn int, row string, `a.b` int, changed int"
EXTRA = (7, 1, 1, 1, "x", 1.0, "w", "r", 5, 8, 9, "row", 3, 4)
TEXTS = [None, "", " \n\t", "word", "Some words to read. " * 5000, "password = abcdefghijklmnop mail a.b@c.example.org", "password = abcdefghijklmnop mail a.b@c.example.org", "é" * 3000, "All rights reserved. CC BY-SA 4.0"]
LABELS = [(4, 1, 0), (5, 0, 1), (6, None, None), (None, 1, 0), (99, 1, 0), (4, 1, 0)]


def documents(spark, texts):
    rows = [(i, t, None, "s" if i % 2 else None, None, *EXTRA) for i, t in enumerate(texts)]
    rows += [(None, t, None, None, None, *EXTRA) for t in texts[:6:5]] + rows[-1:]
    return spark.createDataFrame(rows if texts else [], SCHEMA)


def labels(spark):
    return spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")


OPERATORS = {
    "op1": lambda d, y: line_rules.judge(d),
    "op2": domain_mix.mix,
    "op3": lambda d, y: jpeg_media.media_columns(d),
    "op5": lambda d, y: signature_tree_join.jaccard_classes(d),
    "op6": lambda d, y: secret_models.digest(d),
    "op7": quality_ftrl.classify,
    "op8": lambda d, y: license_rules.scan(d),
    "op10": lambda d, y: disclosure.digest(d),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_one_row_for_each_row(spark, name):
    docs = documents(spark, TEXTS)
    out = OPERATORS[name](docs, labels(spark)).collect()
    ids = lambda rows: sorted(r["doc_id"] if r["doc_id"] is not None else -1 for r in rows)
    assert ids(out) == ids(docs.collect())
    same = [r for r in out if r["doc_id"] == 8]
    assert len(same) == 2 and same[0] == same[1]


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_tables(spark, name):
    assert OPERATORS[name](documents(spark, []), labels(spark).limit(0)).count() == 0


def test_packers_keep_every_id(spark):
    docs = documents(spark, TEXTS)
    n = docs.count()
    pieces = cutting_stock.pack(docs).toPandas()
    assert pieces.groupby("sequence_id")["length"].sum().max() <= 2048
    assert (pieces["start"] == 0).sum() == n
    assert pieces["length"].sum() == pieces[pieces["start"] == 0]["doc_tokens"].sum()
    rows = best_fit_pack.packed_matrices(docs).toPandas()
    assert rows["n_tokens"].sum() == pieces["length"].sum() and set(rows["ids"].map(len)) == {4096}
    assert cutting_stock.pack(documents(spark, [])).count() == 0 and best_fit_pack.packed_matrices(documents(spark, [])).count() == 0


def test_stages_keep_the_columns(spark, tmp_path):
    labels(spark).write.parquet(f"{tmp_path}/labels.parquet")
    fine = [" ".join(f"w{chr(97 + i % 26)}{i}" for i in range(90)) + " mail a.b@c.example.org"]
    for texts in (TEXTS + fine, []):
        docs = documents(spark, texts)
        for _, f in corpus_pipeline.STAGES[:-1]:
            out = f(spark, docs, str(tmp_path))
            assert out.columns == docs.columns and dict(out.dtypes) == dict(docs.dtypes)
            rows = out.collect()
            assert all(tuple(r[5:]) == EXTRA for r in rows) and bool(rows) == bool(texts)


def test_stages_take_effect(spark, tmp_path):
    letters = "abcdefghijklmnopqrstuvwxyz"
    words = [" ".join(f"w{letters[i // 26]}{letters[i % 26]}x{letters[j // 26]}{letters[j % 26]}" for j in range(80)) for i in range(60)]
    texts = [w + "\nThe same line for all" for w in words] + ["too short"] + [words[0] + "\nThe same line for all more"]
    texts[1] += " mail x@y.example.org"
    docs = spark.createDataFrame([(i, t, "en", "h", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    kept = line_rules.apply_rules(docs, max_docs=20).orderBy("doc_id").collect()
    assert [r["doc_id"] for r in kept] == [*range(60), 61]
    assert all("The same line for all" not in r["text"].split("\n") for r in kept) and kept[60]["text"].endswith("for all more")
    assert all(r["n_chars"] == len(r["text"]) for r in kept)
    assert sorted(r["doc_id"] for r in signature_tree_join.keep_representatives(docs).collect()) == list(range(61))
    assert "[EMAIL]" in disclosure.sanitise(docs).where("doc_id = 1").first()["text"]
    assert disclosure.sanitise(docs).where(F.col("text").contains("@")).count() == 0


def against_sql(spark, name, docs, tmp_path):
    docs.select("doc_id", "text", "source").write.parquet(f"{tmp_path}/documents.parquet")
    db = duckdb.connect()
    db.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    wanted = db.sql(queries.oracle_sql()[name]).df()
    got = queries.queries()[name](spark, str(tmp_path)).toPandas()
    plain = lambda f: sorted(map(tuple, f[sorted(wanted.columns)].astype(object).values.tolist()))
    assert plain(got) == plain(wanted)
    return got


def words_of(rng, n):
    return " ".join("".join(rng.choice(list("abcdefgh"), 4)) for _ in range(n))


def test_line_rules_on_repeated_rows(spark, tmp_path):
    """Distinct documents count: 25 rows of one document are one; a line in exactly 20 documents stays, one in 21 goes."""
    import numpy as np

    rng = np.random.default_rng(11)
    shared, common = words_of(rng, 30), words_of(rng, 30)
    rows = [(1, shared + "\n" + words_of(rng, 40), "h")] * 25 + [(2, shared + "\n" + words_of(rng, 40), "h"), (3, None, None), (4, "", "h")]
    rows += [(i, words_of(rng, 60) + (f"\n{common} {i}" if i < 30 else "\nanother line here 9"), "h" if i < 30 or i % 2 else "other") for i in range(10, 51)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = against_sql(spark, "op1_line_rules", docs, tmp_path).groupby("doc_id").first()
    assert not got.loc[[1, 2], "removed_words"].any() and got.loc[[1, 2], "kept"].all()
    assert not got.loc[range(10, 51), "removed_words"].any()  # 20 and 11 documents of a host
    more = docs.union(spark.createDataFrame([(60, words_of(rng, 50) + f"\n{common}  5", "h")], docs.schema))
    (tmp_path / "more").mkdir()
    got = against_sql(spark, "op1_line_rules", more, tmp_path / "more").groupby("doc_id").first()
    assert got.loc[60, "removed_words"] == 31 and (got.loc[range(10, 30), "removed_words"] == 31).all() and not got.loc[[1, 2], "removed_words"].any()


def test_jaccard_ties(spark, tmp_path):
    """Pairs exactly at the limit and just under it."""
    base = [f"w{i}" for i in range(40)]
    texts = [" ".join(base[:n]) for n in (40, 38, 37, 22, 21, 20)] + [" ".join(base[:40]).upper(), None, "w1 w2", "W1  w2"]
    rows = [(i, t, "h") for i, t in enumerate(texts)]
    got = against_sql(spark, "op5_signature_tree_join", spark.createDataFrame(rows, "doc_id long, text string, source string"), tmp_path)
    assert dict(zip(got["doc_id"], got["component_id"], strict=True))[1] == 0


def test_pipeline_end_to_end(spark, tmp_path):
    """run() gives what its stages give one after another, and loses no id of what they keep."""
    source = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{source}/documents.parquet")
    extra = docs.union(docs.limit(3)).union(spark.createDataFrame([(None, None, None, None, None), (10_000, "", None, None, 0), (10_001, " " * 600_000 + "x", "en", "src0", 1)], docs.schema))
    extra.write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{source}/labels.parquet").write.parquet(f"{tmp_path}/labels.parquet")
    step = spark.read.parquet(f"{tmp_path}/documents.parquet")
    sizes = [step.count()]
    for _, f in corpus_pipeline.STAGES[:-1]:
        step = stage(f(spark, step, str(tmp_path)))
        sizes.append(step.count())
    assert sizes == sorted(sizes, reverse=True) and 0 < sizes[-1] < sizes[0]
    out = corpus_pipeline.run(spark, str(tmp_path)).toPandas()
    firsts = out[out["start"] == 0]
    assert sorted(firsts["doc_id"]) == sorted(r["doc_id"] for r in step.collect()) and firsts["doc_tokens"].sum() == out["length"].sum()
    assert out.groupby("sequence_id")["length"].sum().max() <= 2048 and isinstance(out, pd.DataFrame)


def test_stages_of_a_run_can_be_dropped(spark):
    """Tables from before the mark and the last ones stay."""
    before, mark = stage(spark.range(2)), stages_written()
    gone, last = stage(spark.range(3)), stage(spark.range(4))
    files = gone.inputFiles()
    drop_stages_since(spark, mark, but=1)
    assert before.count() == 2 and last.count() == 4 and stages_written() == mark + 1
    with pytest.raises(Exception):  # noqa: B017
        spark.read.parquet(*files).count()


def test_stages_can_be_dropped(spark):
    held = stage(spark.range(3))
    assert held.count() == 3 and shared_dir(spark)
    drop_stages(spark)
    with pytest.raises(Exception):  # noqa: B017
        spark.read.parquet(*[f for f in held.inputFiles()]).count()
