"""Every query of the report library against its SQL, on the smallest tables."""

import glob
import os

import duckdb
import pandas as pd
import pytest

from pagesieve.plans.queries import QUERIES, SQL

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


def rows(frame):
    frame = frame[sorted(frame.columns)].astype(object)
    return sorted(tuple("" if pd.isna(v) else str(int(v)) if isinstance(v, (int, float, bool)) else str(v) for v in r) for r in frame.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, db, name):
    assert rows(QUERIES[name](spark, DATA).toPandas()) == rows(db.sql(SQL[name]).df())


def table(spark, db, name, path, made):
    """A table as Spark reads it below path, and the same to DuckDB."""
    made.write.parquet(f"{path}/{name}.parquet")
    db.sql(f"CREATE TABLE {name} AS SELECT * FROM '{path}/{name}.parquet/*.parquet'")


#: Network addresses beside the words that the queries look for; the second one with a number glued to it.
ADDRESSED = ("A License at 26.58.236.81 und so", "The token +1 555-8050 68.66.253.95 is worthless", "Apache.\n92.142.22.65, License", "A token 3 . 5")


@pytest.mark.parametrize("name", ["note_texts", "theme_hits", "hits_of_themes"])
def test_addresses_stay(spark, tmp_path, name):
    db = duckdb.connect()
    table(spark, db, "documents", tmp_path, spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(ADDRESSED)], "doc_id long, text string, lang string, source string, n_chars int"))
    assert rows(QUERIES[name](spark, str(tmp_path)).toPandas()) == rows(db.sql(SQL[name]).df())


def test_amounts_over_page_numbers(spark, tmp_path):
    """Suppliers of larger tables, whose amounts and page numbers together look like dates."""
    db = duckdb.connect()
    suppliers = spark.createDataFrame([(k, f"Supplier {k}") for k in (1, 2001, 2004, 19812, 19822, 59999)], "s_suppkey long, s_name string")
    table(spark, db, "supplier", tmp_path, suppliers)
    assert rows(QUERIES["page_headers"](spark, str(tmp_path)).toPandas()) == rows(db.sql(SQL["page_headers"]).df())
