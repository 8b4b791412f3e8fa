"""Helpers that every operator of this subpackage shares."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables, read by Spark only (the folder may be in any store)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lower_ascii(col: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(col, UPPER, LOWER)


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def row_key(*columns: Column) -> Column:
    """16 bytes that tell rows apart by these columns; a null is unlike any value, and values don't run together."""
    parts = []
    for c in columns:
        value = c.cast("string")
        parts.append(F.coalesce(F.concat(F.lit("="), F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-")))
    return F.unhex(F.md5(F.concat(*parts).cast("binary")))


def boxed(docs: DataFrame) -> DataFrame:
    """docs with all its columns in one struct, row, beside which an operator's own columns clash with nothing."""
    return docs.select(F.struct(*[F.col(quoted(c)) for c in docs.columns]).alias("row"))


def unboxed(rows: DataFrame, docs: DataFrame, text: Column | None = None, changed: Column | None = None) -> DataFrame:
    """The columns of docs out of row; with text, that in place of the text, and where changed n_chars (if there is one) follows it."""
    out = []
    for f in docs.schema:
        own = F.col("row")[f.name]
        if text is not None and f.name == "text":
            own = text
        elif text is not None and f.name == "n_chars":
            own = F.when(changed, F.length(text)).otherwise(own).cast(f.dataType)
        out.append(own.alias(f.name))
    return rows.select(*out)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one only where none is set and the master is local, as in tests."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        where = tempfile.mkdtemp(prefix="pagesieve-")
        atexit.register(shutil.rmtree, where, True)
        spark.conf.set("spark.checkpoint.dir", where)
    return where


#: One folder in the shared one for each driver process.
_RUN = f"pagesieve-{uuid.uuid4().hex}"
#: Paths of this process's staged tables that are not deleted yet.
_WRITTEN: list[str] = []


def stage(df: DataFrame) -> DataFrame:
    """Write a table to the shared folder and read it back.

    This cuts the lineage: the work is done once, and what is lost with an executor is read again from
    the shared folder. drop_stages() removes these tables when the results that rest on them are written.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{_RUN}/stage-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _WRITTEN.append(path)
    return spark.read.schema(df.schema).parquet(path)


def stages_written() -> int:
    return len(_WRITTEN)


def drop_stages_since(spark: SparkSession, mark: int, but: int = 0) -> None:
    """Delete the tables that stage() wrote since stages_written() gave mark, but the last ones (as many as but says)."""
    gone = _WRITTEN[mark : len(_WRITTEN) - but]
    for path in gone:
        _delete(spark, path)
        _WRITTEN.remove(path)


def _delete(spark: SparkSession, path: str) -> None:
    context = spark.sparkContext
    where = context._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(context._jsc.hadoopConfiguration()).delete(where, True)


def drop_stages(spark: SparkSession) -> None:
    """Delete all tables that stage() wrote for this driver process; what was not written elsewhere is then lost."""
    _delete(spark, f"{shared_dir(spark).rstrip('/')}/{_RUN}")
    _WRITTEN.clear()


def components(edges: DataFrame) -> DataFrame:
    """Connected components of edges (a, b), two columns of one integer type.

    Returns (node, root) for every node that occurs in an edge; root is the smallest node of its component.
    Each round hooks every node to its smallest neighbour, follows these pointers twice and contracts the
    graph, so the number of rounds grows with the logarithm of the longest chain. Only the edge count of a
    round reaches the driver. Self-links and repeated links are allowed; an empty table gives an empty one.
    """
    live = edges.select("a", "b").where("a is not null and b is not null").distinct()
    roots = None
    while True:
        live = stage(live)
        both = live.union(live.select(F.col("b").alias("a"), F.col("a").alias("b")))
        up = stage(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("up")))
        for _ in range(2):
            at = up.select(F.col("node").alias("up"), F.col("up").alias("higher"))
            up = up.join(at, "up").select("node", F.col("higher").alias("up"))
        up = stage(up)
        if roots is None:
            roots = up.select("node", F.col("up").alias("root"))
        else:
            to = up.select(F.col("node").alias("root"), F.col("up").alias("higher"))
            roots = stage(roots.join(to, "root", "left").select("node", F.coalesce("higher", "root").alias("root")))
        left = up.select(F.col("node").alias("a"), F.col("up").alias("ra"))
        right = up.select(F.col("node").alias("b"), F.col("up").alias("rb"))
        live = live.join(left, "a").join(right, "b").where("ra <> rb").select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct()
        if live.isEmpty():
            return roots
