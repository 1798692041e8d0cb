"""Scratch tables in the shared folder, ASCII word helpers and connected components."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The byte tables behind the two word definitions of this package.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
ALNUM = bytes((b + 32 if 65 <= b <= 90 else b) if b >= 128 or chr(b).isalnum() else 32 for b in range(256))

SPACES = " \t\n\x0b\f\r"
_live: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session; a temporary folder of our own only where it is unset (local tests)."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="tidemill-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def stored(spark: SparkSession, df: DataFrame) -> DataFrame:
    """Write df once to the shared folder and read it back: cuts lineage and survives lost executors."""
    path = f"{shared_dir(spark)}/tidemill-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _live.append((spark, path))
    out = spark.read.schema(df.schema).parquet(path)
    out._tidemill_path = path
    return out


def dropped(spark: SparkSession, *tables: DataFrame | None) -> None:
    """Delete stored tables that nothing reads any more."""
    for t in tables:
        path = getattr(t, "_tidemill_path", None)
        if path:
            _delete(spark, path)
            _live[:] = [x for x in _live if x[1] != path]


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


@atexit.register
def _tidy() -> None:
    for spark, path in _live:
        try:
            _delete(spark, path)
        except Exception:  # the JVM may be gone by now; the shared folder's owner then tidies it
            return


def ascii_lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def space_words(c: Column) -> Column:
    """Array of the words [^\\x20\\x09-\\x0D]+ of a text; null and blank texts give an empty array."""
    t = F.btrim(F.coalesce(c, F.lit("")), F.lit(SPACES))
    return F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, "[ \\x09-\\x0D]+"))


def connected_components(spark: SparkSession, edges: DataFrame) -> DataFrame:
    """(node, component) for the nodes of edges (a, b); component is the smallest node reachable.

    Alternating large-star and small-star rounds. Every step is a grouped minimum with map-side
    combine and an equi-join whose hot side adaptive execution can split; nothing is collected.
    """
    cur = stored(spark, edges.where("a <> b").selectExpr("greatest(a, b) AS u", "least(a, b) AS v").distinct())
    while True:
        roots = cur.select(F.col("v").alias("u")).distinct()
        shape = cur.agg(F.count("*").alias("n"), F.count_distinct("u").alias("d")).first()
        if shape["n"] == shape["d"] and cur.join(roots, "u", "left_semi").isEmpty():
            return cur.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots.selectExpr("u", "u"))
        both = cur.union(cur.selectExpr("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).selectExpr("u", "least(u, m) AS m")
        large = both.where("v > u").join(least, "u").selectExpr("v AS u", "m AS v").where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        nxt = stored(spark, small.selectExpr("greatest(v, m) AS u", "least(v, m) AS v").union(small.select("u", "m")).where("u <> v").distinct())
        dropped(spark, cur)
        cur = nxt
