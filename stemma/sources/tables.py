"""Views of the star-schema tables as aligned pairs, trees and symbol sequences.

columns   pair_id, pos, st, a, b      one alignment column a row; st 1 match, 2 insert, 3 delete
pairs     pair_id, fam, tau           one aligned pair a row, with its time
symbols   seq_id, pos, c              letters a-t of a text as codes 0-19
edges     node, parent, length        region > nation > customer > order, ids prefixed by level
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

MATCH, INSERT, DELETE = 1, 2, 3
TASK_ROWS = 1 << 18  # line items that a task sorts at once


def dealt(rows: DataFrame, key: str, most: int = TASK_ROWS) -> DataFrame:
    """``rows`` by ``key`` in tasks of about ``most`` rows, however many rows there are; a table of a few such tasks stays as it is.

    Adaptive execution merges the partitions of a shuffle by their compressed bytes, of which sorted rows take many times as much; a
    number of partitions that is asked for stays.
    """
    n = rows.count()
    if n <= 4 * most:
        return rows
    return rows.repartition(max(-(-n // most), int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))), key)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate", "l_returnflag")
    items = dealt(items, "l_orderkey")
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate")
    state = F.when(F.col("l_returnflag") == "A", MATCH).when(F.col("l_returnflag") == "N", INSERT).otherwise(DELETE)
    return items.select(
        F.col("l_orderkey").alias("pair_id"), (F.row_number().over(order) - 1).cast("long").alias("pos"), state.alias("st"),
        (F.col("l_partkey") % 20).cast("int").alias("a"), (F.col("l_suppkey") % 20).cast("int").alias("b"),
    )


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("pair_id"), F.col("o_custkey").alias("fam"), (F.col("o_totalprice") / 100000.0).alias("tau"))


def letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """seq_id, s: documents' letters a-t; a text's other characters are dropped."""
    kept = F.regexp_replace(F.lower(F.coalesce("text", F.lit(""))), "[^a-t]+", "")
    return read(spark, sf_dir, "documents").select(F.col("doc_id").alias("seq_id"), kept.alias("s"))


def symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents' letters one a row, numbered within their text."""
    docs = letters(spark, sf_dir)
    return docs.select("seq_id", F.posexplode(F.split("s", ""))).select("seq_id", F.col("pos").cast("long").alias("pos"), (F.ascii("col") - 97).alias("c")).where("c >= 0")


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    region, nation, customer, orders = (read(spark, sf_dir, t) for t in ("region", "nation", "customer", "orders"))
    name = lambda level, key: F.concat(F.lit(level), F.col(key).cast("string"))
    return (
        region.select(name("r", "r_regionkey").alias("node"), F.lit("root").alias("parent"), F.lit(1.0).alias("length"))
        .unionAll(nation.select(name("n", "n_nationkey"), name("r", "n_regionkey"), F.lit(0.5)))
        .unionAll(customer.select(name("c", "c_custkey"), name("n", "c_nationkey"), F.abs("c_acctbal") / 10000.0))
        .unionAll(orders.select(name("o", "o_orderkey"), name("c", "o_custkey"), F.col("o_totalprice") / 100000.0))
    )


#: The same views for any ANSI engine, as common table expressions.
CTE = """
columns AS (SELECT l_orderkey AS pair_id, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate) - 1 AS BIGINT) AS pos,
  CASE l_returnflag WHEN 'A' THEN 1 WHEN 'N' THEN 2 ELSE 3 END AS st, CAST(l_partkey % 20 AS INT) AS a, CAST(l_suppkey % 20 AS INT) AS b FROM lineitem),
pairs AS (SELECT o_orderkey AS pair_id, o_custkey AS fam, o_totalprice / 100000.0 AS tau FROM orders),
letters AS (SELECT doc_id AS seq_id, regexp_replace(lower(coalesce(text, '')), '[^a-t]', '', 'g') AS s FROM documents),
symbols AS (SELECT seq_id, CAST(pos - 1 AS BIGINT) AS pos, ascii(substr(s, pos, 1)) - 97 AS c FROM (SELECT seq_id, s, unnest(generate_series(1, length(s))) AS pos FROM letters)),
edges AS (SELECT 'r' || r_regionkey AS node, 'root' AS parent, 1.0::DOUBLE AS length FROM region
  UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, 0.5 FROM nation
  UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey, abs(c_acctbal) / 10000.0 FROM customer
  UNION ALL SELECT 'o' || o_orderkey, 'c' || o_custkey, o_totalprice / 100000.0 FROM orders)
"""
