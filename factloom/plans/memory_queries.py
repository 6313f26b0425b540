"""Queries on chains of scopes and their memory, with their SQL. Regions are modules, nations functions in them, customers functions or (one segment)
classes in those, orders functions of customers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.functions import abstract as av
from factloom.operators import memory
from factloom.operators.fixpoint import union
from factloom.plans.programs import read

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _named(letter: str, key: str):
    return F.concat(F.lit(letter), F.col(key).cast("string"))


def scopes(spark: SparkSession, sf_dir: str, orders: bool) -> DataFrame:
    kind = F.when(F.col("c_mktsegment") == "BUILDING", "class").otherwise("function")
    parts = [
        read(spark, sf_dir, "region").select(_named("r", "r_regionkey").alias("scope"), F.lit(None).cast("string").alias("parent"), F.lit("module").alias("kind")),
        read(spark, sf_dir, "nation").select(_named("n", "n_nationkey").alias("scope"), _named("r", "n_regionkey").alias("parent"), F.lit("function").alias("kind")),
        read(spark, sf_dir, "customer").select(_named("c", "c_custkey").alias("scope"), _named("n", "c_nationkey").alias("parent"), kind.alias("kind")),
    ]
    if orders:
        parts.append(read(spark, sf_dir, "orders").select(_named("o", "o_orderkey").alias("scope"), _named("c", "o_custkey").alias("parent"), F.lit("function").alias("kind")))
    return union(parts)


@query("""WITH o AS (SELECT * FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey)
SELECT 'o' || o_orderkey AS scope, 'rate' AS name, CASE WHEN o_orderstatus = 'F' THEN 'o' || o_orderkey WHEN c_acctbal > 0 AND c_mktsegment <> 'BUILDING' THEN 'c' || c_custkey ELSE 'n' || c_nationkey END AS holder,
CAST(CASE WHEN o_orderstatus = 'F' THEN o_orderkey WHEN c_acctbal > 0 AND c_mktsegment <> 'BUILDING' THEN c_custkey ELSE c_nationkey END AS BIGINT) AS value FROM o
UNION ALL SELECT 'o' || o_orderkey, 'limit', 'r' || n_regionkey, CAST(n_regionkey AS BIGINT) FROM o UNION ALL SELECT 'o' || o_orderkey, 'own', 'c' || c_custkey, CAST(c_custkey AS BIGINT) FROM o WHERE c_mktsegment <> 'BUILDING'""")
def scope_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M7: which scope holds the names that each order uses; a class's names are not seen inside it."""
    row = lambda d, letter, key, name: d.select(_named(letter, key).alias("scope"), F.lit(name).alias("name"), F.col(key).cast("long").alias("value"))
    c, o = read(spark, sf_dir, "customer"), read(spark, sf_dir, "orders")
    held = union([row(read(spark, sf_dir, "region"), "r", "r_regionkey", "limit"), row(read(spark, sf_dir, "nation"), "n", "n_nationkey", "rate"), row(c.where("c_acctbal > 0"), "c", "c_custkey", "rate"), row(c, "c", "c_custkey", "own"), row(o.where("o_orderstatus = 'F'"), "o", "o_orderkey", "rate")])
    wanted = o.select(_named("o", "o_orderkey").alias("scope"), F.explode(F.array(*map(F.lit, ("rate", "limit", "own", "absent")))).alias("name"))
    return memory.lookup(wanted, memory.chains(scopes(spark, sf_dir, True)), held)


@query("""WITH b AS (SELECT c_custkey, CASE WHEN c_acctbal > 0 THEN c_custkey ELSE c_nationkey END AS v, CASE WHEN c_acctbal > 0 THEN 'c' || c_custkey ELSE 'n' || c_nationkey END AS h FROM customer)
SELECT '' AS ctx, 'c' || c_custkey AS scope, h AS holder, 'int' AS types, CAST(v AS DOUBLE) AS lo, CAST(v AS DOUBLE) AS hi FROM b
UNION ALL SELECT '1', 'c' || c_custkey, 'c' || c_custkey, 'int', CAST(-1 AS DOUBLE), CAST(CASE WHEN c_custkey % 3 = 0 THEN c_custkey ELSE v END AS DOUBLE) FROM b""")
def scope_memory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M8: what every customer's scope sees with and without a context, after values were stored and merged under the context."""
    c = read(spark, sf_dir, "customer")
    value = lambda lo, hi: [F.lit(av.BIT["int"]).cast("long").alias("types"), lo.cast("double").alias("lo"), hi.cast("double").alias("hi")]
    key = lambda ctx, letter, k: [F.lit(ctx).alias("ctx"), _named(letter, k).alias("scope"), F.lit("rate").alias("name")]
    k, n = F.col("c_custkey"), F.col("n_nationkey")
    first = read(spark, sf_dir, "nation").select(*key("", "n", "n_nationkey"), *value(n, n)).union(c.where("c_acctbal > 0").select(*key("", "c", "c_custkey"), *value(k, k)))
    chain = memory.chains(scopes(spark, sf_dir, False))
    m = memory.put(first, c.where("c_custkey % 3 = 0").select(*key("1", "c", "c_custkey"), *value(F.lit(0), k)))
    m = memory.merge(m, chain, c.select(*key("1", "c", "c_custkey"), *value(F.lit(-1), F.lit(-1))))
    wanted = c.select(F.explode(F.array(F.lit(""), F.lit("1"))).alias("ctx"), _named("c", "c_custkey").alias("scope"), F.lit("rate").alias("name"))
    return memory.get(m, chain, wanted).select("ctx", "scope", "holder", av.names(F.col("types")).alias("types"), "lo", "hi")
