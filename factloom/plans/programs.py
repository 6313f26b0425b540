"""Programs as relations, derived from the supplied tables, as DataFrames and as the same SQL.

Event programs: a user is a scope, an event a statement that stores its type and loads the type chosen by props.k. Views also skip
one statement; errors also jump back to the latest earlier signup. As labelled code, a signup is a label, a click a no-op, an
error a conditional jump, a purchase a jump to the next signup, or a return without one.

Order programs: an order is straight code and each of its lines, in the order of number and keys, a statement with a variable of its own. The first line
allocates the order's object; every other copies from the line before. An urgent order's first line copies from the first line of its customer's
order before. A line with flag A stores its part's variable, which holds the part's object, in the field of its status; one with flag R loads that field
into one more variable. Every line takes part.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

TYPES = ("click", "error", "purchase", "signup", "view")


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def event_statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(scope, idx, var, lvar, sig, nsig, last): sig and nsig are the nearest signups before and behind, last the scope's last idx."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = read(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type", "props")
    e = e.withColumn("idx", F.row_number().over(w).cast("long"))
    sign = F.when(F.col("event_type") == "signup", F.col("idx"))
    k = F.regexp_extract("props", "([0-9]+)", 1).cast("int") % 5
    return e.select(
        F.col("user_id").alias("scope"),
        "idx",
        F.col("event_type").alias("var"),
        F.element_at(F.array(*map(F.lit, TYPES)), k + 1).alias("lvar"),
        F.max(sign).over(w.rowsBetween(Window.unboundedPreceding, -1)).alias("sig"),
        F.min(sign).over(w.rowsBetween(1, Window.unboundedFollowing)).alias("nsig"),
        F.max("idx").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("last"),
    )


def event_edges(stmt: DataFrame) -> DataFrame:
    """(scope, src, tgt)."""
    i = F.col("idx")
    tgts = F.array_distinct(F.array_compact(F.array(F.when(i < F.col("last"), i + 1), F.when((F.col("var") == "view") & (i + 2 <= F.col("last")), i + 2), F.when(F.col("var") == "error", F.col("sig")))))
    return stmt.select("scope", i.alias("src"), F.explode(tgts).alias("tgt"))


EVENT_SQL = """
ev AS (SELECT user_id AS scope, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS idx, ts, event_id, event_type AS var,
  CASE CAST(regexp_extract(props, '[0-9]+') AS INTEGER) % 5 WHEN 0 THEN 'click' WHEN 1 THEN 'error' WHEN 2 THEN 'purchase' WHEN 3 THEN 'signup' ELSE 'view' END AS lvar FROM events),
stmt AS (SELECT scope, idx, var, lvar,
  max(CASE WHEN var = 'signup' THEN idx END) OVER (PARTITION BY scope ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS sig,
  min(CASE WHEN var = 'signup' THEN idx END) OVER (PARTITION BY scope ORDER BY idx ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS nsig,
  max(idx) OVER (PARTITION BY scope) AS last FROM ev),
edge AS (SELECT scope, idx AS src, idx + 1 AS tgt FROM stmt WHERE idx < last
  UNION SELECT scope, idx, idx + 2 FROM stmt WHERE var = 'view' AND idx + 2 <= last
  UNION SELECT scope, idx, sig FROM stmt WHERE var = 'error' AND sig IS NOT NULL)"""


def event_code(stmt: DataFrame) -> DataFrame:
    """(scope, idx, kind, label, var, lvar): the event program as labelled code."""
    v = F.col("var")
    kind = F.when(v == "signup", "Label").when(v == "click", "Pass").when((v == "error") & F.col("sig").isNotNull(), "JumpIfFalse").when((v == "purchase") & F.col("nsig").isNotNull(), "Goto").when(v == "purchase", "Return").otherwise("Assign")
    label = F.when(v == "signup", F.col("idx")).when(v == "error", F.col("sig")).when(v == "purchase", F.col("nsig"))
    return stmt.select("scope", "idx", kind.alias("kind"), label.alias("label"), "var", "lvar")


CODE_SQL = EVENT_SQL + """,
code AS (SELECT scope, idx, CASE WHEN var = 'signup' THEN 'Label' WHEN var = 'click' THEN 'Pass' WHEN var = 'error' AND sig IS NOT NULL THEN 'JumpIfFalse'
  WHEN var = 'purchase' AND nsig IS NOT NULL THEN 'Goto' WHEN var = 'purchase' THEN 'Return' ELSE 'Assign' END AS kind,
  CASE WHEN var = 'signup' THEN idx WHEN var = 'error' THEN sig WHEN var = 'purchase' THEN nsig END AS label, var, lvar FROM stmt),
lagged AS (SELECT *, CASE WHEN kind = 'Label' OR coalesce(lag(kind) OVER (PARTITION BY scope ORDER BY idx) IN ('Goto', 'JumpIfFalse', 'JumpIfTrue', 'Catch', 'Return', 'Raise'), false) THEN 1 ELSE 0 END AS leads FROM code),
summed AS (SELECT *, sum(leads) OVER (PARTITION BY scope ORDER BY idx) AS s FROM lagged),
blocked AS (SELECT scope, idx, kind, label, var, lvar, CAST(s - min(s) OVER (PARTITION BY scope) AS BIGINT) AS blk FROM summed),
lastof AS (SELECT scope, blk, arg_max(kind, idx) AS kind FROM blocked GROUP BY scope, blk),
bedge AS (SELECT scope, src, tgt, 'Normal' AS kind FROM (SELECT scope, blk AS src, lead(blk) OVER (PARTITION BY scope ORDER BY blk) AS tgt, kind FROM lastof) x WHERE tgt IS NOT NULL AND kind NOT IN ('Goto', 'Return', 'Raise')
  UNION SELECT j.scope, j.blk, l.blk, CASE WHEN j.kind = 'Goto' THEN 'Goto' ELSE 'If' END FROM blocked j JOIN blocked l ON j.scope = l.scope AND l.kind = 'Label' AND j.label = l.label WHERE j.kind IN ('Goto', 'JumpIfFalse')),
sedge AS (SELECT scope, src, tgt, 'Normal' AS kind FROM (SELECT scope, idx AS src, lead(idx) OVER (PARTITION BY scope ORDER BY idx) AS tgt, kind FROM code) x WHERE tgt IS NOT NULL AND kind NOT IN ('Goto', 'Return', 'Raise')
  UNION SELECT j.scope, j.idx, l.idx, CASE WHEN j.kind = 'Goto' THEN 'Goto' ELSE 'If' END FROM code j JOIN code l ON j.scope = l.scope AND l.kind = 'Label' AND j.label = l.label WHERE j.kind IN ('Goto', 'JumpIfFalse'))"""


LINE_KEY = ("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_shipdate", "l_returnflag", "l_linestatus")
LOADED = 10**15  # taken off a line's negative key, this is the variable that it loads into
STEP = 1000  # a line's variable is its order's key times this, plus its place


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(v, o, k, part, supp, flag, status): the statement of each line; k is its place from 1."""
    li = read(spark, sf_dir, "lineitem").select("l_orderkey", *LINE_KEY)
    li = li.withColumn("k", F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*LINE_KEY)).cast("long"))
    return li.select((F.col("l_orderkey") * STEP + F.col("k")).alias("v"), F.col("l_orderkey").alias("o"), "k", F.col("l_partkey").alias("part"), F.col("l_suppkey").alias("supp"), F.col("l_returnflag").alias("flag"), F.col("l_linestatus").alias("status"))


def copies(spark: SparkSession, sf_dir: str, li: DataFrame | None = None) -> DataFrame:
    """(src, tgt): tgt copies from src."""
    li = lines(spark, sf_dir) if li is None else li
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    first = li.where("k = 1").select("o", "v")
    o = read(spark, sf_dir, "orders").join(first, F.col("o_orderkey") == F.col("o"), "left_semi").select("o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority")
    o = o.withColumn("prev", F.lag("o_orderkey").over(w)).where("o_orderpriority = '1-URGENT' and prev is not null")
    return li.where("k > 1").select((F.col("v") - 1).alias("src"), F.col("v").alias("tgt")).union(o.select(F.col("prev") * STEP + 1, F.col("o_orderkey") * STEP + 1))


def allocations(spark: SparkSession, sf_dir: str, li: DataFrame | None = None) -> DataFrame:
    """(node, obj): orders' objects in first lines, parts' in their variables (both with negative keys)."""
    li = lines(spark, sf_dir) if li is None else li
    parts = li.select((-F.col("part")).alias("node")).distinct()
    return li.where("k = 1").select(F.col("v").alias("node"), F.col("o").alias("obj")).union(parts.select("node", F.col("node").alias("obj")))


def field_accesses(spark: SparkSession, sf_dir: str, li: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """load(base, field, tgt), store(base, field, src)."""
    li = lines(spark, sf_dir) if li is None else li
    base, field = F.col("v").alias("base"), F.col("status").alias("field")
    return li.where("flag = 'R'").select(base, field, (-F.col("v") - LOADED).alias("tgt")), li.where("flag = 'A'").select(base, field, (-F.col("part")).alias("src")).distinct()


COPY_SQL = f"""
li AS (SELECT l_orderkey * {STEP} + k AS v, l_orderkey AS o, k, l_partkey AS part, l_suppkey AS supp, l_returnflag AS flag, l_linestatus AS status
  FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY {", ".join(LINE_KEY)}) AS k FROM lineitem) x),
cp AS (SELECT v - 1 AS src, v AS tgt FROM li WHERE k > 1 UNION ALL SELECT prev * {STEP} + 1, o_orderkey * {STEP} + 1
  FROM (SELECT o_orderkey, o_orderpriority, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS prev FROM orders WHERE o_orderkey IN (SELECT o FROM li)) x WHERE o_orderpriority = '1-URGENT' AND prev IS NOT NULL),
al AS (SELECT v AS node, o AS obj FROM li WHERE k = 1 UNION ALL SELECT DISTINCT -part, -part FROM li)"""

FIELD_SQL = COPY_SQL + f""",
acc AS (SELECT DISTINCT v AS base, status AS field, CASE WHEN flag = 'A' THEN -part ELSE -v - {LOADED} END AS v, CASE WHEN flag = 'A' THEN 1 ELSE 0 END AS st FROM li WHERE flag IN ('A', 'R'))"""


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(src, tgt, site): customers call parts through their orders' lines; the site is the order."""
    o = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    li = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey")
    return o.join(li, o.o_orderkey == li.l_orderkey).select(F.concat(F.lit("c"), "o_custkey").alias("src"), F.concat(F.lit("p"), "l_partkey").alias("tgt"), F.col("o_orderkey").alias("site"))


CALL_SQL = """
cg AS (SELECT 'c' || o_custkey AS src, 'p' || l_partkey AS tgt, o_orderkey AS site FROM orders JOIN lineitem ON o_orderkey = l_orderkey)"""
