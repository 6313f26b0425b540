"""Queries on the call graph by assignments, with their SQL. A customer is a module: functions in nested tables, a class that keeps one of them, an
own iterator and a generator; which function is called depends on the balance, which class on the segment."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.operators import assignments
from factloom.plans.front_queries import filled
from factloom.plans.programs import read
from factloom.session import Scratch
from factloom.sources import python_files

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}

MODULE = """class Base:
    def go(self, x):
        return self.run(x)
class {seg}(Base):
    def __init__(self, f):
        self.run = f
def up(x):
    return x
def down(x):
    return up(x)
def gen():
    yield {pick}
table = {'up': {'f': up}, 'down': {'f': down}}
first = table['{pick}']['f'](1)
conf = table['{other}']
obj = {seg}(conf['f'])
obj.go(2)
for g in gen():
    g(3)
def late(x):
    pass
obj.after = late
with open('x') as h:
    obj.after(up(4))
"""

CUSTOMERS = """WITH cu AS (SELECT 'a' || c_custkey AS m, CASE WHEN c_acctbal > 0 THEN 'up' ELSE 'down' END AS pick, CASE WHEN c_acctbal > 0 THEN 'down' ELSE 'up' END AS other, lower(regexp_replace(c_mktsegment, '[^A-Za-z]', '', 'g')) AS seg FROM customer)"""


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLE_SQL[f.__name__] = f"{CUSTOMERS} {sql}"
        return f

    return add


def program(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(module, text): a module for each customer."""
    plus = F.col("c_acctbal") > 0
    c = read(spark, sf_dir, "customer").select(F.concat(F.lit("a"), F.col("c_custkey").cast("string")).alias("module"), F.lower(F.regexp_replace("c_mktsegment", "[^A-Za-z]", "")).alias("seg"), F.when(plus, "up").otherwise("down").alias("pick"), F.when(plus, "down").otherwise("up").alias("other"))
    return c.select("module", filled(MODULE, seg=F.col("seg"), pick=F.col("pick"), other=F.col("other")).alias("text"))


@query("""SELECT 'before' AS pass, m AS module, src, tgt, n FROM cu, LATERAL (VALUES ('', seg || '.__init__', 1), ('', 'gen', 1), ('', 'up', 1), ('down', 'up', 1)) v(src, tgt, n)
UNION ALL SELECT 'after', m, src, tgt, n FROM cu, LATERAL (VALUES ('', seg || '.__init__', 1), ('', 'gen', 1), ('', 'up', CASE WHEN pick = 'up' THEN 3 ELSE 1 END), ('', 'down', CASE WHEN pick = 'up' THEN 0 ELSE 2 END), ('', 'Base.go', 1), ('', 'late', 1),
('Base.go', other, 1), ('down', 'up', 1)) v(src, tgt, n) WHERE n > 0""")
def assignment_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Call edges and their sites before and after access paths are followed."""
    calls = assignments.call_graph(Scratch(spark, "assigned").keep(python_files.facts(program(spark, sf_dir))))
    both = calls.before.withColumn("pass", F.lit("before")).union(calls.after.withColumn("pass", F.lit("after")))
    module = F.split("site", "[.:]")[0]
    inside = lambda c: F.expr(f"substring({c}, length(module) + 2)")
    return both.withColumn("module", module).select("pass", "module", inside("caller").alias("src"), inside("callee").alias("tgt"), "site").groupBy("pass", "module", "src", "tgt").agg(F.count_distinct("site").cast("int").alias("n"))
