"""Queries on abstract values across calls, and on the order of call graphs, with their SQL.

Every customer is a module of its own: a class with an attribute set in __init__, a class whose one object is stored into twice, a function
with a default, a recursive one, a loop and a branch, all on the customer's key and balance.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.operators import call_graph, components, objects, pointer, values
from factloom.plans import front_queries
from factloom.plans.front_queries import filled
from factloom.plans.programs import COPY_SQL, lines, read
from factloom.session import Scratch
from factloom.sources import python_files

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}

MODULE = """class Account:
    rate = 2
    def __init__(self, start):
        self.balance = start
    def total(self, by):
        return self.balance + by
class Box:
    pass
def clamp(x, least=500):
    if x < least:
        return least
    return x
def down(n):
    if n > 0:
        return down(n - 1)
    return n
acct = Account({bal})
held = acct.balance
total = acct.total({k})
low = clamp({bal})
high = clamp({k}, 1)
end = down({k})
box = Box()
box.size = {k}
box.size = {bal}
size = box.size
rate = acct.rate
i = 0
while i < {k}:
    i = i + 1
if size > 0:
    sign = 1
else:
    sign = -1
text = 'n' + '{k}'
width = len(text)
pair = ({bal}, {k})
both = len(pair)
top = max({bal}, {k})
"""

SQL = """WITH cu AS (SELECT 'v' || c_custkey AS m, CAST(c_custkey AS DOUBLE) AS k, CAST(floor(c_acctbal) AS DOUBLE) AS b, CAST(length(CAST(c_custkey AS VARCHAR)) + 1 AS DOUBLE) AS w FROM customer),
cl AS (SELECT *, CASE WHEN least(b, k) >= 500 THEN least(b, k) ELSE least(1, b, k) END AS clo, CASE WHEN least(b, k) >= 500 THEN greatest(b, k) ELSE greatest(500, b, k) END AS chi FROM cu)"""
OWN = """('Account', 'class', NULL, NULL), ('Box', 'class', NULL, NULL), ('clamp', 'function', NULL, NULL), ('down', 'function', NULL, NULL), ('acct', 'instance', NULL, NULL), ('box', 'instance', NULL, NULL),
('held', 'int', b, b), ('total', 'int', b + k, b + k), ('size', 'int', b, b), ('rate', 'int', 2, 2), ('i', 'int', 0, CASE WHEN k <= 0 THEN 0 END), ('sign', 'int', CASE WHEN b > 0 THEN 1 ELSE -1 END, CASE WHEN b > 0 THEN 1 ELSE -1 END),
('text', 'str', w, w), ('width', 'int', w, w), ('pair', 'tuple', 2, 2), ('both', 'int', 2, 2), ('top', 'int', least(b, k), greatest(b, k))"""


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLE_SQL[f.__name__] = sql
        return f

    return add


def program(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(module, text): a module for each customer."""
    c = read(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("k"), F.floor("c_acctbal").cast("string").alias("bal"))
    return c.select(F.concat(F.lit("v"), "k").alias("module"), filled(MODULE, bal=F.col("bal"), k=F.col("k")).alias("text"))


_SOLVED: dict = {}


def solved(spark: SparkSession, sf_dir: str, policy: str) -> values.Values:
    """The values of the program; facts, points-to sets and values are kept for the application, as several queries show them."""
    app = (spark.sparkContext.applicationId, sf_dir)
    if app not in _SOLVED:
        f = Scratch(spark, "customers").keep(python_files.facts(program(spark, sf_dir)))
        _SOLVED[app] = (f, pointer.analyse(f))
    if (*app, policy) not in _SOLVED:
        _SOLVED[(*app, policy)] = values.analyse(*_SOLVED[app], policy)
    return _SOLVED[(*app, policy)]


@query(f"{SQL} SELECT m AS scope, var, types, CAST(lo AS DOUBLE) AS lo, CAST(hi AS DOUBLE) AS hi FROM cl, LATERAL (VALUES {OWN}, ('low', 'int', clo, chi), ('high', 'int', clo, chi), ('end', 'int', CASE WHEN k <= 0 THEN k END, k)) v(var, types, lo, hi)")
def value_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each module-level name ever holds, over calls, attributes, recursion and loops."""
    return solved(spark, sf_dir, "0-cfa").names().where("not contains(scope, '.')")


@query(f"""{SQL} SELECT m AS scope, var, types, CAST(lo AS DOUBLE) AS lo, CAST(hi AS DOUBLE) AS hi FROM cl, LATERAL (VALUES {OWN}, ('low', 'int', greatest(b, 500), greatest(b, 500)), ('high', 'int', greatest(k, 1), greatest(k, 1)), ('end', 'int', CASE WHEN k <= 1 THEN 0 END, CASE WHEN k <= 0 THEN k ELSE k - 1 END)) v(var, types, lo, hi)""")
def value_names_1cfa(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With call sites as contexts each call of ``clamp`` keeps its own interval."""
    return solved(spark, sf_dir, "1-cfa").names().where("not contains(scope, '.')")


@query(f"{SQL} SELECT m || f AS scope, types, CAST(lo AS DOUBLE) AS lo, CAST(hi AS DOUBLE) AS hi FROM cl, LATERAL (VALUES ('.Account.__init__', 'NoneType', NULL, NULL), ('.Account.total', 'int', b + k, b + k), ('.clamp', 'int', clo, chi), ('.down', 'int', CASE WHEN k <= 0 THEN k END, k)) v(f, types, lo, hi)")
def value_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results of functions."""
    return solved(spark, sf_dir, "0-cfa").returns().drop("ctx")


@query(f"{SQL} SELECT m || f AS scope, var, types, CAST(lo AS DOUBLE) AS lo, CAST(hi AS DOUBLE) AS hi FROM cl, LATERAL (VALUES ('.Account.__init__', 'self', 'instance', NULL, NULL), ('.Account.__init__', 'start', 'int', b, b), ('.Account.total', 'self', 'instance', NULL, NULL), ('.Account.total', 'by', 'int', k, k), ('.clamp', 'x', 'int', least(b, k), greatest(b, k)), ('.clamp', 'least', 'int', 1, 500), ('.down', 'n', 'int', CASE WHEN k <= 0 THEN k END, k)) v(f, var, types, lo, hi)")
def value_parameters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Actuals, receivers and defaults bound to parameters."""
    return solved(spark, sf_dir, "0-cfa").parameters().drop("ctx")


@query(f"{SQL} SELECT 'inst:' || m || c AS obj, attr, types, CAST(lo AS DOUBLE) AS lo, CAST(hi AS DOUBLE) AS hi FROM cl, LATERAL (VALUES ('.Account', 'balance', 'int', b, b), ('.Account', 'rate', 'int', 2, 2), ('.Account', '__init__', 'function', NULL, NULL), ('.Account', 'total', 'function', NULL, NULL), ('.Box', 'size', 'int', least(b, k), greatest(b, k))) v(c, attr, types, lo, hi)")
def value_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attributes of instances, those of their classes with them."""
    return solved(spark, sf_dir, "0-cfa").attributes().where("startswith(obj, 'inst:')")


ORDER_SQL = f"""WITH RECURSIVE {COPY_SQL},
e AS (SELECT DISTINCT a.part AS src, b.part AS tgt FROM li a JOIN li b ON b.v = a.v + 1 AND a.k = 1 JOIN orders ON o_orderkey = a.o AND o_orderpriority = '1-URGENT'),
tc(src, tgt) AS (SELECT src, tgt FROM e UNION SELECT t.src, e.tgt FROM tc t JOIN e ON e.src = t.tgt),
mutual AS (SELECT a.src AS node, max(a.tgt) AS far FROM tc a JOIN tc b ON a.src = b.tgt AND a.tgt = b.src GROUP BY a.src),
comp AS (SELECT p_partkey AS node, greatest(p_partkey, coalesce(far, p_partkey)) AS comp FROM part LEFT JOIN mutual ON node = p_partkey),
size AS (SELECT comp, count(*) AS size FROM comp GROUP BY comp),
ce AS (SELECT DISTINCT a.comp AS src, b.comp AS tgt FROM e JOIN comp a ON a.node = e.src JOIN comp b ON b.node = e.tgt WHERE a.comp <> b.comp),
lv(comp, level) AS (SELECT comp, CAST(0 AS BIGINT) FROM size UNION SELECT ce.src, lv.level + 1 FROM lv JOIN ce ON ce.tgt = lv.comp),
top AS (SELECT comp, max(level) AS level FROM lv GROUP BY comp)
SELECT node, comp.comp, size, far IS NOT NULL AS cyclic, level FROM comp JOIN size USING (comp) JOIN top USING (comp) LEFT JOIN mutual USING (node)"""


@query(ORDER_SQL)
def component_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An urgent order's first part calls its second; strongly connected components of parts, callees before callers."""
    li = lines(spark, sf_dir).select("o", "k", "part")
    urgent = read(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_orderkey").alias("o"))
    pair = li.where("k = 1").select("o", F.col("part").alias("src")).join(li.where("k = 2").select("o", F.col("part").alias("tgt")), "o").join(urgent, "o", "left_semi")
    edges = Scratch(spark, "parts").keep(pair.select("src", "tgt").distinct())
    return components.component_order(edges, read(spark, sf_dir, "part").select(F.col("p_partkey").alias("node")))


OBJECT_SQL = """WITH o AS (SELECT l_orderkey AS value, CASE l_linenumber % 6 WHEN 0 THEN 'unknown' WHEN 1 THEN 'constant' WHEN 2 THEN 'unknown' WHEN 3 THEN 'builtin' WHEN 4 THEN 'instance' ELSE 'external_function' END AS kind,
  CASE l_linenumber % 6 WHEN 1 THEN l_returnflag WHEN 3 THEN 'list' WHEN 4 THEN 'C' || l_suppkey % 5 WHEN 5 THEN 'x.f' || l_suppkey % 3 ELSE '' END AS ident, CASE WHEN l_linenumber % 6 IN (1, 3) THEN l_quantity END AS lo,
  CASE WHEN l_linenumber % 6 = 1 OR l_linenumber % 6 = 3 AND l_linestatus = 'F' THEN l_quantity + 1 END AS hi, CASE WHEN l_linenumber % 6 = 3 THEN l_returnflag END AS element, CASE WHEN l_linenumber % 6 = 4 THEN l_linestatus END AS attribute, l_partkey % 50 AS part FROM lineitem),
g AS (SELECT part AS value, kind, ident, CASE WHEN count(lo) = count(*) THEN min(lo) END AS lo, CASE WHEN count(hi) = count(*) THEN max(hi) END AS hi, coalesce(string_agg(DISTINCT element, ',' ORDER BY element), '') AS elements, coalesce(string_agg(DISTINCT attribute, ',' ORDER BY attribute), '') AS attributes FROM o GROUP BY ALL
UNION ALL SELECT -value - 1, kind, ident, CASE WHEN count(lo) = count(*) THEN min(lo) END, CASE WHEN count(hi) = count(*) THEN max(hi) END, coalesce(string_agg(DISTINCT element, ',' ORDER BY element), ''), coalesce(string_agg(DISTINCT attribute, ',' ORDER BY attribute), '') FROM o GROUP BY ALL)"""


@query(f"{OBJECT_SQL} SELECT * FROM g WHERE kind <> 'unknown' OR value NOT IN (SELECT value FROM g WHERE kind <> 'unknown')")
def merged_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line is an object that an order's value (negative) and a class of parts' may be."""
    li, n = read(spark, sf_dir, "lineitem"), F.col("l_linenumber") % 6
    text = lambda c: F.col(c).cast("string")
    kind = F.when(n == 1, "constant").when(n == 3, "builtin").when(n == 4, "instance").when(n == 5, "external_function").otherwise("unknown")
    ident = F.when(n == 1, F.col("l_returnflag")).when(n == 3, "list").when(n == 4, F.concat(F.lit("C"), (F.col("l_suppkey") % 5).cast("string"))).when(n == 5, F.concat(F.lit("x.f"), (F.col("l_suppkey") % 3).cast("string")))
    own = [kind.alias("kind"), ident.alias("ident"), F.when(n.isin(1, 3), F.col("l_quantity")).alias("lo"), F.when((n == 1) | (n == 3) & (F.col("l_linestatus") == "F"), F.col("l_quantity") + 1).alias("hi"), F.when(n == 3, text("l_returnflag")).alias("element"), F.when(n == 4, text("l_linestatus")).alias("attribute")]
    rows = li.select(F.explode(F.array(-F.col("l_orderkey") - 1, F.col("l_partkey") % 50)).alias("value"), *own)
    return objects.merge_objects(rows, "value").withColumns({c: F.array_join(c, ",") for c in ("elements", "attributes")})


@query(f"""WITH {front_queries.CUST_SQL} SELECT m AS module, kind, n FROM md, LATERAL (VALUES ('class', cnt), ('instance', cnt), ('function', cnt + (SELECT count(*) FROM cu WHERE cu.m = md.m AND odd = 'missing_argument')),
('other', cnt + 1 + n_odd - (SELECT count(*) FROM cu WHERE cu.m = md.m AND odd = 'missing_argument'))) v(kind, n) UNION ALL SELECT 'r' || r_regionkey, 'class', 1 FROM region""")
def call_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Call sites of the nations' programs by kind."""
    g = call_graph.call_graph(front_queries.solved(spark, sf_dir), front_queries.facts(spark, sf_dir))
    return g.kinds("caller").withColumnRenamed("caller", "module")
