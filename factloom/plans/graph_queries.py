"""Queries on copy programs, call graphs and hierarchies, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.functions import context, lattice, points_to_sets
from factloom.operators import graph, hierarchy
from factloom.operators.points_to import first_base_wins, flow_of_sizes, points_to, set_sizes
from factloom.plans.programs import CALL_SQL, COPY_SQL, FIELD_SQL, allocations, calls, copies, field_accesses, lines, read
from factloom.session import Scratch

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


PTS_SQL = f"WITH RECURSIVE {COPY_SQL}, pts(node, obj) AS (SELECT node, obj FROM al UNION SELECT c.tgt, p.obj FROM pts p JOIN cp c ON c.src = p.node)"


def _pts(spark: SparkSession, sf_dir: str, of=points_to) -> tuple[DataFrame, DataFrame]:
    scratch = Scratch(spark, "pts")
    li = scratch.keep(lines(spark, sf_dir))
    cp = scratch.keep(copies(spark, sf_dir, li))
    return cp, of(allocations(spark, sf_dir, li), cp)


@query(f"{PTS_SQL} SELECT node, obj FROM pts")
def points_to_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Allocation and copy to the fixpoint."""
    return _pts(spark, sf_dir)[1].select("node", "obj")


@query(
    f"""WITH RECURSIVE {FIELD_SQL},
pts(node, field, obj, dummy) USING KEY (node, field, obj) AS (SELECT node, '', obj, 0 FROM al UNION
 SELECT * FROM (
  SELECT c.tgt, '', p.obj, 0 FROM recurring.pts p JOIN cp c ON c.src = p.node WHERE p.field = ''
  UNION SELECT b.obj, a.field, s.obj, 0 FROM acc a JOIN recurring.pts b ON b.node = a.base AND b.field = '' JOIN recurring.pts s ON s.node = a.v AND s.field = '' WHERE a.st = 1
  UNION SELECT a.v, '', x.obj, 0 FROM acc a JOIN recurring.pts b ON b.node = a.base AND b.field = '' JOIN recurring.pts x ON x.node = b.obj AND x.field = a.field WHERE a.st = 0
  EXCEPT SELECT node, field, obj, 0 FROM recurring.pts) n)
SELECT node, field, obj FROM pts"""
)
def points_to_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With loads and stores of fields."""
    scratch = Scratch(spark, "fields")
    li = scratch.keep(lines(spark, sf_dir))
    load, store = (scratch.keep(x) for x in field_accesses(spark, sf_dir, li))
    return points_to(allocations(spark, sf_dir, li), scratch.keep(copies(spark, sf_dir, li)), load, store)


@query(f"{PTS_SQL} SELECT src AS a, tgt AS b, EXISTS (SELECT 1 FROM pts p JOIN pts q ON p.obj = q.obj WHERE p.node = src AND q.node = tgt) AS may_alias FROM cp")
def may_alias(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R3 for the two sides of each copy."""
    cp, pts = _pts(spark, sf_dir)
    return points_to_sets.may_alias(pts, cp.select(F.col("src").alias("a"), F.col("tgt").alias("b")))


@query(f"""{PTS_SQL}, other AS (SELECT v AS node, o AS obj FROM li WHERE flag <> 'N'), u AS (SELECT 'union' AS op, node, obj FROM (SELECT node, obj FROM pts UNION SELECT node, obj FROM other) x
UNION ALL SELECT 'intersection', node, obj FROM (SELECT node, obj FROM pts INTERSECT SELECT node, obj FROM other) x
UNION ALL SELECT 'difference', node, obj FROM (SELECT node, obj FROM pts EXCEPT SELECT node, obj FROM other) x) SELECT op, node, obj FROM u""")
def set_algebra(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Union, intersection and difference of points-to sets with a relation of each returned or accepted line to its order."""
    pts = Scratch(spark, "algebra").keep(_pts(spark, sf_dir)[1].select("node", "obj"))
    other = lines(spark, sf_dir).where("flag <> 'N'").select(F.col("v").alias("node"), F.col("o").alias("obj"))
    parts = (("union", points_to_sets.union(pts, other)), ("intersection", points_to_sets.intersection(pts, other)), ("difference", points_to_sets.difference(pts, other)))
    out = [d.select(F.lit(op).alias("op"), "node", "obj") for op, d in parts]
    return out[0].union(out[1]).union(out[2])


SIZES_SQL = f"{PTS_SQL}, k AS (SELECT v AS node, count(obj) AS k FROM li LEFT JOIN pts ON node = v GROUP BY v)"


@query(f"""{SIZES_SQL} SELECT count(*) AS nodes, avg(k) AS avg_size, max(k) AS max_size, count(*) FILTER (k = 0) AS empty, count(*) FILTER (k = 1) AS singletons, count(*) FILTER (k > 10) AS large,
(SELECT count(DISTINCT obj) FROM pts) AS objects FROM k""")
def points_to_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and sizes of points-to sets over all lines."""
    return points_to_sets.statistics(_pts(spark, sf_dir)[1], lines(spark, sf_dir).select(F.col("v").alias("node")))


@query(f"{SIZES_SQL} SELECT CASE WHEN k <= 1 THEN CAST(k AS VARCHAR) WHEN k <= 5 THEN '2-5' WHEN k <= 10 THEN '6-10' WHEN k <= 50 THEN '11-50' ELSE '51+' END AS size_class, count(*) AS n FROM k GROUP BY 1")
def points_to_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Histogram of set sizes."""
    return points_to_sets.size_classes(_pts(spark, sf_dir)[1], lines(spark, sf_dir).select(F.col("v").alias("node")))


@query(f"{PTS_SQL} SELECT node FROM pts GROUP BY node HAVING count(*) = 1")
def singleton_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Variables that allow strong updates."""
    return _pts(spark, sf_dir, set_sizes)[1].where("n = 1").select("node")


FLOW_SQL = f"{PTS_SQL}, fl AS (SELECT src, tgt, (SELECT count(*) FROM pts WHERE node = src) AS flow FROM cp)"


@query(f"{FLOW_SQL} SELECT count(*) AS edges, count(*) FILTER (flow > 0) AS activated, count(*) FILTER (flow = 0) AS dead, CAST(sum(flow) AS BIGINT) AS total_flow FROM fl")
def flow_edge_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Activated and dead copy edges."""
    cp, sizes = _pts(spark, sf_dir, set_sizes)
    count = lambda c: F.count(F.when(c, 1))
    return flow_of_sizes(cp, sizes).agg(F.count("*").alias("edges"), count(F.col("flow") > 0).alias("activated"), count(F.col("flow") == 0).alias("dead"), F.sum("flow").alias("total_flow"))


@query(f"{FLOW_SQL} SELECT src, tgt, flow FROM fl ORDER BY flow DESC, src, tgt LIMIT 10")
def busiest_flow_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten edges with most flow."""
    return flow_of_sizes(*_pts(spark, sf_dir, set_sizes)).orderBy(F.desc("flow"), "src", "tgt").limit(10)


@query(f"WITH RECURSIVE {COPY_SQL}, tc(src, tgt) AS (SELECT src, tgt FROM cp UNION SELECT t.src, c.tgt FROM tc t JOIN cp c ON c.src = t.tgt) SELECT src, tgt FROM tc")
def copy_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transitive closure of the copy graph (R10's relation for all pairs)."""
    return graph.closure(Scratch(spark, "closure").keep(copies(spark, sf_dir)))


@query(f"WITH RECURSIVE {COPY_SQL}, r(node, depth) AS (SELECT DISTINCT node, 0 FROM al UNION SELECT c.tgt, depth + 1 FROM r JOIN cp c ON c.src = r.node WHERE depth < 3) SELECT node, CAST(min(depth) AS BIGINT) AS depth FROM r GROUP BY node")
def bounded_discovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S9's rule on the copy graph: what is found from the entries within three steps, with its depth."""
    return graph.distances(Scratch(spark, "found").keep(copies(spark, sf_dir)), allocations(spark, sf_dir).select("node"), 3)


ROOTS_SQL = f"WITH RECURSIVE {COPY_SQL}, node AS (SELECT src AS node FROM cp UNION SELECT tgt FROM cp), root AS (SELECT v AS node FROM li JOIN orders ON o_orderkey = o WHERE k = 1 AND o_orderstatus = 'F'), r(node) AS (SELECT node FROM root UNION SELECT c.tgt FROM r JOIN cp c ON c.src = r.node)"


def _reach(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    li = Scratch(spark, "reach").keep(lines(spark, sf_dir))
    cp = Scratch(spark, "reach").keep(copies(spark, sf_dir, li))
    done = read(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("o"))
    return cp, graph.reachable(cp, li.where("k = 1").join(done, "o").select(F.col("v").alias("node")))


@query(f"{ROOTS_SQL} SELECT node FROM r")
def reachable_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reachable from the entries, which are the first lines of fulfilled orders."""
    return _reach(spark, sf_dir)[1]


@query(f"{ROOTS_SQL} SELECT node FROM node WHERE node NOT IN (SELECT node FROM r)")
def unreachable_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R11."""
    cp, reach = _reach(spark, sf_dir)
    return graph.nodes_of(cp).join(reach, "node", "left_anti")


@query(f"""WITH RECURSIVE {COPY_SQL}, e AS (SELECT src, tgt FROM cp), l(node, level) AS (SELECT node, CAST(0 AS BIGINT) FROM (SELECT src AS node FROM e UNION SELECT tgt FROM e) n
UNION SELECT e.tgt, level + 1 FROM l JOIN e ON e.src = l.node) SELECT node, max(level) AS level FROM l GROUP BY node""")
def topological_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C21 on the copy graph."""
    return graph.topological_levels(copies(spark, sf_dir))


@query(f"""WITH {CALL_SQL}, e AS (SELECT DISTINCT src, tgt FROM cg), n AS (SELECT src AS node FROM e UNION SELECT tgt FROM e)
SELECT node, (SELECT count(*) FROM e WHERE tgt = node) AS in_degree, (SELECT count(*) FROM e WHERE src = node) AS out_degree FROM n""")
def call_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Callers and callees of each function over plain edges."""
    return graph.degrees(calls(spark, sf_dir))


@query(f"""WITH {CALL_SQL}, e AS (SELECT DISTINCT src, tgt FROM cg), n AS (SELECT node, CAST(sum(i) AS BIGINT) AS i, CAST(sum(o) AS BIGINT) AS o FROM (SELECT src AS node, 0 AS i, 1 AS o FROM e UNION ALL SELECT tgt, 1, 0 FROM e) x GROUP BY node)
SELECT count(*) AS functions, CAST(sum(o) AS BIGINT) AS edges, avg(i) AS avg_in, max(i) AS max_in, avg(o) AS avg_out, max(o) AS max_out FROM n""")
def call_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R15."""
    d = graph.degrees(calls(spark, sf_dir))
    return d.agg(F.count("*").alias("functions"), F.sum("out_degree").alias("edges"), F.avg("in_degree").alias("avg_in"), F.max("in_degree").alias("max_in"), F.avg("out_degree").alias("avg_out"), F.max("out_degree").alias("max_out"))


@query(f"""WITH RECURSIVE {COPY_SQL}, root AS (SELECT src AS n FROM cp WHERE src NOT IN (SELECT tgt FROM cp) GROUP BY src), goal AS (SELECT tgt AS n FROM cp WHERE tgt NOT IN (SELECT src FROM cp) GROUP BY tgt),
p(root, node, path, k) AS (SELECT n, n, [n], 0 FROM root UNION ALL SELECT p.root, c.tgt, list_append(p.path, c.tgt), k + 1 FROM p JOIN cp c ON c.src = p.node WHERE k < 10 AND NOT list_contains(p.path, c.tgt))
SELECT CAST(root AS VARCHAR) AS root, CAST(node AS VARCHAR) AS node, array_to_string(path, '>') AS path FROM p JOIN goal ON goal.n = node""")
def simple_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths of up to ten edges from nodes without predecessors to nodes without successors."""
    cp = Scratch(spark, "paths").keep(copies(spark, sf_dir))
    ends = cp.select(F.col("src").alias("node"), F.lit(True).alias("out"), F.lit(False).alias("in")).union(cp.select("tgt", F.lit(False), F.lit(True))).groupBy("node").agg(F.max("out").alias("out"), F.max("in").alias("in"))
    ends = Scratch(spark, "ends").keep(ends.where("out <> in"))
    return graph.simple_paths(cp, ends.where("out").select("node"), ends.where("in").select("node"))


def _classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """class_base of region <- nation <- customer and supplier."""
    t = lambda c, p: F.concat(F.lit(p), F.col(c).cast("string"))
    n = read(spark, sf_dir, "nation").select(t("n_nationkey", "n").alias("cls"), t("n_regionkey", "r").alias("base"))
    c = read(spark, sf_dir, "customer").select(t("c_custkey", "c").alias("cls"), t("c_nationkey", "n").alias("base"))
    s = read(spark, sf_dir, "supplier").select(t("s_suppkey", "s").alias("cls"), t("s_nationkey", "n").alias("base"))
    return n.union(c).union(s).withColumn("base_idx", F.lit(0).cast("long"))


TREE_SQL = "b AS (SELECT 'n' || n_nationkey AS cls, 'r' || n_regionkey AS base FROM nation UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey FROM customer UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey FROM supplier)"


@query(f"WITH RECURSIVE {TREE_SQL}, a(cls, ancestor, depth) AS (SELECT cls, base, CAST(1 AS BIGINT) FROM b UNION SELECT a.cls, b.base, depth + 1 FROM a JOIN b ON b.cls = a.ancestor) SELECT cls, ancestor, depth FROM a")
def class_ancestors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transitive superclasses."""
    return hierarchy.ancestors(_classes(spark, sf_dir))


@query(f"WITH {TREE_SQL}, x AS (SELECT base AS cls, cls AS sub FROM b UNION ALL SELECT p.base, c.cls FROM b c JOIN b p ON p.cls = c.base) SELECT cls, count(*) AS n_subclasses FROM x GROUP BY cls")
def subclass_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transitive subclasses, counted."""
    return hierarchy.subclasses(_classes(spark, sf_dir)).groupBy("cls").agg(F.count("*").alias("n_subclasses"))


def _brands(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    part = read(spark, sf_dir, "part").select(F.concat(F.lit("p"), "p_partkey").alias("cls"), "p_brand", "p_type")
    own = part.select("cls", F.posexplode(F.array("p_brand", "p_type")).alias("base_idx", "base")).select("cls", "base", "base_idx")
    roots = own.select(F.col("base").alias("cls")).distinct().select("cls", F.lit("Item").alias("base"), F.lit(0).alias("base_idx"))
    return own.union(roots), part.select("cls")


@query("SELECT 'p' || p_partkey AS cls, CAST(i AS BIGINT) AS pos, CASE i WHEN 0 THEN 'p' || p_partkey WHEN 1 THEN p_brand WHEN 2 THEN p_type ELSE 'Item' END AS ancestor FROM part, range(4) t(i)")
def c3_linearisation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each part has its brand and its type as ordered bases, both of the base Item."""
    return hierarchy.c3_mro(*_brands(spark, sf_dir))


@query("""WITH d AS (SELECT DISTINCT p_brand AS c, 'size' || p_size % 5 AS attr FROM part WHERE p_size % 2 = 0 UNION SELECT DISTINCT p_type, 'size' || p_size % 5 FROM part WHERE p_size % 3 = 0),
m AS (SELECT 'p' || p_partkey AS cls, p_brand AS c, 1 AS pos FROM part UNION ALL SELECT 'p' || p_partkey, p_type, 2 FROM part)
SELECT cls, attr, arg_min(d.c, pos) AS definer FROM m JOIN d ON d.c = m.c GROUP BY cls, attr""")
def attribute_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first class in order that defines an attribute."""
    part = read(spark, sf_dir, "part")
    attr = F.concat(F.lit("size"), F.col("p_size") % 5).alias("attr")
    d = part.where("p_size % 2 = 0").select(F.col("p_brand").alias("cls"), attr).union(part.where("p_size % 3 = 0").select("p_type", attr)).distinct()
    return hierarchy.resolve_attribute(hierarchy.c3_mro(*_brands(spark, sf_dir)), d)


@query("""WITH f AS (SELECT DISTINCT l_orderkey AS node, l_linenumber AS priority, l_suppkey AS obj FROM lineitem WHERE l_returnflag <> 'N')
SELECT DISTINCT f.node, f.obj FROM f JOIN (SELECT node, min(priority) AS priority FROM f GROUP BY node) m ON m.node = f.node AND m.priority = f.priority""")
def selector_flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only the smallest base index that yields objects passes; lines with flag N yield none."""
    return first_base_wins(read(spark, sf_dir, "lineitem").where("l_returnflag <> 'N'").select(F.col("l_orderkey").alias("node"), F.col("l_linenumber").alias("priority"), F.col("l_suppkey").alias("obj")))


def _cut(policy: str) -> str:
    kind, k, d = context.parse(policy)
    item = {"cfa": "site", "obj": "coalesce(recv, site)", "type": "coalesce(rcls, recv, site)", "rcv": "coalesce(rsite, site)", "param": "args"}.get(kind)
    cut = lambda xs, n: f"list_slice({xs}, greatest(len({xs}) - {n - 1}, 1), len({xs}))"
    if k == 0:
        return "''"
    if kind == "hybrid":
        s = f"list_append(list_filter(ctx, lambda x: starts_with(x, 'c:')), 'c:' || site)"
        o = "list_filter(ctx, lambda x: starts_with(x, 'o:'))"
        return f"array_to_string(list_concat({cut(s, k)}, CASE WHEN recv IS NULL THEN {o} ELSE {cut(f'''list_append({o}, 'o:' || recv)''', d)} END), '|')"
    out = cut(f"list_append(ctx, {item})", k)
    return f"array_to_string({f'CASE WHEN args IS NULL THEN ctx ELSE {out} END' if kind == 'param' else out}, '|')"


@query(
    """WITH c AS (SELECT l_orderkey AS site_id, ['c:' || l_suppkey, 'o:' || l_partkey, 'c:' || l_orderkey % 7][1 : CAST(l_quantity AS INTEGER) % 4] AS ctx, 's' || l_orderkey AS site,
CASE WHEN l_returnflag <> 'R' THEN 'x' || l_partkey END AS recv, CASE WHEN l_returnflag = 'A' THEN 'k' || l_suppkey END AS rcls, CASE WHEN l_returnflag <> 'R' THEN 'a' || l_suppkey END AS rsite,
CASE WHEN l_linestatus = 'O' THEN CASE WHEN 'v' || l_partkey % 10 = 'v' || l_suppkey % 10 THEN 'v' || l_partkey % 10 ELSE least('v' || l_partkey % 10, 'v' || l_suppkey % 10) || '+' || greatest('v' || l_partkey % 10, 'v' || l_suppkey % 10) END END AS args FROM lineitem) """
    + " UNION ALL ".join(f"SELECT '{p}' AS policy, site_id, {_cut(p)} AS ctx FROM c" for p in context.POLICIES)
)
def call_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q1-Q7: the callee's context under each of the 19 policies; every line is a call."""
    s = lambda p, c: F.concat(F.lit(p), F.expr(c).cast("string"))
    li = read(spark, sf_dir, "lineitem")
    args = F.when(F.col("l_linestatus") == "O", F.array(s("v", "l_partkey % 10"), s("v", "l_suppkey % 10"))).otherwise(F.array().cast("array<string>"))
    c = li.select(
        F.col("l_orderkey").alias("site_id"), F.slice(F.array(s("c:", "l_suppkey"), s("o:", "l_partkey"), s("c:", "l_orderkey % 7")), F.lit(1), F.col("l_quantity").cast("int") % 4).alias("ctx"), s("s", "l_orderkey").alias("site"),
        F.when(F.col("l_returnflag") != "R", s("x", "l_partkey")).alias("recv"), F.when(F.col("l_returnflag") == "A", s("k", "l_suppkey")).alias("rcls"), F.when(F.col("l_returnflag") != "R", s("a", "l_suppkey")).alias("rsite"), args.alias("args"),
    )
    col = F.col
    c = c.select("*", context.sites_of(col("ctx")).alias("sites"), context.objects_of(col("ctx")).alias("objects"))
    rows = F.array(*(F.struct(F.lit(p).alias("policy"), F.array_join(context.call_context(p, *map(col, ("ctx", "site", "recv", "rcls", "rsite", "args", "sites", "objects"))), "|").alias("ctx")) for p in context.POLICIES))
    # a column first: what policies share is computed once a row in a projection, not in a generator
    return c.select("site_id", rows.alias("rows")).select("site_id", F.explode("rows").alias("r")).select("r.policy", "site_id", "r.ctx")


@query("""SELECT c_mktsegment AS var, floor(min(c_acctbal)) AS lo, floor(max(c_acctbal)) AS hi, bool_or(floor(c_acctbal) = 0) AS zero, bool_or(floor(c_acctbal) < 0) AS neg, bool_or(floor(c_acctbal) > 0) AS pos,
count(DISTINCT floor(c_acctbal)) AS n_exact FROM customer GROUP BY 1""")
def number_joins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A1-A3: join of exact numbers by variable."""
    c = read(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("var"), lattice.number(F.array(F.floor("c_acctbal").cast("double"))).alias("v"))
    v = c.groupBy("var").agg(lattice.join_numbers("v").alias("v"))
    return v.select("var", "v.lo", "v.hi", "v.zero", "v.neg", "v.pos", F.size("v.exact").cast("long").alias("n_exact"))


@query("""SELECT p_brand AS var, string_agg(DISTINCT left(p_type, 1), '' ORDER BY left(p_type, 1)) AS prefixes, string_agg(DISTINCT right(p_type, 1), '' ORDER BY right(p_type, 1)) AS suffixes, min(length(p_type)) AS min_len, max(length(p_type)) AS max_len, count(DISTINCT p_type) AS n_exact FROM part GROUP BY 1""")
def string_joins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A4: join of strings by variable."""
    v = read(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("var")).agg(lattice.join_strings("p_type").alias("v"))
    return v.select("var", F.array_join("v.prefixes", "").alias("prefixes"), F.array_join("v.suffixes", "").alias("suffixes"), "v.min_len", "v.max_len", F.size("v.exact").cast("long").alias("n_exact"))


@query("""WITH c AS (SELECT l_orderkey, string_agg(DISTINCT l_returnflag, '' ORDER BY l_returnflag) AS types, count(*) AS n FROM lineitem GROUP BY 1), o AS (SELECT o_orderpriority AS var, types, n, o_orderstatus = 'P' AS open FROM c JOIN orders ON o_orderkey = l_orderkey)
SELECT var, string_agg(DISTINCT t, '' ORDER BY t) AS types, min(n) AS min_size, CASE WHEN NOT bool_or(open) THEN max(n) END AS max_size FROM (SELECT var, n, open, unnest(string_split(types, '')) AS t FROM o) x GROUP BY var""")
def container_joins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A5: an order is a container of return flags, unbounded if its status is P; joined by priority."""
    c = read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_set("l_returnflag").alias("types"), F.count("*").alias("n"))
    o = read(spark, sf_dir, "orders").join(c, F.col("o_orderkey") == F.col("l_orderkey")).select(F.col("o_orderpriority").alias("var"), "types", "n", F.when(F.col("o_orderstatus") != "P", F.col("n")).alias("hi"))
    v = o.groupBy("var").agg(lattice.join_containers("types", "n", "hi").alias("v"))
    return v.select("var", F.array_join("v.types", "").alias("types"), "v.min_size", "v.max_size")


CMP = {"lt": "<", "le": "<=", "gt": ">", "ge": ">=", "eq": "==", "ne": "!="}


@query("""WITH x AS (SELECT l_orderkey AS k, min(l_quantity) FILTER (l_linenumber <= 2) AS a, max(l_quantity) FILTER (l_linenumber <= 2) AS b, min(l_quantity) FILTER (l_linenumber > 2) AS c, max(l_quantity) FILTER (l_linenumber > 2) AS d FROM lineitem GROUP BY 1)
SELECT k, CASE WHEN b < c THEN true WHEN a >= d THEN false END AS lt, CASE WHEN b <= c THEN true WHEN a > d THEN false END AS le, CASE WHEN a > d THEN true WHEN b <= c THEN false END AS gt, CASE WHEN a >= d THEN true WHEN b < c THEN false END AS ge,
CASE WHEN a = b AND c = d AND a = c THEN true WHEN b < c OR a > d THEN false END AS eq, CASE WHEN b < c OR a > d THEN true WHEN a = b AND c = d AND a = c THEN false END AS ne FROM x WHERE a IS NOT NULL AND c IS NOT NULL""")
def interval_comparisons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Comparisons of two intervals per order."""
    q, n = F.col("l_quantity"), F.col("l_linenumber")
    x = read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(*(f(F.when(c, q)).alias(a) for a, f, c in (("a", F.min, n <= 2), ("b", F.max, n <= 2), ("c", F.min, n > 2), ("d", F.max, n > 2)))).where("a is not null and c is not null")
    l, r = lattice.interval(F.col("a"), F.col("b")), lattice.interval(F.col("c"), F.col("d"))
    return x.select("k", *(lattice.compare(op, l, r).alias(name) for name, op in CMP.items()))


@query("""SELECT l_orderkey AS k, CASE WHEN bool_or(l_tax = 0) AND bool_or(l_tax > 0) THEN NULL ELSE bool_or(l_tax > 0) END AS truth, CAST(min(trunc(l_extendedprice)) AS DOUBLE) AS lo, CAST(max(trunc(l_extendedprice)) AS DOUBLE) AS hi, count(*) > 0 AS truth_of_list FROM lineitem GROUP BY 1""")
def truth_and_int(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Truth of numbers and of containers, int() of numbers."""
    li = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"), lattice.number(F.array("l_tax")).alias("t"), lattice.number(F.array("l_extendedprice")).alias("p"))
    v = li.groupBy("k").agg(lattice.join_numbers("t").alias("t"), lattice.join_numbers("p").alias("p"), F.count("*").alias("n"))
    i = lattice.int_of_number(F.col("p"))
    return v.select("k", lattice.truth(F.col("t")).alias("truth"), i["lo"].alias("lo"), i["hi"].alias("hi"), lattice.truth_of_size(F.col("n"), F.col("n")).alias("truth_of_list"))
