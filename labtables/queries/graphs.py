"""Graph discovery, ranking, budgets, retrieval: suppliers and parts as nodes, lineitem as edges."""

from pyspark.sql import functions as F

from ..operators import explore as x
from ..operators import graph as g
from ..operators import scoring as sc
from .explore import t

QUERIES = {}


def query(sql=None):
    def add(f):
        QUERIES[f.__name__] = (f, sql)
        return f

    return add


EDGES = "e AS (SELECT DISTINCT 1000000 + l_suppkey AS src, l_partkey AS dst FROM lineitem)"
FOUND = f"""{EDGES}, s AS (SELECT 1000000 + s_suppkey AS node FROM supplier WHERE s_suppkey <= 2),
x1 AS (SELECT e.src AS "from", e.dst AS node FROM s JOIN e ON e.src = s.node UNION ALL SELECT dst, src FROM (SELECT e.dst, e.src, row_number() OVER (PARTITION BY e.dst ORDER BY e.src) AS n FROM s JOIN e ON e.dst = s.node) WHERE n <= 400),
n1 AS (SELECT DISTINCT node, 1 AS round FROM x1 WHERE node NOT IN (SELECT node FROM s)),
f1 AS (SELECT node FROM n1 WHERE node % 4 >= 2),
x2 AS (SELECT e.src AS "from", e.dst AS node FROM f1 JOIN e ON e.src = f1.node UNION ALL SELECT dst, src FROM (SELECT e.dst, e.src, row_number() OVER (PARTITION BY e.dst ORDER BY e.src) AS n FROM f1 JOIN e ON e.dst = f1.node) WHERE n <= 400),
n2 AS (SELECT DISTINCT node, 2 AS round FROM x2 WHERE node NOT IN (SELECT node FROM s) AND node NOT IN (SELECT node FROM n1)),
l AS (SELECT node, count(*) AS links FROM (SELECT node FROM x1 UNION ALL SELECT node FROM x2) GROUP BY node),
d AS (SELECT a.node, CAST(a.node % 4 AS BIGINT) AS score, CAST(coalesce(links, 0) AS BIGINT) AS links, CAST(round AS BIGINT) AS round FROM (SELECT * FROM n1 UNION ALL SELECT * FROM n2) a LEFT JOIN l ON a.node = l.node)"""


def _graph(spark, sf):
    edges = t(spark, sf, "lineitem").select((F.col("l_suppkey") + 1_000_000).alias("src"), F.col("l_partkey").alias("dst")).distinct()
    seeds = t(spark, sf, "supplier").filter("s_suppkey <= 2").select((F.col("s_suppkey") + 1_000_000).alias("node"))
    nodes = edges.select(F.col("src").alias("node")).union(edges.select(F.col("dst").alias("node"))).distinct()
    return seeds, edges, nodes.withColumn("score", F.col("node") % 4)


@query(f"WITH {FOUND} SELECT node, score, links, round FROM d")
def discover_rounds(spark, sf):
    seeds, edges, scores = _graph(spark, sf)
    return g.discover(seeds, edges, scores, max_rounds=2)


BUDGET = 60
#: FOUND with the nodes of the second round that are followed: one after another while the costs fit.
FOUND_WITHIN = FOUND.replace("f1 AS (SELECT node FROM n1 WHERE node % 4 >= 2)", f"""o AS MATERIALIZED (SELECT node, CAST(1 + node % 5 AS BIGINT) AS cost, row_number() OVER (ORDER BY node % 4 DESC, (SELECT count(*) FROM x1 WHERE x1.node = n1.node) DESC, node) AS i FROM n1 WHERE node % 4 >= 2),
r AS (SELECT CAST(0 AS BIGINT) AS i, CAST({BUDGET} - (SELECT sum(1 + node % 5) FROM s) AS BIGINT) AS budget, false AS took, CAST(NULL AS BIGINT) AS node UNION ALL SELECT o.i, CASE WHEN o.cost <= r.budget THEN r.budget - o.cost ELSE r.budget END, o.cost <= r.budget, o.node FROM r JOIN o ON o.i = r.i + 1),
f1 AS (SELECT node FROM r WHERE took)""")


@query(f"WITH RECURSIVE {FOUND_WITHIN} SELECT node, score, links, round FROM d")
def discover_budget(spark, sf):
    """Rounds within a budget of fetches for all of them."""
    seeds, edges, scores = _graph(spark, sf)
    costs = scores.select("node", (1 + F.col("node") % 5).alias("cost"))
    return g.discover(seeds, edges, scores, max_rounds=2, costs=costs, budget=BUDGET)


@query(f"WITH {FOUND} SELECT CAST(count(*) AS BIGINT) AS candidates, CAST(count(*) AS BIGINT) AS judged, CAST(count(*) FILTER (WHERE score >= 2) AS BIGINT) AS likely FROM d")
def search_stats(spark, sf):
    seeds, edges, scores = _graph(spark, sf)
    return g.search_stats(g.discover(seeds, edges, scores, max_rounds=2))


@query(f"""WITH {EDGES} SELECT src AS "from", dst AS node FROM e UNION ALL SELECT dst, src FROM (SELECT dst, src, row_number() OVER (PARTITION BY dst ORDER BY src) AS n FROM e) WHERE n <= 400""")
def neighbours(spark, sf):
    _, edges, nodes = _graph(spark, sf)
    return g.neighbours(nodes, edges)


QUERIES["neighbours_all"] = QUERIES["neighbours"]


@query("""SELECT event_type, event_id, CAST((row_number() OVER (PARTITION BY event_type ORDER BY user_id DESC, event_id) - 1) // 80 AS BIGINT) AS batch FROM events""")
def batches(spark, sf):
    return g.batches(t(spark, sf, "events"), "event_type", 80, [F.col("user_id").desc(), F.col("event_id")]).select("event_type", "event_id", "batch")


@query("""SELECT event_id, CAST(row_number() OVER (ORDER BY user_id % 4 DESC, event_id % 10 DESC, CASE WHEN event_id % 3 = 0 THEN NULL ELSE event_id % 100 END ASC NULLS LAST, event_id) AS BIGINT) AS position FROM events""")
def rank_results(spark, sf):
    nodes = _results(spark, sf)
    return x.with_position(nodes, g.rank_results(nodes)).select(F.col("node").alias("event_id"), "position")


QUERIES["rank_results_all"] = QUERIES["rank_results"]


def _results(spark, sf):
    k = F.col("event_id")
    return t(spark, sf, "events").select(k.alias("node"), (F.col("user_id") % 4).alias("score"), (k % 10).alias("links"), F.when(k % 3 != 0, k % 100).alias("search_rank"))


@query("""WITH RECURSIVE o AS MATERIALIZED (SELECT o_custkey, o_orderkey, o_totalprice, CAST(ceil(CAST(o_totalprice / 100 AS BIGINT) / 100.0) + ceil(least(o_orderkey, 400) / 200.0) AS BIGINT) AS cost, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice, o_orderkey) AS i
FROM (SELECT o_custkey, o_orderkey, o_totalprice FROM orders)),
r AS (SELECT DISTINCT o_custkey, CAST(0 AS BIGINT) AS i, CAST(25 AS BIGINT) AS budget, false AS took FROM o UNION ALL
SELECT r.o_custkey, o.i, CASE WHEN o.cost <= r.budget THEN r.budget - o.cost ELSE r.budget END, o.cost <= r.budget FROM r JOIN o ON o.o_custkey = r.o_custkey AND o.i = r.i + 1)
SELECT o.o_custkey, o.o_orderkey, o.o_totalprice, o.cost FROM r JOIN o ON o.o_custkey = r.o_custkey AND o.i = r.i WHERE r.took""".replace("CAST(o_totalprice / 100 AS BIGINT)", "CAST(trunc(o_totalprice / 100) AS BIGINT)"))
def budget_take(spark, sf):
    orders = t(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_totalprice", g.fetch_cost((F.col("o_totalprice") / 100).cast("long"), F.col("o_orderkey")).alias("cost"))
    return g.take_within_budget(orders, "o_custkey", "cost", ["o_totalprice", "o_orderkey"], 25)


@query("""WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY n_chars DESC, doc_id) AS p FROM documents), w AS (SELECT DISTINCT doc_id FROM labels WHERE quality = 1)
SELECT CAST(count(*) AS BIGINT) AS listed, CAST((SELECT count(*) FROM w) AS BIGINT) AS wanted, CAST(count(*) FILTER (WHERE doc_id IN (SELECT doc_id FROM w)) AS BIGINT) AS found,
CAST(count(*) FILTER (WHERE p <= 50 AND doc_id IN (SELECT doc_id FROM w)) AS BIGINT) AS hits_50, CAST(count(*) FILTER (WHERE p <= 100 AND doc_id IN (SELECT doc_id FROM w)) AS BIGINT) AS hits_100, CAST(count(*) FILTER (WHERE p <= 200 AND doc_id IN (SELECT doc_id FROM w)) AS BIGINT) AS hits_200 FROM r""")
def recall_at_k(spark, sf):
    return sc.recall_at_k(t(spark, sf, "documents").select("doc_id", "n_chars"), t(spark, sf, "labels").filter("quality = 1"), "doc_id", [F.col("n_chars").desc(), F.col("doc_id")])
