"""Candidate links, assignment, cell scores and totals: golden rows are lineitem's, predicted ones a
fixed perturbation of them."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import cells as c
from ..operators import linkage as ln
from ..operators import scoring as sc
from ..shared import deal, parts_of
from .explore import r6, seconds_of, t

QUERIES = {}


def query(sql=None):
    def add(f):
        QUERIES[f.__name__] = (f, sql)
        return f

    return add


def query_all(sql):
    """The query under its name and under NAME_all, as which it was first registered over all orders."""

    def add(f):
        QUERIES[f.__name__] = QUERIES[f"{f.__name__}_all"] = (f, sql)
        return f

    return add


GOLD = """g AS (SELECT l_orderkey AS paper, l_returnflag AS block, l_quantity::DOUBLE AS q, l_discount::DOUBLE AS d, l_tax::DOUBLE AS tax, l_linestatus AS status, l_extendedprice::DOUBLE AS price,
CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax) AS BIGINT) AS id FROM lineitem),
p AS (SELECT paper, block, CASE WHEN (paper + id) % 5 = 0 THEN q * 1.1::DOUBLE WHEN (paper + id) % 5 = 1 THEN NULL ELSE q END AS q, d, CASE WHEN id % 3 = 0 THEN NULL ELSE tax END AS tax, CASE WHEN id % 4 = 0 THEN lower(status) ELSE status END AS status,
CASE WHEN id % 6 = 0 THEN price * 2 ELSE price END AS price, id FROM g WHERE (paper * 7 + id) % 11 <> 0)"""


def gold(spark, sf):
    lines = t(spark, sf, "lineitem")
    df = deal(lines, parts_of(lines), "l_orderkey")
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus")
    return df.select(
        F.col("l_orderkey").alias("paper"), F.col("l_returnflag").alias("block"), F.col("l_quantity").cast("double").alias("q"), F.col("l_discount").cast("double").alias("d"), F.col("l_tax").cast("double").alias("tax"),
        F.col("l_linestatus").alias("status"), F.col("l_extendedprice").cast("double").alias("price"), F.row_number().over(order).cast("long").alias("id"),
    )


def pred(spark, sf):
    k = (F.col("paper") + F.col("id")) % 5
    return gold(spark, sf).filter("(paper * 7 + id) % 11 <> 0").withColumns({
        "q": F.when(k == 0, F.col("q") * 1.1).when(k == 1, None).otherwise(F.col("q")), "tax": F.when(F.col("id") % 3 != 0, F.col("tax")), "status": F.when(F.col("id") % 4 == 0, F.lower("status")).otherwise(F.col("status")),
        "price": F.when(F.col("id") % 6 == 0, F.col("price") * 2).otherwise(F.col("price")),
    })


RANKS = """gr AS (SELECT *, CASE WHEN q IS NULL THEN NULL WHEN count(q) OVER w = 1 THEN 0.5::DOUBLE ELSE (row_number() OVER (PARTITION BY paper, block, q IS NULL ORDER BY q, id) - 1)::DOUBLE / (count(q) OVER w - 1) END AS rp, count(*) OVER w AS n FROM g WINDOW w AS (PARTITION BY paper, block)),
pr AS (SELECT *, CASE WHEN q IS NULL THEN NULL WHEN count(q) OVER w = 1 THEN 0.5::DOUBLE ELSE (row_number() OVER (PARTITION BY paper, block, q IS NULL ORDER BY q, id) - 1)::DOUBLE / (count(q) OVER w - 1) END AS rp FROM p WINDOW w AS (PARTITION BY paper, block))"""
CANDIDATES = """c AS (SELECT pr.paper, pr.id AS pred_id, gr.id AS gold_id, abs(pr.q - gr.q) / greatest(abs(pr.q), abs(gr.q)) AS diff, abs(pr.rp - gr.rp) AS gap, pr.rp IS NULL AND gr.n = 1 AS lone, least(abs(pr.d - gr.d) / 5.0::DOUBLE, 1.0::DOUBLE) AS tie
FROM pr JOIN gr ON pr.paper = gr.paper AND pr.block IS NOT DISTINCT FROM gr.block),
l AS (SELECT paper, pred_id, gold_id, CASE WHEN diff <= 0.15 THEN 'direct' WHEN gap <= 0.34 THEN 'rank' WHEN gap IS NULL AND lone THEN 'block_only' END AS quality,
CASE WHEN diff <= 0.15 THEN 5 * diff + tie WHEN gap IS NOT NULL THEN 1 + 3 * gap + tie ELSE 2 + tie END AS distance FROM c)"""


@query_all(f"WITH {GOLD}, {RANKS} SELECT paper, id, round(rp, 6) AS rank_pos FROM pr")
def rank_position(spark, sf):
    return ln.rank_position(pred(spark, sf), ["paper", "block"], ["q"], "id").select("paper", "id", r6("rank_pos").alias("rank_pos"))


def _candidates(spark, sf):
    p = ln.rank_position(pred(spark, sf), ["paper", "block"], ["q"], "id")
    g = ln.rank_position(gold(spark, sf), ["paper", "block"], ["q"], "id")
    return ln.link_candidates(p, g, ["paper"], "block", [("q", "q")], ("d", "d"), "id", "id")


@query_all(f"WITH {GOLD}, {RANKS}, {CANDIDATES} SELECT paper, pred_id, gold_id, quality, round(distance, 6) AS distance FROM l WHERE quality IS NOT NULL")
def link_candidates(spark, sf):
    return _candidates(spark, sf).select("paper", "pred_id", "gold_id", "quality", r6("distance").alias("distance"))


ALIKE = CANDIDATES.replace("AS tie", "+ CASE WHEN pr.status = gr.status THEN 0.0::DOUBLE ELSE 0.5::DOUBLE END AS tie")


@query(f"WITH {GOLD}, {RANKS}, {ALIKE} SELECT paper, pred_id, gold_id, quality, round(distance, 6) AS distance FROM l WHERE quality IS NOT NULL")
def link_candidates_alike(spark, sf):
    """Ties by how alike the names of both rows are too."""
    p, g = (ln.rank_position(df, ["paper", "block"], ["q"], "id") for df in (pred(spark, sf), gold(spark, sf)))
    found = ln.link_candidates(p, g, ["paper"], "block", [("q", "q")], ("d", "d"), "id", "id", ln.indel_similarity(F.col("p_status"), F.col("g_status")))
    return found.select("paper", "pred_id", "gold_id", "quality", r6("distance").alias("distance"))


#: The greedy pass in SQL: candidates of a paper one after another, with the rows taken so far.
GREEDY = """o AS MATERIALIZED (SELECT paper, pred_id, gold_id, quality, distance, row_number() OVER (PARTITION BY paper ORDER BY distance, pred_id, gold_id) AS i FROM l WHERE quality IS NOT NULL),
r AS (SELECT DISTINCT paper, CAST(0 AS BIGINT) AS i, CAST([] AS BIGINT[]) AS ps, CAST([] AS BIGINT[]) AS gs, false AS took FROM o UNION ALL
SELECT paper, i, CASE WHEN free THEN list_append(ps, pred_id) ELSE ps END, CASE WHEN free THEN list_append(gs, gold_id) ELSE gs END, free FROM (
SELECT r.paper, o.i, r.ps, r.gs, o.pred_id, o.gold_id, NOT list_contains(r.ps, o.pred_id) AND NOT list_contains(r.gs, o.gold_id) AS free FROM r JOIN o ON o.paper = r.paper AND o.i = r.i + 1)),
a AS (SELECT o.* FROM r JOIN o ON o.paper = r.paper AND o.i = r.i WHERE r.took)"""


@query(f"WITH RECURSIVE {GOLD}, {RANKS}, {CANDIDATES}, {GREEDY} SELECT paper, pred_id, gold_id, quality, round(distance, 6) AS distance FROM a")
def assign_greedy(spark, sf):
    return ln.assign_greedy(_candidates(spark, sf), ["paper"]).select("paper", "pred_id", "gold_id", "quality", r6("distance").alias("distance"))


#: Predicted and golden rows of one id, so that the cells have a SQL form.
CELLS = """k AS (SELECT g.paper, g.id, unnest(['q', 'd', 'tax', 'status', 'price']) AS "column", unnest([p.q::VARCHAR, p.d::VARCHAR, p.tax::VARCHAR, p.status, p.price::VARCHAR]) AS pt, unnest([p.q, p.d, p.tax, NULL, p.price]) AS pn,
unnest([g.q::VARCHAR, g.d::VARCHAR, g.tax::VARCHAR, g.status, g.price::VARCHAR]) AS gt, unnest([g.q, g.d, g.tax, NULL, g.price]) AS gn, p.id IS NULL AS unmatched FROM g LEFT JOIN p ON g.paper = p.paper AND g.id = p.id),
s AS (SELECT paper, id, "column", unmatched, CASE WHEN pt IS NULL THEN 'missing' WHEN "column" = 'status' THEN CASE WHEN lower(pt) = lower(gt) THEN 'correct' ELSE 'wrong' END
WHEN "column" = 'd' THEN CASE WHEN abs(pn - gn) <= 1 THEN 'correct' ELSE 'wrong' END WHEN "column" = 'price' THEN CASE WHEN abs(log10(pn) - log10(gn)) <= 0.1 THEN 'correct' WHEN abs(log10(pn) - log10(gn)) <= 0.5 THEN 'near' ELSE 'wrong' END
ELSE CASE WHEN abs(pn - gn) / greatest(abs(gn), 1e-12) <= 0.05 THEN 'correct' ELSE 'wrong' END END AS outcome FROM k WHERE NOT unmatched OR gt IS NOT NULL)"""
COLUMNS = ("q", "d", "tax", "status", "price")


def classes(spark):
    return spark.createDataFrame([("d", "percent"), ("status", "text"), ("price", "log"), ("q", "relative")], "column string, class string")


def groups(spark):
    return spark.createDataFrame([("q", "amounts"), ("price", "amounts"), ("d", "rates"), ("tax", "rates"), ("status", "words"), ("q", "HEADLINE"), ("d", "HEADLINE"), ("none", "empty")], "column string, group string")


def _cells(spark, sf):
    g, p = gold(spark, sf), pred(spark, sf)
    links = p.select("paper", F.col("id").alias("pred_id"), F.col("id").alias("gold_id"))
    return ln.score_cells(p, g, links, ["paper"], "id", "id", COLUMNS, classes(spark)).withColumnRenamed("gold_id", "id")


@query_all(f'WITH {GOLD}, {CELLS} SELECT paper, id, "column", outcome, unmatched FROM s')
def score_cells(spark, sf):
    return _cells(spark, sf)


@query_all(f'WITH {GOLD}, {CELLS} SELECT paper, id, "column", outcome FROM s WHERE unmatched')
def missed_rows(spark, sf):
    p = pred(spark, sf).select("paper", F.col("id").alias("gold_id"))
    return ln.missed_rows(gold(spark, sf), p, ["paper"], "id", COLUMNS).select("paper", "id", "column", "outcome")


TOTALS = """f AS (SELECT * FROM (VALUES ('q', 'amounts'), ('price', 'amounts'), ('d', 'rates'), ('tax', 'rates'), ('status', 'words'), ('q', 'HEADLINE'), ('d', 'HEADLINE'), ('none', 'empty')) AS v("column", "group")),
n AS (SELECT {keys} f."group", CAST(count(*) FILTER (WHERE NOT unmatched AND outcome = 'correct') AS BIGINT) AS correct, CAST(count(*) FILTER (WHERE NOT unmatched AND outcome = 'near') AS BIGINT) AS near,
CAST(count(*) FILTER (WHERE NOT unmatched AND outcome = 'wrong') AS BIGINT) AS wrong, CAST(count(*) FILTER (WHERE NOT unmatched AND outcome = 'missing') AS BIGINT) AS missing, CAST(count(*) FILTER (WHERE NOT unmatched AND outcome = 'extra') AS BIGINT) AS extra,
CAST(count(*) FILTER (WHERE unmatched AND outcome = 'missing') AS BIGINT) AS missing_unmatched_rows FROM {from_} GROUP BY {keys} f."group")
SELECT *, round(correct::DOUBLE / nullif(correct + near + wrong + missing, 0), 4) AS accuracy, round((correct + near)::DOUBLE / nullif(correct + near + wrong + missing, 0), 4) AS accuracy_loose,
round(correct::DOUBLE / nullif(correct + near + wrong + missing + missing_unmatched_rows, 0), 4) AS recall FROM n"""


@query_all(f"WITH {GOLD}, {CELLS}, " + TOTALS.format(keys="", from_='f LEFT JOIN s ON f."column" = s."column"'))
def group_totals(spark, sf):
    return sc.group_totals(_cells(spark, sf), [], groups(spark))


@query_all(f"WITH {GOLD}, {CELLS}, papers AS (SELECT DISTINCT paper FROM s), " + TOTALS.format(keys="papers.paper,", from_='papers CROSS JOIN f LEFT JOIN s ON f."column" = s."column" AND s.paper = papers.paper'))
def paper_totals(spark, sf):
    return sc.group_totals(_cells(spark, sf), ["paper"], groups(spark))


@query("""SELECT o_orderpriority AS run, CASE WHEN grouping(o_custkey) = 1 THEN NULL ELSE o_custkey END AS paper, CAST(count(*) AS BIGINT) AS papers, CAST(count(*) FILTER (WHERE o_orderstatus = 'F') AS BIGINT) AS with_extraction,
CAST(sum(10) AS BIGINT) AS gold, CAST(sum(8) AS BIGINT) AS pred, CAST(sum(o_orderkey % 4) AS BIGINT) AS direct, CAST(sum(o_orderkey % 3) AS BIGINT) AS rank, CAST(sum(o_orderkey % 2) AS BIGINT) AS block_only,
CAST(sum(o_orderkey % 4 + o_orderkey % 3 + o_orderkey % 2) AS BIGINT) AS matched, round_even(sum(o_orderkey % 4 + o_orderkey % 3 + o_orderkey % 2)::DOUBLE / sum(10), 4) AS recall, round_even(sum(o_orderkey % 4 + o_orderkey % 3 + o_orderkey % 2)::DOUBLE / sum(8), 4) AS precision FROM orders GROUP BY GROUPING SETS ((o_orderpriority, o_custkey), (o_orderpriority))""")
def run_totals(spark, sf):
    k = F.col("o_orderkey")
    papers = t(spark, sf, "orders").select(F.col("o_orderpriority").alias("run"), F.col("o_custkey").alias("paper"), (F.col("o_orderstatus") == "F").alias("extracted"), F.lit(10).alias("gold"), F.lit(8).alias("pred"), (k % 4).alias("direct"), (k % 3).alias("rank"), (k % 2).alias("block_only"))
    return sc.run_totals(papers).drop("overall")


@query_all("""SELECT "column", CASE WHEN "column" = 'price' THEN 'wrong' ELSE 'correct' END AS outcome, CAST(count(*) AS BIGINT) AS n FROM lineitem, (VALUES ('q'), ('d'), ('tax'), ('status'), ('price')) AS v("column") GROUP BY 1, 2""")
def self_test(spark, sf):
    """The table against itself with one column tenfold: those cells fail, all others hold."""
    g = gold(spark, sf)
    both = ln.same_row_cells(g.withColumn("price", F.col("price") * 10), g, ["paper", "id"], COLUMNS)
    return ln.compare_cells(both, classes(spark)).groupBy("column", "outcome").agg(F.count(F.lit(1)).alias("n"))


@query("""WITH a AS (SELECT * FROM (VALUES ('goldenrod', 'yellow'), ('brass', 'metal'), ('steel', 'metal'), ('tin', 'metal'), ('quid', 'money')) AS v(alias, canonical)), v AS (SELECT DISTINCT p_type, regexp_replace(lower(p_type), '[ _-]', '', 'g') AS s FROM part)
SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'money' WHEN 1 THEN NULL WHEN 2 THEN '(tn)' || p_partkey WHEN 3 THEN 'yellow' ELSE coalesce((SELECT arg_min(a.canonical, -length(a.alias) * 1000 + ascii(a.alias)) FROM a WHERE contains(v.s, a.alias)), v.s) END AS canonical FROM part JOIN v USING (p_type)""")
def canonical_alias(spark, sf):
    """Values with a prefix, blank ones, ones that begin with a bracket, ones with a prefix and something
    in brackets, and plain ones."""
    aliases = spark.createDataFrame([("goldenrod", "yellow"), ("Brass", "metal"), ("STEEL", "metal"), ("tin", "metal"), ("quid", "money")], "alias string, canonical string")
    k = F.col("p_partkey") % 5
    raw = F.when(k == 0, "Lithium quid").when(k == 1, " ").when(k == 2, F.concat(F.lit("(T_n)"), F.col("p_partkey").cast("string"))).when(k == 3, "Li-Goldenrod (x)").otherwise(F.col("p_type"))
    return ln.canonical_alias(t(spark, sf, "part").withColumn("raw", raw), "raw", aliases).select("p_partkey", "canonical")


@query("""SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 'linear' WHEN p_partkey % 3 = 1 THEN 'high' ELSE 'linear or branched' END AS snapped FROM part""")
def vocab_snap(spark, sf):
    k = F.col("p_partkey") % 3
    raw = F.when(k == 0, "a  Linear chain").when(k == 1, "Yes, it is").otherwise("Linear  or branched")
    return t(spark, sf, "part").select("p_partkey", c.vocab_snap(raw, ("linear", "branched", "high"), {"yes": "high"}).alias("snapped"))


@query("""WITH RECURSIVE n AS (SELECT p_partkey, trim(regexp_replace(lower(p_name), '\\s+', ' ', 'g')) AS a FROM part), p AS (SELECT DISTINCT a, regexp_replace(a, '[aeiou]', 'e', 'g') AS b FROM n),
l AS (SELECT a, b, 0 AS j, [0 for x in range(length(a))] AS best FROM p UNION ALL
SELECT a, b, j + 1, list_transform(range(1, length(a) + 1), lambda i: greatest(best[i], list_max(list_transform(range(1, i + 1), lambda k: CASE WHEN a[k] = b[j + 1] THEN 1 + CASE WHEN k > 1 THEN best[k - 1] ELSE 0 END ELSE 0 END)))) FROM l WHERE j < length(b))
SELECT p_partkey, round(CASE WHEN n.a = l.b THEN 1.0::DOUBLE ELSE 2.0::DOUBLE * list_max(best) / (length(l.a) + length(l.b)) END, 6) AS similarity FROM n JOIN l ON n.a = l.a AND l.j = length(l.b)""")
def name_similarity(spark, sf):
    df = t(spark, sf, "part")
    pairs = df.select("p_partkey", F.col("p_name").alias("a"), F.regexp_replace("p_name", "[aeiou]", "e").alias("b"))
    return ln.name_similarity(pairs, "a", "b").select("p_partkey", r6("similarity").alias("similarity"))


@query("""SELECT c_custkey AS file, CASE WHEN c_custkey % 3 = 2 THEN 'doi' ELSE 'name' END AS rule, c_custkey AS paper, CAST(1 AS BIGINT) AS n_found FROM customer""")
def map_by_key(spark, sf):
    k = F.col("c_custkey")
    surname = F.concat(F.lit("author"), k.cast("string"))
    files = t(spark, sf, "customer").select(k.alias("file"), F.when(k % 3 == 2, "nobody").otherwise(surname).alias("surname"), (1900 + k % 100).alias("year"), F.concat(F.lit("10.1/A-"), k.cast("string")).alias("doi"))
    papers = t(spark, sf, "customer").select(k.alias("paper"), F.concat_ws(", ", F.initcap(surname), F.lit("Journal"), (1900 + k % 100).cast("string")).alias("reference"), F.concat(F.lit("10.1/a"), k.cast("string")).alias("doi"))
    return ln.map_papers(files, papers)


@query("""WITH e AS (SELECT event_id, user_id, floor(epoch(ts))::BIGINT % 100000 / 1000.0::DOUBLE AS t, value::DOUBLE AS x FROM events)
SELECT p.user_id, p.event_id AS pred_id, k.event_id AS gold_id FROM e p JOIN e k ON p.user_id = k.user_id AND p.event_id % 2 = 0 AND k.event_id % 2 = 1 AND abs(p.t - k.t) < 5.0 AND (abs(p.x - k.x) <= 0.2 * abs(k.x) OR abs(p.x - k.x) < 5e-5)""")
def tolerance_match(spark, sf):
    return ln.match_key(*_points(spark, sf), ["user_id"], 5.0, 0.2).select("user_id", "pred_id", "gold_id")


@query()
def tolerance_match_one(spark, sf):
    """The pairs of tolerance_match that are left when each point takes the first unused key row."""
    return ln.match_points(*_points(spark, sf), ["user_id"], 5.0, 0.2).select("user_id", "pred_id", "gold_id")


def _points(spark, sf):
    e = t(spark, sf, "events").select("event_id", "user_id", (seconds_of("ts").cast("long") % 100_000 / 1000.0).alias("t"), F.col("value").cast("double").alias("x"))
    return e.filter("event_id % 2 = 0").withColumnRenamed("event_id", "id"), e.filter("event_id % 2 = 1").withColumnRenamed("event_id", "key_id")
