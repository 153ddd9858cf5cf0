"""Correlations, expectations, roll-ups."""

from pyspark.sql import functions as F

from ..operators import reports as rep
from ..operators import scoring as sc
from ..operators import stats as st
from .explore import r6, seconds_of, t

QUERIES = {}


def query(sql=None):
    def add(f):
        QUERIES[f.__name__] = (f, sql)
        return f

    return add


MEASURES = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")
R = "CASE WHEN regr_count({y}, {x}) >= 2 AND sqrt(regr_sxx({y}, {x}) * regr_syy({y}, {x})) > 0 THEN round(regr_sxy({y}, {x}) / sqrt(regr_sxx({y}, {x}) * regr_syy({y}, {x})), 6) END"


def _matrix_sql():
    cells = []
    for a in MEASURES:
        for b in MEASURES:
            r = "1.0::DOUBLE" if a == b else R.format(x=f"{min(a, b, key=MEASURES.index)}::DOUBLE", y=f"{max(a, b, key=MEASURES.index)}::DOUBLE")
            cells.append(f"SELECT '{a}' AS label_a, '{b}' AS label_b, {r} AS r, CAST(count(*) FILTER (WHERE {a} IS NOT NULL AND {b} IS NOT NULL) AS BIGINT) AS n FROM lineitem")
    return " UNION ALL ".join(cells)


@query(_matrix_sql())
def corr_matrix(spark, sf):
    return st.corr_matrix(t(spark, sf, "lineitem").select(*MEASURES), MEASURES).withColumn("r", r6("r"))


def _targets_sql(extra="", select="target, feature, r, n"):
    features = {"o_totalprice": "o_totalprice", "day": "day", "flat": "flat"}
    rows = " UNION ALL ".join(
        f"SELECT '{y}' AS target, '{f}' AS feature, {R.format(x=f, y=f'v_{y}')} AS r, CAST(count(*) FILTER (WHERE {f} IS NOT NULL AND v_{y} IS NOT NULL) AS BIGINT) AS n FROM d" for y in ("l_extendedprice", "l_tax") for f in features
    )
    return f"""WITH d AS (SELECT o_totalprice, floor(epoch(o_orderdate))::DOUBLE / 86400 AS day, 1.0::DOUBLE AS flat, CASE WHEN l_extendedprice > 0 THEN log10(l_extendedprice) END AS v_l_extendedprice,
CASE WHEN l_tax > 0 THEN log10(l_tax) END AS v_l_tax FROM lineitem JOIN orders ON l_orderkey = o_orderkey), c AS ({rows}) SELECT {select} FROM c {extra}"""


def _order_lines(spark, sf):
    lines = t(spark, sf, "lineitem").select("l_orderkey", "l_extendedprice", "l_tax")
    orders = t(spark, sf, "orders").select("o_orderkey", "o_totalprice", (seconds_of("o_orderdate") / 86400).alias("day"))
    return lines.join(orders, lines.l_orderkey == orders.o_orderkey).withColumn("flat", F.lit(1.0))


@query(_targets_sql())
def corr_targets(spark, sf):
    return st.corr_targets(_order_lines(spark, sf), ["o_totalprice", "day", "flat"], ["l_extendedprice", "l_tax"]).withColumn("r", r6("r"))


@query(f"""WITH m AS ({_matrix_sql()}) SELECT label_a, label_b, r, n, CAST(row_number() OVER (PARTITION BY label_a ORDER BY abs(r) DESC, label_b) AS BIGINT) AS position FROM m WHERE r IS NOT NULL AND label_a <> label_b""")
def rank_corr(spark, sf):
    matrix = st.corr_matrix(t(spark, sf, "lineitem").select(*MEASURES), MEASURES).withColumn("r", r6("r")).filter("label_a <> label_b")
    return st.rank_correlations(matrix, "label_b", ["label_a"])


@query(_targets_sql(select="target, feature, n, round(CASE WHEN max(n) OVER (PARTITION BY target) <= 0 THEN 1.0 ELSE 0.3 + 0.7 * n::DOUBLE / max(n) OVER (PARTITION BY target) END, 6) AS coverage"))
def relative_coverage(spark, sf):
    table = st.corr_targets(_order_lines(spark, sf), ["o_totalprice", "day", "flat"], ["l_extendedprice", "l_tax"])
    return st.relative_coverage(table).select("target", "feature", "n", r6("coverage").alias("coverage"))


@query("SELECT CAST(16 AS BIGINT) AS cells, false AS agrees FROM lineitem LIMIT 1")
def corr_matrix_regression(spark, sf):
    matrix = st.corr_matrix(t(spark, sf, "lineitem").select(*MEASURES), MEASURES)
    # a stored matrix without the factor differs wherever r isn't zero
    return st.matrix_regression(matrix, matrix.withColumn("r", F.col("r") * 0.99)).select("cells", "agrees")


@query("""SELECT 'rows' AS name, CAST(count(*) FILTER (WHERE o_orderkey IS NOT NULL AND o_totalprice IS NOT NULL) - count(*) AS VARCHAR) AS actual, '0' AS expected, CAST(0 AS BIGINT) AS offenders, true AS passed FROM orders UNION ALL
SELECT 'positive', CAST(count(*) FILTER (WHERE o_totalprice <= 0) AS VARCHAR), '0', CAST(count(*) FILTER (WHERE o_totalprice <= 0) AS BIGINT), count(*) FILTER (WHERE o_totalprice <= 0) = 0 FROM orders UNION ALL
SELECT 'open', CAST(count(*) FILTER (WHERE o_orderstatus = 'O') AS VARCHAR), '-1', CAST(count(*) FILTER (WHERE o_orderstatus = 'O') AS BIGINT), false FROM orders""")
def expectations(spark, sf):
    df = t(spark, sf, "orders")
    low, is_open = F.col("o_totalprice") <= 0, F.col("o_orderstatus") == "O"
    return sc.expect(df, {"rows": (F.count_if(F.col("o_orderkey").isNotNull() & F.col("o_totalprice").isNotNull()) - F.count(F.lit(1)), 0), "positive": (F.count_if(low), 0), "open": (F.count_if(is_open), -1)}, {"positive": low, "open": is_open})


@query("""SELECT event_type AS arm, CAST(count(*) AS BIGINT) AS runs, CAST(count(*) FILTER (WHERE event_id % 5 <> 0) AS BIGINT) AS ok, round(median(value), 6) AS median_seconds, CAST(sum(user_id) AS BIGINT) AS prompt_tokens,
CAST(sum(event_id % 97) AS BIGINT) AS output_tokens, round(sum(event_id % 97)::DOUBLE / sum(1 + event_id % 3), 6) AS tokens_per_row, round(sum(event_id % 2)::DOUBLE / sum(4), 6) AS null_share,
CAST(sum(CASE WHEN event_id % 11 = 0 THEN 1 ELSE 0 END) AS BIGINT) AS zeros, CAST(0 AS BIGINT) AS negatives FROM events GROUP BY event_type""")
def arm_summary(spark, sf):
    k = F.col("event_id")
    runs = t(spark, sf, "events").select(
        F.col("event_type").alias("arm"), (k % 5 != 0).alias("ok"), F.col("value").alias("seconds"), F.col("user_id").alias("prompt_tokens"), (k % 97).alias("output_tokens"), (1 + k % 3).alias("rows"),
        (k % 2).alias("nulls"), F.lit(4).alias("fields"), F.when(k % 11 == 0, 1).otherwise(0).alias("zeros"), F.lit(0).alias("negatives"),
    )
    out = rep.arm_summary(runs)
    return out.withColumns({c: r6(c) for c in ("median_seconds", "tokens_per_row", "null_share")})


@query("""SELECT stratum, mode, CAST(overall AS INTEGER) AS overall, metric, CAST(total AS BIGINT) AS total FROM (
SELECT lang AS stratum, source AS mode, grouping(lang) AS overall, CAST(sum(n_chars) AS BIGINT) AS n_chars, CAST(sum(length(text)) AS BIGINT) AS size FROM documents GROUP BY GROUPING SETS ((lang, source), (source)))
UNPIVOT (total FOR metric IN (n_chars, size))""")
def mode_totals(spark, sf):
    docs = t(spark, sf, "documents").withColumn("size", F.char_length("text").cast("long"))
    return rep.mode_totals(docs.select(F.col("lang").alias("stratum"), F.col("source").alias("mode"), "n_chars", "size"), "stratum", "mode", ["n_chars", "size"])


@query("""SELECT l_returnflag AS mode_a, l_linestatus AS mode_b, round(median(l_discount), 6) AS median_similarity, CAST(sum(l_linenumber) AS BIGINT) AS only_a, CAST(sum(l_suppkey) AS BIGINT) AS only_b, CAST(count(*) AS BIGINT) AS n FROM lineitem GROUP BY 1, 2""")
def pair_summary(spark, sf):
    pairs = t(spark, sf, "lineitem").select(F.col("l_returnflag").alias("mode_a"), F.col("l_linestatus").alias("mode_b"), F.col("l_discount").alias("similarity"), F.col("l_linenumber").cast("long").alias("only_a"), F.col("l_suppkey").alias("only_b"))
    return rep.pair_summary(pairs, "mode_a", "mode_b").withColumn("median_similarity", r6("median_similarity"))


@query("""SELECT l_partkey, l_returnflag, round(avg(l_extendedprice) / 1000, 3) AS mean, CAST(count(l_extendedprice) AS BIGINT) AS n FROM lineitem GROUP BY 1, 2""")
def replicate_mean(spark, sf):
    return rep.replicate_mean(t(spark, sf, "lineitem"), ["l_partkey", "l_returnflag"], "l_extendedprice").withColumn("mean", F.round(F.col("mean") / 1000, 3))


@query("""WITH f AS (SELECT page_id, (page_id % 4)::BIGINT AS n, CASE WHEN page_id % 4 = 0 THEN 0 ELSE 1 END AS named FROM pages)
SELECT page_id AS doc, CAST(page_id % 7 + 3 AS BIGINT) AS pages, n AS figures, CAST(named AS BIGINT) AS captioned, CASE WHEN n > 0 THEN round(named::DOUBLE / n, 2) END AS caption_hit_rate, n AS from_a FROM f""")
def parse_stats(spark, sf):
    k = F.col("page_id")
    figure = lambda i: F.struct(F.when(i == 1, F.lit("Fig 1")).alias("caption"), F.lit("a").alias("tier"))
    figures = F.when(k % 4 == 0, F.array().cast("array<struct<caption:string,tier:string>>")).otherwise(F.transform(F.sequence(F.lit(1), (k % 4).cast("int")), figure))
    manifests = t(spark, sf, "pages").select(k.alias("doc"), F.concat_ws("-", (k + 1).cast("string"), (k + 3 + k % 7).cast("string")).alias("page_range"), figures.alias("figures"))
    return rep.parse_stats(manifests)


@query("""SELECT problem, CAST(count(*) AS BIGINT) AS runs, CAST(sum(n) AS BIGINT) AS total, arg_min(event_type, event_id) AS example FROM (
SELECT event_id, event_type, 'failed' AS problem, event_id % 3 AS n FROM events UNION ALL SELECT event_id, event_type, 'off_grid', event_id % 50 // 49 FROM events) WHERE n > 0 GROUP BY problem""")
def issues(spark, sf):
    k = F.col("event_id")
    runs = t(spark, sf, "events").select("event_id", "event_type", (k % 3).alias("failed"), F.floor((k % 50) / 49).cast("long").alias("off_grid"))
    return rep.issues(runs, "event_id", ["failed", "off_grid"], "event_type", "event_id")


@query("""SELECT event_id, CASE WHEN event_id % 9 = 0 THEN 'truncated' WHEN user_id < length(props) * 20 / 6.0 THEN 'prompt_cut' ELSE 'ok' END AS verdict FROM events""")
def valid_calls(spark, sf):
    calls = t(spark, sf, "events").select("event_id", F.when(F.col("event_id") % 9 == 0, "length").otherwise("stop").alias("stop_reason"), F.col("user_id").alias("prompt_tokens"), (F.length("props") * 20).alias("chars"))
    return rep.valid_calls(calls).select("event_id", "verdict")


@query("""SELECT o_custkey, max(CASE WHEN o_orderstatus = 'O' THEN v END) AS v_O, max(CASE WHEN o_orderstatus = 'F' THEN v END) AS v_F FROM (SELECT o_custkey, o_orderstatus, max(o_totalprice) AS v FROM orders GROUP BY 1, 2) GROUP BY o_custkey""")
def compare_runs(spark, sf):
    orders = t(spark, sf, "orders")
    runs = orders.select("o_orderstatus", "o_custkey").distinct()
    scores = orders.groupBy("o_orderstatus", "o_custkey").agg(F.max("o_totalprice").alias("v"))
    return rep.compare_runs(runs, scores, "o_orderstatus", ["O", "F"], "o_custkey", "v")


@query("""WITH r AS (SELECT user_id, event_type, event_id % 2 AS run, row_number() OVER (PARTITION BY user_id, event_id % 2 ORDER BY event_id) AS place FROM events),
c AS (SELECT user_id, event_type, count(*) FILTER (WHERE run = 0) AS a, count(*) FILTER (WHERE run = 1) AS b FROM r GROUP BY 1, 2),
s AS (SELECT user_id, CAST(sum(a) AS BIGINT) AS n_a, CAST(sum(b) AS BIGINT) AS n_b, CAST(sum(greatest(a - b, 0)) AS BIGINT) AS only_a, CAST(sum(greatest(b - a, 0)) AS BIGINT) AS only_b FROM c GROUP BY 1),
p AS (SELECT coalesce(x.user_id, y.user_id) AS user_id, bool_and(x.event_type IS NOT DISTINCT FROM y.event_type) AS same_order FROM (SELECT * FROM r WHERE run = 0) x FULL JOIN (SELECT * FROM r WHERE run = 1) y ON x.user_id = y.user_id AND x.place = y.place GROUP BY 1)
SELECT s.*, p.same_order, only_a = 0 AND only_b = 0 AS same_set FROM s JOIN p USING (user_id)""")
def compare_repeats(spark, sf):
    runs = t(spark, sf, "events").withColumn("run", F.col("event_id") % 2)
    out = rep.compare_repeats(runs, "user_id", "run", "event_id", "event_type", 0, 1)
    return out.withColumns({k: F.col(k).cast("long") for k in ("n_a", "n_b", "only_a", "only_b")})


@query("""SELECT doc_id, lang FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY md5('42|' || doc_id), doc_id) AS n FROM documents) WHERE n <= 25""")
def stratified_sample(spark, sf):
    return rep.stratified_sample(t(spark, sf, "documents").select("doc_id", "lang"), "lang", 25, "doc_id")
