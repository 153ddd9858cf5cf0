"""Files written and read back, identifiers, phrases, and the composite pipelines, on the given tables."""

from pyspark.sql import functions as F

from ..functions import cells as c
from ..operators import assemble, categories, corpus, linkage, reports
from ..plans import pipelines
from ..shared import scratch, stored
from ..sources import tables as src
from . import linking
from .explore import RANKED, planted_tg, r6, raw_part, t
from .texts import _tables

QUERIES = {}


def query(sql=None):
    def add(f):
        QUERIES[f.__name__] = (f, sql)
        return f

    return add


@query("""SELECT CAST(p_partkey AS VARCHAR) AS key, CASE p_partkey % 4 WHEN 0 THEN p_name || ', "' || p_type || '"' WHEN 1 THEN p_name || chr(10) || p_brand WHEN 2 THEN '' ELSE p_name END AS name FROM part""")
def csv_round_trip(spark, sf):
    """Cells with commas, quotes and line ends, and nulls, as CSV and read again as text."""
    k = F.col("p_partkey") % 4
    name = F.when(k == 0, F.concat("p_name", F.lit(', "'), "p_type", F.lit('"'))).when(k == 1, F.concat("p_name", F.lit("\n"), "p_brand")).when(k == 3, F.concat("p_name", F.lit("​")))
    path = scratch(spark, "csv")
    src.write_csv(t(spark, sf, "part").select(F.col("p_partkey").alias("key"), name.alias("name")), path, {"key": "key", "name": "name", "none": "not there"}, clean=True)
    return src.read_strict_csv(spark, path, ["key", "name"]).select("key", F.coalesce("name", F.lit("")).alias("name"))


@query("SELECT CAST(p_partkey AS VARCHAR) AS key, p_name AS name FROM part")
def csv_marked(spark, sf):
    """Files under a byte order mark, which no cell keeps."""
    path = scratch(spark, "csv")
    src.write_csv(t(spark, sf, "part").select(F.col("p_partkey").alias("key"), F.col("p_name").alias("name")), path, {"key": "key", "name": "name"}, mark=True)
    return src.read_strict_csv(spark, path, ["key", "name"])


@query("""WITH p AS (SELECT DISTINCT l_suppkey AS s, l_partkey AS size FROM lineitem WHERE l_suppkey % 3 <> 0)
SELECT CAST(s_suppkey AS VARCHAR) AS paper_id, CASE WHEN s_suppkey % 3 <> 0 AND s IS NOT NULL THEN 'ok' ELSE 'no_extraction' END AS status, CAST(CASE WHEN s IS NOT NULL THEN row_number() OVER (PARTITION BY s_suppkey ORDER BY size) - 1 END AS INTEGER) AS position, CAST(size AS VARCHAR) AS size FROM supplier LEFT JOIN p ON s_suppkey = s""")
def read_runs(spark, sf):
    """A folder per supplier with its parts as one extraction; every third has none."""
    parts = t(spark, sf, "lineitem").filter("l_suppkey % 3 <> 0").select(F.col("l_suppkey").cast("string").alias("paper_id"), "l_partkey").distinct()
    path = scratch(spark, "runs")
    entry = F.struct(F.col("l_partkey").alias("k"), F.col("l_partkey").cast("string").alias("size"))
    runs = parts.groupBy("paper_id").agg(F.transform(F.array_sort(F.collect_list(entry)), lambda e: F.struct(e["size"].alias("size"))).alias("formulations"))
    runs.withColumn("folder", F.col("paper_id")).write.partitionBy("folder").json(path)
    papers = t(spark, sf, "supplier").select(F.col("s_suppkey").cast("string").alias("paper_id"))
    return src.read_runs(spark, path, papers, "size: string", "*/part-*").select("paper_id", "status", F.col("position").cast("int").alias("position"), "formulation.size")


@query("SELECT c_name, c_custkey FROM customer")
def require_columns(spark, sf):
    return src.require_columns(t(spark, sf, "customer"), ["c_name", "c_custkey"])


@query(f"""WITH {linking.GOLD}, {linking.CELLS}, f AS (SELECT * FROM (VALUES ('q', 'amounts'), ('price', 'amounts'), ('d', 'rates'), ('tax', 'rates'), ('status', 'words'), ('q', 'HEADLINE'), ('d', 'HEADLINE'), ('none', 'empty')) AS v("column", "group"))
SELECT f."group" AS "group", outcome, CAST(count(*) AS BIGINT) AS n FROM s JOIN f ON f."column" = s."column" GROUP BY 1, 2""")
def write_scores(spark, sf):
    """A run's tables written, and its cells read again by group."""
    path = scratch(spark, "scores")
    cells = stored(linking._cells(spark, sf), "cells")
    groups = linking.groups(spark)
    from ..operators import scoring

    src.write_scores(cells.join(F.broadcast(groups), "column"), scoring.group_totals(cells, ["paper"], groups), scoring.group_totals(cells, [], groups), path)
    return spark.read.parquet(f"{path}/cells").groupBy(F.col("group").cast("string").alias("group"), "outcome").agg(F.count(F.lit(1)).alias("n"))


@query("""WITH w AS (SELECT p_partkey, string_split(trim(regexp_replace(regexp_replace(replace(replace(CASE WHEN p_partkey % 2 = 0 THEN 'Tg ' || p_name || ' (MW/kg)?' ELSE 'LiTFSI ' || p_brand || ' %' END, '?', ''), '%', ''), '[():/*^,.\\-]', ' ', 'g'), '\\s+', ' ', 'g')), ' ') AS ws FROM part)
SELECT p_partkey, CASE WHEN regexp_matches(ws[1], '^[A-Z0-9]{2,}$') THEN lower(ws[1]) ELSE lower(ws[1][1]) || ws[1][2:] END || array_to_string([CASE WHEN regexp_matches(w, '^[A-Z0-9]{2,}$') THEN w ELSE upper(w[1]) || w[2:] END for w in ws[2:]], '') AS id FROM w""")
def camel_ids(spark, sf):
    raw = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("Tg "), "p_name", F.lit(" (MW/kg)?"))).otherwise(F.concat(F.lit("LiTFSI "), "p_brand", F.lit(" %")))
    return t(spark, sf, "part").select("p_partkey", c.camel_id(raw).alias("id"))


@query("""WITH a AS (SELECT regexp_replace(lower(p_type), '[^0-9a-z]', '', 'g') AS k, min(p_brand) AS canonical FROM part WHERE p_partkey % 2 = 0 GROUP BY 1),
v AS (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'h2o' WHEN 3 THEN NULL ELSE regexp_replace(lower(p_type), '[^0-9a-z]', '', 'g') END AS k FROM part)
SELECT p_partkey, CASE WHEN k = 'h2o' THEN 'water' ELSE coalesce(a.canonical, k) END AS solvent FROM v LEFT JOIN a USING (k)""")
def canonical_solvent(spark, sf):
    """Names with hyphens, water with a subscript, blank cells, and names that no alias has."""
    part = t(spark, sf, "part")
    aliases = part.filter("p_partkey % 2 = 0").select(F.concat(F.upper("p_type"), F.lit(" - ")).alias("alias"), F.col("p_brand").alias("canonical"))
    aliases = aliases.unionAll(part.limit(1).select(F.lit("h2o"), F.lit("water")))
    kind = F.col("p_partkey") % 4
    raw = F.when(kind == 0, " H₂O. ").when(kind == 3, "  ").otherwise(F.concat(F.lit("  "), F.replace("p_type", F.lit(" "), F.lit("-")), F.lit(" ")))
    return linkage.canonical_solvent(part.select("p_partkey", raw.alias("raw")), "raw", aliases).select("p_partkey", "solvent")


@query("""SELECT p_partkey, array_to_string(list_sort(list_distinct(CASE p_partkey % 4 WHEN 0 THEN [lower(p_type), lower(p_brand)] WHEN 1 THEN [lower(p_brand), '-' || lower(p_type)] WHEN 2 THEN [lower(p_type) || '+' || lower(p_brand)] ELSE ['(' || lower(p_type) || ')'] END)), '|') AS family FROM part""")
def canonical_family(spark, sf):
    """Two parts in either order, with poly before one and a plural of the other; what is no separator
    (plus, hyphen, bracket) stays."""
    k, p, b = F.col("p_partkey") % 4, F.col("p_type"), F.col("p_brand")
    both = (
        F.when(k == 0, F.concat(F.lit("Poly "), p, F.lit("s; ; "), b, F.lit("."))).when(k == 1, F.concat(b, F.lit("s and poly-"), p))
        .when(k == 2, F.concat(p, F.lit("+"), b)).otherwise(F.concat(F.lit("Poly("), p, F.lit(") / poly("), p, F.lit(")s")))
    )
    return t(spark, sf, "part").select("p_partkey", F.array_join(c.canonical_family(both), "|").alias("family"))


@query("SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN '.' || p_size || ' m' WHEN 1 THEN lower(p_type) ELSE NULL END AS words FROM part")
def canonical_text(spark, sf):
    """A dot before a number stays, dots after words go, blank cells are null."""
    k = F.col("p_partkey") % 3
    raw = F.when(k == 0, F.concat(F.lit(" ."), F.col("p_size").cast("string"), F.lit("  M.. "))).when(k == 1, F.concat(F.lit("\ufeff"), F.replace("p_type", F.lit(" "), F.lit("\n ")), F.lit("."))).otherwise(" \t")
    return t(spark, sf, "part").select("p_partkey", c.canonical_text(raw).alias("words"))


@query("""SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN p_size::DOUBLE WHEN 1 THEN 0.0::DOUBLE WHEN 2 THEN p_size / 2.0::DOUBLE WHEN 3 THEN 0.0::DOUBLE END AS condition FROM part""")
def condition_of(spark, sf):
    size, k = F.col("p_size").cast("string"), F.col("p_partkey") % 5
    half = (F.col("p_size") / 2).cast("string")
    name = F.when(k == 0, F.concat("p_name", F.lit(" at "), size, F.lit(" ° C, 3 wt"))).when(k == 1, "Thermal run").when(k == 2, F.concat(F.lit("BPO "), half, F.lit(" wt%"))).when(k == 3, "without initiator").otherwise("control")
    return t(spark, sf, "part").select("p_partkey", c.condition_of(name).alias("condition"))


@query("""SELECT p_partkey, p_brand || '|' || p_type AS items FROM part""")
def split_list(spark, sf):
    return t(spark, sf, "part").select("p_partkey", F.array_join(c.split_list(F.concat(F.lit(" ,"), "p_brand", F.lit(" , ,\t"), "p_type", F.lit(","))), "|").alias("items"))


@query("""SELECT c_custkey, 'c' || c_custkey AS id, '10.1/a/' || c_custkey AS doi, CAST(1900 + c_custkey % 100 AS INTEGER) AS year FROM customer""")
def file_names(spark, sf):
    """Ids, DOIs and years in file names."""
    k = F.col("c_custkey").cast("string")
    name = F.concat(F.lit("c"), k, F.lit("-Author"), (1900 + F.col("c_custkey") % 100).cast("string"), F.lit("a.pdf"))
    return t(spark, sf, "customer").select("c_custkey", c.file_id(name).alias("id"), c.doi_from_file(F.concat(F.lit("10.1@a@"), k, F.lit(".pdf"))).alias("doi"), c.year_of_file(name).alias("year"))


@query(f"""SELECT 'p_type' AS "column", value, CAST(rank AS BIGINT) AS rank, n FROM ({RANKED.format(c="p_type", k="p_partkey", t="part")}) UNION ALL SELECT 'p_brand', value, CAST(rank AS BIGINT), n FROM ({RANKED.format(c="p_brand", k="p_partkey", t="part")}) UNION ALL
SELECT 'rows with a size', NULL, NULL, CAST(count(*) FILTER (WHERE p_partkey % 7 >= 3) AS BIGINT) FROM part UNION ALL SELECT 'pairs', NULL, NULL, CAST(4 * count(DISTINCT 1) AS BIGINT) FROM part""")
def build_dataset(spark, sf):
    """The frozen categories of a raw table, its rows with a size, and the pairs of its matrix."""
    raw = t(spark, sf, "part").select("p_partkey", raw_part().alias("size"), F.col("p_retailprice").cast("string").alias("price"), "p_type", "p_brand")
    out = pipelines.build_dataset(raw, ["size", "price"], ["p_type", "p_brand"], "p_partkey", strict=False)
    line = lambda name, df: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("column"), F.lit(None).cast("string").alias("value"), F.lit(None).cast("long").alias("rank"), "n")
    return out["categories"].select("column", "value", "rank", "n").unionByName(line("rows with a size", out["dataset"].filter("size is not null"))).unionByName(line("pairs", out["correlations"]))


@query("""SELECT 'check' AS part, name, actual AS value FROM (SELECT 'rows' AS name, CAST(count(*) AS VARCHAR) AS actual FROM part UNION ALL SELECT 'sized', CAST(count(*) FILTER (WHERE p_partkey % 7 >= 3) AS VARCHAR) FROM part UNION ALL SELECT 'cheap', CAST(count(*) FILTER (WHERE p_retailprice < 0) AS VARCHAR) FROM part)
UNION ALL SELECT 'registry', unnest(['size', 'price', 'p_type']), unnest(['mm numeric how large', 'USD numeric none', 'none text a type'])
UNION ALL SELECT 'target', 'size', CAST(CASE WHEN corr(s, p) IS NULL THEN NULL ELSE 1 END AS VARCHAR) || ' of ' || CAST(regr_count(s, p) AS VARCHAR) FROM (SELECT CASE WHEN p_partkey % 7 >= 3 THEN p_size::DOUBLE END AS s, log10(p_retailprice) AS p FROM part)""")
def build_checked(spark, sf):
    """The checks that are gathered while the dataset is written, its registry, and its ranked targets."""
    raw = t(spark, sf, "part").select("p_partkey", raw_part().alias("size"), F.col("p_retailprice").cast("string").alias("price"), "p_type")
    n = lambda test: F.count_if(test)
    checks = {"rows": (F.count(F.lit(1)), None), "sized": (n(F.col("size").isNotNull()), None), "cheap": (n(F.col("price") < 0), 0)}
    notes = spark.createDataFrame([("size", "how large")], "id string, description string")
    own = spark.createDataFrame([("size", "not this"), ("p_type", "a type")], "id string, description string")
    out = pipelines.build_dataset(raw, ["size", "price"], ["p_type"], "p_partkey", False, checks, {"size": "Size (mm)", "price": "Price (USD)", "p_type": "Type"}, notes, own, ["price"], fail=False)
    line = lambda df, part, name, value: df.select(F.lit(part).alias("part"), name.alias("name"), value.alias("value"))
    registry = F.concat_ws(" ", F.coalesce("unit", F.lit("none")), "kind", F.coalesce("description", F.lit("none")))
    rank = F.concat(F.col("position").cast("string"), F.lit(" of "), F.col("n").cast("string"))
    return line(out["report"], "check", F.col("name"), F.col("actual")).unionByName(line(out["registry"], "registry", F.col("id"), registry)).unionByName(line(out["targets"], "target", F.col("feature"), rank))


@query(f"""WITH d AS ({RANKED.format(c="p_type", k="p_partkey", t="part")}), m AS (SELECT p_partkey, p_type, unnest([25.0, 60.0]::DOUBLE[]) AS t, unnest([p_retailprice - 1000, p_size::DOUBLE]) AS y FROM part WHERE p_size IN (1, 2, 3, 5, 8, 13, 21, 34))
SELECT p_partkey, t, round(1000.0::DOUBLE / (t + 273.15::DOUBLE), 6) AS x, round(y, 6) AS y, round(log10(y), 6) AS log_y, CAST(CASE WHEN rank < 7 THEN rank ELSE 7 END AS BIGINT) AS bucket FROM m LEFT JOIN d ON p_type = value WHERE y > 0""")
def measurement_series(spark, sf):
    part = t(spark, sf, "part")
    df = part.select("p_partkey", "p_type", "p_size", planted_tg().alias("tg"), (F.col("p_retailprice") - 1000).alias("at25"), F.col("p_size").cast("double").alias("at60"))
    out = pipelines.measurement_series(df, {"p_size": [1, 2, 3, 5, 8, 13, 21, 34]}, "p_partkey", {"at25": 25, "at60": 60}, "arrhenius", None, categories.rank_categories(part, "p_type", "p_partkey"), "p_type")
    return out.select("p_partkey", "t", *[r6(k).alias(k) for k in ("x", "y", "log_y")], "bucket")


@query(f"""WITH d AS ({RANKED.format(c="c_mktsegment", k="c_custkey", t="customer")})
SELECT c_custkey, c_nationkey, c_acctbal, CAST(CASE WHEN rank < 7 THEN rank ELSE 7 END AS BIGINT) AS bucket FROM customer LEFT JOIN d ON c_mktsegment = value WHERE c_acctbal > 0 AND c_nationkey IS NOT NULL AND c_nationkey IN (0, 1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11)""")
def scatter_points(spark, sf):
    df = t(spark, sf, "customer")
    dimension = categories.rank_categories(df, "c_mktsegment", "c_custkey")
    return pipelines.scatter_points(df, {"c_nationkey": list(range(12))}, "c_nationkey", "c_acctbal", False, True, dimension, "c_mktsegment", "c_custkey").select("c_custkey", "c_nationkey", "c_acctbal", "bucket")


@query("""WITH l AS (SELECT l_orderkey AS doc, count(*) AS n, count(*) FILTER (WHERE l_partkey % 3 = 0) AS long FROM lineitem GROUP BY 1)
SELECT mode, CAST(count(*) AS BIGINT) AS docs, CAST(sum(n) AS BIGINT) AS table_rows, CAST(sum(2 * n + long) AS BIGINT) AS table_numbers, CAST(CASE WHEN mode = 'b' THEN 0 ELSE count(*) END AS BIGINT) AS display_formulas FROM l, (VALUES ('a'), ('b')) AS m(mode) GROUP BY mode""")
def compare_parsers(spark, sf):
    """Every order's table as two parsers give it, the second without formulas."""
    a = _tables(spark, sf)
    docs = a.select((2 * F.col("doc")).alias("id"), F.lit("a").alias("mode"), F.col("doc").alias("paper"), "text").union(a.select(2 * F.col("doc") + 1, F.lit("b"), "doc", F.replace("text", F.lit("$$"), F.lit(""))))
    metrics = pipelines.compare_parsers(docs, "text", "id", "mode", "paper", ("a", "b"))["metrics"]
    return metrics.groupBy("mode").agg(F.count(F.lit(1)).alias("docs"), *[F.sum(c_).cast("long").alias(c_) for c_ in ("table_rows", "table_numbers", "display_formulas")])


@query()
def compare_parsers_pairs(spark, sf):
    """The summary of the same comparison over conversations: whole texts, and without their digits."""
    turns = t(spark, sf, "conversations").filter("text is not null").select(F.concat_ws("-", "conv_id", "turn", "role").alias("paper"), "text").dropDuplicates(["paper"])
    docs = turns.select(F.concat(F.lit("a"), "paper").alias("id"), F.lit("a").alias("mode"), "paper", "text").union(turns.select(F.concat(F.lit("b"), "paper"), F.lit("b"), "paper", F.regexp_replace("text", "[0-9]", "")))
    return pipelines.compare_parsers(docs, "text", "id", "mode", "paper", ("a", "b"))["summary"]


@query("""WITH i AS (SELECT CASE WHEN conv_id % 5 = 0 THEN 'x' || md5(CAST(conv_id AS VARCHAR)) ELSE md5(CAST(conv_id AS VARCHAR)) END AS r, conv_id, conv_id % 7 = 3 AS bad FROM conversations)
SELECT CAST(count(*) AS BIGINT) AS seen, CAST(count(*) FILTER (WHERE bad) AS BIGINT) AS unreadable, CAST(count(*) FILTER (WHERE NOT bad AND conv_id % 5 = 0) AS BIGINT) AS badly_named, CAST(count(*) FILTER (WHERE NOT bad AND conv_id % 5 <> 0 AND conv_id % 3 = 0) AS BIGINT) AS stored,
CAST(count(*) FILTER (WHERE NOT bad AND conv_id % 5 <> 0 AND conv_id % 3 <> 0) - count(DISTINCT CASE WHEN NOT bad AND conv_id % 5 <> 0 AND conv_id % 3 <> 0 THEN r END) AS BIGINT) AS repeated, CAST(count(DISTINCT CASE WHEN NOT bad AND conv_id % 5 <> 0 AND conv_id % 3 <> 0 THEN r END) AS BIGINT) AS new FROM i""")
def import_counts(spark, sf):
    k = F.col("conv_id")
    ids = t(spark, sf, "conversations").select(k, F.md5(k.cast("string").cast("binary")).alias("h"))
    incoming = ids.select(F.when(k % 5 == 0, F.concat(F.lit("x"), "h")).otherwise(F.col("h")).alias("record_id"), F.when(k % 7 == 3, F.lit("{")).alias("_corrupt_record"))
    return assemble.import_report(ids.filter("conv_id % 3 = 0").select(F.col("h").alias("record_id")), incoming)


@query("""WITH s AS (SELECT o_orderpriority AS stratum, grouping(o_orderpriority) AS overall, o_orderstatus AS mode, sum(o_orderkey % 3)::DOUBLE / nullif(sum(o_orderkey % 7), 0) AS share FROM orders GROUP BY GROUPING SETS ((o_orderpriority, o_orderstatus), (o_orderstatus)))
SELECT stratum, CAST(overall AS INTEGER) AS overall, round(max(CASE WHEN mode = 'O' THEN share END), 6) AS O, round(max(CASE WHEN mode = 'F' THEN share END), 6) AS F FROM s GROUP BY 1, 2""")
def digitised_share(spark, sf):
    k = F.col("o_orderkey")
    metrics = t(spark, sf, "orders").select(F.col("o_orderpriority").alias("stratum"), F.col("o_orderstatus").alias("mode"), (k % 3).alias("chart_rows"), (k % 7).alias("table_rows"))
    return reports.digitised_share(metrics, "stratum", "mode", ["O", "F"]).select("stratum", "overall", r6("O").alias("O"), r6("F").alias("F"))


@query("""SELECT event_type AS arm, round(median(value), 6) AS median_prefill_seconds, round(median(user_id), 6) AS median_decode_seconds, round(sum(event_id % 5)::DOUBLE / sum(4), 6) AS filled_share FROM events GROUP BY 1""")
def arm_phases(spark, sf):
    k, none = F.col("event_id"), F.lit(0)
    runs = t(spark, sf, "events").select(
        F.col("event_type").alias("arm"), F.lit(True).alias("ok"), none.alias("seconds"), none.alias("prompt_tokens"), none.alias("output_tokens"), none.alias("rows"), none.alias("nulls"), F.lit(4).alias("fields"), none.alias("zeros"),
        none.alias("negatives"), F.col("value").alias("prefill_seconds"), F.col("user_id").cast("double").alias("decode_seconds"), (k % 5).alias("filled"),
    )
    return reports.arm_summary(runs).select("arm", *[r6(x).alias(x) for x in ("median_prefill_seconds", "median_decode_seconds", "filled_share")])


MATCHES = """e AS (SELECT event_id, user_id, floor(epoch(ts))::BIGINT % 100000 / 1000.0::DOUBLE AS t, value::DOUBLE AS x FROM events),
o AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY pred_id, gold_id) AS i FROM (
SELECT p.user_id, p.event_id AS pred_id, k.event_id AS gold_id FROM e p JOIN e k ON p.user_id = k.user_id AND p.event_id % 2 = 0 AND k.event_id % 2 = 1 AND abs(p.t - k.t) < 5.0 AND (abs(p.x - k.x) <= 0.2 * abs(k.x) OR abs(p.x - k.x) < 5e-5))),
r AS (SELECT DISTINCT user_id, CAST(0 AS BIGINT) AS i, CAST([] AS BIGINT[]) AS ps, CAST([] AS BIGINT[]) AS gs, false AS took FROM o UNION ALL
SELECT user_id, i, CASE WHEN free THEN list_append(ps, pred_id) ELSE ps END, CASE WHEN free THEN list_append(gs, gold_id) ELSE gs END, free FROM (
SELECT r.user_id, o.i, r.ps, r.gs, o.pred_id, o.gold_id, NOT list_contains(r.ps, o.pred_id) AND NOT list_contains(r.gs, o.gold_id) AS free FROM r JOIN o ON o.user_id = r.user_id AND o.i = r.i + 1)),
a AS (SELECT o.* FROM r JOIN o ON o.user_id = r.user_id AND o.i = r.i WHERE r.took)"""


@query(f"WITH RECURSIVE {MATCHES} SELECT user_id, event_id, 'missed' AS kind FROM e WHERE event_id % 2 = 1 AND event_id NOT IN (SELECT gold_id FROM a)")
def missed_key_rows(spark, sf):
    points, key = linking._points(spark, sf)
    links = linkage.match_points(points, key, ["user_id"], 5.0, 0.2)
    return linkage.missed_key_rows(key, ["user_id"], links).select("user_id", F.col("key_id").alias("event_id"), "kind")


linking.QUERIES["tolerance_match_one"] = (linking.QUERIES["tolerance_match_one"][0], f"WITH RECURSIVE {MATCHES} SELECT user_id, pred_id, gold_id FROM a")


@query("""SELECT doc_id, doc_id % 2 = 0 OR NOT contains(text, '1') AS digits_ok FROM documents WHERE text IS NOT NULL""")
def digit_guard_texts(spark, sf):
    """Whole texts that lose their zeros, or their ones."""
    docs = t(spark, sf, "documents").filter("text is not null")
    after = F.when(F.col("doc_id") % 2 == 0, F.replace("text", F.lit("0"))).otherwise(F.replace("text", F.lit("1")))
    return corpus.digit_guard(docs.select("doc_id", F.col("text").alias("b"), after.alias("a")), "b", "a").select("doc_id", "digits_ok")


@query("""SELECT doc_id, sha256(replace(coalesce(text, ''), '$', '') || ' at ' || (doc_id % 90) || ' °C, then ' || replace(coalesce(text, ''), '$', '') || ' $x_1$.') AS digest, CAST(1 AS BIGINT) AS n_degrees FROM documents""")
def normalise_degrees_texts(spark, sf):
    """A formula between whole texts, and one that is no temperature."""
    own = F.replace(F.coalesce("text", F.lit("")), F.lit("$"))
    text = F.concat(own, F.lit(" at $"), (F.col("doc_id") % 90).cast("string"), F.lit(r" ^ {\circ} \mathrm {C}$, then "), own, F.lit(" $x_1$."))
    return corpus.normalise_degrees(t(spark, sf, "documents").select("doc_id", text.alias("text")), "text", "doc_id").select("doc_id", F.sha2("text", 256).alias("digest"), "n_degrees")


@query("""SELECT doc_id, sha256(own || '![x](new' || doc_id || ')' || own || '![y](' || CASE WHEN doc_id % 2 = 0 THEN 'new' || doc_id ELSE 'other' END || ')') AS digest FROM (SELECT doc_id, replace(coalesce(text, ''), '![', '! [') AS own FROM documents)""")
def rewrite_figures_texts(spark, sf):
    """Marks between whole texts, whose own ones are unmade: by locator, by image path, and unknown."""
    docs = t(spark, sf, "documents")
    k, own = F.col("doc_id").cast("string"), F.replace(F.coalesce("text", F.lit("")), F.lit("!["), F.lit("! ["))
    marked = docs.select("doc_id", F.concat(own, F.lit("![x](loc"), k, F.lit(")"), own, F.lit("![y]("), F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("img"), k)).otherwise("other"), F.lit(")")).alias("text"))
    figures = docs.select("doc_id", F.concat(F.lit("loc"), k).alias("locator"), F.concat(F.lit("img"), k).alias("image"), F.concat(F.lit("new"), k).alias("path"))
    return corpus.rewrite_figures(marked, figures.union(figures), "text", "doc_id", "locator", "path", "image").select("doc_id", F.sha2("text", 256).alias("digest"))


@query("""SELECT doc_id, CAST(i AS BIGINT) AS at, CASE WHEN i = 1 THEN 'Scheme 4: end' WHEN n + 21 <= 8000 THEN 'Figure 3 shows it' WHEN n + 12 <= 8000 THEN rtrim(substring('Figure 3 shows it', 1, CAST(8000 - n - 4 AS BIGINT))) END AS caption FROM (
SELECT doc_id, length(regexp_replace(replace(coalesce(text, ''), '![', '! ['), '(?i)fig|scheme', '-', 'g')) AS n FROM documents), (VALUES (0), (1)) AS v(i)""")
def figure_captions_texts(spark, sf):
    """Marks before and after whole texts, whose own marks and captions are unmade, with captions after
    them: the first is within reach, cut off by it, or beyond."""
    own = F.regexp_replace(F.replace(F.coalesce("text", F.lit("")), F.lit("!["), F.lit("! [")), "(?i)fig|scheme", "-")
    text = F.concat(F.lit("![Image](page:1/block:2)\n"), own, F.lit("\n**Figure 3 shows it\n![b](c)\n\n  Scheme 4: end\n"))
    return corpus.figures(t(spark, sf, "documents").select("doc_id", text.alias("text")), "text", "doc_id").select("doc_id", "at", "caption")


#: Documents that repeat an id, of which every other has no text: rows of their own, with figures of the id.
@query("""SELECT doc_id % 50 AS id, CASE WHEN doc_id % 2 = 1 THEN 'none' ELSE sha256('at 7' || (doc_id % 10) || ' °C ![x](new' || (doc_id % 50) || ')' || own) END AS digest, CAST(CASE WHEN doc_id % 2 = 1 THEN 0 ELSE 1 END AS BIGINT) AS n_degrees
FROM (SELECT doc_id, replace(replace(coalesce(text, ''), '![', '! ['), '$', '') AS own FROM documents)""")
def repeated_documents(spark, sf):
    docs, k = t(spark, sf, "documents"), F.col("doc_id") % 50
    own = F.replace(F.replace(F.coalesce("text", F.lit("")), F.lit("!["), F.lit("! [")), F.lit("$"))
    text = F.concat(F.lit("at $7"), (F.col("doc_id") % 10).cast("string"), F.lit(r"^{\circ} C$ ![x](old)"), own)
    rows = docs.select(k.alias("id"), F.when(F.col("doc_id") % 2 == 0, text).alias("text"))
    figures = docs.select(k.alias("id"), F.lit("old").alias("key"), F.concat(F.lit("new"), k.cast("string")).alias("to")).distinct()
    out = corpus.rewrite_figures(corpus.normalise_degrees(rows, "text"), figures, "text", "id", "key", "to")
    return out.select("id", F.coalesce(F.sha2("text", 256), F.lit("none")).alias("digest"), "n_degrees")
