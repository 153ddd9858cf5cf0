"""Filters, search, sorting, categories, series, parsing."""

from pyspark.sql import functions as F

from ..functions import cells as c
from ..operators import categories as cat
from ..operators import explore as x
from ..operators import series as s


def t(spark, sf, name):
    return spark.read.parquet(f"{sf}/{name}.parquet")


def r6(column):
    return F.round(column, 6)


def seconds_of(column):
    """Whole seconds since 1970 of a timestamp without zone."""
    return F.timestamp_diff("SECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), F.col(column)).cast("double")


QUERIES = {}


def query(sql=None):
    def add(f):
        QUERIES[f.__name__] = (f, sql)
        return f

    return add


@query("SELECT c_custkey, c_mktsegment, c_nationkey FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') AND c_nationkey IN (1, 2, 3, 5, 8, 13)")
def multi_filter(spark, sf):
    return x.multi_filter(t(spark, sf, "customer"), {"c_mktsegment": ["BUILDING", "MACHINERY"], "c_nationkey": [1, 2, 3, 5, 8, 13], "c_name": []}).select("c_custkey", "c_mktsegment", "c_nationkey")


@query("SELECT p_partkey, p_name, p_type FROM part WHERE contains(lower(p_name), 'an') OR contains(lower(p_type), 'an') OR contains(lower(p_brand), 'an')")
def text_search(spark, sf):
    return x.text_search(t(spark, sf, "part"), " AN ", ["p_name", "p_type", "p_brand"]).select("p_partkey", "p_name", "p_type")


@query("SELECT p_partkey, p_name FROM part WHERE contains(lower(p_name), '17') OR contains(lower(p_brand), '17') OR CAST(p_partkey AS VARCHAR) = '17'")
def glossary_search(spark, sf):
    return x.glossary_search(t(spark, sf, "part"), "17", ["p_name", "p_brand"], "p_partkey").select("p_partkey", "p_name")


@query("""WITH s AS (SELECT p_partkey, p_name, p_retailprice, row_number() OVER (ORDER BY p_retailprice DESC NULLS LAST, p_partkey) AS rn FROM part)
SELECT p_partkey, p_name FROM s WHERE rn > 50 AND rn <= 75""")
def sorted_page(spark, sf):
    df = t(spark, sf, "part")
    return x.page(df, 3, 25, x.sort_order(df, "p_retailprice", True, "p_partkey"))[0].select("p_partkey", "p_name")


@query("""SELECT CAST(count(*) AS BIGINT) AS items, CAST(greatest(ceil(count(*) / 30.0), 1) AS BIGINT) AS pages, CAST(greatest(ceil(count(*) / 30.0), 1) AS BIGINT) AS page,
CAST((greatest(ceil(count(*) / 30.0), 1) - 1) * 30 + 1 AS BIGINT) AS first, CAST(count(*) AS BIGINT) AS last FROM customer""")
def page_info(spark, sf):
    df = t(spark, sf, "customer")
    return x.page(df, 10**6, 30, [F.col("c_custkey")])[1]


@query("""WITH k AS (SELECT p_partkey, p_name, regexp_replace(lower(p_name), '\\d+', '', 'g') AS word, CAST(nullif(regexp_extract(p_name, '(\\d+)', 1), '') AS BIGINT) AS num FROM part)
SELECT p_partkey, p_name, CAST(row_number() OVER (ORDER BY word, num NULLS FIRST, p_partkey) AS BIGINT) AS position FROM k""")
def natural_sort_all(spark, sf):
    df = t(spark, sf, "part")
    return x.with_position(df.select("p_partkey", "p_name"), x.sort_order(df, "p_name", False, "p_partkey"))


QUERIES["natural_sort_top"] = QUERIES["natural_sort_all"]


@query("SELECT p_name, p_partkey, p_size FROM part WHERE p_size IN (1, 2, 3) AND contains(lower(p_name), 'a') ORDER BY p_partkey")
def visible_projection(spark, sf):
    return x.table_view(t(spark, sf, "part"), {"p_size": [1, 2, 3]}, "a", ["p_name"], ["p_name", "nope", "p_partkey", "p_name", "p_size"], "p_brand", True, "p_partkey")


def raw_part():
    """Cells with sentinels, junk and numbers planted by key."""
    return F.when(F.col("p_partkey") % 7 == 0, "n/a").when(F.col("p_partkey") % 7 == 1, "  None ").when(F.col("p_partkey") % 7 == 2, "1e3x").when(F.col("p_partkey") % 7 == 3, F.concat(F.lit("+"), F.col("p_size").cast("string"), F.lit("e1"))).otherwise(F.concat(F.lit(" "), F.col("p_size").cast("string")))


@query("""SELECT p_partkey, CASE WHEN p_partkey % 7 = 3 THEN p_size * 10.0::DOUBLE WHEN p_partkey % 7 > 3 THEN p_size::DOUBLE END AS number, p_partkey % 7 = 2 AS junk FROM part""")
def parse_numeric(spark, sf):
    return t(spark, sf, "part").withColumn("raw", raw_part()).select("p_partkey", c.parse_number("raw").alias("number"), c.is_junk_number("raw").alias("junk"))


@query("""SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN NULL WHEN p_partkey % 5 = 1 THEN 'na' ELSE trim(regexp_replace(p_name, '\\s+', ' ', 'g')) END AS cell FROM part""")
def parse_text(spark, sf):
    raw = F.when(F.col("p_partkey") % 5 == 0, "  ​ ").when(F.col("p_partkey") % 5 == 1, "﻿ na ").otherwise(F.concat(F.lit("  "), F.replace("p_name", F.lit(" "), F.lit(" \t ")), F.lit("\n")))
    return t(spark, sf, "part").select("p_partkey", c.parse_text(raw).alias("cell"))


@query("""SELECT l_orderkey, l_linenumber, l_partkey, name, round(value, 6) AS value FROM (SELECT l_orderkey, l_linenumber, l_partkey, l_quantity::DOUBLE AS l_quantity, l_discount::DOUBLE AS l_discount, l_tax::DOUBLE AS l_tax FROM lineitem)
UNPIVOT (value FOR name IN (l_quantity, l_discount, l_tax))""")
def melt_measures(spark, sf):
    df = t(spark, sf, "lineitem").withColumn("l_quantity", F.col("l_quantity").cast("double"))
    return x.melt(df, ["l_orderkey", "l_linenumber", "l_partkey"], ["l_quantity", "l_discount", "l_tax"]).withColumn("value", r6("value"))


def planted_tg():
    return F.when(F.col("p_partkey") % 3 != 0, (F.col("p_partkey") % 60 - 30).cast("double"))


@query("""WITH p AS (SELECT p_partkey, p_size, CASE WHEN p_partkey % 3 <> 0 THEN (p_partkey % 60 - 30)::DOUBLE END AS tg FROM part)
SELECT p_partkey, round(1000.0::DOUBLE / (p_size + 273.15::DOUBLE), 6) AS arrhenius, round((p_size + 273.15::DOUBLE) / (tg + 273.15::DOUBLE), 6) AS tg_ratio,
CASE WHEN p_size - tg + 50 <> 0 THEN round(1000.0::DOUBLE / (p_size - tg + 50), 6) END AS tg_shifted FROM p""")
def axis_transforms(spark, sf):
    df = t(spark, sf, "part").withColumn("tg", planted_tg())
    return df.select("p_partkey", *[r6(c.axis_transform(m, "p_size", "tg")).alias(m) for m in ("arrhenius", "tg_ratio", "tg_shifted")])


@query("SELECT CAST(count(*) AS BIGINT) AS n, CAST(count(*) FILTER (WHERE l_linenumber % 3 = 0 AND l_discount <> l_tax) AS BIGINT) AS mismatches FROM lineitem")
def coalesce_check(spark, sf):
    df = t(spark, sf, "lineitem").withColumn("stored", F.when(F.col("l_linenumber") % 3 == 0, F.col("l_tax")).otherwise(F.col("l_discount")))
    return x.coalesce_check(df, "stored", ["l_discount", "l_tax"], 1e-12)


RANKED = "SELECT {c} AS value, CAST(count(*) AS BIGINT) AS n, CAST(row_number() OVER (ORDER BY count(*) DESC, min({k}), {c}) - 1 AS BIGINT) AS rank FROM {t} WHERE {c} IS NOT NULL GROUP BY {c}"


@query(RANKED.format(c="p_type", k="p_partkey", t="part"))
def rank_categories(spark, sf):
    return cat.rank_categories(t(spark, sf, "part"), "p_type", "p_partkey")


@query(f"""WITH r AS ({RANKED.format(c="source", k="doc_id", t="documents")})
SELECT CASE WHEN rank >= 7 THEN 7 ELSE rank END AS bucket, CAST(sum(n) AS BIGINT) AS n FROM r GROUP BY 1""")
def fold_topk(spark, sf):
    docs = t(spark, sf, "documents").select("doc_id", "source")
    folded = cat.fold_top(cat.with_rank(docs, cat.rank_categories(docs, "source", "doc_id"), "source"))
    return folded.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH r AS ({RANKED.format(c="source", k="doc_id", t="documents")})
SELECT CAST(sum(n) AS BIGINT) AS n, round(100.0::DOUBLE * sum(n) FILTER (WHERE rank < 7) / sum(n), 1) AS covered FROM r""")
def topk_coverage(spark, sf):
    return cat.topk_coverage(t(spark, sf, "documents").select("doc_id", "source"), "source", "doc_id")


@query("""SELECT 'c_acctbal' AS "column", CAST(count(c_acctbal) AS BIGINT) AS considered, CAST(count(*) FILTER (WHERE c_acctbal <= 0) AS BIGINT) AS dropped FROM customer""")
def log_axis_report(spark, sf):
    return s.log_axis_report(t(spark, sf, "customer").select("c_acctbal"), ["c_acctbal"])


@query("SELECT c_custkey, c_acctbal, c_nationkey FROM customer WHERE c_acctbal > 0 AND c_nationkey IS NOT NULL")
def plottable_points(spark, sf):
    return x.plottable(t(spark, sf, "customer"), "c_nationkey", "c_acctbal", False, True).select("c_custkey", "c_acctbal", "c_nationkey")


@query("""SELECT origin, CAST(count(*) AS BIGINT) AS n, CAST(count(s) AS BIGINT) AS with_segment, round(sum(b), 2) AS balance FROM (
SELECT 'dataset' AS origin, c_mktsegment AS s, c_acctbal AS b FROM customer WHERE c_mktsegment = 'BUILDING' UNION ALL SELECT 'user', NULL, s_acctbal FROM supplier) GROUP BY origin""")
def overlay_report(spark, sf):
    base = t(spark, sf, "customer").select(F.col("c_mktsegment").alias("segment"), F.col("c_acctbal").alias("balance"))
    own = t(spark, sf, "supplier").select(F.col("s_acctbal").alias("balance"))
    return x.overlay(base, own, {"segment": ["BUILDING"]}).groupBy("origin").agg(F.count(F.lit(1)).alias("n"), F.count("segment").alias("with_segment"), F.round(F.sum("balance"), 2).alias("balance"))


@query("""WITH m AS (SELECT p_partkey, CASE WHEN p_partkey % 3 <> 0 THEN (p_partkey % 60 - 30)::DOUBLE END AS tg, unnest([25.0, 60.0]::DOUBLE[]) AS t,
unnest([p_retailprice - 1000, p_size::DOUBLE]) AS y FROM part),
p AS (SELECT p_partkey, tg IS NULL AS lacking, count(*) FILTER (WHERE tg IS NOT NULL AND y <= 0) AS low, count(*) FILTER (WHERE tg IS NOT NULL AND y > 0 AND t - tg + 50 = 0) AS nox,
count(*) FILTER (WHERE tg IS NOT NULL AND y > 0 AND t - tg + 50 <> 0) AS good FROM m GROUP BY p_partkey, tg)
SELECT CAST(count(*) FILTER (WHERE NOT lacking) AS BIGINT) AS considered, CAST(count(*) FILTER (WHERE lacking) AS BIGINT) AS without_tg, CAST(sum(low) AS BIGINT) AS non_positive,
CAST(sum(nox) AS BIGINT) AS undefined_x, CAST(count(*) FILTER (WHERE good > 0) AS BIGINT) AS drawn FROM p""")
def series_report(spark, sf):
    df = t(spark, sf, "part").select("p_partkey", planted_tg().alias("tg"), (F.col("p_retailprice") - 1000).alias("at25"), F.col("p_size").cast("double").alias("at60"))
    return s.series_report(df, "p_partkey", {"at25": 25, "at60": 60}, "tg_shifted", "tg")


@query("""WITH m AS (SELECT p_partkey, unnest([25.0, 60.0]::DOUBLE[]) AS t, unnest([p_retailprice - 1000, p_size::DOUBLE]) AS y FROM part)
SELECT p_partkey, t, round(1000.0::DOUBLE / (t + 273.15::DOUBLE), 6) AS x, round(y, 6) AS y, round(log10(y), 6) AS log_y FROM m WHERE y > 0""")
def series_points(spark, sf):
    df = t(spark, sf, "part").select("p_partkey", (F.col("p_retailprice") - 1000).alias("at25"), F.col("p_size").cast("double").alias("at60"))
    return s.series_points(df, "p_partkey", {"at25": 25, "at60": 60}, "arrhenius").select("p_partkey", "t", *[r6(k).alias(k) for k in ("x", "y", "log_y")])


@query("""WITH l AS (SELECT o_orderstatus AS slot, o_custkey AS s, count(*) AS n, sum(o_totalprice) AS v FROM orders GROUP BY 1, 2)
SELECT slot, CAST(count(*) AS BIGINT) AS samples, CAST(sum(n) + count(*) - 1 AS BIGINT) AS points, CAST(count(*) - 1 AS BIGINT) AS gaps, round(sum(v), 2) AS total FROM l GROUP BY slot""")
def line_packing(spark, sf):
    df = t(spark, sf, "orders").withColumn("day", F.unix_timestamp("o_orderdate").cast("double"))
    packed = s.pack_lines(df, "o_orderstatus", "o_custkey", "o_orderkey", "day", "o_totalprice")
    return packed.select(F.col("o_orderstatus").alias("slot"), "samples", F.size("ys").cast("long").alias("points"), F.size(F.filter("ys", lambda v: v.isNull())).cast("long").alias("gaps"), F.round(F.aggregate("ys", F.lit(0.0), lambda a, v: a + F.coalesce(v, F.lit(0.0))), 2).alias("total"))


@query("""SELECT o_orderstatus AS slot, o_custkey AS sample, false AS gap, o_orderkey AS o, epoch(o_orderdate)::DOUBLE AS x, o_totalprice::DOUBLE AS y FROM orders UNION ALL SELECT DISTINCT o_orderstatus, o_custkey, true, NULL::BIGINT, NULL::DOUBLE, NULL::DOUBLE FROM orders""")
def line_rows(spark, sf):
    """The rows of packed lines, whatever the size of a slot."""
    df = t(spark, sf, "orders").withColumn("day", F.unix_timestamp("o_orderdate").cast("double"))
    return s.line_rows(df, "o_orderstatus", "o_custkey", "o_orderkey", "day", "o_totalprice").withColumnRenamed("o_orderstatus", "slot")


@query(f"""WITH r AS ({RANKED.format(c="c_mktsegment", k="c_custkey", t="customer")}),
o AS (SELECT CASE WHEN c_custkey % 10 = 0 THEN NULL WHEN c_custkey % 10 = 1 THEN 'new' ELSE c_mktsegment END AS value, c_custkey AS k FROM customer),
g AS (SELECT value, CAST(count(*) AS BIGINT) AS n, min(k) AS first FROM o GROUP BY value)
SELECT g.value, g.n, CAST(row_number() OVER (ORDER BY g.value IS NULL, r.rank NULLS LAST, g.first) - 1 AS BIGINT) AS position FROM g LEFT JOIN r ON g.value = r.value""")
def group_order(spark, sf):
    df = t(spark, sf, "customer")
    own = df.withColumn("v", F.when(F.col("c_custkey") % 10 != 0, F.when(F.col("c_custkey") % 10 == 1, "new").otherwise(F.col("c_mktsegment"))))
    return cat.group_order(own, cat.rank_categories(df, "c_mktsegment", "c_custkey"), "v", "c_custkey")


@query("SELECT CAST(count(*) AS BIGINT) AS n, CAST(count(DISTINCT l_returnflag) AS BIGINT) AS distinct_l_returnflag, CAST(count(DISTINCT l_suppkey) AS BIGINT) AS distinct_l_suppkey, CAST(2 AS BIGINT) AS measured FROM lineitem")
def table_stats(spark, sf):
    return cat.table_stats(t(spark, sf, "lineitem"), ["l_returnflag", "l_suppkey"], ["l_discount", "l_tax"])


@query("SELECT event_type, CAST(count(*) AS BIGINT) AS n FROM events GROUP BY event_type")
def category_counts(spark, sf):
    return cat.category_counts(t(spark, sf, "events"), "event_type")


@query("SELECT c_custkey, c_mktsegment AS segment FROM customer")
def snap_category(spark, sf):
    df = t(spark, sf, "customer")
    mixed = df.select("c_custkey", F.when(F.col("c_custkey") % 2 == 0, F.lower("c_mktsegment")).otherwise(F.initcap("c_mktsegment")).alias("segment"))
    return cat.snap_category(mixed, cat.rank_categories(df, "c_mktsegment", "c_custkey"), "segment").select("c_custkey", "segment")


@query("""SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN '=' || c_name WHEN c_custkey % 4 = 1 THEN '@' || c_name ELSE c_name END AS raw,
CASE WHEN c_custkey % 4 = 0 THEN '''=' || c_name WHEN c_custkey % 4 = 1 THEN '''@' || c_name ELSE c_name END AS safe FROM customer""")
def spreadsheet_safe(spark, sf):
    raw = F.when(F.col("c_custkey") % 4 == 0, F.concat(F.lit("="), F.col("c_name"))).when(F.col("c_custkey") % 4 == 1, F.concat(F.lit("@"), F.col("c_name"))).otherwise(F.col("c_name"))
    return t(spark, sf, "customer").select("c_custkey", raw.alias("raw"), c.spreadsheet_safe(raw).alias("safe"))


@query("""SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN p_name || ' (' || p_type || ')' ELSE p_name END AS shown FROM part""")
def display_name(spark, sf):
    unit = F.when(F.col("p_partkey") % 2 == 0, F.col("p_type"))
    label = F.when(F.col("p_partkey") % 4 == 0, F.concat("p_name", F.lit(" ("), "p_type", F.lit(")"))).otherwise(F.col("p_name"))
    return t(spark, sf, "part").select("p_partkey", c.display_name(label, unit).alias("shown"))


@query("""SELECT p_partkey, CASE WHEN regexp_matches(n, '^[0-9]') THEN 'f_' || n ELSE n END AS snake FROM (SELECT p_partkey, regexp_replace(regexp_replace(lower(CASE WHEN p_partkey % 3 = 0 THEN p_partkey || ' ' || p_name ELSE p_name || ' (%)' END), '[^0-9a-z]+', '_', 'g'), '^_+|_+$', '', 'g') AS n FROM part)""")
def snake_ids(spark, sf):
    raw = F.when(F.col("p_partkey") % 3 == 0, F.concat_ws(" ", F.col("p_partkey").cast("string"), "p_name")).otherwise(F.concat("p_name", F.lit(" (%)")))
    return t(spark, sf, "part").select("p_partkey", c.snake_id(raw).alias("snake"))


@query("""SELECT doc_id, left(sha256(coalesce(text, '')), 8) AS content_id FROM documents""")
def content_id(spark, sf):
    return t(spark, sf, "documents").select("doc_id", c.content_id(F.coalesce("text", F.lit(""))).alias("content_id"))


@query("""SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'salt wt%' WHEN 4 THEN NULL ELSE 'Li:functional group' END AS kind,
CASE p_partkey % 5 WHEN 0 THEN p_size::DOUBLE WHEN 4 THEN NULL WHEN 3 THEN round_even(0.25::DOUBLE, 6) ELSE round_even(1.0::DOUBLE / p_size, 6) END AS value,
p_partkey % 5 = 2 AS noted FROM part""")
def parse_concentration(spark, sf):
    size, k = F.col("p_size").cast("string"), F.col("p_partkey") % 5
    phrase = F.when(k == 0, F.concat(size, F.lit(" wt %"))).when(k == 1, F.concat(F.lit("EO/Li = "), size)).when(k == 2, F.concat(F.lit("Li:O = "), size, F.lit(":1"))).when(k == 3, F.lit("ratio 1/4")).otherwise(F.lit("some salt"))
    found = c.parse_concentration(phrase)
    return t(spark, sf, "part").select("p_partkey", found["kind"].alias("kind"), found["value"].alias("value"), found["note"].isNotNull().alias("noted"))


@query("""SELECT conv_id, CAST(count(*) AS BIGINT) AS n, string_agg(role, ' ' ORDER BY turn, role) AS words FROM conversations WHERE turn IS NOT NULL AND role IS NOT NULL GROUP BY conv_id""")
def inverted_index_text(spark, sf):
    df = t(spark, sf, "conversations").filter("turn is not null and role is not null")
    index = df.groupBy("conv_id", "role").agg(F.sort_array(F.collect_list(F.col("turn").cast("int"))).alias("at")).groupBy("conv_id").agg(F.map_from_entries(F.collect_list(F.struct("role", "at"))).alias("m"), F.sum(F.size("at")).cast("long").alias("n"))
    return index.select("conv_id", "n", c.inverted_index_text("m").alias("words"))


@query("""SELECT page_id, regexp_replace(url, '^https?://', '') AS bare FROM pages""")
def bare_doi(spark, sf):
    address = F.concat(F.lit("https://doi.org/"), F.regexp_replace("url", "^https?://", ""))
    return t(spark, sf, "pages").select("page_id", c.bare_doi(address).alias("bare"))
