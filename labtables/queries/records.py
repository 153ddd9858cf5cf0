"""Imports, registries, records and the composite pipelines on the given tables."""

from pyspark.sql import functions as F

from ..functions import cells as c
from ..operators import corpus, explore, graph, linkage, scoring
from ..operators import stats as st
from ..plans import pipelines
from ..operators.categories import rank_categories
from ..sources import tables as src
from . import linking
from .explore import r6, raw_part, t

QUERIES = {}


def query(sql=None):
    def add(f):
        QUERIES[f.__name__] = (f, sql)
        return f

    return add


@query("""SELECT CAST(count(*) AS BIGINT) AS n, CAST(count(*) FILTER (WHERE p_partkey % 7 = 2) AS BIGINT) AS junk, CASE WHEN count(*) > 100 THEN 'too-many-rows' END AS error FROM part""")
def import_report(spark, sf):
    df = t(spark, sf, "part").select(raw_part().alias("Size (mm)"), F.col("p_name").alias("Name"))
    return src.import_table(df, {"size": ("Size (mm)", "numeric"), "name": ("Name", "text")}, 100)[1]


@query("""SELECT CASE WHEN p_partkey % 7 = 3 THEN p_size * 10.0::DOUBLE WHEN p_partkey % 7 > 3 THEN p_size::DOUBLE END AS size, CAST(count(*) AS BIGINT) AS n FROM part GROUP BY 1""")
def import_table(spark, sf):
    df = t(spark, sf, "part").select(raw_part().alias("Size (mm)"))
    return src.import_table(df, {"size": ("Size (mm)", "numeric")})[0].groupBy("size").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT c_custkey AS position, CASE WHEN c_custkey % 2 = 0 THEN 'id' || c_nationkey ELSE 'id' || n_nationkey END AS wanted, CASE WHEN row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) = 1 THEN 'id' || c_nationkey END AS id FROM customer JOIN nation ON c_nationkey = n_nationkey""")
def match_headers(spark, sf):
    nations = t(spark, sf, "nation")
    registry = nations.select(F.concat(F.lit("id"), F.col("n_nationkey").cast("string")).alias("id"), F.initcap("n_name").alias("label"))
    own = t(spark, sf, "customer").join(nations, F.col("c_nationkey") == F.col("n_nationkey"))
    wanted = F.concat(F.lit("id"), F.col("n_nationkey").cast("string"))
    headers = own.select(F.concat(F.lit(" "), F.when(F.col("c_custkey") % 2 == 0, F.upper("n_name")).otherwise(F.concat(F.lit("ID"), F.col("n_nationkey").cast("string"))), F.lit("  ​")).alias("header"), F.col("c_custkey").alias("position"), wanted.alias("wanted"))
    return headers.select("position", "wanted").join(src.match_headers(headers.select("header", "position"), registry).select("position", "id"), "position")


@query("""SELECT p_partkey AS id, 'Size ' || p_partkey || CASE WHEN p_partkey % 2 = 0 THEN ' (mm)' ELSE '' END AS label, CASE WHEN p_partkey % 2 = 0 THEN 'mm' END AS unit, CASE WHEN p_partkey % 5 = 0 THEN 'text' ELSE 'numeric' END AS kind,
CASE WHEN p_partkey % 3 = 0 THEN p_brand WHEN p_partkey % 3 = 1 THEN p_type END AS description FROM part""")
def build_registry(spark, sf):
    part, k = t(spark, sf, "part"), F.col("p_partkey")
    headers = part.select(k.alias("id"), F.concat(F.lit("Size "), k.cast("string"), F.when(k % 2 == 0, " (mm)").otherwise("")).alias("label"))
    return src.build_registry(headers, part.filter(k % 5 == 0).select(k.alias("id"), F.lit("text").alias("kind")), part.filter(k % 3 == 0).select(k.alias("id"), F.col("p_brand").alias("description")), part.filter(k % 3 != 2).select(k.alias("id"), F.col("p_type").alias("description")))


@query("""SELECT 'c' || p_partkey AS id, CASE WHEN p_partkey % 4 = 0 THEN 'K' WHEN p_partkey % 2 = 0 THEN 'mm' END AS unit, CASE p_partkey % 3 WHEN 0 THEN '' WHEN 1 THEN 'table' ELSE 'map,table' END AS pages FROM part""")
def registry_overrides(spark, sf):
    """Units that are given instead of a header's own, and the pages that show a column."""
    part, k = t(spark, sf, "part"), F.col("p_partkey")
    name = F.concat(F.lit("c"), k.cast("string")).alias("id")
    headers = part.select(name, F.concat(F.lit("Size"), F.when(k % 2 == 0, " (mm)").otherwise("")).alias("label"))
    none = part.limit(0).select(name, F.lit("x").alias("kind"), F.lit("y").alias("description"))
    pages = part.filter(k % 3 > 0).select(name, F.explode(F.when(k % 3 == 1, F.array(F.lit("table"), F.lit("table"))).otherwise(F.array(F.lit("table"), F.lit("map")))).alias("page"))
    out = src.build_registry(headers, none.select("id", "kind"), none.select("id", "description"), none.select("id", "description"), part.filter(k % 4 == 0).select(name, F.lit("K").alias("unit")), pages)
    return out.select("id", "unit", F.array_join("pages", ",").alias("pages"))


@query("""WITH n AS (SELECT p_brand, count(*) AS n FROM part GROUP BY 1) SELECT CASE p_partkey % 3 WHEN 2 THEN 'Own ' || p_partkey ELSE p_brand END AS brand, CAST(count(*) AS BIGINT) AS n FROM part GROUP BY 1""")
def import_snapped(spark, sf):
    """Imported values that differ from a frozen category by case alone take its spelling."""
    part, k = t(spark, sf, "part"), F.col("p_partkey") % 3
    own = F.when(k == 0, F.upper("p_brand")).when(k == 1, F.lower("p_brand")).otherwise(F.concat(F.lit("Own "), F.col("p_partkey").cast("string")))
    frozen = rank_categories(part, "p_brand", "p_partkey")
    rows, _ = src.import_table(part.select(own.alias("Brand")), {"brand": ("Brand", "text")}, categories={"brand": frozen})
    return rows.groupBy("brand").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT event_id, event_id % 2 = 0 AS kept, CASE WHEN event_id % 4 = 3 THEN 'é”' || event_type ELSE event_type END AS text FROM events")
def repair_bytes(spark, sf):
    k = F.col("event_id")
    raw = F.concat(F.when(k % 4 == 3, F.unhex(F.lit("E994"))).otherwise(F.unhex(F.lit(""))), F.encode("event_type", "UTF-8"))
    return src.repair_bytes(t(spark, sf, "events").select(k, (k % 2 == 0).alias("kept"), raw.alias("text")), "text")


@query("SELECT event_id AS seq, 'F1' AS id, CAST(user_id AS VARCHAR) AS value FROM events WHERE event_id % 5 NOT IN (0, 1)")
def replay_calls(spark, sf):
    k = F.col("event_id")
    reply = F.when(k % 5 == 1, " ").otherwise(F.concat(F.lit('{"values":[{"id":"F1","value":"'), F.col("user_id").cast("string"), F.lit('"}]}')))
    calls = t(spark, sf, "events").select(F.lit("p").alias("paper"), F.lit("values").alias("stage"), (k % 5 != 0).alias("ok"), reply.alias("raw_text"), k.alias("seq"))
    return src.replay_calls(calls, "id:string,value:string").select("seq", "id", "value")


@query("SELECT CAST(count(*) FILTER (WHERE value BETWEEN 10 AND 60) AS BIGINT) AS kept, CAST(count(*) FILTER (WHERE NOT (value BETWEEN 10 AND 60)) AS BIGINT) AS dropped FROM events")
def in_range(spark, sf):
    return explore.in_range(t(spark, sf, "events"), "value", 10, 60)[1]


@query("""SELECT conv_id, role, CAST(row_number() OVER (PARTITION BY conv_id, role ORDER BY turn, text) - 1 AS INTEGER) AS point_no, CAST(turn AS VARCHAR) AS turn, NULL::VARCHAR AS missing, role AS source_value FROM conversations""")
def flatten_points(spark, sf):
    turns = t(spark, sf, "conversations").withColumn("points", F.array(F.create_map(F.lit("turn"), F.col("turn").cast("string"), F.lit("source"), F.col("role"))))
    from pyspark.sql import Window

    numbered = turns.withColumn("seq", F.row_number().over(Window.partitionBy("conv_id", "role").orderBy("turn", "text")))
    return explore.flatten_points(numbered, "conv_id", "role", ["turn", "missing", "source"])


@query("""SELECT event_type, min(event_id) AS first, count(*) FILTER (WHERE event_id % 10 = 0 AND event_type = 'click') = 0 AS numeric, CAST(row_number() OVER (ORDER BY min(event_id)) AS BIGINT) AS position FROM events GROUP BY event_type""")
def infer_columns(spark, sf):
    value = F.when((F.col("event_id") % 10 == 0) & (F.col("event_type") == "click"), "words").otherwise(F.col("value").cast("string"))
    return explore.infer_columns(t(spark, sf, "events").withColumn("v", value), "event_type", "v", "event_id")


@query("""SELECT l_linestatus, CAST(count(CASE WHEN l_discount > 0 THEN 1 END) AS BIGINT) AS n_log, CAST(sum(CASE l_returnflag WHEN 'R' THEN 1 WHEN 'N' THEN 0 END) AS BIGINT) AS n_yes, round(sum(CASE WHEN l_discount > 0 THEN log10(l_discount) END), 4) AS logs FROM lineitem GROUP BY 1""")
def encode_features(spark, sf):
    flag = F.when(F.col("l_returnflag") == "R", " Yes").when(F.col("l_returnflag") == "N", "no")
    df = t(spark, sf, "lineitem").select("l_linestatus", "l_discount", flag.alias("flag"))
    coded = df.select("l_linestatus", *st.encode({"l_discount": "log10", "flag": "yes_no"}))
    return coded.groupBy("l_linestatus").agg(F.count("l_discount").alias("n_log"), F.sum("flag").cast("long").alias("n_yes"), F.round(F.sum("l_discount"), 4).alias("logs"))


@query("""SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'Table IV, page ' || (doc_id % 9) WHEN 1 THEN 'Figure, page ' || (doc_id % 9) ELSE 'Text, page ' || (doc_id % 9) || ': "as said"' END AS line FROM documents""")
def source_line(spark, sf):
    d = F.col("doc_id")
    kind = F.when(d % 3 == 0, "table").when(d % 3 == 1, "figure").otherwise("text")
    return t(spark, sf, "documents").select("doc_id", c.source_line(kind, F.when(d % 3 == 0, "Table IV"), d % 9, F.lit("as said")).alias("line"))


@query("""SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN p_size::DOUBLE WHEN 1 THEN p_size::DOUBLE WHEN 2 THEN p_size * 0.001::DOUBLE END AS number FROM part""")
def number_with_unit(spark, sf):
    size, k = F.col("p_size").cast("string"), F.col("p_partkey") % 4
    raw = F.when(k == 0, F.concat(size, F.lit(" °C"))).when(k == 1, F.concat(F.lit(" "), size)).when(k == 2, F.concat(size, F.lit("e-3"))).otherwise("none")
    return t(spark, sf, "part").select("p_partkey", r6(c.number_with_unit(raw)).alias("number"))


@query("SELECT c_custkey AS file, c_custkey % 3 = 0 AS has_doi, c_custkey % 2 = 0 AS has_pages FROM customer")
def evidence(spark, sf):
    k = F.col("c_custkey")
    mapping = t(spark, sf, "customer").select(k.alias("file"), F.concat(F.lit("Journal 5, "), (k + 100).cast("string"), F.lit("–"), (k + 110).cast("string")).alias("reference"), F.concat(F.lit("https://doi.org/10.1/Q"), k.cast("string"), F.lit("z")).alias("doi"))
    text = F.concat(F.lit("Some title "), F.when(k % 3 == 0, F.concat(F.lit("doi 10.1/q"), k.cast("string"), F.lit("Z "))).otherwise(""), F.when(k % 2 == 0, F.concat(F.lit("pp "), (k + 100).cast("string"), F.lit("-"), (k + 110).cast("string"), F.lit(" "))).otherwise(""))
    return linkage.evidence(mapping, t(spark, sf, "customer").select(k.alias("file"), text.alias("text")), "text")


@query("""SELECT event_id AS id, CASE event_id % 4 WHEN 0 THEN 'exact' WHEN 1 THEN 'wrong_time' WHEN 2 THEN 'wrong_x' ELSE 'not_in_table' END AS kind FROM events""")
def classify_points(spark, sf):
    k = F.col("event_id")
    e = t(spark, sf, "events").select((k * 0 + k).alias("grp"), k.alias("id"))
    key = e.select("grp", F.col("id").alias("key_id"), F.lit(10.0).alias("t"), F.lit(5.0).alias("x"))
    points = e.select("grp", "id", F.when(F.col("id") % 4 == 1, 20.0).when(F.col("id") % 4 == 3, 30.0).otherwise(10.0).alias("t"), F.when(F.col("id") % 4 == 2, 7.0).when(F.col("id") % 4 == 3, 9.0).otherwise(5.0).alias("x"))
    links = linkage.match_points(points, key, ["grp"])
    return linkage.classify_points(points, key, ["grp"], links).select("id", "kind")


@query("""SELECT 'W' || doc_id AS node, lang AS title, 'article' AS type, n_chars AS cited, CASE WHEN doc_id % 2 = 0 THEN source END AS source, CAST(doc_id % 3 AS BIGINT) AS n_authors, CAST(1 AS BIGINT) AS n_references FROM documents WHERE doc_id % 4 <> 0""")
def flatten_works(spark, sf):
    d = F.col("doc_id")
    author = F.struct(F.struct(F.col("lang").alias("display_name")).alias("author"))
    record = F.struct(
        F.concat(F.lit("W"), d.cast("string")).alias("id"), F.col("lang").alias("title"), F.when(d % 4 == 0, "dataset").otherwise("article").alias("type"), F.col("n_chars").alias("cited_by_count"),
        F.when(d % 2 == 0, F.struct(F.struct(F.col("source").alias("display_name")).alias("source"))).alias("primary_location"), F.array_repeat(author, (d % 3).cast("int")).alias("authorships"), F.array(F.lit("W1")).alias("referenced_works"),
    )
    flat = graph.of_types(graph.flatten_works(t(spark, sf, "documents").select(F.to_json(record).alias("j")), "j"))
    return flat.select("node", "title", "type", "cited", "source", F.size("authors").cast("long").alias("n_authors"), F.size("references").cast("long").alias("n_references"))


@query("SELECT CAST(count(*) FILTER (WHERE doc_id % 3 = 0) AS BIGINT) AS open FROM documents")
def open_only(spark, sf):
    return graph.open_only(t(spark, sf, "documents").select("doc_id", F.when(F.col("doc_id") % 3 == 0, "http://x").alias("open_url")))[1]


@query("""WITH f AS (SELECT user_id, event_id, event_id % 100 AS t, lag(event_id % 100) OVER (PARTITION BY user_id ORDER BY event_id) AS p, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS b FROM events)
SELECT user_id, event_id, CAST(CASE WHEN b = 1 AND t < p AND event_id % 2 = 0 THEN t * 60 ELSE t END AS BIGINT) AS t FROM f""")
def fix_last_unit(spark, sf):
    k = F.col("event_id")
    return corpus.fix_last_unit(t(spark, sf, "events").select("user_id", "event_id", (k % 100).alias("t"), (k % 2 == 1).alias("unit")), "user_id", "event_id", "t", "unit").select("user_id", "event_id", "t")


@query("""SELECT page_id, 'text' || CASE WHEN page_id % 2 = 0 THEN chr(10) || chr(10) || '## More figures' || chr(10) || chr(10) || '![cap](b/p' || page_id || ')' ELSE '' END AS text, CAST(CASE WHEN page_id % 2 = 0 THEN 2 ELSE 1 END AS BIGINT) AS n FROM pages""")
def compose_tiers(spark, sf):
    p = F.col("page_id")
    figure = lambda name, caption: [p, F.lit(1).alias("page"), F.lit(2).alias("block"), F.concat(F.lit(name), p.cast("string")).alias("path"), caption.alias("caption")]
    pages = t(spark, sf, "pages")
    docs = pages.select(p, F.lit("text").alias("text"))
    out = corpus.compose(docs, pages.select(*figure("q", F.lit("first"))), pages.filter(p % 2 == 0).select(*figure("p", F.lit("cap"))), "text", "page_id")
    return out.select("page_id", "text", F.size("figures").cast("long").alias("n"))


@query("""SELECT user_id, event_id, CASE WHEN event_id % 3 = 0 THEN value ELSE NULL END AS found_y FROM events""")
def resolve_point(spark, sf):
    e = t(spark, sf, "events")
    points = e.filter("event_id % 3 = 0").select(F.col("user_id").alias("row_id"), F.col("event_id").alias("x"), F.col("value").alias("y"))
    clicks = e.select(F.col("user_id").alias("row_id"), F.col("event_id").alias("x"), F.when(F.col("event_id") % 2 == 0, F.col("value")).otherwise(-1.0).alias("y"))
    return explore.resolve_point(points, clicks).select(F.col("row_id").alias("user_id"), F.col("x").alias("event_id"), "found_y")


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 1000 ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")
def offending_rows(spark, sf):
    df = t(spark, sf, "orders").withColumn("low", -F.col("o_totalprice"))
    return scoring.offending_rows(df, F.col("o_totalprice") > 1000, ["o_orderkey", "o_totalprice", "low"], ["low", "o_orderkey"]).drop("low")


# without a tie-break, and the cells of the rows that were linked
LINKS = linking.CANDIDATES.replace("least(abs(pr.d - gr.d) / 5.0::DOUBLE, 1.0::DOUBLE) AS tie", "0.0::DOUBLE AS tie")
LINKED = linking.CELLS.replace("FROM g LEFT JOIN p ON g.paper = p.paper AND g.id = p.id", "FROM g LEFT JOIN a ON g.paper = a.paper AND g.id = a.gold_id LEFT JOIN p ON a.paper = p.paper AND a.pred_id = p.id")


@query(f"WITH RECURSIVE {linking.GOLD}, {linking.RANKS}, {LINKS}, {linking.GREEDY}, {LINKED}, " + linking.TOTALS.format(keys="", from_='f LEFT JOIN s ON f."column" = s."column"'))
def score_run(spark, sf):
    """Links, cells and totals of a perturbed table against itself."""
    from .linking import classes, gold, groups, pred

    out = pipelines.score_run(pred(spark, sf), gold(spark, sf), ["paper"], "block", [("q", "q")], "id", "id", ["q", "d", "tax", "status", "price"], classes(spark), groups(spark))
    return out["totals"]


@query("""SELECT doc_id, 'F1' AS entity, CAST(length(text) AS DOUBLE) AS size, CAST(0 AS BIGINT) AS duplicates FROM documents WHERE length(regexp_replace(lower(text), '[^0-9a-z]', '', 'g')) >= 8""")
def assemble_extraction(spark, sf):
    """Each document's whole text as a listed entity's quote, and one that no document holds."""
    docs = t(spark, sf, "documents").select("doc_id", "text")
    begin = docs.select("doc_id", F.lit(1).alias("position"), F.col("text").alias("quote"))
    listed = begin.union(begin.withColumn("position", F.lit(2))).union(docs.select("doc_id", F.lit(0), F.lit("Zzzqj xvvkq wwzzx 9876501234"))).withColumn("key", F.col("quote"))
    values = docs.select("doc_id", F.lit("F1").alias("entity"), F.lit("size").alias("field"), F.char_length("text").cast("string").alias("value"), F.lit(1).alias("seq"))
    return pipelines.assemble_extraction(listed, values, docs, "doc_id", "text", {"size": ("number", 20)})
