"""Long to wide assembly, grids, nested records."""

from pyspark.sql import functions as F

from ..operators import assemble as a
from .explore import t

QUERIES = {}


def query(sql=None):
    def add(f):
        QUERIES[f.__name__] = (f, sql)
        return f

    return add


@query("""SELECT user_id, event_type, event_id, duplicates FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS n, CAST(count(*) OVER (PARTITION BY user_id, event_type) - 1 AS BIGINT) AS duplicates FROM events) WHERE n = 1""")
def dedupe_first(spark, sf):
    return a.dedupe_first(t(spark, sf, "events"), ["user_id", "event_type"], ["event_id"]).select("user_id", "event_type", "event_id", F.col("duplicates").cast("long").alias("duplicates"))


@query("SELECT event_id, user_id, 'F' || row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS entity FROM events")
def number_entities(spark, sf):
    return a.number_entities(t(spark, sf, "events"), "user_id", ["event_id"]).select("event_id", "user_id", "entity")


FIELDS = {"click": ("number", 20), "view": ("text", 3), "purchase": ("number", 20)}


def _values(spark, sf):
    k = F.col("event_id")
    value = F.when(k % 7 == 0, "N/A.").when(k % 7 == 1, "abc").otherwise(F.format_string("%d", (k % 1000).cast("int")))
    return t(spark, sf, "events").select((F.col("user_id") % 20).alias("paper"), F.when(k % 50 == 0, "ALL").otherwise(F.concat(F.lit("F"), (F.col("user_id") % 5).cast("string"))).alias("entity"), F.col("event_type").alias("field"), value.alias("value"), k.alias("seq"))


def _entities(spark, sf):
    return _values(spark, sf).filter("entity <> 'ALL'").select("paper", "entity").distinct()


VALUES = """v AS (SELECT user_id % 20 AS paper, CASE WHEN event_id % 50 = 0 THEN 'ALL' ELSE 'F' || (user_id % 5) END AS entity, event_type AS field, CASE event_id % 7 WHEN 0 THEN 'N/A.' WHEN 1 THEN 'abc' ELSE CAST(event_id % 1000 AS VARCHAR) END AS value, event_id AS seq FROM events),
e AS (SELECT DISTINCT paper, entity FROM v WHERE entity <> 'ALL'),
x AS (SELECT paper, entity, field, value, seq FROM v WHERE entity <> 'ALL' UNION ALL SELECT v.paper, e.entity, field, value, seq FROM v JOIN e ON v.paper = e.paper WHERE v.entity = 'ALL'),
k AS (SELECT *, CASE WHEN value = 'N/A.' THEN 'placeholder' WHEN field NOT IN ('click', 'view', 'purchase') THEN 'unknown_field' WHEN field <> 'view' AND value = 'abc' THEN 'wrong_type' ELSE 'ok' END AS status FROM x)"""


@query(f"WITH {VALUES} SELECT status, CAST(count(*) AS BIGINT) AS n FROM k GROUP BY status")
def value_status(spark, sf):
    return a.accepted_values(_entities(spark, sf), _values(spark, sf), "paper", FIELDS).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {VALUES}, f AS (SELECT paper, entity, field, arg_min(value, seq) AS v, count(*) - 1 AS more FROM k WHERE status = 'ok' GROUP BY 1, 2, 3),
w AS (SELECT paper, entity, max(CASE WHEN field = 'click' THEN v::DOUBLE END) AS click, max(CASE WHEN field = 'view' THEN left(v, 3) END) AS view, max(CASE WHEN field = 'purchase' THEN v::DOUBLE END) AS purchase, CAST(sum(more) AS BIGINT) AS duplicates FROM f GROUP BY 1, 2)
SELECT e.paper, e.entity, click, view, purchase, coalesce(duplicates, 0) AS duplicates FROM e LEFT JOIN w ON e.paper = w.paper AND e.entity = w.entity""")
def assemble_wide(spark, sf):
    return a.assemble_wide(_entities(spark, sf), _values(spark, sf), "paper", FIELDS)


@query("""WITH p AS (SELECT user_id, CAST(round_even(event_id % 60 + 0.5, 0) AS INTEGER) AS tat, value::DOUBLE / 100 AS v, event_id AS seq FROM events),
m AS (SELECT *, CASE WHEN NOT (v BETWEEN 1e-13 AND 1.0) THEN 'implausible' WHEN tat NOT IN (0, 20, 30, 40) THEN 'off_grid' ELSE 'ok' END AS status FROM p),
f AS (SELECT user_id, tat, status, arg_min(v, seq) AS v, count(*) AS n FROM m GROUP BY 1, 2, 3)
SELECT user_id, round(max(CASE WHEN status = 'ok' AND tat = 0 THEN v END), 6) AS at_0, round(max(CASE WHEN status = 'ok' AND tat = 20 THEN v END), 6) AS at_20, round(max(CASE WHEN status = 'ok' AND tat = 30 THEN v END), 6) AS at_30, round(max(CASE WHEN status = 'ok' AND tat = 40 THEN v END), 6) AS at_40,
CAST(coalesce(sum(CASE WHEN status = 'implausible' THEN n END), 0) AS BIGINT) AS implausible, CAST(coalesce(sum(CASE WHEN status = 'off_grid' THEN n END), 0) AS BIGINT) AS off_grid, CAST(coalesce(sum(CASE WHEN status = 'ok' THEN n - 1 END), 0) AS BIGINT) AS duplicates FROM f GROUP BY user_id""")
def points_to_grid(spark, sf):
    k = F.col("event_id")
    points = t(spark, sf, "events").select("user_id", (k % 60 + 0.5).cast("double").alias("temperature"), (F.col("value") / 100).alias("value"), k.alias("seq"))
    out = a.points_to_grid(points, ["user_id"], [0, 20, 30, 40])
    return out.withColumns({f"at_{g}": F.round(f"at_{g}", 6) for g in (0, 20, 30, 40)})


def _records(spark, sf):
    turns = t(spark, sf, "conversations").withColumn("p", F.map_from_arrays(F.array(F.lit("role"), F.lit("size")), F.array(F.col("role"), F.when(F.col("turn") % 3 != 0, F.length("text").cast("string")))))
    samples = turns.groupBy("conv_id", "role").agg(F.array_sort(F.collect_list(F.struct("turn", F.map_entries("p").alias("e")))).alias("l"))
    samples = samples.select("conv_id", F.struct(F.col("role").alias("sample"), F.transform("l", lambda x: F.map_from_entries(x["e"])).alias("points")).alias("s"))
    entries = samples.select("conv_id", F.col("s.sample").alias("sample"), F.transform("s.points", F.map_entries).alias("e"))
    nested = entries.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("sample", "e"))).alias("l"))
    return nested.select(F.md5(F.col("conv_id").cast("string").cast("binary")).alias("record_id"), F.concat(F.lit("conv"), F.col("conv_id").cast("string")).alias("file"), F.transform("l", lambda s: F.struct(s["sample"].alias("sample"), F.transform(s["e"], F.map_from_entries).alias("points"))).alias("samples"))


@query("""SELECT md5(CAST(conv_id AS VARCHAR)) AS record_id, CAST(count(*) + count(*) FILTER (WHERE turn % 3 <> 0 AND text IS NOT NULL) AS BIGINT) AS n_values FROM conversations WHERE role IS NOT NULL GROUP BY conv_id""")
def shred_record(spark, sf):
    return a.shred(_records(spark, sf))["point_values"].groupBy("record_id").agg(F.count(F.lit(1)).alias("n_values"))


@query("""SELECT md5(CAST(conv_id AS VARCHAR)) AS record_id, 'conv' || conv_id AS file, CAST(count(DISTINCT role) AS BIGINT) AS samples, CAST(count(*) AS BIGINT) AS points, true AS same FROM conversations GROUP BY conv_id""")
def assemble_record(spark, sf):
    records = _records(spark, sf)
    tables = a.shred(records)
    features = tables["records"].select("record_id", F.explode(F.array(F.lit("role"), F.lit("size"))).alias("feature"))
    plain = lambda df: F.to_json("samples")
    back = a.unshred(tables, features).withColumn("json", plain(None)).select("record_id", "file", "samples", "json")
    both = back.join(records.select("record_id", plain(None).alias("before")), "record_id")
    count = F.aggregate(F.transform("samples", lambda s: F.size(s["points"])), F.lit(0), lambda x, y: x + y)
    return both.select("record_id", "file", F.size("samples").cast("long").alias("samples"), count.cast("long").alias("points"), (F.col("json") == F.col("before")).alias("same"))


@query("SELECT DISTINCT md5(CAST(conv_id AS VARCHAR)) AS record_id FROM conversations WHERE conv_id % 3 <> 0 AND conv_id % 5 <> 0")
def import_new(spark, sf):
    k = F.col("conv_id")
    ids = t(spark, sf, "conversations").select(k, F.md5(k.cast("string").cast("binary")).alias("h"))
    incoming = ids.select(F.when(k % 5 == 0, F.concat(F.lit("x"), "h")).otherwise(F.col("h")).alias("record_id"))
    return a.import_new(ids.filter("conv_id % 3 = 0").select(F.col("h").alias("record_id")), incoming)


@query("""SELECT event_id AS id, CASE event_id % 4 WHEN 0 THEN NULL WHEN 1 THEN true ELSE true END AS has_points, event_id % 4 = 1 AS has_sources, CASE WHEN event_id % 4 = 1 AND event_id % 3 <> 0 THEN CAST(event_id % 3 AS INTEGER) END AS page FROM events WHERE event_id % 4 <> 0""")
def validate_records(spark, sf):
    k = F.col("event_id")
    source = F.concat(F.lit('{"kind":"table","label":"T","page":"'), (k % 3).cast("string"), F.lit('","quote":null}'))
    payload = F.when(k % 4 == 0, F.lit("[1, 2]")).when(k % 4 == 1, F.concat(F.lit('{"points":[{"x":"1"}],"sources":['), source, F.lit("]}"))).when(k % 4 == 2, F.concat(F.lit('{"points":[{"x":"1"},{"x":"2"}],"sources":['), source, F.lit("]}"))).otherwise(F.lit('{"points":[]}'))
    schema = "points array<map<string,string>>, sources array<struct<kind:string,label:string,page:string,quote:string>>"
    ok, _ = a.validate_records(t(spark, sf, "events").select(k.alias("id"), payload.alias("payload")), schema)
    return ok.select("id", F.lit(True).alias("has_points"), F.col("sources").isNotNull().alias("has_sources"), F.get("sources", F.lit(0))["page"].alias("page"))
