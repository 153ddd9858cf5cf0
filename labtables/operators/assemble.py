"""Extracted values from long to wide: entities, placeholders, coercion, grids, nested records."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.cells import is_placeholder


def dedupe_first(df: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The first row of each key, with the number of rows dropped for it."""
    rows = Window.partitionBy(*key)
    return df.withColumn("__n", F.row_number().over(rows.orderBy(*order))).withColumn("duplicates", F.count(F.lit(1)).over(rows) - 1).filter("__n = 1").drop("__n")


def number_entities(df: DataFrame, paper: str, order: Sequence[str], prefix: str = "F", out: str = "entity") -> DataFrame:
    """Gap-free ids F1..Fn within each paper, in order."""
    return df.withColumn(out, F.concat(F.lit(prefix), F.row_number().over(Window.partitionBy(paper).orderBy(*order)).cast("string")))


def accepted_values(entities: DataFrame, values: DataFrame, paper: str, fields: Mapping[str, tuple[str, int]], real_words: Mapping[str, tuple[str, ...]] | None = None) -> DataFrame:
    """Values (paper, entity, field, value, seq) with a status: placeholder, unknown_field, wrong_type
    or ok. The entity ALL stands for every entity of its paper; texts are cut to their field's limit."""
    specs = F.create_map(*[F.lit(x) for f, (kind, _) in fields.items() for x in (f, kind)])
    limits = F.create_map(*[F.lit(x) for f, (_, limit) in fields.items() for x in (f, limit)])
    kind = F.try_element_at(specs, F.col("field"))
    number = F.when(F.col("value").rlike(r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"), F.trim("value").try_cast("double"))
    clean = F.when(kind == "number", number.cast("string")).otherwise(F.substring(F.col("value"), F.lit(1), F.try_element_at(limits, F.col("field"))))
    status = F.when(is_placeholder("value", "field", dict(real_words or {})), "placeholder").when(kind.isNull(), "unknown_field").when(clean.isNull(), "wrong_type").otherwise("ok")
    one = values.filter("entity <> 'ALL'")
    every = values.filter("entity = 'ALL'").drop("entity").join(entities.select(paper, "entity"), paper)
    return one.unionByName(every).withColumn("status", status).withColumn("clean", clean)


def assemble_wide(entities: DataFrame, values: DataFrame, paper: str, fields: Mapping[str, tuple[str, int]], real_words: Mapping[str, tuple[str, ...]] | None = None) -> DataFrame:
    """One row per entity with a column per field; the first accepted value of a field stays, later
    ones count in duplicates. Entities without values are kept."""
    ok = accepted_values(entities, values, paper, fields, real_words).filter("status = 'ok'")
    first = ok.groupBy(paper, "entity", "field").agg(F.min_by("clean", "seq").alias("v"), (F.count(F.lit(1)) - 1).alias("more"))
    kinds = [F.max(F.when(F.col("field") == f, F.col("v"))).try_cast("double" if kind == "number" else "string").alias(f) for f, (kind, _) in fields.items()]
    wide = first.groupBy(paper, "entity").agg(*kinds, F.sum("more").alias("duplicates"))
    return entities.select(paper, "entity").join(wide, [paper, "entity"], "left").na.fill(0, ["duplicates"])


def points_to_grid(points: DataFrame, keys: Sequence[str], grid: Sequence[int], seq: str = "seq", low: float = 1e-13, high: float = 1.0) -> DataFrame:
    """Points (keys, temperature, value, seq) on the columns of a temperature grid: rounded half to
    even, the first one stays. Each row counts implausible, off-grid and duplicate points."""
    at = F.bround("temperature", 0).cast("int")
    plausible = F.coalesce(F.col("value").between(low, high), F.lit(False))
    status = F.when(~plausible, "implausible").when(~at.isin(*grid), "off_grid").otherwise("ok")
    marked = points.withColumn("at", at).withColumn("status", status)
    first = marked.groupBy(*keys, "at", "status").agg(F.min_by("value", seq).alias("value"), F.count(F.lit(1)).alias("n"))
    ok = F.col("status") == "ok"
    columns = [F.max(F.when(ok & (F.col("at") == t), F.col("value"))).alias(f"at_{t}") for t in grid]
    count = lambda test, n: F.coalesce(F.sum(F.when(test, n)), F.lit(0)).cast("long")
    return first.groupBy(*keys).agg(*columns, count(F.col("status") == "implausible", F.col("n")).alias("implausible"), count(F.col("status") == "off_grid", F.col("n")).alias("off_grid"), count(ok, F.col("n") - 1).alias("duplicates"))


def shred(records: DataFrame, record: str = "record_id") -> dict[str, DataFrame]:
    """Nested records (record_id, file, samples: array<struct<sample, points: array<map<string,string>>>>)
    as tables: records, samples, points, point_values. Positions are kept; null values have no row."""
    samples = records.select(record, F.posexplode("samples").alias("sample_pos", "s"))
    points = samples.select(record, "sample_pos", F.posexplode("s.points").alias("point_pos", "p"))
    values = points.select(record, "sample_pos", "point_pos", F.explode("p").alias("feature", "value")).filter("value is not null")
    return {
        "records": records.select(record, "file").dropDuplicates([record]), "samples": samples.select(record, "sample_pos", F.col("s.sample").alias("sample")),
        "points": points.select(record, "sample_pos", "point_pos"), "point_values": values,
    }


def unshred(tables: Mapping[str, DataFrame], features: DataFrame, record: str = "record_id") -> DataFrame:
    """The nested records again: sample and point order kept, samples without points too, and every
    asked feature (record_id, feature) present, null where it has no value."""
    asked = tables["points"].join(features, record).join(tables["point_values"], [record, "sample_pos", "point_pos", "feature"], "left")
    entries = F.map_from_entries(F.array_sort(F.collect_list(F.struct("feature", "value"))))
    points = asked.groupBy(record, "sample_pos", "point_pos").agg(entries.alias("p"))
    lists = points.groupBy(record, "sample_pos").agg(F.transform(F.array_sort(F.collect_list(F.struct("point_pos", F.map_entries("p").alias("e")))), lambda x: F.map_from_entries(x["e"])).alias("points"))
    none = F.array().cast("array<map<string,string>>")
    samples = tables["samples"].join(lists, [record, "sample_pos"], "left").withColumn("points", F.coalesce("points", none))
    entry = F.struct("sample_pos", "sample", F.transform("points", F.map_entries).alias("points"))
    nested = samples.groupBy(record).agg(F.array_sort(F.collect_list(entry)).alias("l"))
    nested = nested.select(record, F.transform("l", lambda s: F.struct(s["sample"].alias("sample"), F.transform(s["points"], F.map_from_entries).alias("points"))).alias("samples"))
    empty = F.array().cast("array<struct<sample:string,points:array<map<string,string>>>>")
    return tables["records"].join(nested, record, "left").withColumn("samples", F.coalesce("samples", empty))


def import_new(existing: DataFrame, incoming: DataFrame, record: str = "record_id") -> DataFrame:
    """Incoming records with an id of 32 hexadecimal digits that aren't stored yet, each once.
    import_report counts the others."""
    return incoming.filter(F.col(record).rlike("^[0-9a-f]{32}$")).dropDuplicates([record]).join(existing.select(record), record, "left_anti")


def import_report(existing: DataFrame, incoming: DataFrame, record: str = "record_id", corrupt: str = "_corrupt_record") -> DataFrame:
    """One row: records seen, unreadable ones (the corrupt column of a permissive read is filled), badly
    named ones, stored ones, repeats, and new ones."""
    bad = F.col(corrupt).isNotNull() if corrupt in incoming.columns else F.lit(False)
    rows = incoming.select(F.col(record).alias("__r"), bad.alias("__bad")).groupBy("__r", "__bad").agg(F.count(F.lit(1)).alias("n"))
    held = existing.select(F.col(record).alias("__r")).distinct().withColumn("__held", F.lit(True))
    kind = F.when(F.col("__bad"), "unreadable").when(~F.coalesce(F.col("__r").rlike("^[0-9a-f]{32}$"), F.lit(False)), "badly_named").when(F.col("__held"), "stored").otherwise("new")
    counted = rows.join(held, "__r", "left").withColumn("kind", kind)
    total = lambda k: F.coalesce(F.sum(F.when(F.col("kind") == k, F.col("n"))), F.lit(0)).cast("long")
    fresh = F.count_if(F.col("kind") == "new")
    return counted.agg(F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("seen"), *[total(k).alias(k) for k in ("unreadable", "badly_named", "stored")], (total("new") - fresh).alias("repeated"), fresh.alias("new"))


def validate_records(payloads: DataFrame, schema: str, id_col: str = "id", payload: str = "payload") -> tuple[DataFrame, DataFrame]:
    """JSON payloads {points: [...], sources: [...]} as records and rejected ones. A payload of another
    shape is rejected; sources are dropped whole unless there is one per point, a malformed source
    becomes null, and a page must be an integer of 1 or more."""
    parsed = payloads.withColumn("r", F.from_json(payload, f"{schema}, _corrupt string", {"columnNameOfCorruptRecord": "_corrupt", "mode": "PERMISSIVE"}))
    bad = F.col("r").isNull() | F.col("r._corrupt").isNotNull() | F.col("r.points").isNull()
    page = lambda s: F.when(s["page"].rlike("^[1-9][0-9]*$"), s["page"].try_cast("int"))
    one = lambda s: F.when(s["kind"].isin("table", "figure", "text"), F.struct(s["kind"].alias("kind"), s["label"].alias("label"), page(s).alias("page"), s["quote"].alias("quote")))
    sources = F.when(F.size("r.sources") == F.size("r.points"), F.transform("r.sources", one))
    return parsed.filter(~bad).select(id_col, F.col("r.points").alias("points"), sources.alias("sources")), parsed.filter(bad).select(id_col, payload)
