"""Reading and writing tables: strict CSV, mixed bytes, imports against a registry, runs, exports."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.cells import INVISIBLE, header_unit, is_junk_number, normal_header, parse_number, parse_text
from ..operators.categories import snap_category
from ..shared import SPARE, settings


def read_strict_csv(spark: SparkSession, path: str, columns: Sequence[str]) -> DataFrame:
    """All cells as text, empty lines skipped, the first malformed row is an error. The columns are
    declared, and a header that differs from them is an error too."""
    schema = ", ".join(f"`{c}` string" for c in columns)
    return spark.read.csv(path, schema=schema, header=True, multiLine=True, mode="FAILFAST", enforceSchema=False, escape='"', nullValue="\0")


def repair_bytes(df: DataFrame, column: str) -> DataFrame:
    """Bytes as text: valid UTF-8 as it is; where bytes are not, each of them is read as Windows-1252,
    its undefined slots as the character of the same number. Only rows with bad bytes leave the JVM."""
    good = F.try_validate_utf8(F.col(column).cast("string"))

    @F.pandas_udf("string")
    def mend(raw: pd.Series) -> pd.Series:
        def one(data):
            if data is None:
                return None
            out, data = [], bytes(data)
            while data:
                try:
                    out.append(data.decode())
                    break
                except UnicodeDecodeError as e:
                    out.append(data[: e.start].decode())
                    byte = data[e.start : e.start + 1]
                    try:
                        out.append(byte.decode("cp1252"))
                    except UnicodeDecodeError:
                        out.append(chr(byte[0]))
                    data = data[e.start + 1 :]
            return "".join(out)

        return raw.map(one)

    marked = df.withColumn("__good", good)
    clean = marked.filter(F.col("__good").isNotNull() | F.col(column).isNull()).withColumn(column, F.col("__good"))
    bad = marked.filter(F.col("__good").isNull() & F.col(column).isNotNull()).withColumn(column, mend(F.col(column)))
    return clean.unionByName(bad).drop("__good")


def match_headers(headers: DataFrame, registry: DataFrame) -> DataFrame:
    """(header, position) with the id of the registry (id, label) it names: by normalised label, else by
    id; the first of two headers for one column wins, the others are ignored (id null)."""
    keyed = headers.withColumn("__k", normal_header("header"))
    names = registry.select(normal_header("label").alias("__k"), "id", F.lit(0).alias("__way")).union(registry.select(normal_header("id"), "id", F.lit(1)))
    best = keyed.join(names, "__k", "left").groupBy("header", "position").agg(F.min_by("id", F.struct("__way", "id")).alias("id"))
    firsts = best.filter("id is not null").groupBy("id").agg(F.min("position").alias("__first"))
    joined = best.join(firsts, "id", "left")
    return joined.select("header", "position", F.when(F.col("position") == F.col("__first"), F.col("id")).alias("id"))


def build_registry(headers: DataFrame, kinds: DataFrame, glossary: DataFrame, own: DataFrame, units: DataFrame | None = None, pages: DataFrame | None = None) -> DataFrame:
    """The registry of (id, label) headers: unit (of `units` (id, unit), else the header's own), kind
    (numeric unless kinds say otherwise), and the description, a verified glossary's before one's own.
    With `pages` (id, page), also the sorted set of pages that show the column."""
    g = glossary.select("id", F.col("description").alias("__g"))
    o = own.select("id", F.col("description").alias("__o"))
    out = headers.join(kinds, "id", "left").join(g, "id", "left").join(o, "id", "left")
    unit, more = header_unit("label"), []
    if units is not None:
        out, unit = out.join(units.select("id", F.col("unit").alias("__u")), "id", "left"), F.coalesce("__u", unit)
    if pages is not None:
        out = out.join(pages.groupBy("id").agg(F.sort_array(F.collect_set("page")).alias("__p")), "id", "left")
        more = [F.coalesce("__p", F.array().cast("array<string>")).alias("pages")]
    return out.select("id", "label", unit.alias("unit"), F.coalesce("kind", F.lit("numeric")).alias("kind"), F.coalesce("__g", "__o").alias("description"), *more)


def ignored_headers(headers: DataFrame, registry: DataFrame) -> DataFrame:
    """The headers (header, position) that name no column, or one that an earlier header has."""
    return match_headers(headers, registry).filter("id is null").select("header", "position")


def import_table(df: DataFrame, matched: dict[str, tuple[str, str]], row_limit: int | None = None, categories: dict[str, DataFrame] | None = None) -> tuple[DataFrame, DataFrame]:
    """User rows typed by the registry: matched maps id to (header, kind). Junk numbers become null and
    are counted; the report has rows, junk cells and an error (no-matching-columns, no-rows,
    too-many-rows, or null). Values of a column with frozen categories (value, rank) take their spelling."""
    if not matched:
        report = df.agg(F.count(F.lit(1)).alias("n"), F.lit(0).cast("long").alias("junk"), F.lit("no-matching-columns").alias("error"))
        return df.limit(0).select(), report
    cells = [(parse_number(F.col(f"`{h}`")) if kind == "numeric" else parse_text(F.col(f"`{h}`"))).alias(i) for i, (h, kind) in matched.items()]
    junk = sum((F.count_if(is_junk_number(F.col(f"`{h}`"))) for h, kind in matched.values() if kind == "numeric"), F.lit(0))
    n = F.count(F.lit(1))
    error = F.when(n == 0, "no-rows").when(n > F.lit(row_limit if row_limit is not None else (1 << 62)), "too-many-rows")
    rows = df.select(*cells)
    for column, dimension in (categories or {}).items():
        rows = snap_category(rows, dimension, column) if column in matched else rows
    return rows.select(*matched), df.agg(n.alias("n"), junk.cast("long").alias("junk"), error.alias("error"))


def read_runs(spark: SparkSession, folder: str, papers: DataFrame, schema: str, files: str = "*/extraction.json") -> DataFrame:
    """Extraction files `files` of a folder joined to the list of papers: one row per formulation,
    and a row with status no_extraction for a paper without a file."""
    found = spark.read.schema(f"paper_id string, formulations array<struct<{schema}>>").json(f"{folder}/{files}", multiLine=True)
    rows = found.select("paper_id", F.lit(True).alias("__found"), F.posexplode_outer("formulations").alias("position", "formulation"))
    return papers.join(rows, "paper_id", "left").withColumn("status", F.when(F.col("__found"), "ok").otherwise("no_extraction")).drop("__found")


def replay_calls(calls: DataFrame, schema: str) -> DataFrame:
    """Saved calls (paper, stage, ok, raw_text, seq) as their values again, those that failed or are
    empty left out: (paper, stage, seq, position, value...)."""
    good = calls.filter(F.col("ok") & (F.coalesce(F.trim("raw_text"), F.lit("")) != ""))
    parsed = good.withColumn("__r", F.from_json("raw_text", f"values array<struct<{schema}>>"))
    return parsed.select("paper", "stage", "seq", F.posexplode("__r.values").alias("position", "__v")).select("paper", "stage", "seq", "position", "__v.*")


def require_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The columns in order, or an error that names those missing."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df.select(*columns)


def require_unique(df: DataFrame, name: str, of: str) -> DataFrame:
    """`df`, or an error that tells which value of `name` stands for several values of `of`, as two headers
    that give one identifier. Null is a value like any other."""
    several = df.groupBy(F.col(name).alias("__n")).agg((F.count_distinct(F.coalesce(F.to_json(F.struct(of)), F.lit("")))).alias("__k")).filter("__k > 1")
    joined = df.join(several, F.col(name).eqNullSafe(F.col("__n")), "left")
    wrong = F.raise_error(F.concat(F.lit("not unique: "), F.coalesce(F.col(name).cast("string"), F.lit("null")))).cast("boolean")
    return joined.filter(F.when(F.col("__k").isNull(), True).otherwise(wrong)).drop("__n", "__k")


def csv_line(columns: Sequence[str]):
    """A row as one CSV line: cells quoted only where they hold a comma, quote or line end, null empty."""
    cells = []
    for c in columns:
        cell = F.coalesce(F.col(c).cast("string"), F.lit(""))
        cells.append(F.when(cell.rlike('[,"\r\n]'), F.concat(F.lit('"'), F.replace(cell, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(cell))
    return F.concat_ws(",", *cells)


def write_csv(df: DataFrame, path: str, headings: dict[str, str], clean: bool = False, mark: bool = False) -> None:
    """Text files of RFC 4180 lines that end in CR LF, each file under a line of display names; `clean`
    takes invisible characters out, `mark` begins each file with a byte order mark, as spreadsheets want
    it."""
    names = [c for c in headings if c in df.columns]
    kinds = dict(df.dtypes)
    out = df.select(*[(F.translate(F.col(c), INVISIBLE, "") if clean and kinds[c] == "string" else F.col(c)).alias(c) for c in names])
    titles = ['"' + t.replace('"', '""') + '"' if any(x in t for x in ',"\r\n') else t for t in (headings[c] for c in names)]

    def headed(batches):
        yield pa.RecordBatch.from_pydict({"line": ["\ufeff" * mark + ",".join(titles)]})
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0)], ["line"])

    out.select(csv_line(names).alias("line")).mapInArrow(headed, "line string").write.option("lineSep", "\r\n").text(path)


def write_scores(cells: DataFrame, papers: DataFrame, totals: DataFrame, path: str) -> None:
    """A run's result tables: cells by group, papers, totals."""
    with settings(cells.sparkSession, SPARE):
        cells.write.option("compression", "zstd").partitionBy("group").parquet(f"{path}/cells")
        papers.write.option("compression", "zstd").parquet(f"{path}/papers")
        totals.write.json(f"{path}/totals")
