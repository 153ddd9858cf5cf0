"""Citation graphs: neighbours, rounds of discovery, ranking, batches, budgets."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..shared import cut
from .explore import with_position


def neighbours(frontier: DataFrame, edges: DataFrame, limit: int = 400) -> DataFrame:
    """(from, node) of all that a frontier node cites and up to `limit` nodes that cite it, those of
    lowest id; a mutual link gives two rows. edges are (src, dst)."""
    cited = frontier.select(F.col("node").alias("src")).join(edges, "src").select(F.col("src").alias("from"), F.col("dst").alias("node"))
    citing = frontier.select(F.col("node").alias("dst")).join(edges, "dst").select(F.col("dst").alias("from"), F.col("src").alias("node"))
    order = Window.partitionBy("from").orderBy("node")
    return cited.union(citing.withColumn("__n", F.row_number().over(order)).filter(F.col("__n") <= limit).drop("__n"))


def new_candidates(candidates: DataFrame, seen: DataFrame, node: str = "node") -> DataFrame:
    return candidates.select(node).distinct().join(seen.select(node).distinct(), node, "left_anti")


def discover(seeds: DataFrame, edges: DataFrame, scores: DataFrame, max_rounds: int = 3, follow_at: int = 2, limit: int = 400, costs: DataFrame | None = None, budget: int | None = None) -> DataFrame:
    """Nodes reached from the seeds, with score, links (followed nodes linking there), round. Seeds are
    followed and not returned; each round's new nodes are followed if their score reaches follow_at,
    until nothing is new or max_rounds is over. With a budget, nodes are followed while the costs (node,
    cost; none is free) of all rounds fit it, the highest score first, then most links: one that is
    too dear is passed over. Rounds are level by level, their tables checkpointed in the shared folder."""
    found = cut(seeds.select("node").distinct().withColumn("round", F.lit(0)))
    frontier, links, left = found.select("node"), None, budget
    for n in range(1, max_rounds + 1):
        if left is not None:
            known = frontier.select("node").join(scores.select("node", "score"), "node", "left")
            known = known.join(links.groupBy("node").agg(F.count(F.lit(1)).alias("links")), "node", "left") if links is not None else known.withColumn("links", F.lit(0))
            priced = known.join(costs, "node", "left").select(F.lit(0).alias("search"), "node", F.coalesce("score", F.lit(0)).alias("score"), F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("cost", F.lit(0)).cast("long").alias("cost"))
            frontier = cut(take_within_budget(priced, "search", "cost", [F.col("score").desc(), F.col("links").desc(), F.col("node")], left))
            left -= frontier.agg(F.sum("cost")).first()[0] or 0
            frontier = frontier.select("node")
        step = cut(neighbours(frontier, edges, limit))
        links = step if links is None else links.union(step)
        fresh = cut(new_candidates(step, found).withColumn("round", F.lit(n)))
        if fresh.isEmpty():
            break
        found = found.union(fresh)
        frontier = fresh.join(scores, "node").filter(F.col("score") >= follow_at).select("node")
    counts = links.groupBy("node").agg(F.count(F.lit(1)).alias("links"))
    return found.filter("round > 0").join(counts, "node", "left").join(scores, "node", "left").select("node", F.coalesce("score", F.lit(0)).cast("long").alias("score"), F.coalesce("links", F.lit(0)).cast("long").alias("links"), F.col("round").cast("long").alias("round"))


def rank_results(nodes: DataFrame, search_rank: str = "search_rank", node: str = "node") -> list:
    """The order of results: score, then links, descending, then best search rank, missing last."""
    return [F.col("score").desc(), F.col("links").desc(), F.col(search_rank).asc_nulls_last(), F.col(node).asc()]


def batches(df: DataFrame, group: str, size: int = 80, order: list | None = None, out: str = "batch") -> DataFrame:
    """Batches of `size` within each search, by priority. Rows are numbered in the order of all rows, so
    that a search with most of them is no single task's window."""
    placed = with_position(df, [F.col(group).asc_nulls_first(), *(order or [])], "__place")
    firsts = placed.groupBy(F.col(group).alias("__group")).agg(F.min("__place").alias("__first"))
    joined = placed.join(firsts, F.col(group).eqNullSafe(F.col("__group")))
    return joined.withColumn(out, F.floor((F.col("__place") - F.col("__first")) / size).cast("long")).drop("__place", "__group", "__first")


def fetch_cost(references, cited):
    return (F.ceil(references / 100) + F.ceil(F.least(cited, F.lit(400)) / 200)).cast("long")


def take_within_budget(df: DataFrame, group: str, cost: str, order: list, budget: int) -> DataFrame:
    """Items in priority order that still fit the group's budget; one that doesn't is skipped and later
    ones may fit. Costs are whole numbers: free ones always fit, null ones never do, negative ones are an
    error. What is left never grows, so the items taken of one cost are the first of that cost, at most
    budget / cost of them: all others are dropped beforehand, by the parts of the input and then by
    (group, cost), and the pass in order sees some budget * ln(budget) items of a group, whatever its
    size. A null group is a group; an empty table gives an empty one; items of equal order may be taken in
    any order."""
    paid = F.when(F.col(cost) >= 0, F.col(cost)).otherwise(F.raise_error(F.lit("a cost is negative")).cast("long"))
    # as written the check would be dropped with the column
    checked = df.filter(F.col(cost).isNotNull()).withColumn("__paid", paid).filter("__paid >= 0")
    free = checked.filter("__paid = 0").drop("__paid") if budget >= 0 else df.limit(0)
    most = F.floor(F.lit(budget) / F.col("__paid"))
    left = checked.filter(F.col("__paid").between(1, budget)).withColumn("__part", F.spark_partition_id())
    for keys in ([group, "__paid", "__part"], [group, "__paid"]):
        left = left.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("__n") <= most).drop("__n")
    left = left.drop("__paid", "__part")

    def run(batches_: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest, last = budget, object()
        for batch in batches_:
            keep = []
            for g, c in zip(batch.column(group).to_pylist(), batch.column(cost).to_pylist()):
                if g != last:
                    rest, last = budget, g
                keep.append(c <= rest)
                rest -= c if keep[-1] else 0
            yield batch.filter(pa.array(keep, pa.bool_()))

    return left.repartition(group).sortWithinPartitions(group, *order).mapInArrow(run, df.schema).unionByName(free)


def search_stats(nodes: DataFrame) -> DataFrame:
    """Candidates, judged and likely ones, seeds (round 0) aside."""
    rest = F.col("round") > 0
    return nodes.agg(F.count_if(rest).alias("candidates"), F.count_if(rest & F.col("score").isNotNull()).alias("judged"), F.count_if(rest & (F.col("score") >= 2)).alias("likely"))


WORK = "id string, title string, type string, cited_by_count long, primary_location struct<source:struct<display_name:string>>, authorships array<struct<author:struct<display_name:string>>>, open_access struct<oa_url:string>, referenced_works array<string>"


def flatten_works(works: DataFrame, payload: str) -> DataFrame:
    """Nested JSON work records as flat rows: source and open-access address may be missing, authors and
    references are lists, empty where the record has none."""
    r = F.from_json(payload, WORK)
    names = F.filter(F.transform(r["authorships"], lambda a: a["author"]["display_name"]), lambda n: n.isNotNull())
    none = F.array().cast("array<string>")
    return works.select(
        r["id"].alias("node"), r["title"].alias("title"), r["type"].alias("type"), F.coalesce(r["cited_by_count"], F.lit(0)).alias("cited"), r["primary_location"]["source"]["display_name"].alias("source"),
        F.coalesce(names, none).alias("authors"), r["open_access"]["oa_url"].alias("open_url"), F.coalesce(r["referenced_works"], none).alias("references"),
    )


def of_types(nodes: DataFrame, types: tuple[str, ...] = ("article", "preprint", "review")) -> DataFrame:
    return nodes.filter(F.col("type").isin(*types))


def open_only(nodes: DataFrame, url: str = "open_url") -> tuple[DataFrame, DataFrame]:
    """Nodes with an open address, and one row that counts them."""
    return nodes.filter(F.col(url).isNotNull()), nodes.agg(F.count(url).alias("open"))
