"""Merkle manifest of a dataset: one hash tree a source, and one over the sources' roots.

A tree's nodes are placed in order by a range sort whose partitions are counted, so no window holds a
source. Each aligned block of FAN ** BLOCK_LEVELS nodes keeps a level as one string of 64 hexadecimal
digits a node: parents are hashes of fixed-width substrings, and what flanks a node's own substring is
its segment of siblings. The block's last node goes on as a node of the next round, until every tree is
one node; then paths come down from round to round, one row a block.

Everything is a DataFrame expression. Only leaves, not texts, are kept and shuffled: the text is read once.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

#: Nodes that share a parent, and levels that one block holds.
FAN = 16
BLOCK_LEVELS = 2
DIGITS = 64
#: Rows of a range of the sort, about, where that needs more partitions than the session's setting.
RANGE_ROWS = 500_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def field_text(value: Column) -> Column:
    """`-` for null, else the number of UTF-8 bytes, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_hash(*values: Column) -> Column:
    """The leaf of a row: sha256 of its fields one after another, in hexadecimal."""
    return F.sha2(F.concat(*map(field_text, values)), 256)


def placed(nodes: DataFrame, order: list[str], partitions: int) -> DataFrame:
    """`nodes` (columns tree, node, those of `order` and others) with place, the row's number from 0
    within its tree in ascending `order` (nulls first), and total, the tree's number of rows. Rows equal
    in all of `order` are numbered in any order. The sort is by ranges, whose rows are counted by tree."""
    ordered = nodes.repartitionByRange(partitions, "tree", *order).sortWithinPartitions("tree", *order)
    # identifiers rise by one within a partition of the sorted rows, and the upper bits name the partition
    kept = written(ordered.withColumn("at", F.monotonically_increasing_id()).withColumn("part", F.spark_partition_id()), "ordered")
    runs = kept.groupBy("tree", "part").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    tree = Window.partitionBy("tree")
    before = F.sum("n").over(tree.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("n")
    runs = runs.select(F.col("tree").alias("run_tree"), F.col("part").alias("run_part"), (before - F.col("first")).alias("shift"), F.sum("n").over(tree).alias("total"))
    joined = kept.join(runs, (kept["part"] == runs["run_part"]) & kept["tree"].eqNullSafe(runs["run_tree"]))
    return joined.withColumn("place", F.col("at") + F.col("shift")).drop("run_tree", "run_part", "shift", "at", "part")


def depth_of(total: Column) -> Column:
    """Levels above the nodes of a tree of so many: none for a single one."""
    return functools.reduce(lambda a, b: a + b, [(total > FAN**k).cast("int") for k in range(15)])


def parents_of(level: Column) -> Column:
    """Hashes of a level's runs of FAN nodes, the last of which may be shorter."""
    width = FAN * DIGITS
    runs = F.sequence(F.lit(0), F.ceil(F.length(level) / width).cast("int") - 1)
    return F.transform(runs, lambda i: F.sha2(F.substring(level, i * width + 1, F.lit(width)), 256))


def blocks_of(nodes: DataFrame, carried: list[str]) -> DataFrame:
    """Nodes with tree, place, node and depth (levels still to build) in aligned blocks: rows by place,
    the levels in the block as strings, and top, the block's last node."""
    size = FAN**BLOCK_LEVELS
    row = F.struct("place", "node", *carried)
    blocks = nodes.groupBy("tree", F.floor(F.col("place") / size).alias("block")).agg(
        F.array_sort(F.collect_list(row)).alias("rows"), F.max("depth").alias("depth")
    )
    blocks = blocks.withColumn("level0", F.array_join(F.transform("rows", lambda r: r["node"]), ""))
    for k in range(1, BLOCK_LEVELS + 1):
        parents = parents_of(F.col(f"level{k - 1}"))
        blocks = blocks.withColumn(f"level{k}", F.when(F.col("depth") >= k, F.array_join(parents, "")))
    top = F.coalesce(*[F.col(f"level{k}") for k in range(BLOCK_LEVELS, -1, -1)])
    return blocks.withColumn("top", top)


def siblings(rows_place: Column, levels: list[Column]) -> Column:
    """For a node at this place within its block: the texts left and right of it, and of each of its
    parents, in their runs; none where a level has no parents."""
    found = []
    for k, level in enumerate(levels[:-1]):
        at = F.floor(rows_place / FAN**k).cast("int")
        start = at - at % FAN
        left = F.substring(level, start * DIGITS + 1, (at - start) * DIGITS)
        right = F.substring(level, (at + 1) * DIGITS + 1, (start + FAN - at - 1) * DIGITS)
        found.append(F.when(levels[k + 1].isNotNull(), F.struct(left.alias("left"), right.alias("right"))))
    return F.filter(F.array(*found), lambda x: x.isNotNull())


def folded(node: Column, path: Column) -> Column:
    """The root that follows from a node and its siblings."""
    return F.aggregate(path, node, lambda acc, s: F.sha2(F.concat(s["left"], acc, s["right"]), 256))


def path_text(path: Column) -> Column:
    """The siblings of a path, one after another."""
    return F.array_join(F.transform(path, lambda s: F.concat(s["left"], s["right"])), "")


EMPTY_PATH = "array<struct<left:string,right:string>>"


def forest(nodes: DataFrame, order: list[str], carried: list[str], partitions: int, what: str) -> DataFrame:
    """One row per lowest block of the trees of `nodes` (tree, node, `order`, `carried`): tree, rows,
    level0.., path (siblings from the block's top to the root) and root. Rounds end when all
    trees are one node: with 2 levels a round, n nodes take log of n to base 256 rounds."""
    lowest = placed(nodes, order, partitions).withColumn("depth", depth_of(F.col("total")))
    rounds = [written(blocks_of(lowest, carried), f"{what}-blocks")]
    while True:
        left = rounds[-1].agg(F.max(F.col("depth") - BLOCK_LEVELS)).first()[0]
        if left is None or left <= 0:
            break
        above = rounds[-1].select("tree", F.col("block").alias("place"), F.col("top").alias("node"), F.greatest(F.col("depth") - BLOCK_LEVELS, F.lit(0)).alias("depth"))
        rounds.append(written(blocks_of(above, []), f"{what}-blocks"))
    down = rounds[-1].select("*", F.lit(None).cast(EMPTY_PATH).alias("none"), F.col("top").alias("root"))
    down = down.withColumn("path", F.coalesce("none", F.array().cast(EMPTY_PATH))).drop("none")
    for below in reversed(rounds[:-1]):
        size = FAN**BLOCK_LEVELS
        levels = [F.col(f"level{k}") for k in range(BLOCK_LEVELS + 1)]
        each = down.select("tree", "root", "path", *levels, F.explode("rows").alias("row"))
        each = each.select(
            F.col("tree").alias("up_tree"), F.col("row.place").alias("up_block"), "root",
            F.concat(siblings(F.col("row.place") % size, levels), F.col("path")).alias("path"),
        )
        down = below.join(each, (below["block"] == each["up_block"]) & below["tree"].eqNullSafe(each["up_tree"])).drop("up_tree", "up_block")
    return down


def dataset_manifest(df: DataFrame, id_col: str = "doc_id", source_col: str = "source", fields: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"), text_col: str = "text", tamper_every: int = 5) -> DataFrame:
    """One row per row of `df`: `id_col`, leaf, subroot (of its source), root (of all), proof_sha256 (of
    all siblings from the leaf to the root), folded_root and verified. folded_root follows from the
    original siblings and the leaf, which is tampered (A-Z of the text in lower case) where `tamper_every`
    divides the crc32 of the id in decimal.

    Null fields are `-` in a leaf, empty texts `0:`; rows of a null source are a source of their own, which
    comes first; a null id comes first in its source and is never tampered with. Rows of one id are ordered
    by leaf; repeated rows are equal leaves, each with a place and proof of its own. An empty table gives an
    empty result. Texts of any length are hashed whole. Columns beyond `fields` are not read, so their names
    can't clash."""
    values = [F.col(f"`{c}`") for c in fields]
    lowered = [F.translate(v, UPPER, LOWER) if c == text_col else v for c, v in zip(fields, values)]
    hit = F.crc32(F.col(f"`{id_col}`").cast("string")) % tamper_every == 0
    leaves = df.select(
        F.col(f"`{source_col}`").alias("tree"), F.col(f"`{id_col}`").alias("id"), leaf_hash(*values).alias("node"),
        # kept only where the text has such a letter, as all other rows fold from their own leaf
        F.when(hit & F.col(f"`{text_col}`").rlike("[A-Z]"), leaf_hash(*lowered)).alias("changed"),
    )
    # a number that is stored with the row parts equal rows between ranges
    leaves = written(leaves.withColumn("tie", F.monotonically_increasing_id()), "leaves")
    partitions = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), leaves.count() // RANGE_ROWS)
    trees = written(forest(leaves, ["id", "node", "tie"], ["id", "changed"], partitions, "manifest"), "trees")

    # one row a source; its tree's root is a node of the tree of all sources
    subroots = trees.filter(F.col("block") == 0).select(F.lit(0).alias("tree"), F.col("tree").alias("source"), F.col("root").alias("node"))
    above = forest(subroots, ["source"], ["source"], partitions, "sources")
    levels = [F.col(f"level{k}") for k in range(BLOCK_LEVELS + 1)]
    size = FAN**BLOCK_LEVELS
    above = above.select("root", "path", *levels, F.explode("rows").alias("row")).select(
        F.col("row.source").alias("of"), F.col("root").alias("whole"),
        F.concat(siblings(F.col("row.place") % size, levels), F.col("path")).alias("above"),
    )
    both = trees.join(above, trees["tree"].eqNullSafe(above["of"]))
    both = both.withColumn("path", F.concat("path", "above")).withColumn("rest", path_text(F.col("path")))

    def result(row: Column) -> Column:
        own = siblings(row["place"] % size, levels)
        return F.struct(
            row["id"].alias(id_col), row["node"].alias("leaf"), F.col("root").alias("subroot"), F.col("whole").alias("root"),
            F.sha2(F.concat(path_text(own), F.col("rest")), 256).alias("proof_sha256"),
            folded(F.coalesce(row["changed"], row["node"]), F.concat(own, F.col("path"))).alias("folded_root"),
        )

    rows = both.select(F.inline(F.transform("rows", result)))
    return rows.withColumn("verified", F.col("folded_root") == F.col("root"))


def oracle(levels: int = 8) -> str:
    """DuckDB SQL of the same on `documents`, with trees of up to 16 ** `levels` nodes. crc32 is folded
    over the digits of the id by shifts, as DuckDB has no function for it."""
    def leaf(text: str) -> str:
        field = "coalesce(octet_length(encode({0}))::varchar || ':' || {0}, '-')"
        return "sha256(" + " || ".join(field.format(c) for c in ("doc_id::varchar", "source", "lang", "n_chars::varchar", text)) + ")"

    steps = [
        f"""leaves as (
  select doc_id, source, text, {leaf('text')} as leaf,
    {leaf(f"translate(text, '{UPPER}', '{LOWER}')")} as lowered,
    list_reduce(list_prepend(4294967295::ubigint, list_transform(string_split(doc_id::varchar, ''), lambda c: ascii(c)::ubigint)), lambda a, c:
      list_reduce([xor(a, c), 0, 0, 0, 0, 0, 0, 0, 0]::ubigint[], lambda x, y: case when x & 1 = 1 then xor(x >> 1, 3988292384::ubigint) else x >> 1 end)) as state
  from documents)""",
        """n0 as (select doc_id, 0 as up, source as tree, leaf as node, leaf as own, case when xor(state, 4294967295::ubigint) % 5 = 0 then lowered else leaf end as changed,
    row_number() over (partition by source order by doc_id nulls first, leaf) - 1 as place, count(*) over (partition by source) as size from leaves)""",
        "s0 as (select tree, place, node from n0)",
    ]

    def climb(prefix: str, tree: str) -> None:
        for k in range(levels):
            steps.append(
                f"""{prefix}{k + 1} as (
  select {tree}tree, place // 16 as place, case when max(many) then sha256(string_agg(node, '' order by place)) else min(node) end as node
  from (select *, count(*) over (partition by tree) > 1 as many from {prefix}{k}) group by tree, place // 16)"""
            )

    climb("s", "")
    steps.append(f"t0 as (select 0 as tree, row_number() over (order by tree nulls first) - 1 as place, node, tree as source from s{levels})")
    climb("t", "")

    # each level adds the siblings' text and folds the changed node
    def walk(name: str, start: str, nodes: str, place: str) -> None:
        steps.append(start)
        for k in range(levels):
            steps.append(
                f"""{name}{k + 1} as (
  select a.* exclude (proof, fold, spot), spot // 16 as spot, proof || coalesce(l, '') || coalesce(r, '') as proof,
    case when many then sha256(coalesce(l, '') || fold || coalesce(r, '')) else fold end as fold
  from {name}{k} a join (
    select tree, place, count(*) over (partition by tree) > 1 as many,
      string_agg(node, '') over (partition by tree, place // 16 order by place rows between unbounded preceding and 1 preceding) as l,
      string_agg(node, '') over (partition by tree, place // 16 order by place rows between 1 following and unbounded following) as r
    from {nodes}{k}) b on a.{place} is not distinct from b.tree and a.spot = b.place)"""
            )

    walk("p", "p0 as (select doc_id, tree, own, place as spot, '' as proof, changed as fold from n0)", "s", "tree")
    walk(
        "q",
        f"q0 as (select p.doc_id, p.own, s.node as subroot, 0 as zero, t.place as spot, p.proof, p.fold from p{levels} p join s{levels} s on p.tree is not distinct from s.tree join t0 t on t.source is not distinct from p.tree)",
        "t",
        "zero",
    )
    return (
        "with " + ",\n".join(steps)
        + f"""
select doc_id, own as leaf, subroot, t.node as root, sha256(proof) as proof_sha256, fold as folded_root, fold = t.node as verified
from q{levels} cross join t{levels} t"""
    )
