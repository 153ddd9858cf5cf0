"""Linking predicted rows to golden rows, and comparing their cells."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator, Mapping, Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ..functions.cells import canonical_text, is_blank, number_with_unit, squash
from ..shared import cut, deal, parts_of

DIRECT_LIMIT, RANK_LIMIT = 0.15, 0.34


def canonical_alias(df: DataFrame, column: str, aliases: DataFrame, out: str = "canonical", prefixes: Sequence[str] = ("lithium", "li"), least: int = 3) -> DataFrame:
    """The canonical name of a squashed value from aliases (alias, canonical): of the whole value, then
    without a prefix, then the same of what stands before a bracket (a value that begins with one has no
    such part); else of the longest alias of `least` letters or more inside it, of several the first by
    letters; else the squashed value. Blank values give null. Only distinct values are looked up."""
    values = df.select(F.col(column).alias("__v")).distinct().filter(~is_blank("__v")).withColumn("__s", squash("__v"))
    begin = F.when(F.col("__s").startswith("("), F.col("__s")).otherwise(F.substring_index("__s", "(", 1))
    keys = []
    for k in (F.col("__s"), begin):
        keys += [k, *[F.when(k.startswith(p), F.substring(k, F.lit(len(p) + 1), F.length(k))) for p in prefixes]]
    tries = values.select("__v", F.posexplode(F.array(*keys)).alias("__at", "__key"))
    known = aliases.groupBy(squash("alias").alias("__alias")).agg(F.min("canonical").alias("__c"))
    exact = tries.join(known, F.col("__key") == F.col("__alias")).groupBy("__v").agg(F.min_by("__c", "__at").alias("__exact"))
    # every run of letters of an alias's length inside the value, looked up by equality; there are no more
    # lengths than the longest alias has letters
    lengths = sorted(r[0] for r in known.filter(F.length("__alias") >= least).select(F.length("__alias")).distinct().collect())
    sized = values.select("__v", "__s", F.explode(F.array(*map(F.lit, lengths)).cast("array<int>")).alias("__n")).filter(F.length("__s") >= F.col("__n"))
    parts = F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("__s") - F.col("__n") + 1), lambda i: F.substring(F.col("__s"), i, F.col("__n"))))
    inside = sized.select("__v", F.explode(parts).alias("__key")).join(known, F.col("__key") == F.col("__alias"))
    held = inside.groupBy("__v").agg(F.min_by("__c", F.struct(-F.length("__key"), F.col("__key"))).alias("__held"))
    found = values.join(exact, "__v", "left").join(held, "__v", "left").select("__v", F.coalesce("__exact", "__held", "__s").alias(out))
    return df.join(found, F.col(column).eqNullSafe(F.col("__v")), "left").drop("__v")


def indel_ratio(a: str, b: str) -> float:
    """2 * longest common subsequence / summed lengths, by bit-parallel rows."""
    if not a and not b:
        return 1.0
    if a == b:
        return 1.0
    masks: dict[str, int] = {}
    for i, c in enumerate(a):
        masks[c] = masks.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    state = full
    for c in b:
        hit = state & masks.get(c, 0)
        state = ((state + hit) | (state - hit)) & full
    return 2 * (len(a) - state.bit_count()) / (len(a) + len(b))


@F.pandas_udf(DoubleType())
def indel_similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else indel_ratio(x, y) for x, y in zip(a, b)], dtype="float64")


def name_similarity(df: DataFrame, a: str, b: str, out: str = "similarity", short: Mapping[str, str] | None = None) -> DataFrame:
    """InDel similarity of two names with abbreviations spelt out: 1 if equal, 0 if either is blank.
    Each distinct unequal pair is compared once."""
    def full(c: str) -> Column:
        name = canonical_text(c)
        for word, long in (short or {}).items():
            name = F.regexp_replace(name, rf"(?<![0-9a-z]){re.escape(word)}(?![0-9a-z])", long.replace("\\", r"\\").replace("$", r"\$"))
        return name

    both = df.withColumn("__a", full(a)).withColumn("__b", full(b))
    blank = is_blank("__a") | is_blank("__b")
    pairs = both.filter(~blank & (F.col("__a") != F.col("__b"))).select("__a", "__b").distinct().withColumn("__s", indel_similarity("__a", "__b"))
    joined = both.join(pairs, ["__a", "__b"], "left")
    return joined.withColumn(out, F.when(blank, 0.0).when(F.col("__a") == F.col("__b"), 1.0).otherwise(F.col("__s"))).drop("__a", "__b", "__s")


def rank_position(df: DataFrame, group: Sequence[str], keys: Sequence[str], order: str, out: str = "rank_pos") -> DataFrame:
    """Place 0..1 of each row's first present key within its group, 0.5 if alone, null without a key;
    ties in row order."""
    value = F.coalesce(*[F.col(k).cast("double") for k in keys])
    by = [*[F.col(g) for g in group], value.isNull()]
    at, n = F.row_number().over(Window.partitionBy(*by).orderBy(value, order)) - 1, F.count(F.lit(1)).over(Window.partitionBy(*by))
    return df.withColumn(out, F.when(value.isNotNull(), F.when(n == 1, 0.5).otherwise(F.try_divide(at.cast("double"), n - 1))))


def link_candidates(
    pred: DataFrame, gold: DataFrame, group: Sequence[str], block: str, pairs: Sequence[tuple[str, str]], extra: tuple[str, str] | None, pred_id: str, gold_id: str, similarity: Column | None = None
) -> DataFrame:
    """Candidate links within a group and block (null blocks meet null ones): (group, pred_id, gold_id,
    distance, quality). direct: the least relative difference of the pairs, within DIRECT_LIMIT;
    rank: places within RANK_LIMIT; block_only: no value to compare and one golden row in the block.
    A pair with places that are too far apart gets no block_only link. Both sides need rank_pos and
    prefixed column names may not clash."""
    # both sides are dealt by group and block, null blocks as a block, in as many parts as the input is large
    parts, keys = parts_of(pred, gold), [*group, "__block"]
    own = lambda df: deal(df.withColumn("__block", F.struct(block)), parts, *keys)
    named = lambda df, side: df.select(*[F.col(c).alias(f"{side}_{c}") for c in df.columns])
    p = named(own(pred), "p")
    g = named(own(gold).withColumn("__alone", F.count(F.lit(1)).over(Window.partitionBy(*keys))), "g")
    on = [F.col(f"p_{c}") == F.col(f"g_{c}") for c in keys]
    both = p.join(g, on)

    def relative(a: Column, b: Column) -> Column:
        size = F.greatest(F.abs(a), F.abs(b))
        return F.when(a.isNotNull() & b.isNotNull(), F.when(size == 0, 0.0).otherwise(F.try_divide(F.abs(a - b), size)))

    compared = [relative(F.col(f"p_{a}").cast("double"), F.col(f"g_{b}").cast("double")) for a, b in pairs]
    difference = F.least(*compared) if len(compared) > 1 else compared[0]
    tie = F.lit(0.0)
    if extra:
        tie = tie + F.coalesce(F.least(F.abs(F.col(f"p_{extra[0]}").cast("double") - F.col(f"g_{extra[1]}")) / 5.0, F.lit(1.0)), F.lit(0.0))
    if similarity is not None:
        tie = tie + 0.5 * (1 - similarity)
    gap = F.abs(F.col("p_rank_pos") - F.col("g_rank_pos"))
    direct, ranked = F.coalesce(difference <= DIRECT_LIMIT, F.lit(False)), gap.isNotNull()
    lone = F.col("p_rank_pos").isNull() & (F.col("g___alone") == 1)
    quality = F.when(direct, "direct").when(ranked & (gap <= RANK_LIMIT), "rank").when(~ranked & lone, "block_only")
    distance = F.when(direct, 5 * difference + tie).when(ranked, 1 + 3 * gap + tie).otherwise(2 + tie)
    out = both.select(*[F.col(f"p_{c}").alias(c) for c in group], F.col(f"p_{pred_id}").alias("pred_id"), F.col(f"g_{gold_id}").alias("gold_id"), distance.alias("distance"), quality.alias("quality"))
    return out.filter("quality is not null")


#: Candidates of one group, or of one component of a larger group, that a task takes in order.
PASS_CANDIDATES = 200_000


def closest_first() -> list[Column]:
    return [F.col("distance").asc_nulls_last(), F.col("pred_id"), F.col("gold_id")]


def assign_greedy(candidates: DataFrame, group: Sequence[str], rounds: int | None = None, pass_candidates: int = PASS_CANDIDATES) -> DataFrame:
    """One-to-one links, the closest first (ties by pred_id, then gold_id), as a sequential greedy pass
    takes them. Links of different groups, and of different connected components of a group, don't touch
    each other: groups of at most `pass_candidates` candidates are taken in order by one shuffle; larger ones
    are parted into components first, which are taken so in turn; only components that are larger still
    go through assign_in_rounds (at most `rounds` of them, if given). All three give the same links. Null
    groups are one group, and a null row of either side is a row of its own kind; distances of null come
    last; an empty table gives no links."""
    names = list(candidates.columns)
    sizes = candidates.groupBy(*group).agg(F.count(F.lit(1)).alias("__size"))
    large = cut(sizes.filter(F.col("__size") > pass_candidates).select(*[F.col(c).alias(f"__{c}") for c in group]))
    same = [candidates[c].eqNullSafe(large[f"__{c}"]) for c in group]
    if large.isEmpty():
        return take_in_order(candidates, group)
    rest = take_in_order(candidates.join(large, same, "left_anti"), group)
    labelled = with_components(cut(candidates.join(large, same, "left_semi")), group)
    parts = labelled.groupBy("__part").agg(F.count(F.lit(1)).alias("__size"))
    giants = cut(parts.filter(F.col("__size") > pass_candidates).select("__part"))
    small = take_in_order(labelled.join(giants, "__part", "left_anti"), ["__part", *group]).select(*names)
    out = rest.unionByName(small)
    if giants.isEmpty():
        return out
    return out.unionByName(assign_in_rounds(labelled.join(giants, "__part", "left_semi").select(*names), group, rounds))


def take_in_order(candidates: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Greedy links of each distinct `keys`, all candidates of which are read by one task, sorted and
    in slices; it keeps the rows that are taken so far."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, used = None, (set(), set())
        for batch in batches:
            keep = []
            groups = zip(*[batch.column(k).to_pylist() for k in keys]) if keys else ((),) * batch.num_rows
            for key, p, g in zip(groups, batch.column("pred_id").to_pylist(), batch.column("gold_id").to_pylist()):
                if key != last:
                    last, used = key, (set(), set())
                free = p not in used[0] and g not in used[1]
                keep.append(free)
                if free:
                    used[0].add(p)
                    used[1].add(g)
            yield batch.filter(pa.array(keep, pa.bool_()))

    dealt = candidates.repartition(*keys) if keys else candidates.repartition(1)
    return dealt.sortWithinPartitions(*keys, *closest_first()).mapInArrow(run, candidates.schema)


def with_components(candidates: DataFrame, group: Sequence[str]) -> DataFrame:
    """The candidates with __part, the same for all of a connected component. Rows are named by 64-bit
    hashes: two components that share a name by chance are taken as one, which gives the same links.
    Each round leads every row to the least neighbour, then to that one's, until nothing changes; so
    rounds are about the logarithm of the longest chain, and no row's neighbours are gathered."""
    name = lambda side, c: F.xxhash64(F.lit(side), *group, F.col(c).isNull(), c)
    named = cut(candidates.withColumns({"__p": name("p", "pred_id"), "__g": name("g", "gold_id")}))
    edges = named.select(F.col("__p").alias("u"), F.col("__g").alias("v")).distinct()
    edges = cut(edges.union(edges.select("v", "u")))
    while True:
        # large star: every larger neighbour of u is led to the least of u and its neighbours
        least = edges.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        stars = edges.join(least, "u").filter(F.col("v") > F.col("u")).select(F.col("v").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        # small star: every smaller neighbour of a, and a, are led to the least of them
        low = stars.groupBy("a").agg(F.min("b").alias("m"))
        led = stars.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.select("a", F.col("m").alias("b"))).filter("a <> b").distinct()
        fresh = cut(led.select(F.col("a").alias("u"), F.col("b").alias("v")).union(led.select("b", "a")))
        changed = not fresh.join(edges, ["u", "v"], "left_anti").isEmpty() or not edges.join(fresh, ["u", "v"], "left_anti").isEmpty()
        edges = fresh
        if not changed:
            break
    roots = edges.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("__part"))
    return cut(named.join(roots, named["__p"] == roots["u"]).drop("__p", "__g", "u"))


def assign_in_rounds(candidates: DataFrame, group: Sequence[str], rounds: int | None = None) -> DataFrame:
    """assign_greedy by rounds over all rows: each takes every pair that is the best left for both of its
    rows. The best pair left of a group is always taken, so rounds end; a chain of pairs, each better than
    the next, takes one round a pair."""
    left, taken, n = candidates, None, 0

    def without(rows: DataFrame, used: DataFrame, names: list[str]) -> DataFrame:
        keys = used.select(*[F.col(c).alias(f"__{c}") for c in names]).distinct()
        return rows.join(keys, [rows[c].eqNullSafe(keys[f"__{c}"]) for c in names], "left_anti")

    while True:
        best = lambda side: F.row_number().over(Window.partitionBy(*group, side).orderBy(*closest_first())) == 1
        mutual = cut(left.withColumn("a", best("pred_id")).withColumn("b", best("gold_id")).filter("a and b").drop("a", "b"))
        n += 1
        if mutual.isEmpty() or n == rounds:
            return mutual if taken is None else taken.unionByName(mutual)
        taken = mutual if taken is None else taken.unionByName(mutual)
        left = cut(without(without(left, mutual, [*group, "pred_id"]), mutual, [*group, "gold_id"]))


def assign_greedy_grouped(candidates: DataFrame, group: Sequence[str]) -> DataFrame:
    """assign_greedy with each group in one task, for groups that are known to be small."""
    return take_in_order(candidates.select(*group, "pred_id", "gold_id", "distance", "quality"), group)


def missed_rows(gold: DataFrame, links: DataFrame, group: Sequence[str], gold_id: str, columns: Sequence[str]) -> DataFrame:
    """A missing cell for each filled column of golden rows without a link."""
    rest = gold.join(links.select(*group, F.col("gold_id").alias(gold_id)), [*group, gold_id], "left_anti")
    return rest.select(*group, gold_id, *[F.col(c).cast("string").alias(c) for c in columns]).unpivot([*group, gold_id], list(columns), "column", "gold").filter("gold is not null").withColumn("outcome", F.lit("missing"))


def compare_cells(cells: DataFrame, classes: DataFrame, pred: str = "pred", gold: str = "gold") -> DataFrame:
    """Outcome of each long cell (column, pred, gold as text) by its column's class (log, temperature,
    percent, relative, text; relative if unlisted): blank, extra, missing, correct, near, wrong."""
    p, g, no_p, no_g = (F.col(f"__{c}") for c in ("pn", "gn", "pb", "gb"))
    kind = F.coalesce("__class", F.lit("relative"))
    decades = F.abs(F.log10(F.when(p > 0, p)) - F.log10(F.when(g > 0, g)))
    yes = lambda test: F.when(test, "correct").otherwise("wrong")
    on_log = F.when((p <= 0) | (g <= 0), yes(p == g)).when(decades <= 0.1, "correct").when(decades <= 0.5, "near").otherwise("wrong")
    numbers = (
        F.when(kind == "log", on_log).when(kind == "temperature", yes(F.abs(p - g) <= 2)).when(kind == "percent", yes(F.abs(p - g) <= 1))
        .otherwise(yes(F.try_divide(F.abs(p - g), F.greatest(F.abs(g), F.lit(1e-12))) <= 0.05))
    )
    # cells that are filled, so that equal ones have equal words
    words = F.when(F.col(pred) == F.col(gold), "correct").otherwise(yes(canonical_text(pred) == canonical_text(gold)))
    outcome = (
        F.when(no_p & no_g, "blank").when(no_g, "extra").when(no_p, "missing")
        .when((kind == "text") | (p.isNull() & g.isNull()), words).when(p.isNotNull() & g.isNotNull(), numbers).otherwise("wrong")
    )
    lookup = classes.select(F.col("column").alias("__column"), F.col("class").alias("__class"))
    # numbers and blanks are columns of their own, so that each cell's text is read once and not in every branch
    read = cells.withColumns({"__pn": number_with_unit(pred), "__gn": number_with_unit(gold), "__pb": is_blank(pred), "__gb": is_blank(gold)})
    # classes are declared by hand, one for a field: cells stay where they are, and don't meet in a task for each field
    return read.join(F.broadcast(lookup), F.col("column") == F.col("__column"), "left").withColumn("outcome", outcome).drop("__column", "__class", "__pn", "__gn", "__pb", "__gb")


def cell_structs(columns: Sequence[str]) -> Column:
    """The cells of a wide row with p_ and g_ columns: (column, pred, gold)."""
    return F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"p_{c}").alias("pred"), F.col(f"g_{c}").alias("gold")) for c in columns])


def as_text(df: DataFrame, keys: Sequence[str | Column], side: str, columns: Sequence[str]) -> DataFrame:
    return df.select(*keys, *[F.col(c).cast("string").alias(f"{side}_{c}") for c in columns])


def same_row_cells(pred: DataFrame, gold: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Long cells (keys, column, pred, gold as text) of rows with equal keys."""
    return as_text(pred, keys, "p", columns).join(as_text(gold, keys, "g", columns), list(keys)).select(*keys, F.inline(cell_structs(columns)))


def score_cells(pred: DataFrame, gold: DataFrame, links: DataFrame, group: Sequence[str], pred_id: str, gold_id: str, columns: Sequence[str], classes: DataFrame) -> DataFrame:
    """compare_cells of pair_cells, and missed_rows, in one pass over the golden rows: (group, gold_id,
    column, outcome, unmatched). A link whose predicted row is not there has no cells."""
    p = as_text(pred, [*group, F.col(pred_id).alias("pred_id"), F.lit(True).alias("__there")], "p", columns)
    g = as_text(gold, [*group, F.col(gold_id).alias("gold_id")], "g", columns)
    linked = links.select(*group, "pred_id", "gold_id", F.lit(True).alias("__linked"))
    rows = g.join(linked.join(p, [*group, "pred_id"], "left"), [*group, "gold_id"], "left").filter("__linked is null or __there")
    cells = rows.select(*group, "gold_id", F.col("__linked").isNull().alias("unmatched"), F.inline(cell_structs(columns))).filter("not unmatched or gold is not null")
    outcome = F.when(F.col("unmatched"), "missing").otherwise(F.col("outcome"))
    return compare_cells(cells, classes).select(*group, "gold_id", "column", outcome.alias("outcome"), "unmatched")


def pair_cells(pred: DataFrame, gold: DataFrame, links: DataFrame, group: Sequence[str], pred_id: str, gold_id: str, columns: Sequence[str]) -> DataFrame:
    """Long cells (group, gold_id, column, pred, gold as text) of linked rows. Wide rows meet by key, and
    are unpivoted after, so that a row is shuffled once whatever its number of columns."""
    p = as_text(pred, [*group, F.col(pred_id).alias("pred_id")], "p", columns)
    g = as_text(gold, [*group, F.col(gold_id).alias("gold_id")], "g", columns)
    both = links.select(*group, "pred_id", "gold_id").join(p, [*group, "pred_id"]).join(g, [*group, "gold_id"])
    return both.select(*group, "gold_id", F.inline(cell_structs(columns)))


def canonical_solvent(df: DataFrame, column: str, aliases: DataFrame, out: str = "solvent") -> DataFrame:
    """The canonical name of a solvent by the letters and digits of its squashed text (subscripts are
    digits) from aliases (alias, canonical), else those letters and digits. Of aliases of the same letters
    the least name counts; blank cells give null."""
    letters = lambda c: F.regexp_replace(squash(c), "[^0-9a-z]", "")
    known = aliases.groupBy(letters("alias").alias("__a")).agg(F.min("canonical").alias("__c"))
    keyed = df.withColumn("__k", F.when(~is_blank(column), letters(column)))
    return keyed.join(known, F.col("__k") == F.col("__a"), "left").withColumn(out, F.coalesce("__c", "__k")).drop("__k", "__a", "__c")


def map_papers(files: DataFrame, papers: DataFrame, strict: bool = False) -> DataFrame:
    """Each file (file, surname, year, doi) with the paper (paper, reference, doi) whose reference has
    its surname and year as words, else whose DOI has the same letters and digits; n_found says how
    many papers matched, of which the least is kept. With `strict`, a file without exactly one paper is
    an error."""
    bare = lambda c: F.nullif(F.lower(F.regexp_replace(c, "[^0-9A-Za-z]", "")), F.lit(""))
    words = papers.select("paper", F.explode(F.array_distinct(F.split(F.lower("reference"), r"[^0-9\p{L}]+"))).alias("word"))
    by_name = files.join(words.withColumnRenamed("word", "w1"), F.lower("surname") == F.col("w1")).join(words.withColumnRenamed("word", "w2"), ["paper"]).filter(F.col("w2") == F.col("year").cast("string"))
    by_doi = files.select("file", bare("doi").alias("k")).join(papers.select("paper", bare("doi").alias("k")), "k")
    hits = by_name.select("file", "paper", F.lit("name").alias("rule")).union(by_doi.select("file", "paper", F.lit("doi").alias("rule"))).distinct()
    best = hits.groupBy("file", "rule").agg(F.min("paper").alias("paper"), F.countDistinct("paper").alias("n_found"))
    chosen = best.groupBy("file").agg(F.max_by(F.struct("rule", "paper", "n_found"), "rule").alias("b"))
    out = files.select("file").join(chosen, "file", "left").select("file", "b.rule", "b.paper", F.coalesce("b.n_found", F.lit(0)).cast("long").alias("n_found"))
    if strict:
        wrong = F.raise_error(F.concat_ws(" ", F.lit("not one paper but"), F.col("n_found").cast("string"), F.lit("for"), F.col("file").cast("string"))).cast("long")
        out = out.withColumn("n_found", F.when(F.col("n_found") == 1, F.col("n_found")).otherwise(wrong))
    return out


def match_key(points: DataFrame, key: DataFrame, group: Sequence[str], t_tol: float = 0.051, share: float = 0.006, least: float = 5e-5) -> DataFrame:
    """Candidates of match_points: all pairs of points (group, id, t, x) and key rows (group, key_id, t,
    x) of the same group, t closer than t_tol, x within a share of the key's or closer than `least`. A join
    on buckets of both t and x, so that points of one t meet only key rows of about their x: of the
    logarithm of x for the share, of x itself for `least`; a pair that both find counts once."""
    p = points.select(*group, F.col("id").alias("pred_id"), F.col("t").cast("double").alias("pt"), F.col("x").cast("double").alias("px"))
    k = key.select(*group, F.col("key_id").alias("gold_id"), F.col("t").cast("double").alias("kt"), F.col("x").cast("double").alias("kx"))
    around = lambda slot: F.explode(F.array(slot - 1, slot, slot + 1))
    p, k = p.withColumn("slot", F.floor(F.col("pt") / t_tol)), k.withColumn("slot", around(F.floor(F.col("kt") / t_tol)))
    apart = F.abs(F.col("px") - F.col("kx"))
    like, close = apart <= share * F.abs(F.col("kx")), apart < least
    near_t = F.abs(F.col("pt") - F.col("kt")) < t_tol
    if share >= 1:
        found = p.join(k.hint("merge"), [*group, "slot"]).filter(near_t & (like | close))
    else:
        # within a share: signs are equal and logarithms differ by less than a bucket; zero meets zero
        width = -math.log1p(-share) * 1.000001 or 1e-9
        size = lambda c: F.when(c == 0, F.lit(0)).otherwise(F.floor(F.log(F.abs(c)) / width))
        left, right = (df.withColumns({"sign": F.signum(x), "size": size(F.col(x))}) for df, x in ((p, "px"), (k, "kx")))
        found = left.join(right.withColumn("size", around(F.col("size"))).hint("merge"), [*group, "slot", "sign", "size"]).filter(near_t & like).drop("sign", "size")
        if least > 0:
            step = least * 1.000001
            by_x = p.withColumn("place", F.floor(F.col("px") / step)).join(k.withColumn("place", around(F.floor(F.col("kx") / step))).hint("merge"), [*group, "slot", "place"])
            found = found.unionByName(by_x.filter(near_t & close & ~like).drop("place"))
    return found.select(*group, "pred_id", "gold_id", F.col("pred_id").cast("double").alias("distance"), F.lit("exact").alias("quality"))


def match_points(points: DataFrame, key: DataFrame, group: Sequence[str], t_tol: float = 0.051, share: float = 0.006, least: float = 5e-5) -> DataFrame:
    """Points matched one to one with key rows: the first unused near key row of each point, points in
    order."""
    return assign_greedy(match_key(points, key, group, t_tol, share, least), group)


def evidence(mapping: DataFrame, docs: DataFrame, text: str, reach: int = 3000) -> DataFrame:
    """What in the first characters of a file's text speaks for its paper: mapping has (file, paper,
    reference, doi), docs (file, text). Returns (file, has_doi, has_pages): the bare DOI, or the page
    range of the reference with any dash."""
    head = F.regexp_replace(F.lower(F.substring(F.col(text), 1, reach)), "[‐‑‒–—−]", "-")
    span = F.regexp_extract(F.regexp_replace("reference", "[‐‑‒–—−]", "-"), r"(\d+)\s*-\s*(\d+)", 0)
    pages = F.regexp_replace(span, r"\s", "")
    doi = F.lower(F.regexp_replace("doi", r"(?i)^(https?://)?(dx\.)?doi\.org/|^doi:\s*", ""))
    both = mapping.join(docs.select("file", head.alias("__head")), "file", "left").withColumns({"__doi": doi, "__pages": pages})
    has = lambda c: F.coalesce((c != "") & F.contains(F.col("__head"), c), F.lit(False))
    return both.select("file", has(F.col("__doi")).alias("has_doi"), has(F.col("__pages")).alias("has_pages"))


def missed_key_rows(key: DataFrame, group: Sequence[str], links: DataFrame) -> DataFrame:
    """The key rows (group, key_id, t, x) that no point was matched with: class missed."""
    used = links.select(*group, F.col("gold_id").alias("key_id"))
    return key.join(used, [*group, "key_id"], "left_anti").withColumn("kind", F.lit("missed"))


def classify_points(points: DataFrame, key: DataFrame, group: Sequence[str], links: DataFrame, t_tol: float = 0.051, share: float = 0.006) -> DataFrame:
    """The class of each point (group, id, t, x): exact if linked; wrong_time if a key row of its group
    has its x, wrong_x if one has its t, not_in_table otherwise; unknown if its group has no key, or only
    key rows without x. Links are one to one, as match_points gives them. Key rows of the same t are
    looked up in buckets of t, those of the same x in buckets of the logarithm of x. No join is broadcast,
    so that the driver holds nothing that grows with the rows."""
    flags = ("__linked", "__same_t", "__same_x")
    flagged = lambda df, flag: df.select(*group, "id", *[F.lit(True if f == flag else None).cast("boolean").alias(f) for f in flags])
    linked = links.select(*group, F.col("pred_id").alias("id")).distinct()
    rest = points.join(linked.hint("merge"), [*group, "id"], "left_anti").select(*group, "id", "t", "x")
    rows = key.select(*group, F.col("t").alias("__t"), F.col("x").alias("__x"))
    around = lambda slot: F.explode(F.array(slot - 1, slot, slot + 1))

    def meets(left: DataFrame, right: DataFrame, keys: Sequence[str], test: Column) -> DataFrame:
        """The rows of `left` that have a right one; merged by sort, so that no side goes through the driver."""
        named = right.select(*[F.col(c).alias(f"__key_{c}") for c in keys], *[c for c in right.columns if c not in keys])
        return left.join(named.hint("merge"), [F.col(c) == F.col(f"__key_{c}") for c in keys] + [test], "left_semi")

    same_t = meets(rest.withColumn("slot", F.floor(F.col("t") / t_tol)), rows.select(*group, "__t").distinct().withColumn("slot", around(F.floor(F.col("__t") / t_tol))), [*group, "slot"], F.abs(F.col("t") - F.col("__t")) < t_tol)
    xs, alike = rows.select(*group, "__x").distinct(), F.abs(F.col("x") - F.col("__x")) <= share * F.abs("__x")
    if share < 1:
        # x within a share of the key's: a logarithm differs by less than a bucket, signs are the same
        width = -math.log1p(-share) * 1.000001
        size = lambda c: F.when(c == 0, F.lit(0)).otherwise(F.floor(F.log(F.abs(c)) / width))
    if 0 < share < 1:
        same_x = meets(rest.withColumns({"slot": size(F.col("x")), "sign": F.signum("x")}), xs.withColumns({"slot": around(size(F.col("__x"))), "sign": F.signum("__x")}), [*group, "slot", "sign"], alike)
    elif share == 0:
        same_x = meets(rest, xs.withColumn("x", F.col("__x")), [*group, "x"], alike)
    else:
        same_x = meets(rest, xs, list(group), alike)
    known = flagged(linked, "__linked").unionByName(flagged(same_t, "__same_t")).unionByName(flagged(same_x, "__same_x"))
    known = known.groupBy(*group, "id").agg(*[F.bool_or(f).alias(f) for f in flags])
    keyed = rows.filter("__x is not null").select(*group).distinct().withColumn("__keyed", F.lit(True))
    out = points.join(known.hint("merge"), [*group, "id"], "left").join(keyed.hint("merge"), list(group), "left")
    kind = F.when(F.col("__linked"), "exact").when(F.col("__keyed").isNull() | F.col("x").isNull(), "unknown").when(F.col("__same_x"), "wrong_time").when(F.col("__same_t"), "wrong_x").otherwise("not_in_table")
    return out.withColumn("kind", kind).drop("__linked", "__same_t", "__same_x", "__keyed")
