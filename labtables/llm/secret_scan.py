"""Secret scans with DataFrame functions only.

Patterns find assignments, access keys and long hexadecimal runs. Beside them, candidate strings of
each character class are slid over by a window: as it moves, the count of the character that enters
and of the one that leaves change by one, and with them the sum of n log2 n from which the window's
Shannon entropy follows, so a step costs the same whatever the window. Windows above their class's
entropy give a span, unless the candidate is on the allow list.

Positions come from splitting the text at its matches: a match starts where the lengths of the pieces
and matches before it end. Nothing leaves its row, so the scan has no shuffle.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: Name, pattern, group whose length counts, least length. A run of the class is
#: maximal, so a least length in its pattern finds the same matches as dropping short ones after.
BASE_KINDS = (
    ("assign", ASSIGN, 2, 6),
    ("access", r"AKIA[A-Z0-9]{16,}", 0, 20),
    ("hex", r"[0-9a-f]{24,}", 0, 24),
)


@dataclass(frozen=True)
class EntropyClass:
    """Candidate strings of one character class: `pattern` finds maximal runs, a window of `window`
    characters counts when its entropy in bits is at least `bits`."""

    name: str
    pattern: str
    window: int
    bits: float


#: Words of examples. They part base-64 runs at their first letter, so that a secret beside one is looked
#: at by itself.
WORDS = "example|placeholder|your_|dummy|xxxx|0123456789|abcdefghij"
RUN = "[0-9A-Za-z+/_=-]"
#: Hexadecimal in capitals too (the base kind is lower case only), ended by letters and digits alone, as a
#: secret may stand in an address or an assignment; and base 64 in both alphabets.
ENTROPY_CLASSES = (
    EntropyClass("entropy_hex", r"(?<![0-9A-Za-z])[0-9A-Fa-f]{24,}(?![0-9A-Za-z])", 24, 3.0),
    EntropyClass("entropy_base64", rf"(?={RUN}{{20}})(?:(?!(?i:{WORDS})){RUN}){{20,}}+", 20, 3.7),
)
#: Candidates that match any of these are no secrets: they lack a digit or a letter, hold the words of
#: examples, or are dashed ids or paths as addresses have, of short pieces that are all letters or all
#: digits.
ALLOWED = (
    r"^[^0-9]*$",
    r"^[^A-Za-z]*$",
    rf"(?i){WORDS}",
    r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",
    PATH := r"^(?:[A-Za-z]{0,14}|[0-9]{0,14})(?:[/_=-]+(?:[A-Za-z]{0,14}|[0-9]{0,14})){2,}$",
)
#: The path rule for the JVM, whose matcher recurses at each turn of a repeated group and so fails on
#: long runs: of base-64 characters, what must be found and what must not.
BY_PIECES = {PATH: (r"[/_=-][^/_=-]*[/_=-]", r"\+|[A-Za-z0-9]{15}|[A-Za-z][0-9]|[0-9][A-Za-z]")}
SCALE = 1_000_000
#: Counts of a window are held so many bits each, in SLOTS integers of 64 bits.
COUNT_BITS, SLOTS = 5, 8


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is computed once, however often `body` uses it."""
    return F.transform(F.array(value), body)[0]


def running(values: Column, add: Callable[[Column, Column], Column]) -> Column:
    """Running sums (or what else `add` makes of numbers from 0 up) of an array, in steps of its length's
    square root: n ** 1.5 additions at most."""

    def sums(a: Column) -> Column:
        step = F.greatest(F.ceil(F.sqrt(F.size(a).cast("double"))).cast("int"), F.lit(1))
        chunks = F.transform(F.sequence(F.lit(0), F.floor((F.size(a) - 1) / step).cast("int")), lambda q: F.slice(a, q * step + 1, step))
        total = lambda x: F.aggregate(x, F.lit(0), add)

        def bases(cs: Column) -> Column:
            return let(F.transform(cs, total), lambda t: F.flatten(F.transform(cs, lambda c, q: let(total(F.slice(t, 1, q)), lambda base: F.transform(c, lambda _, i: add(base, total(F.slice(c, 1, i + 1))))))))

        return let(chunks, bases)

    return let(values, lambda a: F.when(F.size(a) > 0, sums(a)).otherwise(F.array().cast("array<int>")))


def running_sum(values: Column) -> Column:
    return running(values, lambda s, y: s + y)


SPAN = "array<struct<start:int,kind:int,end:int,text:string>>"


def spans_of(text: Column, pattern: str, kind: int, group: int = 0, least: int = 1) -> Column:
    """Spans of the leftmost non-overlapping matches whose `group` has `least` characters or more, as
    structs of start, kind, end (code points, end exclusive) and matched text."""
    hits = lambda g: F.regexp_extract_all(text, F.lit(pattern), F.lit(g))

    def located(found: Column, sized: Column) -> Column:
        gaps = F.transform(F.split(text, pattern, -1), lambda g: F.char_length(g))
        lengths = F.transform(found, lambda h: F.char_length(h))
        steps = let(lengths, lambda n: F.transform(gaps, lambda g, i: g + F.when(i > 0, F.get(n, i - 1)).otherwise(0)))
        build = lambda starts: F.filter(F.transform(found, lambda h, i: F.struct(
            F.get(starts, i).alias("start"), F.lit(kind).alias("kind"), (F.get(starts, i) + F.char_length(h)).alias("end"), h.alias("text"),
            F.char_length(F.get(sized, i)).alias("n"))), lambda s: s["n"] >= least)
        return F.transform(let(running_sum(steps), build), lambda s: F.struct(s["start"], s["kind"], s["end"], s["text"]))

    out = let(hits(0), lambda found: located(found, found)) if group == 0 else let(hits(0), lambda found: let(hits(group), lambda sized: located(found, sized)))
    return F.when(text.rlike(pattern), out).otherwise(F.array()).cast(SPAN)


def entropy_terms(window: int) -> list[int]:
    """n log2 n for n up to the window, in millionths, so that sums are exact."""
    return [0] + [round(n * math.log2(n) * SCALE) for n in range(1, window + 1)]


def hot_range(candidate: Column, window: int, bits: float) -> Column:
    """First and end index of the windows of `candidate` (ASCII) with at least `bits` of entropy, or
    null: lo and hi of a struct. Entropy is log2 w - sum(n log2 n) / w over the window's counts. A step
    changes two counts, packed in SLOTS integers, whatever the window (of fewer than 32)."""
    if window >= 1 << COUNT_BITS:
        raise ValueError("windows have fewer than 32 characters")
    terms = F.array(*[F.lit(x) for x in entropy_terms(window)])
    most = math.floor((math.log2(window) - bits) * window * SCALE)
    codes = F.transform(F.split(candidate, ""), lambda c: F.ascii(c) - 32)
    empty = F.struct(
        F.array_repeat(F.lit(0).cast("long"), SLOTS).alias("n"), F.lit(0).alias("sum"), F.lit(0).alias("i"),
        F.lit(None).cast("int").alias("lo"), F.lit(None).cast("int").alias("hi"),
    )
    slot, place = lambda c: c.bitwiseAND(SLOTS - 1), lambda c: F.shiftright(c, 3) * COUNT_BITS
    one = F.lit(1).cast("long")

    def slide(a: Column) -> Column:
        def step(s: Column, enters: Column) -> Column:
            full = s["i"] >= window
            leaves = F.when(full, F.get(a, s["i"] - window)).otherwise(-1)
            count = lambda c: F.call_function("shiftright", F.get(s["n"], slot(c)), place(c)).bitwiseAND((1 << COUNT_BITS) - 1).cast("int")
            unit = lambda c, j: F.when(j == slot(c), F.call_function("shiftleft", one, place(c))).otherwise(0)
            gained = let(count(enters), lambda n: F.get(terms, n + 1) - F.get(terms, n))
            lost = F.when(full, let(count(leaves), lambda n: F.get(terms, n) - F.get(terms, n - 1))).otherwise(0)
            moved = F.transform(s["n"], lambda n, j: n + unit(enters, j) - F.when(full, unit(leaves, j)).otherwise(0))

            def after(t: Column) -> Column:
                hot = (s["i"] >= window - 1) & (t <= most)
                return F.struct(
                    F.when(leaves == enters, s["n"]).otherwise(moved).alias("n"), t.alias("sum"), (s["i"] + 1).alias("i"),
                    F.coalesce(s["lo"], F.when(hot, s["i"] - window + 1)).alias("lo"), F.when(hot, s["i"] + 1).otherwise(s["hi"]).alias("hi"),
                )

            return let(F.when(leaves == enters, s["sum"]).otherwise(s["sum"] + gained - lost), after)

        return F.aggregate(a, empty, step, lambda s: F.struct(s["lo"], s["hi"]))

    return let(codes, slide)


def is_allowed(candidate: Column, allowed: tuple[str, ...]) -> Column:
    """Whether a run of base-64 characters matches any of the rules."""
    rules = [r for r in allowed if r not in BY_PIECES]
    out = candidate.rlike("|".join(f"(?:{r})" for r in rules)) if rules else F.lit(False)
    for must, never in (BY_PIECES[r] for r in allowed if r in BY_PIECES):
        out = out | (candidate.rlike(must) & ~candidate.rlike(never))
    return out


def entropy_spans(text: Column, cls: EntropyClass, kind: int, allowed: tuple[str, ...] = ALLOWED) -> Column:
    """Spans from the first to the last window of each candidate that is hot, allow list applied."""
    candidates = F.filter(spans_of(text, cls.pattern, kind), lambda s: ~is_allowed(s["text"], allowed))
    hot = F.transform(candidates, lambda s: let(hot_range(s["text"], cls.window, cls.bits), lambda h: F.struct(
        (s["start"] + h["lo"]).alias("start"), s["kind"].alias("kind"), (s["start"] + h["hi"]).alias("end"), F.lit("").alias("text"))))
    return F.filter(hot, lambda s: s["start"].isNotNull()).cast(SPAN)


def secret_spans(
    docs: DataFrame, text_col: str = "text", classes: tuple[EntropyClass, ...] = ENTROPY_CLASSES, allowed: tuple[str, ...] = ALLOWED, out: str = "secret_spans"
) -> DataFrame:
    """`docs` with a column `out`: array<struct<start int, kind string, end int>> by start, then kind in
    the order assign, access, hex, entropy classes. Positions are code points, ends exclusive. Null and
    empty texts have no spans; spans of different kinds may overlap; a column named as `out` is
    replaced, all others stay whatever their names. Each row is scanned by itself, so ties and repeated
    rows don't matter; texts and runs of any length are scanned whole, in a time that grows with n ** 1.5
    of the number of spans at most; an empty table gives no rows."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    kinds = [k for k, *_ in BASE_KINDS] + [c.name for c in classes]
    parts = [spans_of(text, pattern, i, group, least) for i, (_, pattern, group, least) in enumerate(BASE_KINDS)]
    parts += [entropy_spans(text, c, len(BASE_KINDS) + i, allowed) for i, c in enumerate(classes)]
    names = F.array(*[F.lit(k) for k in kinds])
    named = F.transform(F.array_sort(F.concat(*parts)), lambda s: F.struct(s["start"].alias("start"), F.get(names, s["kind"]).alias("kind"), s["end"].alias("end")))
    return docs.withColumn(out, named)


def spans_text(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def secret_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """`id_col`, n_assign, n_access, n_hex, base_sha256, spans for each row of `docs`; cases as in
    secret_spans."""
    base = [k for k, *_ in BASE_KINDS]
    found = secret_spans(docs.select(id_col, text_col), text_col, **options).select(id_col, "secret_spans")
    count = lambda k: F.size(F.filter("secret_spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    only = F.filter("secret_spans", lambda s: s["kind"].isin(base))
    return found.select(id_col, *[count(k) for k in base], F.sha2(spans_text(only), 256).alias("base_sha256"), spans_text(F.col("secret_spans")).alias("spans"))


def redact_secrets(docs: DataFrame, text_col: str = "text", mark: str = "[secret]", **options) -> DataFrame:
    """`docs` with each stretch of `text_col` that spans cover replaced by `mark`; overlapping and
    touching spans are one stretch. Texts without spans stay as they are, null included; repeated rows
    give equal rows, an empty table an empty one; other columns stay, whatever their names."""
    kept = "__spans"
    while kept in docs.columns:
        kept += "_"
    found = secret_spans(docs, text_col, out=kept, **options)
    text, spans = F.col(text_col), F.col(kept)
    clean = F.when(F.size(spans) > 0, F.array_join(let(stretches(spans), lambda m: pieces_between(text, m)), mark)).otherwise(text)
    return found.withColumn(text_col, clean).drop(kept)


def stretches(spans: Column) -> Column:
    """What ordered spans cover together, as structs of start and end: a stretch begins at a span that
    starts after all spans before it have ended."""
    reach = running(F.transform(spans, lambda s: s["end"]), lambda a, b: F.greatest(a, b))

    def cut(r: Column) -> Column:
        begins = F.filter(F.transform(spans, lambda s, i: F.when((i == 0) | (s["start"] > F.get(r, i - 1)), i)), lambda i: i.isNotNull())
        last = lambda b, k: F.coalesce(F.get(b, k + 1), F.size(spans)) - 1
        return let(begins, lambda b: F.transform(b, lambda i, k: F.struct(F.get(spans, i)["start"].alias("start"), F.get(r, last(b, k)).alias("end"))))

    return let(reach, cut)


def pieces_between(text: Column, cover: Column) -> Column:
    """The pieces of a text before, between and after ordered stretches. They are cut out of runs of
    about the square root of their number, so that no piece is sought from the text's begin."""
    ends = F.concat(F.array(F.lit(0)), F.transform(cover, lambda s: s["end"]))
    bounds = F.zip_with(ends, F.concat(F.transform(cover, lambda s: s["start"]), F.array(F.char_length(text))), lambda a, b: F.struct(a.alias("a"), b.alias("b")))

    def cut(all_: Column) -> Column:
        step = F.ceil(F.sqrt(F.size(all_).cast("double"))).cast("int")
        runs = F.transform(F.sequence(F.lit(0), F.floor((F.size(all_) - 1) / step).cast("int")), lambda q: F.slice(all_, q * step + 1, step))

        def of_run(run: Column) -> Column:
            begin = F.get(run, F.lit(0))["a"]
            whole = F.substring(text, begin + 1, F.element_at(run, -1)["b"] - begin)
            return let(whole, lambda w: F.transform(run, lambda x: F.substring(w, x["a"] - begin + 1, x["b"] - x["a"])))

        return F.flatten(F.transform(runs, of_run))

    return let(bounds, cut)


def oracle() -> str:
    """secret_report of documents in DuckDB's SQL: positions from pieces between matches, and each
    window's entropy from a histogram of its own. Base-64 runs are masked where a word of examples begins,
    and what is left of them is matched again; hexadecimal candidates are whole runs of letters and
    digits."""
    rules = "|".join(f"(?:{a})" for a in ALLOWED)
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    base, n = BASE_KINDS, len(BASE_KINDS)

    def matches(kind: int, least: int, pattern: str, sized: str, text: str = "t", rows: str = "d", keep: str = "0 AS begin") -> str:
        p = quoted(pattern)
        return f"SELECT doc_id, {keep}, {kind} AS kind, {least} AS least, regexp_extract_all({text}, {p}, 0) AS hits, {sized} AS sized, string_split_regex({text}, {p}) AS gaps FROM {rows} WHERE regexp_matches({text}, {p})"

    def placed(rows: str) -> str:
        at = "CAST(begin + list_sum([length(g) for g in gaps[1:nth + 1]]) + coalesce(list_sum([length(h) for h in hits[1:nth]]), 0) AS BIGINT)"
        return f"SELECT doc_id, kind, hits[nth + 1] AS hit, {at} AS start, sized IS NULL OR length(sized[nth + 1]) >= least AS ok FROM (SELECT *, unnest(range(len(hits))) AS nth FROM {rows})"

    whole = [matches(i, least, pattern, f"regexp_extract_all(t, {quoted(pattern)}, {group})") for i, (_, pattern, group, least) in enumerate(base)]
    whole += [matches(n, 0, "[0-9A-Za-z]{24,}", "NULL"), matches(n + 1, 0, f"{RUN}{{20,}}", "NULL")]
    masked = f"array_to_string([CASE WHEN regexp_matches(substring(hit, i, 12), {quoted(f'^(?i:{WORDS})')}) THEN ' ' ELSE hit[i] END for i in range(1, length(hit) + 1)], '')"
    hot = []
    for i, c in enumerate(ENTROPY_CLASSES):
        most = math.floor((math.log2(c.window) - c.bits) * c.window * SCALE)
        own = "regexp_full_match(hit, '[0-9A-Fa-f]{24,}')" if c.name == "entropy_hex" else "true"
        hot.append(f"""SELECT doc_id, {n + i} AS kind, {quoted(c.name)} AS name, start + min(w) AS start, start + max(w) + {c.window} AS stop FROM (
SELECT doc_id, start, hit, unnest(range(length(hit) - {c.window} + 1)) AS w FROM {"s" if i == 0 else "r"} WHERE kind = {n + i} AND {own} AND NOT regexp_matches(hit, {quoted(rules)}))
WHERE list_sum([{entropy_terms(c.window)}[CAST(n AS BIGINT) + 1] for n in map_values(list_aggregate(string_split(substring(hit, w + 1, {c.window}), ''), 'histogram'))]) <= {most} GROUP BY doc_id, start""")
    names = "[" + ", ".join(quoted(k) for k, *_ in base) + "]"
    line = lambda where: f"coalesce(string_agg(name || ':' || start || ':' || stop, ',' ORDER BY start, kind){where}, '')"
    counts = ", ".join(f"CAST(count(*) FILTER (WHERE kind = {i}) AS BIGINT) AS n_{k}" for i, (k, *_) in enumerate(base))
    return f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), m AS ({" UNION ALL ".join(whole)}), s AS ({placed("m")}),
k AS (SELECT doc_id, start AS begin, {masked} AS run FROM s WHERE kind = {n + 1}), p AS ({matches(n + 1, 0, f"{RUN}{{20,}}", "NULL", "run", "k", "begin")}), r AS ({placed("p")}),
a AS (SELECT doc_id, kind, {names}[kind + 1] AS name, start, start + length(hit) AS stop FROM s WHERE ok AND kind < {n} UNION ALL {" UNION ALL ".join(hot)})
SELECT d.doc_id, {counts}, sha256({line(f" FILTER (WHERE kind < {n})")}) AS base_sha256, {line(" FILTER (WHERE kind IS NOT NULL)")} AS spans FROM d LEFT JOIN a ON a.doc_id = d.doc_id GROUP BY d.doc_id"""
