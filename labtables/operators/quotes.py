"""Quotes looked up in their documents: whole, nearly, or by page. All quotes of a document (a bounded
run of them, where a document has very many) are searched in one pass over its text by an automaton."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.cells import squeeze
from ..shared import deal, parts_of

#: Quotes that are searched at once; more of one document go in several runs, each with the text.
RUN_QUOTES = 1_000
#: Letters of the shortest quote that is evidence of anything, for letters and for pages.
LEAST_LETTERS, LEAST_PAGE = 8, 12
NONE, NEAR, EXACT = 0, 1, 2
#: Letters of a piece by which stretches are told apart before they are compared, and bits of its number.
PIECE, HASH_BITS = 4, 16


def automaton_of(patterns: dict[str, list]) -> ahocorasick.Automaton | None:
    """An automaton whose hits give (length, values) of each pattern, or None without any."""
    automaton = ahocorasick.Automaton()
    for pattern, values in patterns.items():
        automaton.add_word(pattern, (len(pattern), values))
    if not len(automaton):
        return None
    automaton.make_automaton()
    return automaton


class Like:
    """A quote of n letters, and the stretches that are at least `cutoff` like it (twice the longest
    common subsequence by both lengths): any n letters of a text, or fewer at the text's ends."""

    def __init__(self, quote: str, cutoff: float):
        self.quote, self.n, self.cutoff = quote, len(quote), cutoff
        self.masks: dict[str, int] = {}
        for i, c in enumerate(quote):
            self.masks[c] = self.masks.get(c, 0) | 1 << i
        self.full = (1 << self.n) - 1
        # letters of the quote, and as many of a stretch of its length, that may be left out
        self.slack = max(k for k in range(self.n + 1) if self.enough(self.n - k, self.n)) if self.n else 0
        # a piece of `size` letters of a stretch is one of the quote's unless a letter left out breaks it: each of
        # the stretch's breaks `size` pieces, each of the quote's one less
        for self.size in range(min(PIECE, max(self.n, 1)), 0, -1):
            self.least = self.n - self.size + 1 - self.slack * (2 * self.size - 1)
            if self.least > 0:
                break

    def enough(self, common: int, size: int) -> bool:
        return 2 * common >= self.cutoff * (self.n + size) - 1e-9

    def rows(self, letters: Iterator[str]) -> Iterator[int]:
        """Longest common subsequence with each beginning of `letters`, a bit-parallel row per letter."""
        state = self.full
        for c in letters:
            hit = state & self.masks.get(c, 0)
            state = ((state + hit) | (state - hit)) & self.full
            yield self.n - state.bit_count()

    def at(self, text: str, start: int) -> bool:
        """Whether the n letters from `start` on are such a stretch."""
        state, masks, full = self.full, self.masks, self.full
        for c in text[start : start + self.n]:
            hit = state & masks.get(c, 0)
            state = ((state + hit) | (state - hit)) & full
        return self.enough(self.n - state.bit_count(), self.n)

    def at_ends(self, text: str) -> bool:
        """Whether a shorter beginning or end of the text is such a stretch."""
        if self.n < 2:
            return False
        back = Like(self.quote[::-1], self.cutoff)
        begins, ends = self.rows(iter(text[: self.n - 1])), back.rows(reversed(text[1 - self.n :]))
        return any(self.enough(common, size) for rows in (begins, ends) for size, common in enumerate(rows, 1))

    def least_at_ends(self) -> float:
        """How many pieces of the quote a shorter stretch at an end has, at least. Both leave out (1 - cutoff)
        of their letters at most, and a stretch is no shorter than its letters in common need."""
        pieces = lambda size: size - self.size + 1 - self.size * (1 - self.cutoff) * (self.n + size)
        return min(pieces(self.cutoff * self.n / (2 - self.cutoff)), pieces(self.n - 1)) - 1e-6

    def within(self, text: str, pieces: Pieces | None = None) -> bool:
        """Whether any stretch of the text is like the quote. Exact: only what has too few of the quote's
        pieces is left out, all other stretches are compared."""
        pieces = pieces or Pieces(text)
        sums = pieces.counted(self.quote, self.size)
        held = lambda begin, end: sums[max(begin, end)] - sums[begin]
        count, ends = len(sums) - 1, max(self.n - self.size, 0)
        least = self.least_at_ends()
        if (held(0, min(ends, count)) >= least or held(max(count - ends, 0), count) >= least) and self.at_ends(text):
            return True
        windows = len(text) - self.n + 1
        if windows <= 0:
            return False
        reach = self.n - self.size + 1
        starts = np.flatnonzero(sums[reach : reach + windows] - sums[:windows] >= self.least)
        return any(self.at(text, start) for start in starts.tolist())


class Pieces:
    """A text's runs of a few letters, by number, for any number of quotes. Numbers are hashes: two runs
    that share one by chance only let a stretch be compared that need not be."""

    def __init__(self, text: str):
        self.letters, self.known = letter_numbers(text), {}

    def counted(self, quote: str, size: int) -> np.ndarray:
        """How many runs of `size` letters before each place of the text are the quote's too."""
        if size not in self.known:
            self.known[size] = runs_of(self.letters, size)
        own = self.known[size]
        table = np.zeros(1 << HASH_BITS, dtype=bool)
        table[runs_of(letter_numbers(quote), size)] = True
        sums = np.zeros(len(own) + 1, dtype=np.int32)
        np.cumsum(table[own], out=sums[1:])
        return sums


def letter_numbers(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def runs_of(letters: np.ndarray, size: int) -> np.ndarray:
    """A hash of HASH_BITS of each run of `size` letters."""
    n = max(len(letters) - size + 1, 0)
    out = np.zeros(n, dtype=np.uint32)
    for i in range(size):
        out = out * np.uint32(0x01000193) + letters[i : i + n]
    return (out * np.uint32(0x9E3779B1)) >> np.uint32(32 - HASH_BITS)


def stands_nearly(quotes: Sequence[str], text: str, cutoff: float) -> set[int]:
    """Which of the quotes have a stretch of the text that is like them, or, if the text is no longer than
    the quote, have a stretch that is like the text. Exact: every stretch that holds enough short pieces of
    a quote to be like it is compared."""
    found, pieces = set(), None
    for k, quote in enumerate(quotes):
        if not quote or not text:
            continue
        if len(quote) >= len(text) and Like(text, cutoff).within(quote):
            found.add(k)
        elif len(quote) <= len(text):
            pieces = pieces or Pieces(text)
            if Like(quote, cutoff).within(text, pieces):
                found.add(k)
    return found


def levels(whole: Sequence[str | None], labels: Sequence[str | None], rests: Sequence[str | None], text: str | None, cutoff: float) -> list[int]:
    """For each quote (its letters, those of its first word, those of the rest) how it stands in the text."""
    out, asked, owners = [], [], []
    text = text or ""
    for k, (q, label, rest) in enumerate(zip(whole, labels, rests)):
        tries = [q] if q and len(q) >= LEAST_LETTERS else []
        if label and len(label) >= 2 and rest and len(rest) >= LEAST_LETTERS and label in text:
            tries.append(rest)
        out.append(EXACT if any(x in text for x in tries) else NONE)
        if out[-1] == NONE:
            asked += tries
            owners += [k] * len(tries)
    for i in stands_nearly(asked, text, cutoff):
        out[owners[i]] = NEAR
    return out


def in_runs(quotes: DataFrame, id_col: str, asked: Column, order: str) -> DataFrame:
    """The distinct quotes of each id as arrays `asked` of about RUN_QUOTES, dealt by a hash."""
    sizes = quotes.groupBy(id_col).agg(F.ceil(F.count(F.lit(1)) / RUN_QUOTES).alias("__runs"))
    dealt = quotes.join(sizes, id_col).withColumn("__run", F.pmod(F.xxhash64(order), F.col("__runs")))
    return dealt.groupBy(id_col, "__run").agg(F.collect_list(asked).alias("asked")).drop("__run")


def quote_levels(quotes: DataFrame, docs: DataFrame, id_col: str, quote: str, text: str, letters, cutoff: float) -> DataFrame:
    """(id, quote, level): the best of NONE, NEAR and EXACT over the documents of the quote's id, a row per
    distinct quote whose id has a document."""
    distinct = quotes.select(F.col(id_col).alias("__id"), F.col(quote).alias("quote")).filter("__id is not null and quote is not null").distinct()
    first, rest = F.substring_index(F.trim("quote"), " ", 1), F.regexp_replace(F.trim("quote"), r"^\S*\s*", "")
    part = F.struct("quote", letters(F.col("quote")).alias("q"), letters(first).alias("l"), letters(rest).alias("r"))
    parts = parts_of(quotes, docs)
    runs = deal(in_runs(distinct, "__id", part, "quote"), parts, "__id")
    texts = deal(docs.select(F.col(id_col).alias("__id"), letters(F.col(text)).alias("__t")), parts, "__id")

    @F.pandas_udf("array<int>")
    def level(asked_q: pd.Series, asked_l: pd.Series, asked_r: pd.Series, t: pd.Series) -> pd.Series:
        return pd.Series([levels(q, l, r, x, cutoff) for q, l, r, x in zip(asked_q, asked_l, asked_r, t)])

    names = F.transform("asked", lambda a: a["quote"])
    found = runs.join(texts, "__id").select("__id", names.alias("quotes"), level("asked.q", "asked.l", "asked.r", "__t").alias("levels"))
    rows = found.select("__id", F.explode(F.arrays_zip("quotes", "levels")).alias("x"))
    return rows.groupBy("__id", F.col("x.quotes").alias("__quote")).agg(F.max("x.levels").alias("__level"))


def first_pages(quotes: Sequence[str], pages: Sequence[str]) -> list[tuple[int | None, int | None]]:
    """For each quote the first page that has it, and the first that has its first six words. One
    automaton over all quotes and beginnings; what is too short to be evidence is on no page."""
    patterns: dict[str, list] = {}
    for k, quote in enumerate(quotes):
        for leg, pattern in enumerate((quote, " ".join(quote.split(" ")[:6]))):
            if len(pattern) >= LEAST_PAGE:
                patterns.setdefault(pattern, []).append((k, leg))
    automaton, out = automaton_of(patterns), [[None, None] for _ in quotes]
    for number, page in enumerate(pages) if automaton else ():
        for _, (_, places) in automaton.iter(page):
            for k, leg in places:
                if out[k][leg] is None:
                    out[k][leg] = number
    return [tuple(x) for x in out]


def quote_pages(quotes: DataFrame, pages: DataFrame, id_col: str) -> DataFrame:
    """(id, quote, q1, q2) of distinct quotes (id, quote) from pages (id, part, page, flat): the page of
    the first part that has the quote, and of the first that has its beginning. Of several documents of
    one id the earliest part counts."""
    flat = F.lower(squeeze("quote"))
    distinct = quotes.filter(F.col(id_col).isNotNull() & F.col("quote").isNotNull()).select(id_col, "quote").distinct()
    runs = in_runs(distinct, id_col, F.struct("quote", flat.alias("flat")), "quote")

    @F.pandas_udf("array<struct<one:int,two:int>>")
    def search(asked: pd.Series, texts: pd.Series) -> pd.Series:
        return pd.Series([[{"one": a, "two": b} for a, b in first_pages(list(q), list(x))] for q, x in zip(asked, texts)])

    found = runs.join(pages.filter("pages is not null"), id_col).withColumn("hits", search(F.transform("asked", lambda a: a["flat"]), F.transform("pages", lambda p: p["flat"])))
    place = lambda k: F.get("pages", k)
    each = F.transform(
        F.arrays_zip(F.col("asked").alias("a"), F.col("hits").alias("h")),
        lambda x: F.struct(x["a"]["quote"].alias("quote"), *(F.struct(place(x["h"][leg])["part"].alias("part"), place(x["h"][leg])["page"].alias("page")).alias(leg) for leg in ("one", "two"))),
    )
    rows = found.select(id_col, F.inline(each))
    first = lambda leg: F.min_by(f"{leg}.page", f"{leg}.part")
    return rows.groupBy(id_col, "quote").agg(first("one").alias("__q1"), first("two").alias("__q2"))
