"""Columns from columns: parsing, naming and display of single cells. All are built-in expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# What counts as no number, the form of a number, invisible characters.
NUMBER_SENTINELS = ("", "none", "na", "n/a", "unknown atom type (vabc/naring/mordred.ringcount.rings()/naring/nbonds)")
NUMBER_FORM = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"
BARE_NUMBER = r"^[+-]?(?:\d++(?:\.\d*+)?|\.\d++)(?:[eE][+-]?\d++)?\z"
INVISIBLE = "﻿​‌‍⁠"
SUBSCRIPTS = "₀₁₂₃₄₅₆₇₈₉⁰¹²³⁴⁵⁶⁷⁸⁹"
PLACEHOLDERS = (
    "", "na", "n/a", "n.a.", "nan", "null", "none reported", "not reported", "not stated", "not given", "not available", "not provided",
    "not mentioned", "not specified", "not applicable", "unknown", "no data", "-", "--", "—", "?",
)
ZERO_CELSIUS = 273.15
# fixed values: forms of a concentration
WEIGHT_SHARE = r"(?i)(\d+(?:\.\d+)?)\s*(?:wt|weight)\s*\.?\s*%"
RATIO = r"(\d+(?:\.\d+)?)\s*[:/]\s*(\d+(?:\.\d+)?)"
EQUALS_NUMBER = r"=\s*(\d+(?:\.\d+)?)"


def text(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def trim_all(c: Column | str) -> Column:
    """Unicode white space off both ends."""
    return F.regexp_replace(text(c), r"(?U)^\s+|\s+$", "")


def squeeze(c: Column | str) -> Column:
    """Runs of Unicode white space as one space, ends trimmed."""
    return trim_all(F.regexp_replace(text(c), r"(?U)\s+", " "))


def is_blank(c: Column | str) -> Column:
    return F.coalesce(~text(c).rlike(r"(?U)\S"), F.lit(True))


def parse_number(c: Column | str, strict: bool = False, sentinels: tuple[str, ...] = NUMBER_SENTINELS) -> Column:
    """A number, or null for null and sentinel cells. Other text is null too, or an error if strict."""
    cell = trim_all(c)
    number = F.when(cell.rlike(NUMBER_FORM), cell.try_cast("double"))
    if strict:
        number = F.when(cell.rlike(NUMBER_FORM), cell.try_cast("double")).otherwise(F.raise_error(F.concat(F.lit("not a number: "), cell)).cast("double"))
    return F.when(cell.isNull() | F.lower(cell).isin(*sentinels), None).otherwise(number)


def is_junk_number(c: Column | str, sentinels: tuple[str, ...] = NUMBER_SENTINELS) -> Column:
    """Whether a lenient parse_number turned text into null."""
    cell = trim_all(c)
    return F.coalesce(~F.lower(cell).isin(*sentinels) & ~cell.rlike(NUMBER_FORM), F.lit(False))


def parse_text(c: Column | str) -> Column:
    """Text with invisible characters off, white space (no-break too) squeezed, empty as null."""
    return F.nullif(squeeze(F.translate(text(c), INVISIBLE, "")), F.lit(""))


def normal_header(c: Column | str) -> Column:
    return F.lower(squeeze(F.translate(text(c), INVISIBLE, "")))


def camel_id(c: Column | str) -> Column:
    """A header as an identifier: ?% off, ():/*^ as spaces, words joined in camel case; words in
    capitals keep them beyond the first place."""
    words = F.split(squeeze(F.regexp_replace(F.regexp_replace(text(c), "[?%]", ""), r"[():/*^,.\-]", " ")), " ")
    shout = lambda w: w.rlike("^[A-Z0-9]{2,}$")
    first = lambda w: F.when(shout(w), F.lower(w)).otherwise(F.concat(F.lower(F.substring(w, 1, 1)), F.substring(w, F.lit(2), F.length(w))))
    rest = lambda w: F.when(shout(w), w).otherwise(F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, F.lit(2), F.length(w))))
    return F.array_join(F.transform(words, lambda w, i: F.when(i == 0, first(w)).otherwise(rest(w))), "")


def snake_id(c: Column | str) -> Column:
    """A header as a snake-case identifier; one that begins with a digit gets f_ before it."""
    name = F.regexp_replace(F.regexp_replace(F.lower(text(c)), "[^0-9a-z]+", "_"), "^_+|_+$", "")
    return F.when(name.rlike("^[0-9]"), F.concat(F.lit("f_"), name)).otherwise(name)


def display_name(label: Column | str, unit: Column | str) -> Column:
    """label (unit), unless the label already ends so or there is no unit."""
    label, unit = text(label), text(unit)
    suffix = F.concat(F.lit(" ("), unit, F.lit(")"))
    return F.when(unit.isNull() | (unit == "") | label.endswith(suffix), label).otherwise(F.concat(label, suffix))


def header_unit(label: Column | str) -> Column:
    """The unit in the trailing brackets of a header; S/cm for conductivity columns."""
    label = text(label)
    found = F.nullif(F.regexp_extract(label, r"\(([^()]+)\)\s*$", 1), F.lit(""))
    return F.when(label.startswith("Conductivity at "), "S/cm").otherwise(found)


def axis_transform(mode: str, t: Column | str, tg: Column | str | None = None) -> Column:
    """Temperature in Celsius on one of four axes; null where undefined. The last two need the raw
    glass transition."""
    t = text(t)
    if mode == "T":
        return t.cast("double")
    if mode == "arrhenius":
        return F.try_divide(F.lit(1000.0), t + ZERO_CELSIUS)
    tg = text(tg)
    if mode == "tg_ratio":
        return F.try_divide(t + ZERO_CELSIUS, tg + ZERO_CELSIUS)
    if mode == "tg_shifted":
        return F.try_divide(F.lit(1000.0), t - tg + 50)
    raise ValueError(f"no such axis: {mode}")


def log10_positive(c: Column | str) -> Column:
    c = text(c)
    return F.when(c > 0, F.log10(F.when(c > 0, c)))


def yes_no(c: Column | str) -> Column:
    word = F.lower(trim_all(c))
    return F.when(word == "no", 0.0).when(word == "yes", 1.0)


def number_with_unit(c: Column | str) -> Column:
    """A number, alone or before a unit ("55 °C", "24 h"). Most cells are numbers alone, which one test tells."""
    cell = text(c)
    led = F.regexp_extract(trim_all(cell), r"^([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)\s*(?:[^\d\s+\-–.][^\d]*)?$", 1)
    return F.when(cell.rlike(BARE_NUMBER), cell).otherwise(led).try_cast("double")  # what is no number is empty text


def squash(c: Column | str) -> Column:
    """Sub- and superscript digits plain, lower case, no white space, dashes or underscores."""
    plain = F.translate(F.translate(text(c), SUBSCRIPTS, "01234567890123456789"), INVISIBLE, "")
    return F.lower(F.regexp_replace(plain, r"(?U)[\s_\-‐‑‒–—−]+", ""))


def canonical_text(c: Column | str) -> Column:
    """Lower case, white space squeezed, dots off the end; null for blank cells."""
    plain = F.lower(squeeze(F.translate(text(c), INVISIBLE[0], "")))
    return F.when(~is_blank(c), F.regexp_replace(plain, r"\.+$", ""))


def canonical_family(c: Column | str) -> Column:
    """Parts of a family name in any order, as a sorted set: parted by comma, semicolon, slash or the word
    and; lower case, poly before a part and a plural s after it off. Null for blank cells."""
    parts = F.split(canonical_text(c), r"[,;/]| and ")
    clean = lambda p: F.regexp_replace(trim_all(F.regexp_replace(trim_all(p), "^poly", "")), "s$", "")
    return F.array_sort(F.array_distinct(F.transform(F.filter(parts, lambda p: trim_all(p) != ""), clean)))


def vocab_snap(c: Column | str, words: tuple[str, ...], synonyms: dict[str, str] | None = None) -> Column:
    """The one word of a small vocabulary that stands in the text; the text itself if none or several do."""
    cell = F.lower(squeeze(c))
    targets = {w: w for w in words} | (synonyms or {})
    found = F.array_distinct(F.array_compact(F.array(*[F.when(cell.rlike(rf"\b{re.escape(w)}\b"), F.lit(to)) for w, to in targets.items()])))
    return F.when(F.size(found) == 1, F.get(found, F.lit(0))).otherwise(cell)


def bare_doi(c: Column | str) -> Column:
    """A DOI without its resolver address."""
    return F.regexp_replace(trim_all(c), r"(?i)^(https?://)?(dx\.)?doi\.org/|^doi:\s*", "")


def doi_from_file(name: Column | str) -> Column:
    return F.regexp_replace(F.regexp_replace(text(name), r"\.[A-Za-z0-9]{1,5}$", ""), "@", "/")


def file_id(name: Column | str) -> Column:
    """What stands before the first dash of a file name; an error without a dash."""
    name = text(name)
    return F.when(name.contains("-"), F.substring_index(name, "-", 1)).otherwise(F.raise_error(F.concat(F.lit("no id in "), name)).cast("string"))


def content_id(c: Column | str, digits: int = 8) -> Column:
    return F.left(F.sha2(text(c).cast("binary"), 256), F.lit(digits))


def year_in(c: Column | str) -> Column:
    return F.nullif(F.regexp_extract(text(c), r"(?<!\d)(19\d\d|20\d\d)(?!\d)", 1), F.lit("")).cast("int")


def year_of_file(name: Column | str) -> Column:
    """The year in a file name, not in its id before the first dash, which may look like one."""
    name = text(name)
    rest = F.substring(name, F.length(F.substring_index(name, "-", 1)) + 1, F.length(name))
    return year_in(F.when(name.contains("-"), rest).otherwise(name))


def parse_concentration(c: Column | str) -> Column:
    """A phrase as struct(kind, value, note): N wt%; else a ratio a:b or a/b, or = N where O or Li occurs.
    A ratio of 1 or more is oxygens per lithium and is inverted, with a note if lithium comes first."""
    c = text(c)
    number = lambda pattern, g: F.nullif(F.regexp_extract(c, pattern, g), F.lit("")).try_cast("double")
    share = number(WEIGHT_SHARE, 1)
    ratio = F.when(c.rlike(RATIO), F.try_divide(number(RATIO, 1), number(RATIO, 2))).when(c.contains("O") | c.contains("Li"), number(EQUALS_NUMBER, 1))
    ratio = F.when(ratio != 0, ratio)
    inverted = ratio >= 1
    value = F.when(share.isNotNull(), share).otherwise(F.bround(F.when(inverted, F.try_divide(F.lit(1.0), ratio)).otherwise(ratio), 6))
    kind = F.when(share.isNotNull(), "salt wt%").when(ratio.isNotNull(), "Li:functional group")
    note = F.when(share.isNull() & inverted & F.lower(trim_all(c)).startswith("li"), "read as oxygens per lithium")
    return F.struct(kind.alias("kind"), value.alias("value"), note.alias("note"))


def condition_of(sample: Column | str) -> Column:
    """The condition in a sample's name: degrees, else 0 for thermal or without initiator, else per cent."""
    sample = text(sample)
    number = lambda pattern: F.nullif(F.regexp_extract(sample, pattern, 1), F.lit("")).try_cast("double")
    return F.coalesce(number(r"(\d+(?:\.\d+)?)\s*°\s*C"), F.when(sample.rlike("(?i)thermal|no initiator|without initiator"), 0.0), number(r"(?i)(\d+(?:\.\d+)?)\s*(?:wt|%)"))


def inverted_index_text(index: Column | str) -> Column:
    """Text from map<word, positions>: words by position, then by word; null for an empty map."""
    pairs = F.flatten(F.transform(F.map_entries(text(index)), lambda e: F.transform(e["value"], lambda p: F.struct(p.alias("at"), e["key"].alias("word")))))
    return F.nullif(F.array_join(F.transform(F.array_sort(pairs), lambda p: p["word"]), " "), F.lit(""))


def split_list(c: Column | str) -> Column:
    return F.filter(F.transform(F.split(text(c), ","), trim_all), lambda p: p != "")


def source_line(kind: Column, label: Column, page: Column, quote: Column) -> Column:
    """A source as one line: Table IV, page 12; a text source gets its quote."""
    name = F.coalesce(F.nullif(label, F.lit("")), F.initcap(kind))
    at = F.concat_ws(", ", name, F.concat(F.lit("page "), page.cast("string")))
    return F.when((kind == "text") & quote.isNotNull(), F.concat(at, F.lit(': "'), quote, F.lit('"'))).otherwise(at)


def spreadsheet_safe(c: Column | str) -> Column:
    """A text that a spreadsheet would run as a formula gets a quote before it."""
    c = text(c)
    return F.when(c.rlike(r"^[=+\-@\t\r]"), F.concat(F.lit("'"), c)).otherwise(c)


def is_placeholder(c: Column | str, field: Column | str | None = None, real_words: dict[str, tuple[str, ...]] | None = None) -> Column:
    """Whether a cell holds a word for "nothing", except where it is a real value of its field."""
    word = F.regexp_replace(F.lower(trim_all(c)), r"\.+$", "")
    out = F.coalesce(word.isin(*PLACEHOLDERS), F.lit(False))
    for name, words in (real_words or {}).items():
        out = out & ~((text(field) == name) & word.isin(*words))
    return out


def natural_key(c: Column | str) -> Column:
    """A sort key that reads runs of digits as numbers, of any length: each run, without zeros before it,
    comes after its number of digits, and that after its own number of digits."""
    c = F.lower(text(c))
    pieces = F.regexp_extract_all(c, F.lit(r"(\d+|\D+)"), F.lit(1))
    bare = lambda p: F.regexp_replace(p, "^0+(?=.)", "")
    size = lambda d: F.length(d).cast("string")
    led = lambda d: F.concat(size(size(d)), size(d), d)
    return F.array_join(F.transform(pieces, lambda p: F.when(p.rlike(r"^\d"), led(bare(p))).otherwise(p)), "")
