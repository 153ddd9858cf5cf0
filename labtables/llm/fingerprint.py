"""Document fingerprints by locally consistent parsing.

A text's characters are parsed into phrases, the phrases into longer phrases, level by level. Where a
phrase begins is decided by deterministic coin tossing: each symbol is replaced by the position and
value of the lowest bit in which its name differs from its left neighbour's, three times over, which
leaves labels under 8; local minima of the labels begin phrases. A symbol's phrase so depends on a few
neighbours only, and a phrase's name on nothing but its content, so equal substrings have equal
phrases inside whatever their offset. The lowest SIZE hashes of the names at LEVELS are the
fingerprint, and two fingerprints estimate the Jaccard similarity of their texts' phrase sets.

All texts of a slice are parsed at once in numpy; a text's first symbol always begins a phrase, so
neighbouring texts don't touch each other.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices

#: Levels whose phrase names are signatures (phrases of about 9 and 27 characters), and how many of
#: the lowest hashes a fingerprint keeps.
LEVELS = (2, 3)
SIZE = 64
ODD = np.uint64(0x9E3779B97F4A7C15)
LOWEST_BIT = np.array([0] + [(x & -x).bit_length() - 1 for x in range(1, 256)], np.uint8)
POWERS = np.array([pow(0x5851F42D4C957F2D, k, 1 << 64) for k in range(64)], np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit integers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def phrases(names: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The next level: names of the phrases of `names`, and which of them begin a text. `first` says
    which names begin a text."""
    # runs of one name become one symbol, so that neighbours differ
    begins = first.copy()
    begins[1:] |= names[1:] != names[:-1]
    at = np.flatnonzero(begins)
    run = np.diff(at, append=len(names)).astype(np.uint64)
    symbols, first = names[at], first[at]
    long = run > 1
    symbols[long] = mixed(symbols[long] ^ (run[long] * ODD))
    # coin tossing: 64-bit names to labels under 130, then under 16, then under 8
    before = np.empty_like(symbols)
    before[1:], before[first] = symbols[:-1], symbols[first] ^ np.uint64(1)
    differ = symbols ^ before
    low = np.bitwise_count((differ & (~differ + np.uint64(1))) - np.uint64(1))
    label = (2 * low + ((symbols >> low.astype(np.uint64)) & np.uint64(1)).astype(np.uint8)).astype(np.uint8)
    for _ in range(2):
        left = np.empty_like(label)
        left[1:], left[first] = label[:-1], label[first] ^ 1
        low = LOWEST_BIT[label ^ left]
        label = 2 * low + ((label >> low) & 1)
    opens = first.copy()
    if len(label) > 2:
        opens[1:-1] |= (label[1:-1] < label[:-2]) & (label[1:-1] < label[2:]) & ~first[2:]
    start = np.flatnonzero(opens)
    length = np.diff(start, append=len(symbols))
    place = np.arange(len(symbols)) - np.repeat(start, length)
    sums = np.add.reduceat(mixed(symbols) * POWERS[place & 63], start)
    return mixed(sums + length.astype(np.uint64) * ODD), first[start]


def signatures(texts: list[str]) -> list[np.ndarray]:
    """Per text the lowest SIZE distinct 32-bit hashes of its phrase names, ascending; empty for the
    empty text."""
    sizes = np.array([len(t) for t in texts], np.int64)
    out = [np.zeros(0, np.uint32)] * len(texts)
    held = np.flatnonzero(sizes)
    if not len(held):
        return out
    codes = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
    names, first = mixed(codes + ODD), np.zeros(len(codes), bool)
    first[np.concatenate([[0], np.cumsum(sizes[held])[:-1]])] = True
    keys = []
    for level in range(1, max(LEVELS) + 1):
        names, first = phrases(names, first)
        if level in LEVELS:
            hashes = mixed(names ^ np.uint64(level)) >> np.uint64(32)
            keys.append((np.cumsum(first) - 1).astype(np.uint64) << np.uint64(32) | hashes)
    keys = np.unique(np.concatenate(keys))
    owner = (keys >> np.uint64(32)).astype(np.int64)
    begins = np.searchsorted(owner, np.arange(len(held) + 1))
    low = keys.astype(np.uint32)
    for k, i in enumerate(held.tolist()):
        out[i] = low[begins[k] : min(begins[k + 1], begins[k] + SIZE)]
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Estimated Jaccard similarity: of the lowest SIZE hashes of both together, the share in both.
    Exact where neither text has more; 1 for two empty texts."""
    x, y = set(a.tolist()), set(b.tolist())
    both = sorted(x | y)[:SIZE]
    return sum(h in x and h in y for h in both) / len(both) if both else 1.0


def written_out(signature: np.ndarray) -> str:
    return signature.astype(">u4").tobytes().hex()


def fingerprint(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: `id_col`, n_chars, fingerprint (hexadecimal). Null is as empty, and empty
    texts have the empty fingerprint; equal texts have equal ones; other columns are not read."""
    key = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        for batch in slices(batches, text_col, 1_000_000):
            texts = [t or "" for t in batch.column(text_col).to_pylist()]
            marks = [written_out(s) for s in signatures(texts)]
            yield pa.RecordBatch.from_arrays([batch.column(id_col), pa.array(map(len, texts), pa.int64()), pa.array(marks, pa.string())], [id_col, "n_chars", "fingerprint"])

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {key}, n_chars long, fingerprint string")


LEAST = -(1 << 63)


def range_cuts(quantiles: list[int]) -> list[tuple[int, int]]:
    """Ascending cuts (k, d) between ranges from quantiles of k, repeats included: a k that is several
    quantiles is cut by d, a hash, into as many even parts."""
    out = []
    for k, m in sorted(Counter(quantiles).items()):
        out += [(k, LEAST + (j << 64) // m) for j in range(m)]
    return out


def range_numbers(cuts: list[tuple[int, int]], k: np.ndarray, d: np.ndarray) -> np.ndarray:
    """How many cuts are at or below each (k, d)."""
    ks, ds = (np.array([c[i] for c in cuts], np.int64) for i in (0, 1))
    out = np.searchsorted(ks, k, side="right")
    hot, n = np.unique(ks, return_counts=True)
    for v in hot[n > 1].tolist():
        here, first = k == v, np.searchsorted(ks, v)
        out[here] = first + np.searchsorted(ds[ks == v], d[here], side="right")
    return out.astype(np.int32)


def with_neighbours(docs: DataFrame, id_col: str, text_col: str, partitions: int) -> DataFrame:
    """The rows dealt into ranges of descending id, each sorted, with the range's successor as a last
    row (tail = 1). Columns k (the id, the least long for null), d (a hash of the text, by which rows of
    one id are ordered), id, text, tail.

    Ranges are cut at quantiles of the id column, and inside an id that many rows have by the hash; a
    range's first row, of which there is one per partition, is also sent to the range before it, so no
    task needs to see another's rows."""
    d = F.bitwise_not(F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))))
    keyed = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(LEAST)).alias("k"), d.alias("d"), F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    shares = [i / partitions for i in range(1, partitions)]
    found = keyed.agg(F.percentile_approx("k", shares, 10 * max(partitions, 1000)).alias("q")).first().q if shares else []
    cuts = range_cuts(found or [])

    @F.pandas_udf("int")
    def range_of(k: pd.Series, d: pd.Series) -> pd.Series:
        return pd.Series(range_numbers(cuts, k.to_numpy(np.int64), d.to_numpy(np.int64)))

    numbered = keyed.select("k", "d").withColumn("r", range_of("k", "d"))
    heads = sorted((r.r, r.h.k, r.h.d) for r in numbered.groupBy("r").agg(F.max(F.struct("k", "d")).alias("h")).collect())  # one row per range
    before = {(k, d): heads[(i + 1) % len(heads)][0] for i, (_, k, d) in enumerate(heads)}

    @F.pandas_udf("array<int>")
    def places(k: pd.Series, d: pd.Series) -> pd.Series:
        own = range_numbers(cuts, k.to_numpy(np.int64), d.to_numpy(np.int64)).tolist()
        return pd.Series([[r, before[x]] if x in before else [r] for r, x in zip(own, zip(k.tolist(), d.tolist()))])

    dealt = keyed.select("k", "d", "id", "text", F.posexplode(places("k", "d")).alias("tail", "r"))
    return dealt.repartitionById(len(cuts) + 1, F.col("r")).sortWithinPartitions("tail", F.col("k").desc(), F.col("d").desc(), F.col("text").asc_nulls_first()).drop("r")


def _runs_of_rows(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[list[tuple]]:
    """Rows in runs of about `limit` characters; each run begins with the last row of the one before.
    Of the tail rows only the first is kept."""
    rows, size, tailed = [], 0, False
    for batch in slices(batches, "text", limit):
        for doc_id, text, tail in zip(batch.column("id").to_pylist(), batch.column("text").to_pylist(), batch.column("tail").to_pylist()):
            if tail and tailed:
                continue
            tailed |= bool(tail)
            rows.append((doc_id, text or "", tail))
            size += len(rows[-1][1])
            if size > limit and len(rows) > 1:
                yield rows
                rows, size = rows[-1:], len(rows[-1][1])
    if len(rows) > 1:
        yield rows


def edited_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", partitions: int | None = None) -> DataFrame:
    """Fingerprints of each text and of its edited text, in which the last third of the characters is
    replaced by the first as many of the next document by descending id (after the last: the first;
    null ids last; rows of one id by a hash of their text). Returns `id_col`, n_chars, edited_sha256,
    fingerprint, edited_fingerprint, near_edited, near_next. Null is as the empty text; a single row is
    its own next; an empty table gives no rows; texts of any length are parsed whole; other columns are
    not read. Ids are whole numbers, or text of such; others end the job. Texts are shuffled once."""
    n = partitions or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches):
        for rows in _runs_of_rows(batches, 700_000):
            texts = [t for _, t, _ in rows]
            edited = [t[: len(t) - len(t) // 3] + after[: len(t) // 3] for t, after in zip(texts, texts[1:])]
            own, changed = signatures(texts), signatures(edited)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([r[0] for r in rows[:-1]], pa.int64()), pa.array([len(t) for t in texts[:-1]], pa.int64()),
                    pa.array([hashlib.sha256(t.encode()).hexdigest() for t in edited]), pa.array([written_out(s) for s in own[:-1]]), pa.array([written_out(s) for s in changed]),
                    pa.array([likeness(a, b) for a, b in zip(own, changed)], pa.float64()), pa.array([likeness(a, b) for a, b in zip(own, own[1:])], pa.float64()),
                ],
                [id_col, "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
            )

    schema = f"`{id_col}` long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    if docs.select(id_col).isEmpty():
        return docs.sparkSession.createDataFrame([], schema)
    return with_neighbours(docs, id_col, text_col, n).select("id", "text", "tail").mapInArrow(run, schema)
