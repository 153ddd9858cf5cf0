"""Removal of repeated passages by recompression.

Rounds name runs of equal words and pairs of adjacent symbols. A name is a hash of what it stands for and
of the round, so names are global without a shuffle, and whether a symbol joins its neighbour depends on
the two alone: equal passages get equal symbols inside, whatever stands around them. Each symbol carries
the words that decided it. A pair of adjacent symbols whose deciding words lie in a window is in each
document with that window, so a window with a pair that stands in one document only is nobody else's.
What is left is held to fingerprints of 128 bits of whole windows, with the smallest document of each.

Documents are written once as slices, one row each, of word codes and a list of words. A slice sends each
name once, sorted in hash buckets of bounded size, and gets a bit for each back; so a passage that
a third of all documents share costs one entry a slice, and no group of documents is ever gathered.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, map_arrow, packed, slices, unpacked, written

#: Words of a window.
WINDOW = 13
#: What each round names, and how many words a symbol that takes part may stand for.
ROUNDS = (("run", 1), ("pair", 1), ("pair", 2))
#: Bytes of text of a slice, and names in a bucket, about.
SLICE_BYTES = 8_000_000
BUCKET_NAMES = 500_000
#: Bytes of a slice for each bucket at least. Beyond some terabytes buckets grow with the input, unless
#: slices do: slices of 64 MB have buckets of some 80 million names at 100 TB.
BYTES_A_BUCKET = 600
FAR = 1 << 29
LAST_ID = (1 << 63) - 1
SLICE_SCHEMA = "slice long, n_words long, ids binary, nulls binary, counts binary, codes binary, words binary"
SENT_SCHEMA = "slice long, bucket int, names binary, extra binary"


def mixed(x: np.ndarray) -> np.ndarray:
    """A hash of 64-bit integers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Slice:
    """Some documents as word codes, with the hashes of their words."""

    def __init__(self, row: dict, codes: np.ndarray | None = None, words: bytes | None = None):
        """`codes` and `words` of a row where they are packed; else it has them plainly."""
        self.key: int = row["slice"]
        self.ids, self.nulls = np.frombuffer(row["ids"], "<i8"), np.frombuffer(row["nulls"], np.uint8)
        self.counts = np.frombuffer(row["counts"], "<i8")
        self.codes = np.frombuffer(pa.decompress(row["codes"], 4 * row["n_words"], "zstd", asbytes=True), "<u4") if codes is None else codes
        words = row["words"] if words is None else words
        self.words = words.split(b" ") if words else []
        digests = np.frombuffer(b"".join([xxhash.xxh3_128_digest(w) for w in self.words]), "<u8").reshape(-1, 2)
        self.hashes = digests[self.codes]
        self.doc = np.repeat(np.arange(len(self.counts), dtype=np.int32), self.counts)
        self.ranks = np.where(self.nulls == 1, LAST_ID, self.ids)

    def symbols(self) -> tuple[np.ndarray, ...]:
        """The symbols after all rounds: name, first and last word that decided it, document."""
        n = len(self.codes)
        if not n:
            return np.zeros(0, np.uint64), *(np.zeros(0, np.int32),) * 3
        name, doc = self.hashes[:, 0].copy(), self.doc
        low, high = np.arange(n, dtype=np.int32), np.arange(1, n + 1, dtype=np.int32)
        size = np.ones(n, np.int32)
        for k, (kind, most) in enumerate(ROUNDS):
            n = len(name)
            free = size <= most
            near = doc[1:] == doc[:-1]
            if kind == "run":
                joins = near & (name[1:] == name[:-1]) & free[1:] & free[:-1]
                asks_left = asks_right = free
            else:
                side = mixed(name + np.uint64(7919 * k + 1)) & np.uint64(1) == 0
                asks_right, asks_left = free & side, free & ~side
                joins = near & asks_right[:-1] & asks_left[1:]
            first = np.flatnonzero(np.append(True, ~joins))
            last = np.append(first[1:], n) - 1
            many = last > first
            # a symbol is decided by the neighbour it could have joined; at a text's end that is unknown
            left, right = np.full(n, -FAR, np.int32), np.full(n, FAR, np.int32)
            left[1:][near], right[:-1][near] = low[:-1][near], high[1:][near]
            open_left, open_right = asks_left[first], asks_right[last]
            if kind == "pair":
                open_left, open_right = open_left & ~many, open_right & ~many
            low = np.where(open_left, np.minimum(low[first], left[first]), low[first])
            high = np.where(open_right, np.maximum(high[last], right[last]), high[last])
            if kind == "run":
                joined = mixed(name[first] + (last - first + 1).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
            else:
                joined = mixed(name[first] * np.uint64(3) + mixed(name[last]) + np.uint64(k))
            size = np.add.reduceat(size, first)
            name, doc = np.where(many, joined, name[first]), doc[first]
        return name, low, high, doc

    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Pairs of adjacent symbols that a window can decide: name, first and last word, document."""
        name, low, high, doc = self.symbols()
        low, high = np.minimum(low[:-1], low[1:]), np.maximum(high[:-1], high[1:])
        use = (doc[1:] == doc[:-1]) & (high - low <= WINDOW)
        return mixed(name[:-1] * np.uint64(31) + mixed(name[1:]))[use], low[use], high[use], doc[:-1][use]

    def candidates(self, pairs: tuple[np.ndarray, ...], shared: np.ndarray) -> np.ndarray:
        """The windows none of whose pairs stands in one document only."""
        n, (_, low, high, _) = len(self.codes), pairs
        alone = ~shared
        starts, ends = np.maximum(high[alone] - WINDOW, 0), low[alone] + 1
        blocked = np.cumsum(np.bincount(starts, minlength=n + 1) - np.bincount(ends, minlength=n + 1)) > 0
        at = np.flatnonzero(~blocked[: max(0, n - WINDOW + 1)])
        return at[self.doc[at] == self.doc[at + WINDOW - 1]]

    def fingerprints(self, at: np.ndarray) -> np.ndarray:
        """128 bits of each window's words, as two columns."""
        out = np.zeros((2, len(at)), np.uint64)
        weights = mixed(np.arange(1, 2 * WINDOW + 1, dtype=np.uint64)) | np.uint64(1)
        for j in range(WINDOW):
            for side in (0, 1):
                out[side] += mixed(self.hashes[at + j, side] + weights[2 * j + side]) * weights[2 * j + side]
        return out


class Sending:
    """Distinct entries of a slice in buckets: the order in which they are sent is the order of replies."""

    def __init__(self, keys: np.ndarray, buckets: np.ndarray):
        """`keys`: one or two rows of integers for each item; `buckets`: theirs."""
        order = np.lexsort((*keys[::-1], buckets))
        changed = np.zeros(len(order), bool)
        changed[:1] = True
        for k in (*keys, buckets):
            changed[1:] |= k[order[1:]] != k[order[:-1]]
        self.first = np.flatnonzero(changed)
        self.order = order
        self.entry = np.empty(len(order), np.int64)
        self.entry[order] = np.cumsum(changed) - 1
        self.keys = keys[:, order[self.first]]
        self.buckets = buckets[order[self.first]]
        opens = np.append(True, self.buckets[1:] != self.buckets[:-1])[: len(self.buckets)]
        self.at = np.append(np.flatnonzero(opens), len(self.buckets))

    def least(self, values: np.ndarray) -> np.ndarray:
        return np.minimum.reduceat(values[self.order], self.first) if len(self.first) else values[:0]

    def most(self, values: np.ndarray) -> np.ndarray:
        return np.maximum.reduceat(values[self.order], self.first) if len(self.first) else values[:0]

    def rows(self, key: int, kind: str, extra: np.ndarray) -> pa.RecordBatch:
        """A row per bucket: its keys one column after another, of the first, which ascends, the steps, and
        `extra` of each."""
        spans = list(zip(self.at[:-1].tolist(), self.at[1:].tolist()))
        steps = self.keys.astype(kind)
        steps[0, 1:] -= steps[0, :-1].copy()
        steps[0, self.at[:-1]] = self.keys[0, self.at[:-1]]
        return pa.RecordBatch.from_arrays(
            [
                pa.array([key] * len(spans), pa.int64()), pa.array(self.buckets[self.at[:-1]], pa.int32()),
                pa.array([packed(steps[:, i:j]) for i, j in spans], pa.binary()),
                pa.array([packed(extra[i:j]) for i, j in spans], pa.binary()),
            ],
            ["slice", "bucket", "names", "extra"],
        )

    def replied(self, replies: list[dict] | None) -> np.ndarray:
        """The bit of each entry."""
        bits = {r["bucket"]: r["bits"] for r in replies or []}
        parts = []
        for i, j in zip(self.at[:-1].tolist(), self.at[1:].tolist()):
            parts.append(np.unpackbits(np.frombuffer(bits[int(self.buckets[i])], np.uint8), count=j - i))
        return np.concatenate([*parts, np.zeros(0, np.uint8)]).astype(bool)


def names_sent(part: Slice, buckets: int) -> tuple[Sending, tuple[np.ndarray, ...]]:
    pairs = part.pairs()
    upper = ((pairs[0] >> np.uint64(32)) % np.uint64(buckets)).astype(np.int32)
    return Sending((pairs[0] & np.uint64(0xFFFFFFFF))[None, :], upper), pairs


def windows_sent(part: Slice, buckets: int, replies: list[dict] | None) -> tuple[Sending, np.ndarray]:
    sending, pairs = names_sent(part, buckets)
    at = part.candidates(pairs, sending.replied(replies)[sending.entry])
    prints = part.fingerprints(at)
    return Sending(prints, (prints[0] % np.uint64(buckets)).astype(np.int32)), at


def document_slices(df: DataFrame, id_col: str, text_col: str, slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """Rows of SLICE_SCHEMA: documents in the order in which a task reads them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, k = TaskContext.get().partitionId() << 32, 0
        for batch in slices(batches, "t", slice_bytes):
            ids = batch.column("k")
            lists = pc.ascii_split_whitespace(pc.utf8_trim(batch.column("t").fill_null(""), "\t\n\x0b\x0c\r "))
            words = lists.flatten()
            # the split gives an empty word for a text without any
            some = pc.not_equal(words, "").to_numpy(zero_copy_only=False)
            ends = np.append(0, np.cumsum(some))[lists.offsets.to_numpy() - lists.offsets[0].as_py()]
            coded = words.filter(pa.array(some)).dictionary_encode()
            # frequent words have the small codes, and words of one frequency stand in order: both pack well
            found = coded.indices.to_numpy(zero_copy_only=False)
            table = pa.table({"n": np.bincount(found, minlength=len(coded.dictionary)), "w": coded.dictionary.cast(pa.binary())})
            order = pc.sort_indices(table, sort_keys=[("n", "descending"), ("w", "ascending")])
            place = np.empty(len(order), "<u4")
            place[order.to_numpy()] = np.arange(len(order))
            codes = place[found]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([base + k], pa.int64()), pa.array([len(codes)], pa.int64()),
                    pa.array([ids.fill_null(0).to_numpy(zero_copy_only=False).astype("<i8").tobytes()], pa.binary()),
                    pa.array([ids.is_null().to_numpy(zero_copy_only=False).astype(np.uint8).tobytes()], pa.binary()),
                    pa.array([np.diff(ends).astype("<i8").tobytes()], pa.binary()),
                    pa.array([packed(codes)], pa.binary()),
                    pa.array([packed(np.frombuffer(b" ".join(table.column("w").take(order).to_pylist()), np.uint8))], pa.binary()),
                ],
                ["slice", "n_words", "ids", "nulls", "counts", "codes", "words"],
            )
            k += 1

    rows = df.select(F.col(f"`{id_col}`").cast("long").alias("k"), F.col(f"`{text_col}`").alias("t"))
    return map_arrow(rows, run, SLICE_SCHEMA)


def each_slice(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield batch.slice(i, 1).to_pylist()[0]


def stored(row: dict) -> Slice:
    return Slice(row, unpacked(row["codes"], "<u4"), unpacked(row["words"], "u1").tobytes())


def exchanged(sent: DataFrame, decide) -> DataFrame:
    """slice, replies: for each bucket that the slice sent to, a bit per entry. `decide` takes a bucket's
    names, extras and rows' sizes and gives a bit for each entry."""

    def run(group: pa.Table) -> pa.Table:
        names, extras = group.column("names").to_pylist(), group.column("extra").to_pylist()
        bits, sizes = decide(names, extras)
        ends = np.cumsum(sizes).tolist()
        packed = [np.packbits(bits[e - n : e]).tobytes() for n, e in zip(sizes, ends)]
        return pa.table([group.column("slice"), group.column("bucket"), pa.array(packed, pa.binary())], ["slice", "bucket", "bits"])

    replies = sent.groupBy("bucket").applyInArrow(run, "slice long, bucket int, bits binary")
    return replies.groupBy("slice").agg(F.collect_list(F.struct("bucket", "bits")).alias("replies"))


def in_two_documents(names: list[bytes], extras: list[bytes]) -> tuple[np.ndarray, list[int]]:
    """Whether more than one slice sent the name, or one that holds it in two documents."""
    each = [np.cumsum(unpacked(n, "<u4"), dtype=np.uint32) for n in names]
    sizes = [len(x) for x in each]
    keys, twice = np.concatenate(each), np.concatenate([unpacked(x, "u1") for x in extras])
    order = np.argsort(keys, kind="stable")
    first = np.flatnonzero(np.append(True, keys[order[1:]] != keys[order[:-1]]))
    shared = np.add.reduceat(1 + twice[order].astype(np.int64), first) > 1
    out = np.empty(len(keys), bool)
    out[order] = np.repeat(shared, np.diff(np.append(first, len(keys))))
    return out, sizes


def has_smaller(names: list[bytes], extras: list[bytes]) -> tuple[np.ndarray, list[int]]:
    """Whether another slice has the window in a smaller document than the slice's own smallest."""
    sides = [unpacked(n, "<u8").reshape(2, -1) for n in names]
    sizes = [s.shape[1] for s in sides]
    one, two = np.concatenate([np.cumsum(s[0], dtype=np.uint64) for s in sides]), np.concatenate([s[1] for s in sides])
    least = np.concatenate([unpacked(x, "<i8") for x in extras])
    order = np.lexsort((two, one))
    first = np.flatnonzero(np.append(True, (one[order[1:]] != one[order[:-1]]) | (two[order[1:]] != two[order[:-1]])))
    smallest = np.minimum.reduceat(least[order], first)
    out = np.empty(len(one), bool)
    out[order] = np.repeat(smallest, np.diff(np.append(first, len(one)))) < least[order]
    return out, sizes


def kept_words(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False, slice_bytes: int = SLICE_BYTES, bucket_names: int = BUCKET_NAMES
) -> DataFrame:
    """One row per row of `df`: `id_col` long, n_words, n_removed, kept_sha256 of the words that stay, joined
    by one space, and with `with_text` kept_text itself. A word goes if it stands in a window of WINDOW
    consecutive words of its document whose sequence also begins in a document of a smaller id; windows
    are judged on the input.

    Ids are integers; null ranks as the largest long, after or with all others. Rows of one id don't remove
    each other's words, so repeated rows give equal results. Null and empty texts, and texts of white
    space only, have no words; texts of fewer words than a window stay whole. An empty table gives an empty
    result. Texts of any length are worked on whole; other columns are not read."""
    bounded_batches(df.sparkSession, f"{max(slice_bytes, SLICE_BYTES)}b")
    parts = written(document_slices(df, id_col, text_col, slice_bytes), "slices")
    # a slice's part of a bucket is one row, so there are no more buckets than leave some fifty names in each
    buckets = 1 + min((parts.agg(F.sum("n_words")).first()[0] or 0) // (2 * bucket_names), slice_bytes // BYTES_A_BUCKET)

    def send_names(batches):
        for row in each_slice(batches):
            part = stored(row)
            sending, (_, _, _, doc) = names_sent(part, buckets)
            if len(sending.first):
                yield sending.rows(part.key, "<u4", (sending.least(doc) < sending.most(doc)).astype(np.uint8))

    def send_windows(batches):
        for row in each_slice(batches):
            part = stored(row)
            sending, at = windows_sent(part, buckets, row["names"])
            if len(sending.first):
                yield sending.rows(part.key, "<u8", sending.least(part.ranks[part.doc[at]]).astype("<i8"))

    def finish(batches):
        for row in each_slice(batches):
            part = stored(row)
            sending, at = windows_sent(part, buckets, row["names"])
            smaller = sending.replied(row["windows"])
            ranks = part.ranks[part.doc[at]]
            gone = at[smaller[sending.entry] | (ranks > sending.least(ranks)[sending.entry])]
            n = len(part.codes)
            covered = np.cumsum(np.bincount(gone, minlength=n + 1) - np.bincount(gone + WINDOW, minlength=n + 1))[:n] > 0
            ends = np.append(0, np.cumsum(part.counts))
            stays = np.append(0, np.cumsum(~covered))[ends]
            words = pa.array(part.words, pa.binary()).take(pa.array(part.codes[~covered].astype(np.int64)))
            texts = pc.binary_join(pa.ListArray.from_arrays(pa.array(stays, pa.int32()), words.cast(pa.string())), " ")
            columns = [
                pa.array(part.ids, pa.int64(), mask=part.nulls == 1), pa.array(part.counts, pa.int64()),
                pa.array(part.counts - np.diff(stays), pa.int64()),
                pa.array([hashlib.sha256(t.as_buffer()).hexdigest() for t in texts], pa.string()), *([texts] if with_text else []),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["k", "n_words", "n_removed", "kept_sha256", *["kept_text"] * with_text])

    names = written(exchanged(map_arrow(parts, send_names, SENT_SCHEMA), in_two_documents), "names")
    first = parts.join(names.withColumnRenamed("replies", "names"), "slice", "left")
    windows = written(exchanged(map_arrow(first, send_windows, SENT_SCHEMA), has_smaller), "windows")
    both = first.join(windows.withColumnRenamed("replies", "windows"), "slice", "left")
    out = map_arrow(both, finish, "k long, n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * with_text)
    return out.withColumnRenamed("k", id_col)


#: DuckDB SQL of the same on `documents`. A window's sequence is compared as a string.
ORACLE = f"""
with texts as (
  select row_number() over () as r, doc_id, coalesce(doc_id, {LAST_ID}) as place,
    list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') as words
  from documents),
starts as (select r, place, words, unnest(range(1, len(words) - {WINDOW - 2})) as s from texts),
windows as (select r, place, s, array_to_string(words[s:s + {WINDOW - 1}], ' ') as w from starts),
first as (select w, min(place) as least from windows group by w having min(place) < max(place)),
gone as (select r, list(distinct i) as cut from (
  select r, unnest(range(s, s + {WINDOW})) as i from windows join first using (w) where least < place) group by r)
select doc_id, len(words) as n_words, coalesce(len(cut), 0) as n_removed,
  sha256(coalesce(array_to_string(case when cut is null then words else list_filter(words, lambda x, i: not list_contains(cut, i)) end, ' '), '')) as kept_sha256
from texts left join gone using (r)
"""
