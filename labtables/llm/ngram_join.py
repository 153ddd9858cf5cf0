"""Jaccard self-join of documents on sets of word n-grams, by T-occurrence search.

Documents with equal sets are one node. Two sets of similarity s or more share a token among the
first n - ceil(s n) + 1 tokens of each, whatever the order of tokens; the order here puts rare ones
first, by a count sketch of fixed size (it decides cost, never results). All nodes of about one size
that share such a token go to the block of the least of them, so every pair that can link meets in a
block, and a long text that quotes many short ones meets none of them.

The search in inverted lists is DivideSkip: a node links with those that occur in T or more of its
lists, so short lists are heap-merged, skipping what cannot get there, and long lists are only probed
for what came out of the merge. Nodes that are reached leave the lists, so that a search yields links
that span its components, not all pairs of a group. It runs twice. In the blocks it runs on the shared
prefix tokens alone, with the overlap that a prefix must have; what that connects are candidate
groups, and each node is in one at most. In the groups it runs on whole sets and is exact.

Blocks and groups of many nodes or shingles are cut into chunks, each with the group's least node; what
a chunk leaves unconnected to that node is then searched for in the other chunks, which with chunks of
about the square root of a group is n ** 1.5 steps at most. Components grow from the links by star
contraction.
"""

from __future__ import annotations

import heapq
import math
import zlib
from bisect import bisect_left
from collections.abc import Callable, Iterable, Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import released, slices, squeezed, unsqueezed, utf8, written
from .fingerprint import ODD, mixed

#: Words of a shingle; similarity in hundredths.
WORDS = 5
PERCENT = 80
SLOTS = 1 << 20
#: Shingles of a chunk of a block (8 bytes each), unless one node has more.
CHUNK_SHINGLES = 2_000_000
#: Bytes of text that are shingled at once, and set names that a task remembers, so as not to repeat a set.
SLICE_BYTES = 400_000
SEEN_KEYS = 100_000
#: Groups of more nodes are cut into chunks of so many times the square root of their number.
WHOLE_NODES = 512
CHUNK_ROOTS = 8
#: Tokens whose slot counts this binary logarithm or more may be too many for one task's window.
HEAVY_CLASS = 14
SALTS = 64
#: Bytes of ids up to which they are broadcast to filter the documents; more are joined by a shuffle, of
#: compressed texts.
BROADCAST_BYTES = 32 << 20
#: Weight of a probe against a merge step in choosing how many lists are long.
MU = 0.02

_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_LETTER = mixed(np.arange(256, dtype=np.uint64) * ODD + np.uint64(1))
_LETTER[65:91] = _LETTER[97:123]
_PLACE = mixed(np.arange(1, 65, dtype=np.uint64) * ODD) | np.uint64(1)


def _places(n: int) -> np.ndarray:
    global _PLACE
    if n > len(_PLACE):
        _PLACE = mixed(np.arange(1, 2 * n + 1, dtype=np.uint64) * ODD) | np.uint64(1)
    return _PLACE


def shingle_sets(texts: list[bytes], words: int = WORDS) -> list[np.ndarray]:
    """Per text its distinct shingles as ascending 64-bit hashes: runs of `words` words, or the whole
    sequence if shorter; A-Z are lower-cased. Texts without words have empty sets."""
    joined = b" ".join(texts)
    data = np.frombuffer(joined, np.uint8)
    inside = ~_SPACE[data]
    edge = np.diff(inside.astype(np.int8), prepend=0)
    at = np.flatnonzero(inside)
    empty = np.zeros(0, np.uint64)
    if not len(at):
        return [empty] * len(texts)
    starts = np.flatnonzero(edge == 1)
    first = np.searchsorted(at, starts)
    lengths = np.diff(first, append=len(at))
    place = np.arange(len(at)) - np.repeat(first, lengths)
    powers = _places(max(int(lengths.max()), words))
    hashes = mixed(np.add.reduceat(_LETTER[data[at]] * powers[place], first) + lengths.astype(np.uint64) * ODD)
    n = len(hashes)
    rolled = np.zeros(max(n - words + 1, 0), np.uint64)
    for k in range(words if n >= words else 0):
        rolled += hashes[k : n - words + 1 + k] * powers[k]
    rolled = mixed(rolled + np.uint64(words))
    begins = np.searchsorted(starts, np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])]))
    out = []
    for a, b in zip(begins.tolist(), begins[1:].tolist()):
        if b - a >= words:
            out.append(np.unique(rolled[a : b - words + 1]))
        elif b > a:
            out.append(mixed((hashes[a:b] * powers[: b - a]).sum(dtype=np.uint64, keepdims=True) + np.uint64(b - a)))
        else:
            out.append(empty)
    return out


def set_key(tokens: np.ndarray) -> int:
    """A signed 64-bit name of a set."""
    return int.from_bytes(blake2b(tokens.tobytes(), digest_size=8).digest(), "little", signed=True)


def prefix_length(n: int, percent: int = PERCENT) -> int:
    return n - -(-percent * n // 100) + 1


def least_overlap(n: int, m: int, percent: int = PERCENT) -> int:
    """Smallest intersection of sets of n and m with 100 * intersection >= percent * union."""
    return -(-percent * (n + m) // (100 + percent))


class TOccurrence:
    """Inverted lists of some sets, searched by required overlap; nodes can be taken out."""

    def __init__(self, sets: list[np.ndarray], percent: int = PERCENT, sizes: list[int] | None = None, ends: list[int] | None = None):
        """`sizes` says that the sets are prefixes (or what is shared of them) of sets of these sizes,
        `ends` where in the order of tokens the prefixes end."""
        self.ends = ends
        self.sizes, self.percent = sizes or [len(s) for s in sets], percent
        tokens, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        order = np.argsort(tokens, kind="stable")
        tokens, owner = tokens[order], owner[order]
        begins = np.flatnonzero(np.concatenate([[True], tokens[1:] != tokens[:-1]]))
        lengths = np.diff(begins, append=len(tokens))
        shared = lengths > 1  # a list of one node finds no other
        self.lists = [owner[a : a + n].tolist() for a, n in zip(begins[shared].tolist(), lengths[shared].tolist())]
        kept = np.repeat(shared, lengths)
        owners, ids = owner[kept], np.repeat(np.arange(len(self.lists)), lengths[shared])
        order = np.argsort(owners, kind="stable")
        cuts = np.searchsorted(owners[order], np.arange(len(sets) + 1)).tolist()
        ids = ids[order].tolist()
        self.lists_of = [ids[a:b] for a, b in zip(cuts, cuts[1:])]

    def take_out(self, node: int) -> None:
        for i in self.lists_of[node]:
            entries = self.lists[i]
            at = bisect_left(entries, node)
            if at < len(entries) and entries[at] == node:
                del entries[at]

    def needed(self, i: int, k: int) -> int:
        """The overlap of two sets; of their prefixes, what the rest of the prefix that ends first, in
        which all other shared tokens stand, leaves of it."""
        n, m = self.sizes[i], self.sizes[k]
        whole = least_overlap(n, m, self.percent)
        if self.ends is None:
            return whole
        rest = [x - prefix_length(x, self.percent) for x, end in ((n, self.ends[i]), (m, self.ends[k])) if end <= min(self.ends[i], self.ends[k])]
        return max(1, whole - max(rest))

    def search(self, node: int) -> list[int]:
        """The nodes still in the lists, other than `node`, that reach the overlap with it."""
        n = self.sizes[node]
        lists = [x for i in self.lists_of[node] if (x := self.lists[i])]
        least = least_overlap(n, -(-self.percent * n // 100), self.percent) if self.ends is None else 1
        if len(lists) < least:
            return []
        lists.sort(key=len)
        longest = len(lists[-1])
        long = min(least - 1, int(least / (MU * math.log2(longest) + 1)))
        short, probed = lists[: len(lists) - long], lists[len(lists) - long :]
        found = []
        for other, count in merge_skip(short, least - long):
            if other == node:
                continue
            m = self.sizes[other]
            if 100 * min(n, m) < self.percent * max(n, m):
                continue
            need = self.needed(node, other)
            left = len(probed)
            for entries in probed:
                if count >= need or count + left < need:
                    break
                left -= 1
                at = bisect_left(entries, other)
                count += at < len(entries) and entries[at] == other
            if count >= need:
                found.append(other)
        return found


def merge_skip(lists: list[list[int]], least: int) -> Iterator[tuple[int, int]]:
    """Entries that stand in at least `least` of the ascending lists, with their counts. The heap holds
    each list's next entry; when the lowest entry falls short, the lists of the next lowest ones that
    could not reach the count either jump ahead by binary search."""
    heap = [(x[0], i) for i, x in enumerate(lists)]
    heapq.heapify(heap)
    at = [0] * len(lists)
    while len(heap) >= least:
        low, popped = heap[0][0], []
        while heap and heap[0][0] == low:
            popped.append(heapq.heappop(heap)[1])
        if len(popped) >= least:
            yield low, len(popped)
            jump = low + 1
        else:
            while heap and len(popped) < least - 1:
                popped.append(heapq.heappop(heap)[1])
            if not heap:
                return
            jump = heap[0][0]
        for i in popped:
            entries = lists[i]
            p = bisect_left(entries, jump, at[i])
            if p < len(entries):
                at[i] = p
                heapq.heappush(heap, (entries[p], i))


def spanning_links(sets: list[np.ndarray], percent: int = PERCENT, sizes: list[int] | None = None, ends: list[int] | None = None) -> list[tuple[int, int]]:
    """Links that span each component of the sets: from each reached node, those not yet reached are
    searched for and taken out of the lists."""
    index, links, reached = TOccurrence(sets, percent, sizes, ends), [], [False] * len(sets)
    for start in range(len(sets)):
        if reached[start]:
            continue
        reached[start] = True
        index.take_out(start)
        waiting = [start]
        while waiting:
            node = waiting.pop()
            for other in index.search(node):
                links.append((node, other))
                reached[other] = True
                index.take_out(other)
                waiting.append(other)
    return links


def crossing_links(
    sets: list[np.ndarray], components: list[int], asked: list[bool], percent: int = PERCENT, sizes: list[int] | None = None, ends: list[int] | None = None
) -> list[tuple[int, int]]:
    """From each asked node a link to each other component that it reaches."""
    index, links = TOccurrence(sets, percent, sizes, ends), []
    for node in (i for i, a in enumerate(asked) if a):
        seen = {components[node]}
        for other in index.search(node):
            if components[other] not in seen:
                seen.add(components[other])
                links.append((node, other))
    return links


def _named(docs: DataFrame, id_col: str, text_col: str, *more: Column) -> DataFrame:
    """Columns k (the id, null or not) and d (a hash of the text), which name a document's text also
    where ids are null or repeated, text, and `more`."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).cast("long").alias("k"), F.xxhash64(text).alias("d"), text.alias("text"), *more)


def _least() -> Column:
    """The first of some documents: by id, null last, then by hash."""
    return F.min(F.struct(F.col("k").isNull().alias("none"), F.col("k").alias("k"), F.col("d").alias("d")))


def document_nodes(docs: DataFrame, id_col: str, text_col: str, words: int) -> DataFrame:
    """Table of k, d, n (set size), key (the set's name), and from each task a row with sketch, its token
    counts by slot."""

    def run(batches):
        counts = np.zeros(SLOTS, np.int64)
        names = ["k", "d", "n", "key", "sketch"]
        for batch in slices(batches, "text", SLICE_BYTES):
            sets = shingle_sets(utf8(batch.column("text")), words)
            keys = [set_key(s) if len(s) else None for s in sets]
            counts += np.bincount((np.concatenate(sets) & np.uint64(SLOTS - 1)).astype(np.int64), minlength=SLOTS)
            yield pa.RecordBatch.from_arrays([batch.column("k"), batch.column("d"), pa.array(map(len, sets), pa.int32()), pa.array(keys, pa.int64()), pa.nulls(batch.num_rows, pa.binary())], names)
        if counts.any():
            packed = zlib.compress(np.minimum(counts, 0xFFFFFFFF).astype("<u4").tobytes(), 1)
            yield pa.RecordBatch.from_arrays([*[pa.nulls(1, pa.int64())] * 2, pa.nulls(1, pa.int32()), pa.nulls(1, pa.int64()), pa.array([packed], pa.binary())], names)

    return written(_named(docs, id_col, text_col).mapInArrow(run, "k long, d long, n int, key long, sketch binary"), "nodes")


def rarity_classes(nodes: DataFrame) -> np.ndarray:
    """The binary logarithm of each slot's count over all documents: SLOTS bytes, whatever the input."""

    def add(batches):
        total = np.zeros(SLOTS, np.uint64)
        for batch in batches:
            for x in batch.column("sketch"):
                total += np.frombuffer(zlib.decompress(x.as_py()), "<u4").astype(np.uint64)
        yield pa.RecordBatch.from_arrays([pa.array([zlib.compress(np.minimum(total, 0xFFFFFFFF).astype("<u4").tobytes(), 1)], pa.binary())], ["sketch"])

    sketches = nodes.filter("sketch is not null").select("sketch").mapInArrow(add, "sketch binary")
    total = np.zeros(SLOTS, np.uint64)
    for row in sketches.repartition(8).mapInArrow(add, "sketch binary").collect():  # 8 rows
        total += np.frombuffer(zlib.decompress(row.sketch), "<u4").astype(np.uint64)
    return np.floor(np.log2(total.astype(np.float64) + 1)).astype(np.uint8)


def size_classes(n: int, percent: int = PERCENT) -> range:
    """The size classes of a set: that of its power of four, and the next one too if sets of that one
    can link with it. Any two sets that can link have a class in common."""
    own = (n.bit_length() - 1) // 2
    return range(own, own + 1 + (100 * n >= percent * 4 ** (own + 1)))


def prefix_tokens(docs: DataFrame, id_col: str, text_col: str, words: int, percent: int, classes: np.ndarray) -> DataFrame:
    """Rows (token, size, key, n, stop, heavy): the rarest tokens of each set, as many as similar sets must
    share one of, for each of its size classes. stop grows with the place of the last of them in the
    order of tokens; heavy ones may be in too many sets for one task."""
    shared = docs.sparkSession.sparkContext.broadcast(classes)

    def run(batches):
        seen: set[int] = set()
        for batch in slices(batches, "text", SLICE_BYTES):
            rows: list[tuple[np.ndarray, ...]] = []
            for s in shingle_sets(utf8(batch.column("text")), words):
                if not len(s) or (key := set_key(s)) in seen:
                    continue
                if len(seen) < SEEN_KEYS:
                    seen.add(key)
                rarity = shared.value[s & np.uint64(SLOTS - 1)]
                order = np.lexsort((s, rarity))[: prefix_length(len(s), percent)]
                stop = int(rarity[order[-1]]) << 24 | int(s[order[-1]] >> np.uint64(40))
                same = lambda x, kind: np.full(len(order), x, kind)  # noqa: E731, B023
                for size in size_classes(len(s), percent):
                    rows.append((s[order].view(np.int64), same(size, np.int8), same(key, np.int64), same(len(s), np.int32), same(stop, np.int32), rarity[order] >= HEAVY_CLASS))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*rows)], ["token", "size", "key", "n", "stop", "heavy"])

    return docs.select(F.col(text_col).alias("text")).mapInArrow(run, "token long, size byte, key long, n int, stop int, heavy boolean")


def shared_tokens(prefix: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows (token, size, key, n, stop, hub) of the tokens that several nodes of a size class have, and the
    table that they are read from; hub is the least of them. One shuffle and a window per token; heavy tokens are dealt into SALTS windows
    first, whose least nodes meet by an aggregate and a join, which Spark splits where they are
    skewed."""
    salt = F.when(F.col("heavy"), F.pmod(F.xxhash64("key"), F.lit(SALTS))).otherwise(0)
    window = Window.partitionBy("token", "size", "salt")
    dealt = prefix.withColumn("salt", salt).withColumns({"hub": F.min("key").over(window), "last": F.max("key").over(window)})
    some = written(dealt.filter("heavy or hub != last").drop("salt"), "tokens")
    names = ["token", "size", "key", "n", "stop"]
    light, heavy = some.filter("not heavy").select(*names, "hub"), some.filter("heavy")
    hubs = heavy.groupBy("token", "size").agg(F.min("hub").alias("hub"), F.max("last").alias("last")).filter("hub != last").drop("last")
    return light.unionByName(heavy.select(*names).join(hubs, ["token", "size"]).select(*names, "hub")) if not heavy.isEmpty() else light, some


def node_texts(docs: DataFrame, places: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows of `places` (key, k, d and others) with, in place of k and d, the text as a zstd frame of each
    document (k, d), which other texts may have too. Texts are shorter than the sets of their shingles.
    They are shuffled only if `places` are too many to be broadcast, and compressed before. A task gives a
    row once; several tasks may repeat it where rows repeat the document."""
    others = [c for c in places.columns if c not in ("k", "d")]
    named = places.select(*others, F.col("k").alias("k_"), F.col("d").alias("d_"))
    small = _sized(named, 8 * len(named.columns) + 16)
    same = F.col("k").eqNullSafe(F.col("k_")) & (F.col("d") == F.col("d_"))

    def run(names: list[str]):
        def squeeze(batches):
            seen: set[tuple] = set()
            for batch in slices(batches, "text", SLICE_BYTES):
                rows = list(zip(*[batch.column(c).to_pylist() for c in names]))
                fresh = []
                for i, row in enumerate(rows):
                    if row not in seen:
                        fresh.append(i)
                        if len(seen) < SEEN_KEYS:
                            seen.add(row)
                kept = batch.take(pa.array(fresh, pa.int64()))
                yield pa.RecordBatch.from_arrays([*[kept.column(c) for c in names], pa.array(squeezed(utf8(kept.column("text"))), pa.binary())], [*names, "text"])

        return squeeze

    def frames(df: DataFrame, names: list[str]) -> DataFrame:
        types = dict(df.dtypes)
        return df.select(*names, "text").mapInArrow(run(names), ", ".join(f"`{c}` {types[c]}" for c in names) + ", text binary")

    texts = _named(docs, id_col, text_col)
    if small is not named:
        return frames(texts.join(small, same), others)
    return frames(texts, ["k", "d"]).join(small, same).select(*others, "text")


def with_sets(batches: Iterable[pa.RecordBatch], words: int) -> Iterator[pa.RecordBatch]:
    """The batches with the set of each text (a zstd frame), tokens, in its place, without texts whose set is
    not the one that key names."""
    for batch in slices(batches, "text", SLICE_BYTES // 2):
        sets = shingle_sets(unsqueezed(batch.column("text").to_pylist()), words)
        fits = [i for i, (s, key) in enumerate(zip(sets, batch.column("key").to_pylist())) if len(s) and set_key(s) == key]
        kept = batch.take(pa.array(fits, pa.int64()))
        names = [c for c in batch.schema.names if c != "text"]
        yield pa.RecordBatch.from_arrays([*[kept.column(c) for c in names], pa.array([sets[i].tobytes() for i in fits], pa.binary())], [*names, "tokens"])


def _groups(batches: Iterable[pa.RecordBatch], by: list[str]) -> Iterator[list[dict]]:
    """Runs of rows that are equal in `by`, across batches."""
    held, last = [], None
    for batch in batches:
        for start in range(0, batch.num_rows, 512):
            for row in batch.slice(start, 512).to_pylist():
                group = tuple(row[c] for c in by)
                if group != last and held:
                    yield held
                    held = []
                held.append(row)
                last = group
    if held:
        yield held


def stars(n: int, links: list[tuple[int, int]], keys: list[int]) -> list[tuple[int, int]]:
    """Each linked node of a group with the least node that its links reach there: (node, least)."""
    root = list(range(n))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for x, y in links:
        x, y = find(x), find(y)
        if keys[x] < keys[y]:
            root[y] = x
        else:
            root[x] = y
    return [(keys[x], keys[find(x)]) for x in range(n) if find(x) != x]


def _search(rows: DataFrame, by: list[str], percent: int, words: int) -> DataFrame:
    """Pairs (a, b) of a node and the least one it is connected to, from each group of rows: key and text
    (a zstd frame, of which the set is made here), or tokens (a prefix's array beside n and stop). Rows with component and asked are those of
    two chunks: of them only what the asked ones reach is searched for."""

    def links_of(group: list[dict]) -> list[tuple[int, int]]:
        prefixes = "stop" in group[0]
        sets = [np.array(r["tokens"], np.int64) if prefixes else np.frombuffer(r["tokens"], np.uint64) for r in group]
        sizes, ends = ([r["n"] for r in group], [r["stop"] for r in group]) if prefixes else (None, None)
        if "asked" in group[0]:
            return crossing_links(sets, [r["component"] for r in group], [r["asked"] for r in group], percent, sizes, ends)
        return spanning_links(sets, percent, sizes, ends)

    texts = "text" in rows.columns

    def run(batches):
        a, b = [], []
        for group in _groups(with_sets(batches, words) if texts else batches, by):
            group = sorted({r["key"]: r for r in group}.values(), key=lambda r: (len(r["tokens"]), r["key"]))
            for x, y in stars(len(group), links_of(group), [r["key"] for r in group]) if len(group) > 1 else ():
                a.append(x)
                b.append(y)
            if len(a) > 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])
                a, b = [], []
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return rows.repartition(*by).sortWithinPartitions(*by, "key").mapInArrow(run, "a long, b long")


def turned(rows: DataFrame, *ways: Column) -> DataFrame:
    """(a, b) of each of the structures that `ways` make of a row, but for null ones."""
    return rows.select(F.explode(F.filter(F.array(*ways), lambda x: x.isNotNull())).alias("x")).select("x.a", "x.b")


def components(links: DataFrame) -> DataFrame:
    """(key, root) of every node with a link: the least node that links reach. Large and small stars
    alternate until nothing changes; each round is written, and no round leaves the cluster."""
    last, before = None, None
    stars = links.filter("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    while True:
        # rows are turned in place: a union would double the plan, and the next steps would double it again
        both = turned(stars, F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        stars = both.join(low, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a != b").distinct()
        low = stars.groupBy("a").agg(F.min("b").alias("m"))
        least = F.struct("a", F.col("m").alias("b"))
        stars = turned(stars.join(low, "a"), least, F.when(F.col("b") != F.col("m"), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).distinct()
        stars = written(stars, "stars")
        if last is not None:
            released(last)
        last = stars
        now = tuple(stars.agg(F.count(F.lit(1)), F.expr("bit_xor(xxhash64(a, b))"), F.expr("sum(cast(xxhash64(b, a) as decimal(38, 0)))")).first())
        if now == before:
            return stars.select(F.col("a").alias("key"), F.col("b").alias("root"))
        before = now


def candidate_groups(docs: DataFrame, id_col: str, text_col: str, words: int, percent: int, chunk: int, classes: np.ndarray) -> DataFrame:
    """Rows (key, n, root): the nodes that may link, by group. A block's nodes are searched by their
    shared prefix tokens."""
    prefix = prefix_tokens(docs, id_col, text_col, words, percent, classes)
    shared, table = shared_tokens(prefix)
    # rows that repeat a set in several tasks repeat its tokens
    tokens = F.array_distinct(F.collect_list("token")).alias("tokens")
    nodes = written(shared.groupBy("key", "size").agg(F.max("n").alias("n"), F.max("stop").alias("stop"), tokens, F.collect_set("hub").alias("hubs")), "shared")
    released(table)
    blocks = nodes.select("key", "size", "n", "stop", "tokens", F.size("tokens").alias("weight"), F.explode("hubs").alias("hub"))
    links = searched(blocks, ["hub", "size"], lambda where: nodes.drop("hubs").join(where, ["key", "size"]), percent, chunk, words, True)
    roots = components(links)
    roots = roots.union(roots.select("root", "root").distinct())
    groups = written(roots.join(nodes.groupBy("key").agg(F.max("n").alias("n")), "key"), "groups")
    released(nodes)
    return groups


def searched(groups: DataFrame, by: list[str], attach: Callable[[DataFrame], DataFrame], percent: int, chunk: int, words: int, ready: bool = False) -> DataFrame:
    """Links (a, b) that span the components of each group. `groups` has rows (key, weight) with the columns
    `by`, of which the first is the group's least node; `attach` gives such rows their sets or texts,
    unless they are `ready`."""
    rows = F.count(F.lit(1))
    chunks = F.greatest(F.ceil(F.sum("weight") / chunk), F.when(rows > WHOLE_NODES, F.ceil(F.sqrt(rows.cast("double")) / CHUNK_ROOTS)).otherwise(1))
    cuts = written(groups.groupBy(*by).agg(chunks.cast("int").alias("chunks")).filter("chunks > 1"), "cuts")
    none = cuts.isEmpty()
    small = groups if none else groups.join(_sized(cuts.select(*by), 24), by, "left_anti")
    links = written(_search(small if ready else attach(small.select(*by, "key")), by, percent, words), "links")
    if none:
        return links
    least = F.col("key") == F.col(by[0])
    # the least node stands in every chunk, so that chunks of one group of near copies are connected
    place = F.when(least, F.sequence(F.lit(0), F.col("chunks") - 1)).otherwise(F.array(F.pmod(F.xxhash64("key"), F.col("chunks")).cast("int")))
    placed = written(groups.select(*by, "key").join(_sized(cuts, 24), by).select(*by, "key", F.explode(place).alias("chunk")), "placed")
    inside = written(_search(attach(placed), [*by, "chunk"], percent, words), "inside")
    # nodes with a link to the least node are done; the others, dealt into parts like the chunks, meet every chunk
    joined = inside.select(F.col("a").alias("key"), F.col("b").alias(by[0]), F.lit(True).alias("done"))
    named = inside.groupBy(F.col("a").alias("key")).agg(F.min("b").alias("component"))
    several = placed.join(joined, ["key", by[0]], "left").join(named, "key", "left")
    several = written(several.withColumns({"component": F.coalesce("component", "key"), "done": F.coalesce("done", F.lit(False)) | least}), "several")
    rest = several.filter("not done").select(*by, F.col("chunk").alias("part"), "key", "component")
    pairs = several.select(*by, "chunk").distinct().join(rest.select(*by, "part").distinct(), by).filter("part != chunk")
    own = several.select(*by, "chunk", "key", "component").join(pairs, [*by, "chunk"]).withColumn("asked", F.lit(False))
    asked = pairs.join(rest, [*by, "part"]).withColumn("asked", F.lit(True))
    met = written(own.unionByName(asked).groupBy(*by, "chunk", "part", "key").agg(F.max("component").alias("component"), F.max("asked").alias("asked")), "met")
    links = links.union(inside)
    return links if met.isEmpty() else links.union(written(_search(attach(met), [*by, "chunk", "part"], percent, words), "crossing"))


def similarity_links(docs: DataFrame, nodes: DataFrame, id_col: str, text_col: str, words: int, percent: int, chunk: int) -> DataFrame:
    """Links (a, b) between nodes that span every component of the similarity graph."""
    groups = candidate_groups(docs, id_col, text_col, words, percent, chunk, rarity_classes(nodes))
    wanted = written(nodes.filter("key is not null").groupBy("key").agg(_least().alias("w")).join(groups.select("key"), "key", "left_semi").select("key", "w.k", "w.d"), "wanted")
    attach = lambda where: node_texts(docs, where.join(wanted, "key"), id_col, text_col)
    return searched(groups.select("root", "key", F.col("n").alias("weight")), ["root"], attach, percent, chunk, words)


def ngram_components(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, percent: int = PERCENT, chunk: int = CHUNK_SHINGLES
) -> DataFrame:
    """One row per input row: `id_col`, n_shingles, component_id, set_key. Rows link when the
    intersection of their shingle sets is at least `percent` hundredths of the union, and component_id
    is the smallest id that links reach. Null and empty texts, and texts without words, have 0
    shingles, no links and their own id; null ids come after all others; repeated rows share a
    component; an empty table gives no rows; texts of any length count whole; other columns are not
    read. Ids are whole numbers, or text of such; others end the job. Shingles and sets are compared by
    64-bit hashes."""
    out = labelled_rows(docs, id_col, text_col, words, percent, chunk)
    component = F.when(F.col("label").isNull(), F.col("k")).otherwise(F.col("label.k"))
    return out.select(F.col("k").alias(id_col), F.col("n").cast("long").alias("n_shingles"), component.alias("component_id"), F.col("key").alias("set_key"))


def labelled_rows(docs: DataFrame, id_col: str, text_col: str, words: int = WORDS, percent: int = PERCENT, chunk: int = CHUNK_SHINGLES) -> DataFrame:
    """One row (k, d, n, key, label) per input row: label is the first document (none, k, d) of the row's
    component where that has several rows, else null."""
    nodes = document_nodes(docs, id_col, text_col, words)
    roots = components(similarity_links(docs, nodes, id_col, text_col, words, percent, chunk))
    # copies are counted into their node before nodes meet by component, and only nodes of components
    # with several documents need a label
    per_key = written(nodes.filter("key is not null").groupBy("key").agg(_least().alias("own"), F.count(F.lit(1)).alias("rows")), "keys")
    rooted = per_key.join(_sized(roots, 16), "key", "left").withColumn("root", F.coalesce("root", "key"))
    least = rooted.groupBy("root").agg(F.min("own").alias("label"), F.sum("rows").alias("rows")).filter("rows > 1").select("root", "label")
    labels = written(rooted.select("key", "root").join(_sized(written(least, "least"), 32), "root").select("key", "label"), "labels")
    return nodes.filter("n is not null").select("k", "d", "n", "key").join(_sized(labels, 32), "key", "left")


def _sized(df: DataFrame, row_bytes: int) -> DataFrame:
    """`df` for a broadcast if it is known to be small, else for a shuffle join."""
    return F.broadcast(df) if row_bytes * df.count() <= BROADCAST_BYTES else df


def near_duplicates_removed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """`docs` with one document of each component, that of the smallest id (null last, then by a hash of
    the text). Of rows with that id and text one stays, the least as JSON. Documents without words all
    stay; columns may have any names and types; an empty table gives no rows. What goes is named by id
    and text hash, and filters the texts, which are shuffled only if the names are more than
    BROADCAST_BYTES."""
    found = written(labelled_rows(docs, id_col, text_col, **options).filter("label is not null").select("k", "d", (F.col("k").eqNullSafe(F.col("label.k")) & (F.col("d") == F.col("label.d"))).alias("first")), "found")
    names = [F.col("k").alias("k_"), F.col("d").alias("d_")]
    gone = written(found.filter("not first").select(*names).distinct(), "gone")
    repeated = written(found.filter("first").groupBy(*names).agg(F.count(F.lit(1)).alias("rows")).filter("rows > 1").select("k_", "d_"), "repeated")
    same = F.col("k").eqNullSafe(F.col("k_")) & (F.col("d") == F.col("d_"))
    keyed = _named(docs, id_col, text_col, F.struct("*").alias("row")).select("k", "d", "row")
    kept = keyed.join(_sized(gone, 16), same, "left_anti")
    if not repeated.isEmpty():
        twins = kept.join(_sized(repeated, 16), same, "left_semi").groupBy("k", "d").agg(F.min_by("row", F.to_json("row")).alias("row"))
        kept = kept.join(_sized(repeated, 16), same, "left_anti").select("row").union(twins.select("row"))
    return kept.select("row.*")
