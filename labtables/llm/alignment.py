"""Alignment of two tokenizers over the same texts.

The cumulative byte ends of both id lists are kept in dictionaries from end to index; the sorted
intersection of their keys slices both lists into groups, and a group links each of its ids of one
side with each of the other. Neither tokenizer joins a character that is no white space with a space
after it, so a text is cut before such spaces, and the stretches between the cuts are aligned once while
a Python worker keeps them: a document's groups are those of its stretches, one after another.

Documents and their pairs are written once. Pairs are counted per task before they are shuffled. The
most frequent pairs, as many as a bound allows, are broadcast to the documents; all others are joined
by a shuffle, where no pair has more rows than the least frequent broadcast one has documents.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import byte_characters, gathered, grown
from .common import bounded_batches, slices, tokenizer_path, written

FILE_A, FILE_B = "byte_bpe_50k.json", "piece_bpe_32k.model"
MARK = "▁"
#: Stretches that a worker keeps; beyond it only those of several slices stay, half as many at most.
KEPT_STRETCHES = 500_000
#: Bytes of new stretches that are tokenized as one text.
ALIGNED_BYTES = 1 << 16
#: A group of more links than this is expanded by its distinct ids.
EXPANDED_LINKS = 1 << 16
#: Pairs that are broadcast (12 bytes each), and pairs whose counts a task holds at once.
BROADCAST_PAIRS = 1_000_000
COUNTED_PAIRS = 4_000_000
#: Ids of B lie below this, so that a pair is a * SIDE + b in 63 bits.
SIDE = 1 << 31


class Aligner:
    """Both tokenizers, and the stretches that were aligned so far."""

    kept = KEPT_STRETCHES

    def __init__(self, path_a: str, path_b: str):
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.b = SentencePieceProcessor(model_file=path_b)
        letters = {c: i for i, c in enumerate(byte_characters())}
        names = [self.a.id_to_token(i) or "" for i in range(self.a.get_vocab_size())]
        self.bytes_a = [bytes(letters[c] for c in t) if all(c in letters for c in t) else t.encode() for t in names]
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(MARK, " ").encode() for i, p in enumerate(pieces)]
        self.size_a, self.size_b = (np.array([len(x) for x in side], np.int64) for side in (self.bytes_a, self.bytes_b))
        # ids as they stand in groups: each with the sign after it inside its side of a group, then each with that at its end
        signs = ((len(names), ",|"), (len(pieces), ",;"))
        self.signed = [np.array([f"{i}{sign}" for sign in both for i in range(n)], object) for n, both in signs]
        self.signed_size = [np.array([len(x) for x in side], np.int64) for side in self.signed]
        # stretches stand alone only if no piece goes on into a space
        self.parted = not any(MARK in p.lstrip(MARK) for p in pieces)
        self.forget()

    def forget(self) -> None:
        self.slot: dict[str, int] = {}
        self.words: list[bytes] = []  # groups of each kept stretch as text
        self.figures = np.zeros((0, 5), np.int64)  # n_a, n_b, n_groups, n_links, and 1 where bytes differ
        self.start, self.length = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.pairs, self.times, self.end = np.zeros(0, np.int64), np.zeros(0, np.int64), 0
        self.used = np.zeros(0, np.int64)  # slices that had each kept stretch

    def keep_frequent(self) -> None:
        """Forgets all but the stretches that most slices had, and more than one."""
        n = len(self.words)
        often = np.flatnonzero(self.used[:n] > 1)
        often = np.sort(often[np.argsort(-self.used[often], kind="stable")[: self.kept // 2]])
        names, words, figures, used, length = list(self.slot), self.words, self.figures[often], self.used[often], self.length[often]
        pairs, times = (gathered(x, self.start[often], length) for x in (self.pairs, self.times))
        self.forget()
        self._keep([names[i] for i in often.tolist()], [words[i] for i in often.tolist()], figures, length, pairs, times)
        self.used[: len(often)] = used

    def tokens(self, text: str) -> tuple[list[int], list[int], bool, bool]:
        """Ids of both sides for a text that begins with a space, and whether each gives its bytes."""
        ids_a, ids_b = self.a.encode(text, add_special_tokens=False).ids, self.b.encode(text[1:])
        data, of_a, of_b = text.encode(), self.bytes_a, self.bytes_b
        return ids_a, ids_b, b"".join([of_a[i] for i in ids_a]) == data, b"".join([of_b[i] for i in ids_b]) == data

    def cuts(self, ids_a: list[int], ids_b: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Where groups end: the common byte ends, and how many ids of each side stand before them."""
        index_a = dict(zip(np.cumsum(self.size_a[ids_a]).tolist(), range(1, len(ids_a) + 1)))
        index_b = dict(zip(np.cumsum(self.size_b[ids_b]).tolist(), range(1, len(ids_b) + 1)))
        common = sorted(index_a.keys() & index_b.keys())
        return np.array(common, np.int64), np.array([index_a[e] for e in common], np.int64), np.array([index_b[e] for e in common], np.int64)

    def learn(self, new: list[str]) -> None:
        """Aligns stretches and keeps what came of them. Those that end in white space, as texts may, would
        run into a following one, so they are not tokenized with others."""
        batch, size = [], 0
        for text in new:
            if text[-1].isspace():
                self._learn([text])
                continue
            batch.append(text)
            size += len(text)
            if size >= ALIGNED_BYTES:
                self._learn(batch)
                batch, size = [], 0
        if batch:
            self._learn(batch)

    def _learn(self, batch: list[str]) -> None:
        ids_a, ids_b, same_a, same_b = self.tokens("".join(batch))
        if not (same_a and same_b):
            if len(batch) > 1:
                # some stretch is not given back as it was: each for itself
                for text in batch:
                    self._learn([text])
            else:
                self._keep(batch, [b""], np.array([[0, 0, 0, 0, 1]]), np.zeros(1, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64))
            return
        common, cut_a, cut_b = self.cuts(ids_a, ids_b)
        ends = np.cumsum(list(map(len, map(str.encode, batch))))
        first_a, first_b = np.append(0, cut_a[:-1]), np.append(0, cut_b[:-1])
        n_a, n_b = cut_a - first_a, cut_b - first_b
        owner = np.searchsorted(ends, common)  # the stretch of each group
        at = np.searchsorted(owner, np.arange(len(batch) + 1))
        if (common[at[1:] - 1] != ends).any():
            raise ValueError("a token of one of the tokenizers goes on into the space after a word")
        ids_a, ids_b = np.array(ids_a, np.int64), np.array(ids_b, np.int64)
        words = self.written(ids_a, ids_b, cut_a, cut_b, at)
        links = n_a * n_b
        figures = np.zeros((len(batch), 5), np.int64)
        for k, values in enumerate((n_a, n_b, np.ones(len(links), np.int64), links)):
            figures[:, k] = np.add.reduceat(values, at[:-1])
        # each group's links, all at once; of huge groups the distinct ids with how often they stand there
        small = np.flatnonzero(links <= EXPANDED_LINKS)
        of = np.repeat(small, links[small])
        within = np.arange(len(of)) - np.repeat(np.cumsum(links[small]) - links[small], links[small])
        pairs = [ids_a[first_a[of] + within // n_b[of]] * SIDE + ids_b[first_b[of] + within % n_b[of]]]
        owners, times = [owner[of]], [np.ones(len(of), np.int64)]
        for g in np.flatnonzero(links > EXPANDED_LINKS).tolist():
            x, x_times = np.unique(ids_a[first_a[g] : cut_a[g]], return_counts=True)
            y, y_times = np.unique(ids_b[first_b[g] : cut_b[g]], return_counts=True)
            pairs.append((x[:, None] * SIDE + y).ravel())
            times.append((x_times[:, None] * y_times).ravel())
            owners.append(np.full(len(pairs[-1]), owner[g]))
        owners, pairs, times = summed(np.concatenate(owners), np.concatenate(pairs), np.concatenate(times))
        self._keep(batch, words, figures, np.bincount(owners, minlength=len(batch)), pairs, times)

    def written(self, ids_a: np.ndarray, ids_b: np.ndarray, cut_a: np.ndarray, cut_b: np.ndarray, at: np.ndarray) -> list[bytes]:
        """The groups that end at the cuts as text, joined for each stretch; `at`: the stretches' first groups, and their number."""
        parts, sizes = np.empty(len(ids_a) + len(ids_b), object), np.empty(len(ids_a) + len(ids_b), np.int64)
        # a group's ids of A stand after all groups before it, its ids of B after those of A
        for ids, cut, before, signed, size in zip((ids_a, ids_b), (cut_a, cut_b), (np.append(0, cut_b[:-1]), cut_a), self.signed, self.signed_size):
            place = np.arange(len(ids)) + np.repeat(before, np.diff(cut, prepend=0))
            which = ids.copy()
            which[cut - 1] += len(signed) // 2
            parts[place], sizes[place] = signed[which], size[which]
        text = "".join(parts.tolist()).encode()
        ends = np.append(0, np.cumsum(sizes))[np.append(0, cut_a + cut_b)[at]].tolist()
        return [text[i : j - 1] for i, j in zip(ends, ends[1:])]

    def _keep(self, batch: list[str], words: list[bytes], figures: np.ndarray, length: np.ndarray, pairs: np.ndarray, times: np.ndarray) -> None:
        n, end = len(self.words), self.end + len(pairs)
        self.slot.update(zip(batch, range(n, n + len(batch))))
        self.words += words
        if len(self.figures) < n + len(batch):
            self.figures = np.concatenate([self.figures, np.zeros((max(n, len(batch)), 5), np.int64)])
        self.figures[n : n + len(batch)] = figures
        self.start, self.length, self.used = (grown(x, n + len(batch)) for x in (self.start, self.length, self.used))
        self.used[n : n + len(batch)] = 0
        self.pairs, self.times = grown(self.pairs, end), grown(self.times, end)
        self.start[n : n + len(batch)] = self.end + np.cumsum(length) - length
        self.length[n : n + len(batch)] = length
        self.pairs[self.end : end], self.times[self.end : end] = pairs, times
        self.end = end

    def slots(self, stretches: list[str]) -> np.ndarray:
        """Places of distinct stretches among the kept ones."""
        new = [s for s in stretches if s not in self.slot]
        if new and (len(self.slot) + len(new) > self.kept or self.end > 32 * self.kept):
            self.keep_frequent()
            if self.end > 16 * self.kept:
                self.forget()
            new = [s for s in stretches if s not in self.slot]
        self.learn(new)
        slots = np.fromiter(map(self.slot.__getitem__, stretches), np.int64, len(stretches))
        self.used[slots] += 1
        return slots

    def texts(self, texts: list[str]) -> tuple[np.ndarray, list[str], np.ndarray, np.ndarray, np.ndarray]:
        """Figures of each text and the digest of its groups, and the distinct pairs of all: the text's
        place, the pair, and how often it stands there."""
        cells, counts = stretches_of(texts, self.parted)
        coded = cells.dictionary_encode()
        slot = self.slots(coded.dictionary.to_pylist())[coded.indices.to_numpy(zero_copy_only=False)] if len(cells) else np.zeros(0, np.int64)
        owner = np.repeat(np.arange(len(texts)), counts)
        figures = np.zeros((len(texts), 5), np.int64)
        full = np.flatnonzero(counts)
        if len(full):
            figures[full] = np.add.reduceat(self.figures[slot], (np.cumsum(counts) - counts)[full], axis=0)
        bad = {int(i) for i in np.flatnonzero(figures[:, 4]) if not all(self.tokens(" " + texts[i])[2:])}
        odd = set(np.flatnonzero(figures[:, 4]).tolist()) - bad
        digests, ends, places, words = [], np.cumsum(counts).tolist(), slot.tolist(), self.words
        for i, (n, end) in enumerate(zip(counts.tolist(), ends)):
            if not n or i in bad:
                digests.append("")
                continue
            digest = hashlib.sha256()
            for k in range(end - n, end, 100_000):
                digest.update(b";" * (k > end - n) + b";".join([words[s] for s in places[k : min(end, k + 100_000)]]))
            digests.append(digest.hexdigest())
        if odd:
            raise ValueError("a text is given back whole though one of its stretches is not")
        live = ~np.isin(owner, list(bad))
        figures[list(bad)] = 0
        one, times = np.unique(owner[live] << 32 | slot[live], return_counts=True)
        owner, slot = one >> 32, one & 0xFFFFFFFF
        length = self.length[slot]
        pairs = gathered(self.pairs, self.start[slot], length)
        times = gathered(self.times, self.start[slot], length) * np.repeat(times, length)
        return figures[:, :4], digests, *summed(np.repeat(owner, length), pairs, times)


def summed(owner: np.ndarray, pairs: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (owner, pair) in ascending order, with the sum of their times."""
    if not len(owner):
        return owner, pairs, times
    order = np.lexsort((pairs, owner))
    owner, pairs, times = owner[order], pairs[order], times[order]
    first = np.flatnonzero(np.append(True, (owner[1:] != owner[:-1]) | (pairs[1:] != pairs[:-1])))
    return owner[first], pairs[first], np.add.reduceat(times, first)


def stretches_of(texts: list[str], parted: bool = True) -> tuple[pa.Array, np.ndarray]:
    """Each text with a space before it, cut before every space that follows no white space (unless the
    tokenizers need whole texts), and the number of stretches of each text; none of an empty text. What is
    white space is told by the last two bytes of a character, so some other characters aren't cut after."""
    data = [(" " + t).encode() if t else b"" for t in texts]
    whole = np.frombuffer(b"".join(data), np.uint8)
    sizes = np.array([len(d) for d in data], np.int64)
    begins = np.zeros(len(whole), bool)
    if parted and len(whole):
        last, before = np.append(0, whole[:-1]), np.concatenate([[0, 0], whole[:-2]])[: len(whole)]
        ascii_blank = (last >= 0x09) & (last <= 0x0D) | (last >= 0x1C) & (last <= 0x20)
        wide_blank = np.isin(before, (0xC2, 0x9A, 0x80, 0x81)) & (last >= 0x80) & (last <= 0xAF)
        begins = (whole == 0x20) & ~ascii_blank & ~wide_blank
        begins[np.cumsum(sizes)[sizes > 0] - 1] = False  # a space alone would be no text
    firsts = (np.cumsum(sizes) - sizes)[sizes > 0]
    begins[firsts] = True
    at = np.flatnonzero(begins)
    counts = np.diff(np.searchsorted(at, np.append(0, np.cumsum(sizes))))
    buffers = [None, pa.py_buffer(np.append(at, len(whole)).astype(np.int32)), pa.py_buffer(whole.tobytes())]
    return pa.StringArray.from_buffers(len(at), buffers[1], buffers[2]), counts


@lru_cache(1)
def aligner_of(path_a: str, path_b: str) -> Aligner:
    return Aligner(path_a, path_b)


def aligned(df: DataFrame, id_col: str, text_col: str, path_a: str, path_b: str) -> DataFrame:
    """One row per row of `df`: `id_col`, n_a, n_b, n_groups, n_links, groups_sha256, and pairs and times,
    the distinct pairs of the document and how often it links them, as 64-bit integers."""
    key = df.schema[id_col].dataType.simpleString()

    def run(batches):
        for batch in slices(batches, "t"):
            model = aligner_of(path_a, path_b)
            figures, digests, owner, pairs, times = model.texts([t or "" for t in batch.column("t").to_pylist()])
            at = np.searchsorted(owner, np.arange(batch.num_rows + 1)).tolist()
            packed = [[x[i:j].tobytes() for i, j in zip(at, at[1:])] for x in (pairs.astype("<i8"), times.astype("<i8"))]
            columns = [batch.column("k"), *(pa.array(figures[:, i]) for i in range(4)), pa.array(digests, pa.string()), *(pa.array(p, pa.binary()) for p in packed)]
            yield pa.RecordBatch.from_arrays(columns, ["k", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times"])

    rows = df.select(F.col(f"`{id_col}`").alias("k"), F.col(f"`{text_col}`").alias("t"))
    return rows.mapInArrow(run, f"k {key}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs binary, times binary")


def pair_counts(rows: DataFrame) -> DataFrame:
    """pair, n: in how many of the aligned documents it is linked. Tasks count before the shuffle."""

    def run(batches):
        held, size = [], 0
        for batch in batches:
            for data in batch.column("pairs"):
                held.append(np.frombuffer(data.as_buffer(), "<i8"))
                size += len(held[-1])
                if size > COUNTED_PAIRS:
                    yield counted(held)
                    held, size = [], 0
        if size:
            yield counted(held)

    def counted(held):
        pairs, n = np.unique(np.concatenate(held), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(pairs), pa.array(n.astype(np.int64))], ["pair", "n"])

    return rows.select("pairs").mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))


def best_counts(counts: DataFrame) -> DataFrame:
    """a, best: the highest count of a pair of that id. At most one row an id of the vocabulary."""
    return counts.groupBy(F.floor(F.col("pair") / SIDE).alias("a")).agg(F.max("n").alias("best"))


def least_broadcast(counts: DataFrame, bound: int) -> int:
    """The least power of two such that at most `bound` pairs have so high a count."""
    classes = counts.groupBy(F.floor(F.log2("n")).cast("int").alias("class")).agg(F.count("*").alias("n")).collect()
    least, total = 62, 0
    for c in sorted(classes, key=lambda r: -r["class"]):
        total += c["n"]
        if total > bound:
            break
        least = c["class"]
    return 1 << least


def tokenizer_alignment(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path_a: str | None = None, path_b: str | None = None, broadcast_pairs: int = BROADCAST_PAIRS
) -> DataFrame:
    """One row per row of `df`: `id_col`, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.
    A pair's count is the number of rows that link it; n_best are the links whose count is the highest of
    their A id, ties included; count_sum is over links.

    Null and empty texts, and texts that one of the tokenizers doesn't give back byte by byte, have no
    tokens: zeros and an empty digest. Repeated rows each count and give equal rows; an empty table gives
    an empty result; ids, null and repeated ones too, are handed through; other columns aren't read. Texts
    of any length are aligned whole."""
    spark = df.sparkSession
    bounded_batches(spark)
    path_a, path_b = path_a or tokenizer_path(FILE_A), path_b or tokenizer_path(FILE_B)
    rows = written(aligned(df, id_col, text_col, path_a, path_b).withColumn("row", F.monotonically_increasing_id()), "aligned")
    counts = written(pair_counts(rows), "pairs")
    least = least_broadcast(counts, broadcast_pairs)
    top = best_counts(counts).toArrow()  # bounded by A's vocabulary
    best = np.zeros(max(top.column("a").to_pylist(), default=0) + 1, np.int64)
    best[top.column("a").to_numpy()] = top.column("best").to_numpy()
    hot = counts.filter(F.col("n") >= least).toArrow()  # at most broadcast_pairs rows
    order = np.argsort(hot.column("pair").to_numpy())
    sent = spark.sparkContext.broadcast((hot.column("pair").to_numpy()[order], hot.column("n").to_numpy()[order], best))
    key = df.schema[id_col].dataType.simpleString()

    def looked_up(batch):
        """Of all pairs of a batch: the row's place, the pair, its times, and its count or 0."""
        data = [np.frombuffer(x.as_buffer(), "<i8") for x in batch.column("pairs")]
        owner = np.repeat(np.arange(len(data)), [len(d) for d in data])
        pairs = np.concatenate([*data, np.zeros(0, np.int64)]).astype(np.int64)
        times = np.concatenate([*(np.frombuffer(x.as_buffer(), "<i8") for x in batch.column("times")), np.zeros(0, np.int64)])
        known, n, _ = sent.value
        if not len(known):
            return owner, pairs, times, np.zeros(len(pairs), np.int64)
        at = np.minimum(np.searchsorted(known, pairs), len(known) - 1)
        return owner, pairs, times, np.where(known[at] == pairs, n[at], 0)

    def total(batches):
        for batch in batches:
            owner, pairs, times, n = looked_up(batch)
            sums = np.zeros((2, batch.num_rows), np.int64)
            np.add.at(sums[0], owner, times * (n == sent.value[2][pairs // SIDE]))
            np.add.at(sums[1], owner, times * n)
            names = ["k", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "row"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(sums[0]), pa.array(sums[1])], [*names, "n_best", "count_sum"])

    def left_over(batches):
        for batch in batches:
            owner, pairs, times, n = looked_up(batch)
            cold = n == 0
            yield pa.RecordBatch.from_arrays([batch.column("row").take(pa.array(owner[cold])), pa.array(pairs[cold]), pa.array(times[cold])], ["row", "pair", "times"])

    out = rows.mapInArrow(total, f"k {key}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, row long, n_best long, count_sum long")
    if least > 1:
        rest = rows.select("row", "pairs", "times").mapInArrow(left_over, "row long, pair long, times long")
        ranked = counts.withColumn("best", F.max("n").over(Window.partitionBy(F.floor(F.col("pair") / SIDE)))).filter(F.col("n") < least)
        sums = rest.join(ranked, "pair").groupBy("row").agg(
            F.sum(F.when(F.col("n") == F.col("best"), F.col("times")).otherwise(0)).alias("more_best"), F.sum(F.col("times") * F.col("n")).alias("more")
        )
        out = out.join(sums, "row", "left")
        for name, more in (("n_best", "more_best"), ("count_sum", "more")):
            out = out.withColumn(name, F.col(name) + F.coalesce(more, F.lit(0)))
    return out.select(F.col("k").alias(id_col), "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
