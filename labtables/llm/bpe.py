"""BPE encoding and decoding with a contiguous rank array per word.

A word is a run of part ids beside a run of the ranks of adjacent pairs. The smallest rank is found by
scanning, its boundary deleted and the two neighbouring ranks looked up again, until no adjacent pair
has a rank. The words that a slice of documents adds are merged together: one row of a rank matrix is
one word, and each step scans, deletes and refreshes in all rows at once. Words of more than
LONG_WORD bytes take a heap over linked parts, which gives the same parts in n log n.

Reads the JSON format of the tokenizers library for models of the kind "NFC, white space, lower case;
split by pattern; byte level; word ends marked by a suffix". Results equal the library's for all
characters of Unicode 15.1; for later ones the two follow different editions of the letter classes.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame

from .common import slices, tokenizer_path

NO_RANK = (1 << 31) - 1
#: Words of more bytes than this are merged with a heap.
LONG_WORD = 400
#: Words of at most this many bytes share rank matrices of MATRIX_ROWS rows.
SHORT_WORD = 48
MATRIX_ROWS = 4096
#: Words whose ids a Python worker keeps; beyond it all are forgotten.
KEPT_WORDS = 150_000
DEFAULT_FILE = "word_bpe_49k.json"
# Fixed value: the pattern whose words are told by classes of characters.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
LETTER, DIGIT, OTHER = 1, 2, 3


def byte_characters() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies: printable
    Latin-1 bytes stand for themselves, the others follow from U+0100."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = [b for b in range(256) if b not in set(plain)]
    return [chr(b) if b in set(plain) else chr(256 + other.index(b)) for b in range(256)]


class WordBpe:
    """Encoder and decoder of one tokenizer file."""

    kept = KEPT_WORDS

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            config = json.load(file)
        model = config["model"]
        vocabulary: dict[str, int] = model["vocab"]
        self.suffix: str = model.get("end_of_word_suffix") or ""
        self.special = {x["content"]: x["id"] for x in config["added_tokens"]}
        self.size = max([*vocabulary.values(), *self.special.values()]) + 1
        self.tokens: list[str] = [""] * self.size
        for token, i in [*vocabulary.items(), *self.special.items()]:
            self.tokens[i] = token
        self.ranks: dict[int, int] = {}
        self.merged: list[int] = []
        for rank, pair in enumerate(model["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            self.ranks.setdefault(vocabulary[left] << 20 | vocabulary[right], rank)
            self.merged.append(vocabulary[left + right])
        characters = byte_characters()
        self.inner = [vocabulary[c] for c in characters]
        self.final = [vocabulary[c + self.suffix] for c in characters]
        keys = np.fromiter(self.ranks, np.int64, len(self.ranks))
        order = np.argsort(keys)
        self.pair_keys = np.append(keys[order], np.iinfo(np.int64).max)
        self.pair_ranks = np.append(np.fromiter(self.ranks.values(), np.int32, len(keys))[order], NO_RANK)
        self.merged_ids = np.array([*self.merged, 0], np.int32)
        self.inner_ids, self.final_ids = np.array(self.inner, np.int32), np.array(self.final, np.int32)
        steps = config["pre_tokenizer"].get("pretokenizers", [config["pre_tokenizer"]])
        self.pattern = regex.compile(next(s["pattern"]["Regex"] for s in steps if s["type"] == "Split"))
        self.special_pattern = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.by_class = self.pattern.pattern == SPLIT
        # kept words: place by word; where a word's ids begin in flat, and how many they are
        self.slot: dict[str, int] = {}
        self.start, self.length = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.flat, self.end = np.zeros(0, np.uint32), 0

    def merge(self, word: bytes) -> list[int]:
        """Ids of one word."""
        if not word:
            return []
        ids = [self.inner[b] for b in word]
        ids[-1] = self.final[word[-1]]
        if len(ids) > LONG_WORD:
            return self._merge_long(ids)
        rank_of, merged = self.ranks.get, self.merged
        ranks = [rank_of(a << 20 | b, NO_RANK) for a, b in zip(ids, ids[1:])]
        while ranks:
            rank = min(ranks)
            if rank == NO_RANK:
                break
            i = ranks.index(rank)
            ids[i] = merged[rank]
            del ids[i + 1], ranks[i]
            if i:
                ranks[i - 1] = rank_of(ids[i - 1] << 20 | ids[i], NO_RANK)
            if i < len(ranks):
                ranks[i] = rank_of(ids[i] << 20 | ids[i + 1], NO_RANK)
        return ids

    def _merge_long(self, ids: list[int]) -> list[int]:
        n = len(ids)
        after, before, rank_of = [*range(1, n), -1], [-1, *range(n - 1)], self.ranks.get
        heap = [(r, i) for i in range(n - 1) if (r := rank_of(ids[i] << 20 | ids[i + 1], NO_RANK)) != NO_RANK]
        heapq.heapify(heap)
        while heap:
            rank, i = heapq.heappop(heap)
            j = after[i]
            if ids[i] < 0 or j < 0 or rank_of(ids[i] << 20 | ids[j], NO_RANK) != rank:
                continue
            ids[i], ids[j], after[i] = self.merged[rank], -1, after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b >= 0 and (r := rank_of(ids[a] << 20 | ids[b], NO_RANK)) != NO_RANK:
                    heapq.heappush(heap, (r, a))
        return [x for x in ids if x >= 0]

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = left.astype(np.int64) << 20 | right
        at = np.searchsorted(self.pair_keys, keys)
        return np.where(self.pair_keys[at] == keys, self.pair_ranks[at], NO_RANK).astype(np.int32)

    def merge_all(self, words: list[bytes]) -> list[bytes]:
        """Ids of each word as little-endian 32-bit integers."""
        out: list[bytes] = [b""] * len(words)
        order = sorted(range(len(words)), key=lambda i: len(words[i]))
        for start in range(0, len(order), MATRIX_ROWS):
            part = [i for i in order[start : start + MATRIX_ROWS] if 0 < len(words[i]) <= SHORT_WORD]
            if part:
                self._merge_matrix([words[i] for i in part], part, out)
        for i in reversed(order):
            if len(words[i]) <= SHORT_WORD:
                break
            out[i] = np.array(self.merge(words[i]), "<u4").tobytes()
        return out

    def _merge_matrix(self, words: list[bytes], at: list[int], out: list[bytes]) -> None:
        width = len(words[-1])
        length = np.array([len(w) for w in words])
        symbols = np.frombuffer(b"".join(w.ljust(width, b"\0") for w in words), np.uint8).reshape(len(words), width)
        ids, row = self.inner_ids[symbols], np.arange(len(words))
        ids[row, length - 1] = self.final_ids[symbols[row, length - 1]]
        ranks = self._rank(ids[:, :-1], ids[:, 1:])
        ranks[np.arange(width - 1) >= (length - 1)[:, None]] = NO_RANK
        place = np.array(at)
        while len(row):
            low = ranks.argmin(1) if ranks.shape[1] else np.zeros(len(row), int)
            rank = ranks[row, low] if ranks.shape[1] else np.full(len(row), NO_RANK)
            over = rank == NO_RANK
            if over.any():
                done, step = ids[over].astype("<u4").tobytes(), 4 * ids.shape[1]
                for k, (i, n) in enumerate(zip(place[over].tolist(), length[over].tolist())):
                    out[i] = done[k * step : k * step + 4 * n]
                left = ~over
                ids, ranks, low, rank, length, place = ids[left], ranks[left], low[left], rank[left], length[left], place[left]
                row = np.arange(len(ids))
                if not len(row):
                    return
            ids[row, low] = self.merged_ids[rank]
            column = np.arange(ids.shape[1])
            ids = ids[column != low[:, None] + 1].reshape(len(row), -1)
            ranks = ranks[column[:-1] != low[:, None]].reshape(len(row), -1)
            length = length - 1
            has = low > 0
            ranks[row[has], low[has] - 1] = self._rank(ids[row[has], low[has] - 1], ids[row[has], low[has]])
            has = low < length - 1
            ranks[row[has], low[has]] = self._rank(ids[row[has], low[has]], ids[row[has], low[has] + 1])

    def words_of(self, run: str) -> list[str]:
        """Words of a text, and the special tokens that stand in it, in order."""
        out, at = [], 0
        for hit in self.special_pattern.finditer(run) if self.special_pattern else ():
            out += self.pattern.findall(normalized(run[at : hit.start()]))
            out.append(hit.group())
            at = hit.end()
        return out + self.pattern.findall(normalized(run[at:]))

    def _words(self, runs: pa.StringArray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
        """The words of runs between white space, and for each run its first word's place and its number
        of words. Runs with an apostrophe or a special token go through the pattern one by one; in all
        others a word ends where the class of the character changes or stands a digit, which is found
        for all runs at once."""
        odd = pc.match_substring(runs, "'")
        for token in self.special:
            odd = pc.or_(odd, pc.match_substring(runs, token))
        odd = odd.to_numpy(zero_copy_only=False) if self.by_class else np.ones(len(runs), bool)
        count, parts = np.zeros(len(runs), np.int64), []
        plain = np.flatnonzero(~odd)
        if len(plain):
            some = runs if len(plain) == len(runs) else runs.take(pa.array(plain))
            text = normalized(pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(some)], pa.int32()), some), " ")[0].as_py())
            codes = np.frombuffer(text.encode(), np.uint8) if text.isascii() else np.frombuffer(text.encode("utf-32-le"), np.uint32)
            kinds = character_kinds()[codes]
            inside = kinds > 0
            opens = inside.copy()
            opens[1:] &= (kinds[1:] != kinds[:-1]) | (kinds[1:] == DIGIT)
            first = np.flatnonzero(opens)
            if codes.dtype == np.uint8:
                size, data = inside, codes[inside].tobytes()
            else:
                size = (1 + (codes > 0x7F).astype(np.int8) + (codes > 0x7FF) + (codes > 0xFFFF)) * inside
                data = codes[inside].tobytes().decode("utf-32-le").encode()
            before = np.cumsum(size, dtype=np.int64) - size
            offsets = np.append(before[first], len(data)).astype(np.int32)
            parts.append(pa.StringArray.from_buffers(len(first), pa.py_buffer(offsets), pa.py_buffer(data)))
            run = np.cumsum(codes == 32)[first]
            count[plain] = np.bincount(run, minlength=len(plain))
        words = [self.words_of(r) for r in runs.filter(pa.array(odd)).to_pylist()]
        if words:
            parts.append(pa.array([w for ws in words for w in ws], pa.string()))
            count[odd] = [len(ws) for ws in words]
        # plain runs' words come first, then the others'
        order = np.concatenate([plain, np.flatnonzero(odd)])
        first = np.empty(len(runs), np.int64)
        first[order] = np.cumsum(count[order]) - count[order]
        return pa.concat_arrays(parts) if parts else pa.array([], pa.string()), first, count

    def merge_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Number of ids of each word, and the ids of all."""
        merged = self.merge_all([w.encode() for w in words])
        return np.array([len(m) // 4 for m in merged], np.int64), np.frombuffer(b"".join(merged), "<u4")

    def _slots(self, words: list[str]) -> np.ndarray:
        """The place of each distinct word in the kept words; new ones are merged. What is kept is
        forgotten when it would grow beyond its bounds."""
        slot = self.slot
        new = [w for w in words if w not in slot]
        if new and (len(slot) + len(new) > self.kept or self.end > 8 * self.kept):
            slot.clear()
            self.end, new = 0, words
        if new:
            known = [w for w in new if w not in self.special]
            length, ids = self.merge_words(known)
            marks = [w for w in new if w in self.special]
            length = np.concatenate([length, np.ones(len(marks), np.int64)])
            ids = np.concatenate([ids, np.array([self.special[w] for w in marks], np.uint32)])
            n, end = len(slot), self.end + len(ids)
            slot.update(zip(known + marks, range(n, n + len(new))))
            self.start, self.length = grown(self.start, n + len(new)), grown(self.length, n + len(new))
            self.flat = grown(self.flat, end)
            self.start[n : n + len(new)] = self.end + np.cumsum(length) - length
            self.length[n : n + len(new)] = length
            self.flat[self.end : end] = ids
            self.end = end
        return np.fromiter(map(slot.__getitem__, words), np.int64, len(words))

    def encode_column(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The number of ids of each whole text (null: none), and all ids in order. White space parts
        words and is dropped, so the distinct runs between white space are split once, their distinct
        words are looked up or merged once, and ids are gathered from there."""
        lists = pc.ascii_split_whitespace(texts.fill_null(""))
        flat = lists.flatten().dictionary_encode()
        words, first, count = self._words(flat.dictionary)
        coded = words.dictionary_encode()
        slots = self._slots(coded.dictionary.to_numpy(zero_copy_only=False).tolist())[coded.indices.to_numpy()] if len(words) else np.zeros(0, np.int64)
        length = self.length[slots]
        begins = np.concatenate([[0], np.cumsum(length)])
        ids = gathered(self.flat, self.start[slots], length)
        run = flat.indices.to_numpy()
        start, length = begins[first], begins[first + count] - begins[first]
        ends = np.concatenate([[0], np.cumsum(length[run])])
        offsets = lists.offsets.to_numpy()
        return np.diff(ends[offsets]), gathered(ids, start[run], length[run])

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """Ids of each whole text as little-endian 32-bit integers."""
        lengths, ids = self.encode_column(pa.array([t.decode() for t in texts], pa.string()))
        ends = np.cumsum(lengths)
        return [ids[e - n : e].astype("<u4").tobytes() for n, e in zip(lengths.tolist(), ends.tolist())]

    def decode(self, ids: list[int]) -> str:
        """The tokens of the ids joined by spaces, as decode() of a tokenizer without a decoder does;
        ids beyond the vocabulary are left out."""
        try:
            return " ".join([self.tokens[i] for i in ids])
        except IndexError:
            return " ".join([self.tokens[i] for i in ids if i < self.size])


@lru_cache(1)
def character_kinds() -> np.ndarray:
    """Code point -> 0 for white space, or whether it is a letter, a digit or another character."""
    every = "".join(map(chr, range(0x110000)))
    kinds = np.full(len(every), OTHER, np.uint8)
    for kind, pattern in ((0, r"\s+"), (LETTER, r"\p{L}+"), (DIGIT, r"\p{N}+")):
        for hit in regex.finditer(pattern, every):
            kinds[hit.start() : hit.end()] = kind
    return kinds


def grown(a: np.ndarray, size: int) -> np.ndarray:
    """`a` with room for `size` items, at least doubled where it had too little."""
    return a if len(a) >= size else np.concatenate([a, np.zeros(max(size, 2 * len(a)) - len(a), a.dtype)])


def gathered(flat: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The stretches of `flat` that begin at `start`, one after another."""
    ends = np.cumsum(length)
    return flat[np.repeat(start - ends + length, length) + np.arange(ends[-1] if len(ends) else 0)]


def normalized(text: str) -> str:
    """NFC, then lower case character by character (no final sigma)."""
    if text.isascii():
        return text.lower()
    text = unicodedata.normalize("NFC", text)
    return "".join(c.lower() for c in text) if "Σ" in text else text.lower()


@lru_cache(2)
def model_of(path: str) -> WordBpe:
    """One model and its known runs for all tasks of a Python worker."""
    return WordBpe(path)


def encode_text(path: str, text: bytes) -> np.ndarray:
    return np.frombuffer(model_of(path).encode([text])[0], "<u4")


def bpe_encode(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """One row per input row: `id_col`, ids array<int>. Null and empty texts, and texts of white space
    only, give an empty array; repeated rows give equal rows; other columns of `df` are not read."""
    at = path or tokenizer_path(DEFAULT_FILE)
    key = df.schema[id_col].dataType.simpleString()

    def run(batches):
        for batch in slices(batches, text_col):
            lengths, ids = model_of(at).encode_column(batch.column(text_col))
            offsets = pa.array(np.concatenate([[0], np.cumsum(lengths)]), pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(id_col), pa.ListArray.from_arrays(offsets, pa.array(ids.astype(np.int32)))], [id_col, "ids"])

    return df.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {key}, ids array<int>")


def bpe_decode(df: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", path: str | None = None) -> DataFrame:
    """One row per input row: `id_col`, decoded string. A null array decodes as the empty text."""
    at = path or tokenizer_path(DEFAULT_FILE)
    key = df.schema[id_col].dataType.simpleString()

    def run(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                model = model_of(at)
                texts = [model.decode(ids or []) for ids in part.column(ids_col).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(id_col), pa.array(texts, pa.string())], [id_col, "decoded"])

    return df.select(id_col, ids_col).mapInArrow(run, f"`{id_col}` {key}, decoded string")


def bpe_round_trip(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """Encode each whole text and decode its ids in the same task, keeping digests only: `id_col`,
    n_tokens, ids_sha256 (of the ids as little-endian unsigned 32-bit integers), decoded_sha256.
    Rows and cases as in bpe_encode; no row leaves its task, so nothing is shuffled."""
    at = path or tokenizer_path(DEFAULT_FILE)
    key = df.schema[id_col].dataType.simpleString()

    def run(batches):
        for batch in slices(batches, text_col):
            model, ids_digest, text_digest = model_of(at), [], []
            counts, every = model.encode_column(batch.column(text_col))
            ends = np.cumsum(counts)
            for n, end in zip(counts.tolist(), ends.tolist()):
                ids = every[end - n : end].astype("<u4")
                ids_digest.append(hashlib.sha256(ids.tobytes()).hexdigest())
                text_digest.append(hashlib.sha256(model.decode(ids.tolist()).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(id_col), pa.array(counts, pa.int64()), pa.array(ids_digest), pa.array(text_digest)],
                [id_col, "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return df.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {key}, n_tokens long, ids_sha256 string, decoded_sha256 string")
