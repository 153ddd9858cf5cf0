"""Token ids in fixed-width bit packing: each id takes the fewest bits that hold the vocabulary.

A data set is a folder of Parquet files written by Spark, so that writes are atomic, survive lost
executors and reach any file system. Its rows are frames in ascending document order: shard (the
writing partition), frame, shard_start (ids of the shard before it), n_ids, and the packed image:

    magic "FWID", version u8, bits u8, zero u16, documents u32, blocks u32, ids u64, ids a block u64,
    document ids i64[documents], document starts u64[documents + 1], nulls u8[documents],
    block offsets u64[blocks + 1] (bytes from the start of the payload), payload

All numbers are little-endian, and id i of a block stands in its bits i * bits and up, lowest bit
first. A block begins at a byte, so any id is reached from one offset without reading what precedes it.
"""

from __future__ import annotations

import struct
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bpe import DEFAULT_FILE, WordBpe, byte_characters
from .common import shared_folder, slices, tokenizer_path

HEAD = struct.Struct("<4sBBHIIQQ")
#: Ids of one frame, unless a single document has more; and of one block.
FRAME_IDS = 1 << 20
BLOCK_IDS = 1 << 12
#: Characters of text that are encoded at once: the more, the fewer words are looked up twice.
ENCODED_CHARS = 4_000_000
FRAME_SCHEMA = "shard int, frame int, shard_start long, n_ids long, image binary"


def bits_for(vocabulary: int) -> int:
    """Bits of an id of a vocabulary of so many entries."""
    return max(1, (max(vocabulary, 1) - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """The ids' lowest `bits` bits, one after another."""
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    planes = (ids.astype(np.uint32)[:, None] >> np.arange(bits, dtype=np.uint32)) & 1
    return np.packbits(planes.astype(np.uint8).ravel(), bitorder="little").tobytes()


def unpack(data: bytes | memoryview, n: int, bits: int, first: int = 0) -> np.ndarray:
    """`n` ids from position `first` of a packed run."""
    if bits in (8, 16, 32):
        return np.frombuffer(data, f"<u{bits // 8}", n, first * bits // 8).astype(np.uint32)
    raw = np.concatenate([np.frombuffer(data, np.uint8), np.zeros(8, np.uint8)])
    at = (np.arange(first, first + n, dtype=np.int64)) * bits
    byte, out = at >> 3, np.zeros(n, np.uint64)
    for k in range((bits + 14) // 8):
        out |= raw[byte + k].astype(np.uint64) << np.uint64(8 * k)
    return ((out >> (at & 7).astype(np.uint64)) & np.uint64((1 << bits) - 1)).astype(np.uint32)


def frame_image(doc_ids: list[int | None], lengths: np.ndarray, ids: np.ndarray, bits: int) -> bytes:
    starts = np.concatenate([[0], np.cumsum(lengths)]).astype("<u8")
    blocks = [pack(ids[i : i + BLOCK_IDS], bits) for i in range(0, len(ids), BLOCK_IDS)]
    offsets = np.concatenate([[0], np.cumsum([len(b) for b in blocks])]).astype("<u8")
    head = HEAD.pack(b"FWID", 1, bits, 0, len(doc_ids), len(blocks), len(ids), BLOCK_IDS)
    keys = np.array([0 if d is None else d for d in doc_ids], "<i8")
    nulls = np.array([d is None for d in doc_ids], np.uint8)
    return b"".join([head, keys.tobytes(), starts.tobytes(), nulls.tobytes(), offsets.tobytes(), *blocks])


class Frame:
    """Random access to the ids of one image."""

    def __init__(self, image: bytes):
        self.image = memoryview(image)
        magic, version, self.bits, _, docs, blocks, self.n_ids, self.block_ids = HEAD.unpack_from(image)
        if magic != b"FWID" or version != 1:
            raise ValueError("not a frame of packed ids")
        at = HEAD.size
        keys = np.frombuffer(image, "<i8", docs, at)
        self.starts = np.frombuffer(image, "<u8", docs + 1, at := at + 8 * docs).astype(np.int64)
        nulls = np.frombuffer(image, np.uint8, docs, at := at + 8 * (docs + 1))
        self.doc_ids = [None if z else int(k) for k, z in zip(keys, nulls)]
        self.offsets = np.frombuffer(image, "<u8", blocks + 1, at := at + docs).astype(np.int64)
        self.payload = self.image[at + 8 * (blocks + 1) :]

    def ids(self, first: int, last: int) -> np.ndarray:
        """The ids from `first` up to but without `last`; only the blocks that hold them are read."""
        parts = []
        for b in range(first // self.block_ids, -(-last // self.block_ids)):
            base = b * self.block_ids
            lo, hi = max(first - base, 0), min(last - base, self.block_ids)
            parts.append(unpack(self.payload[self.offsets[b] : self.offsets[b + 1]], hi - lo, self.bits, lo))
        return np.concatenate(parts) if parts else np.zeros(0, np.uint32)


class LibraryBpe(WordBpe):
    """The tokenizers library's own model merges the words."""

    kept = 1_000_000

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        super().__init__(path)
        self.library = Tokenizer.from_file(path)
        self.letters = {b: ord(c) for b, c in enumerate(byte_characters())}

    def merge_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        tokenize, letters = self.library.model.tokenize, self.letters
        lengths, ids = [], []
        for word in words:
            # printable ASCII stands for itself among the byte characters
            tokens = tokenize(word if word.isascii() and word.isprintable() else word.encode().decode("latin-1").translate(letters))
            lengths.append(len(tokens))
            ids += [t.id for t in tokens]
        return np.array(lengths, np.int64), np.array(ids, np.uint32)


def with_ends(lengths: np.ndarray, ids: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """Lengths and ids with `end_id` after each run."""
    sizes = lengths + 1
    out = np.full(len(ids) + len(sizes), end_id, np.uint32)
    inside = np.ones(len(out), bool)
    inside[np.cumsum(sizes) - 1] = False
    out[inside] = ids
    return sizes, out


@lru_cache(2)
def library_of(path: str) -> LibraryBpe:
    return LibraryBpe(path)


def write_packed(
    df: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text", path: str | None = None,
    end_id: int = 1, partitions: int | None = None, frame_ids: int = FRAME_IDS,
) -> None:
    """Tokenize each whole text, append `end_id`, and write the ids under `folder` in ascending order
    of `id_col` (nulls first, equal ids by a hash of their text). Null and empty texts have the end id
    alone; an empty table gives an empty folder of frames; texts of any length are one run of ids;
    other columns are not read. Ids are whole numbers, or text of such; others end the job. One range
    shuffle of the rows; every file is written by the task that holds its range, frame by frame."""
    at = path or tokenizer_path(DEFAULT_FILE)
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches):
        shard, frame, start, model = TaskContext.get().partitionId(), 0, 0, library_of(at)
        bits = bits_for(model.size)
        keys, lengths, ids, held = [], [], [], 0

        def flush():
            nonlocal frame, start, keys, lengths, ids, held
            image = frame_image(keys, np.array(lengths, np.int64), np.concatenate(ids), bits)
            row = pa.RecordBatch.from_arrays(
                [pa.array([shard], pa.int32()), pa.array([frame], pa.int32()), pa.array([start], pa.int64()), pa.array([held], pa.int64()), pa.array([image], pa.binary())],
                ["shard", "frame", "shard_start", "n_ids", "image"],
            )
            frame, start, keys, lengths, ids, held = frame + 1, start + held, [], [], [], 0
            return row

        for batch in slices(batches, text_col, ENCODED_CHARS):
            sizes, every = with_ends(*model.encode_column(batch.column(text_col)), end_id)
            first = last = 0  # ids of this slice that the open frame holds
            for key, size in zip(batch.column(id_col).to_pylist(), sizes.tolist()):
                if held and held + size > frame_ids:
                    ids.append(every[first:last])
                    first = last
                    yield flush()
                keys.append(key)
                lengths.append(size)
                held, last = held + size, last + size
            ids.append(every[first:])
        if keys:
            yield flush()

    # a hash of the text parts the rows of an id that many have
    keyed = df.select(F.col(id_col).cast("long").alias("k"), F.col(text_col).alias("t"), F.xxhash64(text_col).alias("h"))
    ordered = keyed.repartitionByRange(n, "k", "h").sortWithinPartitions("k", "h", "t").select(F.col("k").alias(id_col), F.col("t").alias(text_col))
    ordered.mapInArrow(run, FRAME_SCHEMA).write.option("compression", "zstd").parquet(folder)


def read_frames(spark: SparkSession, folder: str) -> DataFrame:
    """The frames with `start`, the ids of all frames before: a running sum over one row per written
    file, whose number the partition count bounds, broadcast to the frames."""
    frames = spark.read.schema(FRAME_SCHEMA).parquet(folder)
    totals = frames.groupBy("shard").agg(F.sum("n_ids").alias("total"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select("shard", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("base"))
    return frames.join(F.broadcast(starts), "shard").withColumn("start", F.col("base") + F.col("shard_start"))


def read_packed(spark: SparkSession, folder: str, id_col: str = "doc_id", with_ids: bool = False) -> DataFrame:
    """One row per document of a packed folder: `id_col`, start, n_tokens, ids_crc32 (of its ids as
    little-endian unsigned 32-bit integers), and the ids themselves if asked for. Null and repeated ids
    have rows of their own; a folder of an empty table gives no rows."""
    schema = f"`{id_col}` long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids

    def run(batches):
        for batch in batches:
            for image, base in zip(batch.column("image"), batch.column("start").to_pylist()):
                frame = Frame(image.as_py())
                ids = frame.ids(0, frame.n_ids).astype("<u4")
                parts = [ids[a:b] for a, b in zip(frame.starts, frame.starts[1:])]
                columns = [
                    pa.array(frame.doc_ids, pa.int64()), pa.array(frame.starts[:-1] + base, pa.int64()),
                    pa.array([len(x) for x in parts], pa.int64()), pa.array([zlib.crc32(x.tobytes()) for x in parts], pa.int64()),
                ]
                if with_ids:
                    columns.append(pa.array([x.astype(np.int64) for x in parts], pa.list_(pa.int64())))
                yield pa.RecordBatch.from_arrays(columns, [id_col, "start", "n_tokens", "ids_crc32", *["ids"] * with_ids])

    return read_frames(spark, folder).select("image", "start").mapInArrow(run, schema)


def packed_digests(df: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """Write `df` packed, then read the files back: a row per row of `df`, cases as in write_packed."""
    write_packed(df, folder, id_col, text_col, **options)
    return read_packed(df.sparkSession, folder, id_col)


def scratch_folder(spark: SparkSession, what: str) -> str:
    """A new path in the shared folder, removed when the application ends."""
    import atexit
    import uuid

    from .common import _remove

    path = f"{shared_folder(spark)}/labtables-{what}-{uuid.uuid4().hex}"
    atexit.register(_remove, spark, path)
    return path
