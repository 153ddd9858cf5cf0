"""Language identification with averaged hashed subword embeddings and a linear softmax.

A document is the mean of the embeddings of its character n-grams, hashed into BUCKETS rows; a linear
layer and a softmax give the languages. Stochastic gradient descent in numpy trains both on a bounded
sample of labelled documents. A temperature fitted on other labelled documents calibrates the scores,
and a low quantile of their scores is the bound below which a document is rejected.

The mean and the linear layer commute, so where languages are few, prediction needs one row of language
scores per bucket (embeddings times weights), summed over the n-grams of a whole text in numpy; where they
are more than DIMENSIONS, embeddings are summed, so that a model's size hardly grows with its languages.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import packed, slices, unpacked

BUCKET_BITS = 18
BUCKETS = 1 << BUCKET_BITS
DIMENSIONS = 16
#: Lengths of n-grams; those above 1 may begin or end with the word's edge.
LENGTHS = (1, 3, 4)
#: Most labelled documents per language in the training sample, and in the calibration sample.
TRAIN_ROWS = 600
CALIBRATION_ROWS = 300
#: Distinct n-grams of all documents of a sample together. Of each language whole documents are taken in
#: the sample's order while they fit its equal share, one at least; so this and the two numbers
#: of rows bound what the driver gets, at 8 bytes an n-gram, whatever the number of languages.
SAMPLE_NGRAMS = 6_000_000
EPOCHS = 12
RATE = 4.0
#: Share of calibration documents that fall below the rejection bound, and the most it can be: a half,
#: and so many times what a guess among the languages scores.
REJECTED_SHARE = 0.001
MOST_BOUND = 0.5
ABOVE_CHANCE = 1.5
UNDETERMINED = "und"


@lru_cache(1)
def letters() -> np.ndarray:
    """Code point -> lower-case code point of a letter, 0 for anything else."""
    table = np.zeros(0x110000, np.uint32)
    for c in range(0x110000):
        if chr(c).isalpha():
            low = chr(c).lower()
            table[c] = ord(low) if len(low) == 1 else c
    return table


def ngram_buckets(codes: np.ndarray) -> list[np.ndarray]:
    """For each length, the bucket of the n-gram that starts at each position, BUCKETS where there is
    none: the inner characters must be letters, and the outer ones may be word edges (0)."""
    out = []
    padded = np.concatenate([codes, np.zeros(max(LENGTHS), np.uint32)])
    n = len(codes)
    for length in LENGTHS:
        h = np.full(n, 0x9E3779B1 * length & 0xFFFFFFFF, np.uint32)
        for k in range(length):
            h = (h ^ padded[k : n + k]) * np.uint32(0x85EBCA6B)
            h ^= h >> np.uint32(15)
        inner = range(1, length - 1) if length > 2 else range(length)
        valid = np.ones(n, bool)
        for k in inner:
            valid &= padded[k : n + k] > 0
        out.append(np.where(valid, (h * np.uint32(0xC2B2AE35)) >> np.uint32(32 - BUCKET_BITS), BUCKETS))
    return out


def joined_codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Letter codes of all texts with an edge before each, and where each begins."""
    joined = "\n" + "\n".join(texts)
    codes = letters()[np.frombuffer(joined.encode("utf-32-le", "replace"), np.uint32)]
    starts = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])])[:-1]
    return codes, starts


def text_features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of a whole text's n-grams and their shares."""
    codes, _ = joined_codes([text])
    counts = sum(np.bincount(b, minlength=BUCKETS + 1)[:BUCKETS] for b in ngram_buckets(codes))
    at = np.flatnonzero(counts)
    return at.astype(np.int32), (counts[at] / max(counts[at].sum(), 1)).astype(np.float32)


@dataclass
class LanguageModel:
    """Languages, a row per bucket (a last row of zeros for "no n-gram") of scores or, with `weights`,
    embeddings that these turn into scores; temperature, bound."""

    languages: list[str]
    table: np.ndarray
    weights: np.ndarray | None = None
    temperature: float = 1.0
    bound: float = 0.0
    notes: dict = field(default_factory=dict)

    def logits(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Uncalibrated scores of each text, and its number of letters."""
        codes, starts = joined_codes(texts)
        sums, grams = np.zeros((len(texts), self.table.shape[1])), np.zeros(len(texts))
        for b in ngram_buckets(codes):
            sums += np.add.reduceat(self.table[b], starts, axis=0, dtype=np.float64)
            grams += np.add.reduceat(b < BUCKETS, starts, dtype=np.float64)
        sums /= np.maximum(grams, 1)[:, None]
        return sums if self.weights is None else sums @ self.weights, np.add.reduceat(codes > 0, starts, dtype=np.int64)

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        if not texts:
            return [], []
        if not self.languages:
            return [UNDETERMINED] * len(texts), [0.0] * len(texts)
        logits, n_letters = self.logits([t or "" for t in texts])
        p = softmax(logits / self.temperature)
        best = p.argmax(1)
        names = [self.languages[k] if n else UNDETERMINED for k, n in zip(best, n_letters)]
        return names, [float(min(max(x, 0.0), 1.0)) if n else 0.0 for x, n in zip(p[np.arange(len(best)), best], n_letters)]


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def train(rows: list[tuple[str, np.ndarray, np.ndarray]], held: list[tuple[str, np.ndarray, np.ndarray]], seed: int = 7) -> LanguageModel:
    """Fit on (language, buckets, shares) rows; calibrate on held ones. No rows give a model that
    rejects everything; one language gives that language."""
    languages = sorted({r[0] for r in rows})
    draw, n = np.random.default_rng(seed), len(languages)
    embed = draw.uniform(-1 / DIMENSIONS, 1 / DIMENSIONS, (BUCKETS, DIMENSIONS)).astype(np.float32)
    weights, seen = np.zeros((DIMENSIONS, n), np.float32), np.zeros(BUCKETS, bool)
    steps, total = 0, EPOCHS * len(rows)
    target = np.eye(n, dtype=np.float32)
    known = {x: i for i, x in enumerate(languages)}
    for _ in range(EPOCHS):
        for k in draw.permutation(len(rows)):
            language, at, share = rows[k]
            if not len(at):
                continue
            rate = RATE * (1 - steps / total)
            mean = share @ embed[at]
            wrong = softmax((mean @ weights)[None])[0] - target[known[language]]
            back = weights @ wrong
            weights -= rate * np.outer(mean, wrong)
            seen[at] = True
            # the mean shares one gradient among its n-grams; scaled by their number, or rows that
            # occur once would hardly move
            embed[at] -= (0.1 * rate * len(at) ** 0.5) * share[:, None] * back
            steps += 1
    embed[~seen] = 0  # n-grams that no document had speak for no language
    few = n <= DIMENSIONS
    table = embed @ weights if few else embed
    table = np.concatenate([table, np.zeros((1, table.shape[1]), np.float32)]).astype(np.float32)
    model = LanguageModel(languages, table, None if few else weights)
    held = [h for h in held if h[0] in known and len(h[1])]
    if held:
        logits = np.array([h[2].astype(np.float64) @ table[h[1]] for h in held])
        logits = logits if few else logits @ weights
        truth = np.array([known[h[0]] for h in held])
        loss = lambda t: -np.log(np.maximum(softmax(logits / t)[np.arange(len(truth)), truth], 1e-12)).mean()
        model.temperature = float(min(np.geomspace(0.05, 5, 60), key=loss))
        top = softmax(logits / model.temperature)
        model.bound = float(min(MOST_BOUND, ABOVE_CHANCE / n, np.quantile(top.max(1), REJECTED_SHARE)))
        model.notes = {"held": len(held), "accuracy": float((top.argmax(1) == truth).mean())}
    return model


def fold(id_col: str, folds: int = 4) -> Column:
    return (F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % folds).cast("int")


def labelled_sample(docs: DataFrame, id_col: str, text_col: str, lang_col: str, samples: dict[str, tuple[Column, int]]) -> dict[str, list[tuple[str, np.ndarray, np.ndarray]]]:
    """For each of `samples` (which rows, how many per language) the features of labelled documents, those
    of lowest hash of id and text; rows that repeat both count once. The labels are counted in one pass;
    in another, texts of low hashes are read whole. The driver gets a row per label, and vectors of
    SAMPLE_NGRAMS n-grams and one document a language at most."""
    part = F.coalesce(*[F.when(keep, F.lit(name)) for name, (keep, _) in samples.items()])
    known = docs.select(F.col(id_col).cast("string").alias("i"), F.col(text_col).alias("t"), F.col(lang_col).cast("string").alias("l"), part.alias("part"))
    known = known.filter("part is not null and l is not null and t is not null")
    counts = known.groupBy("part", "l").agg(F.count(F.lit(1)).alias("n"))
    found = counts.collect()
    if not found:
        return {name: [] for name in samples}
    # about one and a half times as many as wanted pass, so that few texts are shuffled
    share = F.create_map(*[x for r in found for x in (F.lit(f"{r.part} {r.l}"), F.lit(min(1.0, 1.5 * samples[r.part][1] / r.n + 40.0 / r.n)))])
    h = F.xxhash64(F.lit(7), "i", "t")
    some = known.withColumn("h", h).filter((F.col("h") / 2.0**64 + 0.5) < F.try_element_at(share, F.concat_ws(" ", "part", "l")))

    def run(batches):
        for batch in slices(batches, "t", 200_000):
            pairs = [text_features(t) for t in batch.column("t").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("part"), batch.column("l"), batch.column("h"), pa.array([len(a) for a, _ in pairs], pa.int64()),
                    pa.array([packed(np.diff(a, prepend=np.int32(0))) for a, _ in pairs], pa.binary()), pa.array([packed(s) for _, s in pairs], pa.binary()),
                ],
                ["part", "l", "h", "n", "steps", "share"],
            )

    # vectors are made where texts are read, so that no text is shuffled
    vectors = some.select("part", "l", "h", "t").mapInArrow(run, "part string, l string, h long, n long, steps binary, share binary").dropDuplicates(["part", "l", "h"])
    wanted = F.coalesce(*[F.when(F.col("part") == name, F.lit(rows)) for name, (_, rows) in samples.items()])
    by = Window.partitionBy("part", "l").orderBy("h")
    placed = vectors.withColumns({"nth": F.row_number().over(by), "grams": F.sum("n").over(by.rowsBetween(Window.unboundedPreceding, 0))})
    fits = (F.col("nth") == 1) | (F.col("grams") <= SAMPLE_NGRAMS / len({r.l for r in found}))
    # packed, so that the driver's heap gets a third of the bytes, as Arrow buffers, which go back to the system
    got = placed.filter((F.col("nth") <= wanted) & fits).select("part", "l", "nth", "steps", "share").toArrow().sort_by([("part", "ascending"), ("l", "ascending"), ("nth", "ascending")])
    out: dict[str, list] = {name: [] for name in samples}
    for batch in got.to_batches():
        for i, (name, language) in enumerate(zip(batch.column("part").to_pylist(), batch.column("l").to_pylist())):
            at = np.cumsum(unpacked(batch.column("steps")[i].as_py(), "<i4"), dtype=np.int32)
            share = unpacked(batch.column("share")[i].as_py(), "<f4")
            if len(at):
                out[name].append((language, at, share))
    return out


def fit_language_model(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", held_out: int = 2,
    train_rows: int = TRAIN_ROWS, calibration_rows: int = CALIBRATION_ROWS,
) -> LanguageModel:
    """Fit on labelled documents of all folds of crc32(id) mod 4 but `held_out`; of those, the fold
    after it calibrates. Null labels and texts don't train; without labels all is rejected; repeated
    rows count once; other columns are not read."""
    cut = fold(id_col)
    other = (held_out + 1) % 4
    got = labelled_sample(docs, id_col, text_col, lang_col, {"train": (~cut.isin(held_out, other), train_rows), "held": (cut == other, calibration_rows)})
    model = train(got["train"] or got["held"], got["held"])
    del got
    pa.default_memory_pool().release_unused()
    return model


def predict_language(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per input row: `id_col`, the columns `keep`, lang_pred (a learned language, or und for
    null texts and texts without letters), score (0 to 1), rejected (und, or score below the model's
    bound). Whole texts count; empty tables give no rows; repeated rows give equal rows; kept columns of
    the results' names give way to the results."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)  # BUCKETS rows of at most DIMENSIONS numbers
    carried = [id_col, *[k for k in keep if k not in (id_col, "lang_pred", "score", "rejected")]]
    fields = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in carried)

    def run(batches):
        for batch in slices(batches, text_col, 400_000):
            names, scores = shared.value.predict(batch.column(text_col).to_pylist())
            rejected = [n == UNDETERMINED or s < shared.value.bound for n, s in zip(names, scores)]
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in carried], pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(rejected, pa.bool_())], [*carried, "lang_pred", "score", "rejected"]
            )

    columns = [*carried, text_col] if text_col not in carried else carried
    return docs.select(*columns).mapInArrow(run, f"{fields}, lang_pred string, score double, rejected boolean")


def language_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", held_out: int = 2) -> DataFrame:
    """`id_col`, held_out, lang_pred, score, rejected, bound (the score below which a document is
    rejected) for each row of `docs`, from a model that never saw the held-out fold; cases as in
    fit_language_model and predict_language."""
    model = fit_language_model(docs, id_col, text_col, lang_col, held_out)
    out = predict_language(docs, model, id_col, text_col)
    return out.select(id_col, (fold(id_col) == held_out).alias("held_out"), "lang_pred", "score", "rejected", F.lit(model.bound).alias("bound"))
