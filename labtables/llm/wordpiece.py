"""Token counts by linear longest match.

Greedy word-piece takes the longest vocabulary entry at each position of a word. Here the vocabulary is
a trie with failure links: where no entry goes on, the link names the state that the remaining
characters stand in once the longest entry, and whatever must follow it, has been popped; how many
tokens that pops is precomputed. A word so takes one step a character, and only counts are kept.

Entries that begin with the mark stand at the start of a word, the others inside it.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterable
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import slices, tokenizer_path, utf8

DEFAULT_FILE = "piece_bpe_32k.model"
MARK = "▁"
#: Words whose counts a Python worker keeps; beyond it the older half is dropped.
KEPT_WORDS = 500_000
UNKNOWN = 1 << 40


class LongestMatch:
    """The automaton of a vocabulary."""

    def __init__(self, vocabulary: Iterable[str], mark: str = MARK):
        self.mark = mark
        self.goto: dict[int, int] = {}
        first, inner, parent, entry = 0, 1, [(-1, 0), (-1, 0)], [False, False]
        for piece in vocabulary:
            state, rest = (first, piece) if piece.startswith(mark) else (inner, piece)
            for c in rest:
                key = state << 21 | ord(c)
                if key not in self.goto:
                    self.goto[key] = len(parent)
                    parent.append((state, ord(c)))
                    entry.append(False)
                state = self.goto[key]
            entry[state] = bool(piece)
        # state -> state after popping, and how many tokens that pops; -1: the word can't be matched
        self.link, self.pops = [-1] * len(parent), [0] * len(parent)
        below: list[list[int]] = [[] for _ in parent]
        for state, (above, _) in enumerate(parent):
            if above >= 0:
                below[above].append(state)
        waiting = deque([first, inner])
        while waiting:
            above = waiting.popleft()
            for state in below[above]:
                waiting.append(state)
                if entry[state]:
                    self.link[state], self.pops[state] = inner, 1
                    continue
                at, popped = self.link[above], self.pops[above]
                while at >= 0 and (at << 21 | parent[state][1]) not in self.goto:
                    popped += self.pops[at]
                    at = self.link[at]
                if at >= 0:
                    self.link[state], self.pops[state] = self.goto[at << 21 | parent[state][1]], popped
        self.inner = inner
        self.words: dict[bytes, int] = {}

    def count(self, word: str) -> int:
        """Pieces of a word, or 0 if no greedy match covers it. The empty word has none."""
        if not word:
            return 0
        state, n, goto, link, pops = 0, 0, self.goto, self.link, self.pops
        for c in self.mark + word:
            code = ord(c)
            while (after := goto.get(state << 21 | code)) is None:
                n += pops[state]
                state = link[state]
                if state < 0:
                    return 0
            state = after
        while state != self.inner:
            n += pops[state]
            state = link[state]
            if state < 0:
                return 0
        return n

    def counts(self, texts: list[bytes]) -> list[tuple[int, int, int]]:
        """Words, pieces and unmatched words of each text; an unmatched word counts as one piece."""
        split = [t.split() for t in texts]
        new = set().union(*split) - self.words.keys()
        if len(self.words) + len(new) > KEPT_WORDS:
            self.words = dict(list(self.words.items())[len(self.words) // 2 :])
            new = set().union(*split) - self.words.keys()
        for word in new:
            self.words[word] = self.count(word.decode()) or UNKNOWN + 1
        totals = [(len(words), sum(map(self.words.__getitem__, words))) for words in split]
        for word in new:
            if len(word) > 64:
                del self.words[word]
        return [(n, total % UNKNOWN, total // UNKNOWN) for n, total in totals]


@lru_cache(2)
def automaton_of(path: str) -> LongestMatch:
    """The automaton of a sentencepiece vocabulary, control, unknown and byte pieces left out."""
    from sentencepiece import SentencePieceProcessor

    pieces = SentencePieceProcessor(model_file=path)
    plain = (i for i in range(pieces.get_piece_size()) if not (pieces.is_control(i) or pieces.is_unknown(i) or pieces.is_byte(i)))
    return LongestMatch(pieces.id_to_piece(i) for i in plain)


def token_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """One row per input row: `id_col`, n_words (runs of other than ASCII white space), n_pieces
    (greedy longest matches, one for an unmatched word), n_unknown (unmatched words). Null and empty
    texts have zeros; repeated rows give equal rows; an empty table gives no rows; other columns are
    not read. Nothing is shuffled."""
    at = path or tokenizer_path(DEFAULT_FILE)
    key = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        for batch in slices(batches, text_col):
            columns = zip(*automaton_of(at).counts(utf8(batch.column(text_col))))
            yield pa.RecordBatch.from_arrays([batch.column(id_col), *[pa.array(c, pa.int64()) for c in columns]], [id_col, "n_words", "n_pieces", "n_unknown"])

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {key}, n_words long, n_pieces long, n_unknown long")
