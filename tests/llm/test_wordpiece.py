import random

from labtables.llm import wordpiece as w
from labtables.llm.common import tokenizer_path


def greedy(word, vocabulary, mark=w.MARK):
    """Longest entry first, by trying all lengths."""
    rest, n = mark + word, 0
    while rest:
        for k in range(len(rest), 0, -1):
            piece = rest[:k]
            if piece in vocabulary and piece.startswith(mark) == (n == 0):
                break
        else:
            return 0
        rest, n = rest[len(piece) :], n + 1
    return n


def test_small_vocabularies():
    draw = random.Random(1)
    for _ in range(300):
        vocabulary = {("_" if draw.random() < 0.5 else "") + "".join(draw.choice("abc") for _ in range(draw.randint(1, 5))) for _ in range(draw.randint(1, 12))}
        match = w.LongestMatch(vocabulary, "_")
        for _ in range(40):
            word = "".join(draw.choice("abcd") for _ in range(draw.randint(1, 12)))
            assert match.count(word) == greedy(word, vocabulary, "_"), (vocabulary, word)


def test_public_vocabulary(spark):
    from sentencepiece import SentencePieceProcessor

    p = SentencePieceProcessor(model_file=tokenizer_path(w.DEFAULT_FILE))
    vocabulary = {p.id_to_piece(i) for i in range(p.get_piece_size()) if not (p.is_control(i) or p.is_unknown(i) or p.is_byte(i))}
    texts = [None, "", "The quick  brown\nfox", "Straße été 日本 \U0001f9ff", "z" * 50_000, "The quick  brown\nfox"]
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, n_words string")
    got = {r.doc_id: tuple(r)[1:] for r in w.token_counts(docs).collect()}
    for i, text in enumerate(texts):
        counts = [greedy(x, vocabulary) if len(x) < 100 else w.automaton_of(tokenizer_path(w.DEFAULT_FILE)).count(x) for x in (text or "").split()]
        assert got[i] == (len(counts), sum(c or 1 for c in counts), sum(c == 0 for c in counts))
    assert w.token_counts(docs.limit(0)).count() == 0


def test_whole_sample(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").limit(30)
    match = w.automaton_of(tokenizer_path(w.DEFAULT_FILE))
    want = {r.doc_id: sum(match.count(x) or 1 for x in r.text.encode().decode().split(" ") for x in x.split()) for r in docs.collect()}
    assert {r.doc_id: r.n_pieces for r in w.token_counts(docs).collect()} == want
