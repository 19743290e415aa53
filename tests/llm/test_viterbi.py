"""Unigram encodings by shared forward scores against exhaustive segmentation and a library; decoding; byte-pair texts beyond ASCII."""

import random

import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer
from tokenizers.models import Unigram

from tallychain.llm import pieces


def splits(word):
    if not word:
        yield []
    for n in range(1, len(word) + 1):
        for rest in splits(word[n:]):
            yield [word[:n], *rest]


@given(st.dictionaries(st.text("abc", min_size=1, max_size=4), st.integers(-40, -1), max_size=25), st.lists(st.text("abcd", max_size=8), max_size=12))
@settings(max_examples=150, deadline=None)
def test_best_paths_have_the_largest_sum(scores, words):
    unknown = min(scores.values(), default=0) - 10
    value = lambda parts: sum(scores.get(x, unknown) for x in parts)
    legal = lambda parts: all(x in scores or len(x) == 1 for x in parts)
    found = dict(pieces.best_paths(words, scores, unknown))
    assert set(found) == set(words)
    for word, parts in found.items():
        assert "".join(parts) == word and legal(parts)
        assert value(parts) == max(value(s) for s in splits(word) if legal(s))


def test_equal_to_a_library():
    r = random.Random(6)
    vocab = {c: -9 - r.random() for c in "abcdefg"} | {"".join(r.choice("abcdefg") for _ in range(r.randint(2, 5))): -r.random() * 12 for _ in range(400)}
    library = Tokenizer(Unigram([("<unk>", -99.0), *vocab.items()], unk_id=0))
    words = {"".join(r.choice("abcdefg") for _ in range(r.randint(1, 30))) for _ in range(300)}
    for word, parts in pieces.best_paths(words, vocab, min(vocab.values()) - 10):
        assert library.encode(word).tokens == parts


def test_unigram_texts_round_trip(spark):
    texts = ["some words and some more words", "Über naïve 😀 text", "", None, "line\nend  two"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    coded = pieces.encode_documents(df, kind="unigram")
    assert all(r.lossless for r in coded.collect())
    p = pieces.pieces(kind="unigram")
    word = "▁words"
    best = dict(pieces.best_paths([word], p.scores, min(p.scores.values()) - 10))[word]
    assert sum(p.scores[x] for x in best) == max(sum(p.scores[x] for x in s) for s in splits(word) if all(x in p.scores for x in s))


def test_decoding_documents(spark):
    texts = ["one two", "Ä ß 😀", "", None, " lead", "tail "]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r.doc_id: r.text for r in pieces.decode_documents(pieces.encode_documents(df)).collect()}
    assert found == dict(enumerate(texts))


def test_texts_beyond_ascii_equal_the_library():
    """Composed letters are left as they are by the library's folding, so both must agree on them."""
    library = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    r = random.Random(3)
    letters = "abcdeéèüößñçàîÄÖêabcdefghij"
    texts = [" ".join("".join(r.choice(letters) for _ in range(r.randint(1, 12))) for _ in range(r.randint(1, 30))) for _ in range(200)]
    assert [x.tolist() for x in pieces.pieces().encode(texts)] == library.encode(texts)
