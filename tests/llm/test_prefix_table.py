"""The prefix table of op7_sentencepiece against the library, words of every length, and against merging part by part."""

import random

import pyarrow as pa
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")

from tabulon.llm import sentencepieces  # noqa: E402

LETTERS = "etaoinshrdluETé'ß.,中的文😀\x01▁\x1e\n "


@pytest.fixture(scope="module")
def table():
    return sentencepieces.PrefixTable(public_tokenizers.path("piece_bpe_32k.model"))


def encoded(table, texts):
    got = []
    for _, _, offsets, ids in sentencepieces.encode_texts(table, pa.array(texts, pa.large_string()), 2):
        got += [ids[a:b].tolist() for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
    return got


def test_short_words_are_not_encoded_one_by_one(table, monkeypatch):
    rng = random.Random(7)
    texts = [" ".join("".join(rng.choice(LETTERS[:20]) for _ in range(rng.randint(1, 12))) for _ in range(200)) for _ in range(50)]
    want = [[*x, 2] for x in table.library.encode(texts)]
    monkeypatch.setattr(table, "segment", lambda word: pytest.fail(f"{word} was encoded alone"))
    for step in (1, 100, 1 << 18):
        monkeypatch.setattr(table, "STEP", step)
        assert encoded(table, texts) == want


def test_words_of_every_length(table):
    rng = random.Random(8)
    texts = ["".join(rng.choice(LETTERS[: rng.choice((6, 16, 19, 22, 25))]) for _ in range(n)) for n in [*range(150), 3000] for _ in range(5)]
    texts += ["", " ", "\x01" * 70, "😀" * 63, "😀" * 64, "😀" * 65, "a" * 300, "中" * 63 + "a", "é " * 40]
    rng.shuffle(texts)
    assert encoded(table, texts) == [[*x, 2] for x in table.library.encode(texts)]


def test_compatible_is_what_merging_gives(table):
    def merged(text):
        parts = list(text)
        while True:
            found = [(table.score[a + b], -i) for i, (a, b) in enumerate(zip(parts[:-1], parts[1:], strict=True)) if a + b in table.score]
            if not found:
                return parts
            at = -max(found)[1]
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    rng, own = random.Random(9), sorted(table.piece)
    plain = [i for i in own if table.piece[i].isascii()]
    fits = 0
    for _ in range(6000):
        a, b = rng.choice(rng.choice((own, plain))), rng.choice(plain)
        want = merged(table.piece[a] + table.piece[b]) == [table.piece[a], table.piece[b]]
        assert table.compatible(a, b) == want, (table.piece[a], table.piece[b])
        fits += want
    assert 1000 < fits < 5900


def test_pairs_are_dropped_where_they_are_many(monkeypatch):
    monkeypatch.setattr(sentencepieces.PrefixTable, "PAIR_BITS", 6)
    small = sentencepieces.PrefixTable(public_tokenizers.path("piece_bpe_32k.model"))
    texts = ["the quick brown fox jumps over the lazy dog " * 3, "sphinx of black quartz judge my vow", "é中 the 😀"]
    assert encoded(small, texts) == [[*x, 2] for x in small.library.encode(texts)]
