import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from newsloom.llm import packing
from newsloom.llm.tokens import Encoder, default_path


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(default_path())


def ids_of(tokenizer, text):
    return np.array(tokenizer.encode(text or "", add_special_tokens=False).ids + [0], "<u4")


@pytest.mark.parametrize("text", [
    "It's we'll THE'RE o'clock 'stuff", "a1b22 c_d__!! <|endoftext|>", "Straße ÉÈ ſ İ ß½²", "é é",
    "a <|endoftext|> b", "x<|STARTOFTEXT|>y <|startoftext|>", "''s 'still 're're 'r' ''ll a's1 'd", "'s", "'",
    "Ⱥ Ɓ K Å ﬁ", "l'été d'où ÀÉ_ª º µ ×÷ … – “q”",
    "日本語 текст", "\x1c\x85 \xa0x", "Σας ΣΑΣ", "",
])
def test_encoder_equals_tokenizer(tokenizer, text):
    encoder = Encoder.at(default_path())
    want = ids_of(tokenizer, text)[:-1].tolist()
    assert encoder.ids(text).tolist() == want
    assert encoder.count(text) == len(want)


def test_texts_do_not_meet(tokenizer, texts, monkeypatch):
    """Many texts in one piece, and a piece per text, give what the tokenizer gives for each."""
    import pyarrow as pa

    odd = ["it'", "s", "<|endo", "ftext|>", None, "", "1", "2", "日本", "a", "İ", "don't"]
    for size in (1 << 17, 1):
        monkeypatch.setattr("newsloom.llm.tokens.PIECE", size)
        found = list(Encoder(default_path()).each(pa.array(odd + texts)))
        want = [ids_of(tokenizer, text)[:-1].tolist() for text in odd + texts]
        assert [ids.tolist() for ids in found] == want


def test_every_character_of_the_table(tokenizer):
    encoder = Encoder(default_path())
    for code in range(0x300):
        text = f"ab{chr(code)}c {chr(code)}'s{chr(code)}1"
        assert encoder.ids(text).tolist() == ids_of(tokenizer, text)[:-1].tolist(), code


def test_cache_is_bounded(tokenizer, monkeypatch):
    monkeypatch.setattr("newsloom.llm.tokens.CACHED_WORDS", 3)
    encoder = Encoder(default_path())
    for text in ("one two three four", "five one", "two two nine"):
        assert encoder.ids(text).tolist() == ids_of(tokenizer, text)[:-1].tolist()


@pytest.mark.parametrize("size, most", [(16, 2), (64, 8)])
def test_round_trip(documents, texts, tokenizer, size, most):
    pieces = packing.pack(documents, default_path(), size, most, with_ids=True)
    rows = pieces.collect()
    by_document = {}
    for row in rows:
        assert zlib.crc32(np.array(row["ids"], "<u4").tobytes()) == row["ids_crc32"]
        by_document.setdefault(row["doc_id"], []).append(row)
    for k, text in enumerate(texts):
        want = ids_of(tokenizer, text).tolist()
        got = sorted(by_document[k], key=lambda r: (r["piece"], r["sequence_id"]))
        if k == 4:  # a repeated row
            assert len(got) == 2 * -(-len(want) // size)
            continue
        assert [i for r in got for i in r["ids"]] == want
        assert [r["piece"] for r in got] == list(range(len(got)))
        assert [r["start"] for r in got] == [size * j for j in range(len(got))]
    filled = {}
    for row in rows:
        filled.setdefault(row["sequence_id"], []).append(row)
    for parts in filled.values():
        at = 0
        for row in sorted(parts, key=lambda r: r["offset"]):
            assert row["offset"] == at
            at += row["length"]
        assert at <= size
    whole = packing.sequences(pieces)
    assert whole.count() == len(filled)
    assert whole.selectExpr("sum(size(ids))").first()[0] == sum(r["length"] for r in rows)


def test_best_fit_choice():
    packer = packing.BestFit(10, 2)
    assert packer.place(6)[:2] == (0, 0)
    assert packer.place(7)[:2] == (1, 0)
    assert packer.place(3) == (1, 7, [1])  # the fuller of the two that fit, and it closes
    assert packer.place(9)[:2] == (2, 0)
    assert packer.place(8) == (3, 0, [2])  # both open: the fullest closes


def test_empty_table(nothing):
    assert packing.pack(nothing, default_path()).count() == 0
