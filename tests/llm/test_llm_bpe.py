"""Encoding and decoding against the library whose vocabulary is used."""

import json
import random

import pytest
from pyspark.sql import functions as F

from seriesframe.llm import bpe

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def encoder():
    with open(PATH, encoding="utf-8") as file:
        return bpe.Encoder(bpe.Vocabulary(file.read()))


def ids_of(library, texts):
    return [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]


def test_table_of_odd_rows(spark, odd_rows, odd_docs, library):
    docs = odd_docs.withColumns({"ids": F.lit(1), "n_tokens": F.lit(2)}).repartition(3)
    out = bpe.decode(bpe.encode(docs, PATH), PATH).collect()
    texts = [r[1] or "" for r in odd_rows]
    want = [(str(r[0]), ids, text) for r, ids, text in zip(odd_rows, ids_of(library, texts), texts)]
    assert sorted((str(r.doc_id), r.ids, r.text) for r in out) == sorted(want)


def test_every_code_point(library, encoder):
    """Each in the neighbourhood of letters, numbers, spaces, marks and itself."""
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    for at in range(0, len(points), 40_000):
        texts = [f"a{c}1{c}{c}.{c} {c}\n{c}" for c in map(chr, points[at : at + 40_000])]
        some = texts if at == 0 else texts[:: 1 if at > 1_000_000 else 3]
        for text, want in zip(some, ids_of(library, some)):
            assert encoder.ids(text).tolist() == want, text


def test_random_texts(library, encoder):
    rng = random.Random(8)
    pieces = ["the", "The", " it's", "'ll", "'", "  ", "\n", "\t", "\r\n", "...", "!?", "1234", "½", "é", "é", "中文", "😀", " ", "​", "\x00", "\x1c", "\x85",
              "<|endoftext|>", "<|endoftext|", "|>", "Ġ", "՘", "ꟑ", "aaaaaaaaaaaaaaaa", "http://x.y/z?q=1", "_", "ﷺ", "﻿", "İ", "ß"]
    texts = ["".join(rng.choices(pieces, k=rng.randint(0, 60))) for _ in range(3_000)]
    texts += ["".join(chr(rng.choice((rng.randint(0, 127), rng.randint(0, 0x2FFF), rng.randint(0x1F000, 0x1FAFF)))) for _ in range(80)) for _ in range(500)]
    for text, want in zip(texts, ids_of(library, texts)):
        assert encoder.ids(text).tolist() == want, text


def test_long_words(library, encoder):
    rng = random.Random(9)
    texts = ["a" * 20_000, "ab" * 9_999 + "a", "".join(rng.choices("abcdefgh", k=30_000)), " " * 5_000 + "x", "é" * 7_777]
    assert [encoder.ids(t).tolist() for t in texts] == ids_of(library, texts)


def test_memo_starts_anew(library, encoder, monkeypatch):
    monkeypatch.setattr(bpe, "MEMO_WORDS", 3)
    monkeypatch.setattr(bpe, "MEMO_CHARS", 5)
    own = bpe.Encoder(encoder.words.vocabulary)
    text = "one two three four five sixteen seventeen one two three"
    assert own.ids(text).tolist() == ids_of(library, [text])[0] and len(own.words) <= 3


def test_decode_any_ids(spark, library):
    rng = random.Random(10)
    runs = [[rng.randrange(50_257) for _ in range(rng.randint(0, 40))] for _ in range(300)]
    rows = [(k, r) for k, r in enumerate(runs)] + [(1_000, None), (1_001, [None, 5, None]), (1_002, [-1, 5, 60_000]), (None, [5])]
    out = {r.doc_id: r.text for r in bpe.decode(spark.createDataFrame(rows, "doc_id long, ids array<int>"), PATH).collect()}
    for k, run in enumerate(runs):
        assert out[k] == library.decode(run, skip_special_tokens=False)
    five = library.decode([5])
    assert (out[1_000], out[1_001], out[1_002], out[None]) == ("", five, five, five)


def test_empty_table_and_other_files(spark, no_docs, tmp_path):
    assert bpe.decode(bpe.encode(no_docs, PATH), PATH).collect() == []
    with open(PATH, encoding="utf-8") as file:
        spec = json.load(file)
    for change in ({"normalizer": {"type": "Lowercase"}}, {"pre_tokenizer": {"type": "Whitespace"}}, {"model": spec["model"] | {"dropout": 0.1}}):
        with pytest.raises(ValueError):
            bpe.Vocabulary(json.dumps(spec | change))
