"""Operators 2, 5 and 10's tokenizers against the tokenizers library."""

import random
import zlib

import numpy as np
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")
tokenizers = pytest.importorskip("tokenizers")

from twinegraph.llm import bpe, pieces  # noqa: E402

TEXTS = [
    "", " ", "\n", "a", "It's we'll THEY'RE don't 'S '", "  two  blanks \n and\n\nlines\t.\r\n", "123 4567 8.9", "x<|endoftext|>y <|startoftext|>", "<|endoftext",
    "Ünïcode é é İI ß ﬁ Σας ΣΑΣ", "中文 テスト 한국어 🙂🙂 👩‍👩‍👧", "a b c\u0085d\x1ce", "﻿x​y", "!!!???...---", "_under_score_ ²³½ Ⅻ",
    "ffffffffffffffffffffffff aaaaaaaaaaaaaa", "\x00\x01", "नमस्ते दुनिया", "éclair", "</w> <w>",
]


def random_texts(n=400, seed=4):
    r = random.Random(seed)
    parts = ["th", "er", "ing", "a", "e", "on", "ß", "é", "ou", "x", "qz", "st", "ment", " ", " ", " ", "\n", ".", ",", "1", "'s", "-", "A", "Ç"]
    return ["".join(r.choice(parts) for _ in range(r.randint(0, 120))) for _ in range(n)]


@pytest.fixture(scope="module")
def library():
    return {n: tokenizers.Tokenizer.from_file(public_tokenizers.path(n)) for n in ("byte_bpe_50k.json", "word_bpe_49k.json")}


@pytest.mark.parametrize(("name", "kind"), [("byte_bpe_50k.json", "byte"), ("word_bpe_49k.json", "word")])
def test_pieces(library, name, kind, monkeypatch):
    monkeypatch.setattr(pieces, "MOST_KEPT", 300)
    e = pieces.PieceEncoder(public_tokenizers.path(name), kind)
    for t in TEXTS + random_texts():
        want = library[name].encode(t, add_special_tokens=False).ids
        assert np.frombuffer(e.encode(t), "<u4").tolist() == want, repr(t)


def test_backtracking_encoder_and_decoder(library):
    own, lib = bpe.WordBpe(public_tokenizers.path("word_bpe_49k.json")), library["word_bpe_49k.json"]
    for t in TEXTS + random_texts(1500, 9):
        want = lib.encode(t, add_special_tokens=False).ids
        got = np.frombuffer(own.encode(t), "<u4").tolist()
        assert got == want, repr(t)
        assert own.decode(own.encode(t)).decode() == lib.decode(want, skip_special_tokens=False), repr(t)
    long = "".join(random.Random(2).choice("abcdeinorst") for _ in range(20_000))
    assert np.frombuffer(own.encode(long), "<u4").tolist() == lib.encode(long, add_special_tokens=False).ids


def test_query_rows(spark, library):
    rows = [(i, t, "c") for i, t in enumerate(TEXTS)] + [(1, TEXTS[1], "c"), (None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    got = bpe.encode_rows(docs, public_tokenizers.path("word_bpe_49k.json")).collect()
    assert len(got) == len(rows)
    n = {r["doc_id"]: r["n_tokens"] for r in got}
    assert all(n[i] == len(library["word_bpe_49k.json"].encode(t or "", add_special_tokens=False).ids) for i, t, _ in rows if i is not None)
    assert bpe.encode_rows(docs.limit(0), public_tokenizers.path("word_bpe_49k.json")).collect() == []
    assert zlib.crc32(b"") == 0
