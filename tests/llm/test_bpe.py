"""Ids and decoded texts against the tokenizers library."""

import random

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from casegraph.llm import bpe

WORDS, BYTES = (public_tokenizers.path(f"{n}.json") for n in ("word_bpe_49k", "byte_bpe_50k"))
PIECES = [" ", "\t", "\n", "\x1c", "\x85", " ", " ", "e", "́", "̈", "'", "s", "'s", "'LL", "''", "-", "1", "９", "Σ", "ς", "İ", "漢", "😀", "b", "Z", "zxqj", "<|endoftext|>", "<|startoftext|>", "<|", "|>", "</w>", "ﬁ", "ᄀ", "ᅡ", "﻿", "\x00"]
TEXTS = ["", "   \n\t ", "one", "Don't I'LL  3.5", "<|endoftext|> a<|endoftext|>b", "Ünïcode ñandú 漢字 😀 naïve", "zxqjvk" * 40, "a" * 500, "x" * 300 + " y"]


@pytest.fixture(scope="module", params=[WORDS, BYTES])
def both(request):
    return Tokenizer.from_file(request.param), bpe.codec(request.param)


def same(library, codec, text):
    want = library.encode(text, add_special_tokens=False).ids
    got = codec.encode(text.encode())
    assert np.frombuffer(got, "<u4").tolist() == want, text
    assert codec.decode(got).decode() == library.decode(want, skip_special_tokens=False)


def test_as_the_library(both):
    r = random.Random(5)
    for text in TEXTS + ["".join(r.choice(PIECES) for _ in range(r.randrange(30))) for _ in range(3000)]:
        same(*both, text)


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_any_text(text):
    same(Tokenizer.from_file(WORDS) if not hasattr(test_any_text, "t") else test_any_text.t, bpe.codec(WORDS), text)


test_any_text.t = Tokenizer.from_file(WORDS)


def test_cuts_are_pairs_that_no_token_holds():
    codec = bpe.codec(WORDS)
    held = set()
    for token in codec.whole.get_vocab():
        symbols = [*token[: -len(codec.suffix) - 1], token[-len(codec.suffix) - 1] + codec.suffix] if token.endswith(codec.suffix) and len(token) > len(codec.suffix) else [*token]
        held |= set(zip(symbols, symbols[1:], strict=False))
    assert codec.inside <= held and not {p for p in held - codec.inside if "|" not in "".join(p)}  # but for the marks, no token has another pair
    assert codec.cut("zxqj") == [1, 3]  # z, xq, j
    assert all(codec.cut(w) == [] for w in ("the", "house", "x"))


def test_long_texts_are_sliced(monkeypatch):
    monkeypatch.setattr(bpe, "SLICE", 64)
    monkeypatch.setattr(bpe, "KNOWN", 10)
    r = random.Random(1)
    for sep in (" ", "\n", ""):
        same(Tokenizer.from_file(WORDS), bpe.Codec(WORDS), sep.join(r.choice(["river", "stone", "zxqj", "é", "x9"]) for _ in range(400)))


def test_table(spark, monkeypatch):
    rows = [(i if i != 3 else None, t, "c", "d") for i, t in enumerate([*TEXTS, None, "one", "one"])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string, decoded string").repartition(3)
    out = bpe.decoded(bpe.encoded(docs, WORDS), WORDS)
    library = Tokenizer.from_file(WORDS)
    want = []
    for d, t, _, _ in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        want.append((d, len(ids), np.array(ids, "<u4").tobytes(), library.decode(ids, skip_special_tokens=False)))
    assert sorted(map(str, ((r.doc_id, r.n_tokens, bytes(r.ids), r.decoded) for r in out.collect()))) == sorted(map(str, want))
    assert bpe.encoded(docs.limit(0), WORDS).count() == 0
    named = bpe.encoded(docs.selectExpr("concat('k', doc_id) doc_id", "text"), WORDS)
    assert {r.doc_id for r in named.collect()} == {f"k{d}" if d is not None else None for d, *_ in rows}


def test_foreign_ids_and_models(tmp_path):
    codec, library = bpe.codec(WORDS), Tokenizer.from_file(WORDS)
    ids = [320, 99_999, 49_407, 0]
    assert codec.decode(np.array(ids, "<u4").tobytes()).decode() == library.decode(ids, skip_special_tokens=False)
    other = tmp_path / "unigram.json"
    other.write_text('{"model": {"type": "Unigram"}, "added_tokens": []}')
    with pytest.raises(ValueError):
        bpe.Codec(str(other))
