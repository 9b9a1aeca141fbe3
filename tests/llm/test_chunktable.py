"""Ids by distinct chunks against ids of whole texts."""

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from lodestar.llm.chunktable import byte_table, slices, word_table
from lodestar.llm.pieces import open_model

ODD = ["", " ", "  ", "a", " a", "a ", "a  b", "a\n b", "\ta \n\n b\r\n", "x  y", "x 　y", "␞ ␞ a", "é ́a", "</s> <|endoftext|> a", "a <|endoftext|> b", "a<|ENDOFTEXT|>b <|StartOfText|> c<|startoftext|>", "<|endoftext|>", "Ω ΑΣ ΑΣ. ς", "日本語 テキスト", "a▁b ▁▁ c", "a" * 5000, " .b 12 3's don't", "\x00 a\x1f b", "ﬁ Ⅳ ½", "🙂 a🙂 b"]
TEXT = st.text(st.sampled_from("ab Z.,'12\n\t é▁ ́Σ日🙂"), max_size=60)


def ids_of(table, texts):
    values, lengths = table.encode(pa.array(texts))
    return [x.tolist() for x in np.split(values, np.cumsum(lengths)[:-1])]


def library(name):
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path(name))


@settings(max_examples=80, deadline=None)
@given(texts=st.lists(TEXT, min_size=1, max_size=8))
def test_words(texts):
    texts = texts + ODD
    want = [x.ids for x in library("word_bpe_49k.json").encode_batch(texts, add_special_tokens=False)]
    assert ids_of(word_table("word_bpe_49k.json"), texts) == want


@settings(max_examples=80, deadline=None)
@given(texts=st.lists(TEXT, min_size=1, max_size=8))
def test_bytes(texts):
    texts = texts + ODD
    want = [x.ids for x in library("byte_bpe_50k.json").encode_batch(texts, add_special_tokens=False)]
    assert ids_of(byte_table("byte_bpe_50k.json"), texts) == want


@settings(max_examples=60, deadline=None)
@given(texts=st.lists(TEXT, min_size=1, max_size=8))
def test_pieces(texts):
    sp, table = open_model("piece_bpe_32k.model")
    texts = texts + ODD
    assert ids_of(table, texts) == sp.encode(texts)


def test_small_tables_are_trimmed():
    sp, table = open_model("piece_bpe_32k.model")
    table._clear()
    table.limit, before = 50, table.limit
    try:
        for k in range(12):
            texts = [f"word{i} same words again {i * k}" for i in range(30)]
            assert ids_of(table, texts) == sp.encode(texts)
    finally:
        table.limit = before
        table._clear()


def test_slices_cover_all_rows():
    texts = pa.array(["a" * 10, None, "b" * 50, "", "c"])
    assert [r for a, b in slices(texts, 20) for r in range(a, b)] == list(range(5))
