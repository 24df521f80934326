import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from kinledger.llm import tokenizer as tk

PATH = f"{tk.TOKENIZER_DIR}/{tk.VOCABULARY}"


def whole(text):
    return tk.load(PATH)[0].encode_ordinary(text)


CASES = ["", "a", " ", "don't stop", "x" * 3000, " " * 700 + "y", "naïve café 👩‍👩‍👧 தமிழ் हिन्दी 12345", "\n\n \t a", "ab12" * 900, "!" * 1500, "'s" * 600, "अ" * 900]


@pytest.mark.parametrize("text", CASES)
@pytest.mark.parametrize("block", [16, 64, 8192])
def test_blocks_change_nothing(text, block):
    assert tk.encode(text, PATH, block) == whole(text)
    assert "".join(tk.decode(tk.encode(text, PATH, block), PATH)) == text


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("abcdetion  's!?12é़क\n ")), max_size=400), st.integers(8, 40))
def test_any_text_any_block(text, block):
    assert tk.encode(text, PATH, block) == whole(text)


def test_transducer_is_exact_and_keeps_little():
    encoding, ranks = tk.load(PATH)
    rng = random.Random(3)
    piece = "".join(rng.choice(["the", "tion", "ing", "zq", "e", "ab"]) for _ in range(2500)).encode()
    t = tk.PieceTransducer(encoding, ranks)
    out, kept = [], 0
    for b in piece:
        out += t.push(b)
        kept = max(kept, len(t.last))
    assert out + t.finish() == encoding._core_bpe.encode_single_piece(piece)
    assert kept < 4 * t.lookahead


def test_null_and_empty(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "hi")], "doc_id long, text string")
    rows = {r.doc_id: r.ids for r in df.select("doc_id", tk.token_ids(F.col("text")).alias("ids")).collect()}
    assert rows == {1: [], 2: [], 3: whole("hi")}
    assert df.limit(0).select(tk.token_count(F.col("text"))).collect() == []


def test_every_text_goes_through_the_machine():
    t = tk.Transducer(PATH, 64)
    texts = ["a first text", "a first text", "z" * 500, "अ" * 300 + "!" * 200 + " " * 150 + "x", "\x1c\x1d tabs\x85"]
    for i, text in enumerate(texts):
        before = t.pieces
        assert t.encode(text) == whole(text)
        assert (t.pieces > before) == (i != 1)  # the second time its pieces are known
    assert len(t.buffer) == 0 and t.open is None


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=120), st.integers(3, 30))
def test_any_unicode(text, block):
    assert tk.encode(text, PATH, block) == whole(text)


def test_decoding_is_the_way_back(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "naïve தமிழ் 👩‍👩‍👧"), (4, "x" * 20000)], "doc_id long, text string")
    got = {r.doc_id: r.t for r in df.select("doc_id", tk.decoded(tk.token_ids(F.col("text"))).alias("t")).collect()}
    assert got == {1: "", 2: "", 3: "naïve தமிழ் 👩‍👩‍👧", 4: "x" * 20000}
