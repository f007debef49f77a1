import os
import random

import pytest

from methyloom.llm import tokens as tk

PATH = f"{tk.TOKENIZERS}/byte_bpe_50k.tiktoken"
pytestmark = pytest.mark.skipif(not os.path.exists(PATH), reason="no vocabulary files here")


@pytest.fixture(scope="module")
def other():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(f"{tk.TOKENIZERS}/byte_bpe_50k.json")
    t.encode_special_tokens = True
    return t


def test_same_ids_as_another_library(spark, other):
    texts = ["Hello  world\n\n", "Привет, мир!", "のリボ", "<|endoftext|> x", " a  b\t c", "don't we'll", "", None, " 　 x", "🔬" * 3, "x" * 300, "1234567 8"]
    df = spark.createDataFrame([(i, t, 5, "c") for i, t in enumerate(texts)], "doc_id BIGINT, text STRING, ids INT, bytes STRING")
    got = {r.doc_id: r.ids for r in tk.token_ids(df, "doc_id", "text").collect()}
    assert got == {i: other.encode(t, add_special_tokens=False).ids if t else [] for i, t in enumerate(texts)}
    back = {r.doc_id: r.text for r in tk.token_texts(tk.token_ids(df, "doc_id", "text"), "doc_id").collect()}
    assert back == {i: t or "" for i, t in enumerate(texts)}
    assert tk.token_ids(df.limit(0), "doc_id", "text").collect() == []


def test_pieces_of_long_texts(other):
    rng = random.Random(0)
    ranks = tk.read_ranks(PATH)
    for _ in range(40):
        text = "".join(rng.choice(["a", "Bc", " ", "  ", "\n", "1", "23", ".", "'s", "'", "é", "の", "🔬", " ", "don't "]) for _ in range(400))
        cut = list(tk.pieces(text, 20))
        assert "".join(cut) == text
        assert [i for p in cut for i in tk.encode(p, ranks)] == tk.encode(text, ranks) == other.encode(text, add_special_tokens=False).ids
    long = "word " * 60_000 + "z" * 3000
    assert len(list(tk.pieces(long))) > 3 and tk.encode(long, ranks) == tk._encoding(ranks).encode_ordinary(long)


def test_cut_characters(spark):
    ids = tk.encode("é🔬", tk.read_ranks(PATH))
    df = spark.createDataFrame([(1, ids[:-1]), (2, None), (3, [])], "k BIGINT, ids ARRAY<INT>")
    out = {r.k: (r.bytes, r.text) for r in tk.token_texts(df, "k").collect()}
    assert out[1][1] is None and "é🔬".encode().startswith(bytes(out[1][0])) and out[2] == (None, None) and out[3][1] == ""


def test_a_large_rank_file_is_refused(tmp_path, monkeypatch):
    monkeypatch.setattr(tk, "MOST_BYTES", 3)
    (tmp_path / "r").write_bytes(b"12345")
    with pytest.raises(ValueError):
        tk.read_ranks(str(tmp_path / "r"))
