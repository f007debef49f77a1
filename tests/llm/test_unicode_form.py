import unicodedata

import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from methyloom.llm import unicode_form as u


def brute(text):
    return unicodedata.normalize("NFC", "".join(u.char_form(c) for c in text))


letters = st.sampled_from("aAeE éﬁﬂｱﾞｶﾟ가각ᄀ ᅡᆨ゙̧̣́̈​­ 　аеоΑΒο🔬é1２．\n\t\U000e0100\U00030005")


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(letters, max_size=12), st.text(max_size=12)), max_size=8))
def test_against_one_call_per_text(texts):
    texts = [None if t is None else t.encode("utf-8", "ignore").decode() for t in texts]
    got = u.consistent(pa.array(texts, pa.string())).to_pylist()
    assert got == [None if t is None else brute(t) for t in texts]
    assert u.consistent(pa.array(got, pa.string())).to_pylist() == got


def test_what_reads_the_same():
    same = [("ﬁｎ", "fin"), ("é", "é"), ("a b", "a b"), ("a​b", "ab"), ("соса", "coca"), ("ＡＢ１", "AB1"), ("ｶﾞ", "ガ"), ("ậ", "ậ"), ("ά", "ά")]
    for a, b in same:
        x, y = u.consistent(pa.array([a, b])).to_pylist()
        assert x == y, (a, b)
    for a, b in [("a", "A"), ("e", "é"), ("1", "l"), ("a.", "a,"), ("²", "2")]:
        x, y = u.consistent(pa.array([a, b])).to_pylist()
        assert x != y, (a, b)


def test_slices_and_long_texts(monkeypatch):
    monkeypatch.setattr(u, "SLICE_BYTES", 10)
    texts = ["é" * 50, None, "", "x" * 9, "é" * 3] * 3
    assert u.consistent(pa.array(texts)).to_pylist() == [None if t is None else brute(t) for t in texts]
    assert u.consistent(pa.array(texts)[2:7]).to_pylist() == [None if t is None else brute(t) for t in texts[2:7]]
    long = "á" * 200_000 + "́" * 50
    assert u.consistent(pa.array([long])).to_pylist() == [brute(long)]


def test_pairs(spark):
    rows = [(1, "abc é"), (2, "аbc é"), (3, "abc é"), (4, "Abc é"), (5, None), (6, ""), (7, "​"), (8, " "), (9, "copy"), (10, "copy")]
    df = spark.createDataFrame([(i, t, "x", "y") for i, t in rows], "doc_id BIGINT, text STRING, form STRING, class_id STRING")
    assert sorted(tuple(r) for r in u.alike_pairs(df, "doc_id", "text").collect()) == [(1, 2), (2, 3)]
    assert u.alike_pairs(df.limit(0), "doc_id", "text").collect() == []
    assert [r.f for r in df.where("doc_id > 4 AND doc_id < 8").orderBy("doc_id").select(u.consistent_form(F.col("text")).alias("f")).collect()] == [None, "", ""]


def test_a_hot_class_costs_what_comes_out(spark):
    import time

    other = spark.createDataFrame([(-1, "сopy of one text"), (-2, "copy оf one text")], "doc_id BIGINT, text STRING")
    docs = spark.range(200_000).select(F.col("id").alias("doc_id"), F.lit("copy of one text").alias("text")).unionByName(other).repartition(6)
    began = time.perf_counter()
    pairs = u.alike_pairs(docs, "doc_id", "text").groupBy().agg(F.count("*").alias("n"), F.count_if(F.col("id_a") < F.col("id_b")).alias("m"), F.count_distinct("id_a", "id_b").alias("d")).first()
    assert (pairs.n, pairs.m, pairs.d) == (400_001, 400_001, 400_001)
    assert time.perf_counter() - began < 90
    links = u.alike_links(docs, "doc_id", "text").groupBy("links").count().collect()
    assert sorted((r.links, r["count"]) for r in links) == [(2, 200_000), (200_001, 2)]


def test_a_class_of_many_texts(spark, monkeypatch):
    monkeypatch.setattr(u, "SIDE", 3)
    monkeypatch.setattr(u, "CHUNK", 2)
    marks = ["\u200b" * i + "abc" for i in range(10)]
    rows = [(i, marks[i % 10]) for i in range(35)]
    df = spark.createDataFrame(rows, "doc_id BIGINT, text STRING")
    want = sorted((a, b) for a, s in rows for b, t in rows if a < b and s != t)
    assert sorted(tuple(r) for r in u.alike_pairs(df, "doc_id", "text").collect()) == want
    got = {r.id: r.links for r in u.alike_links(df, "doc_id", "text").collect()}
    assert got == {i: sum(i in p for p in want) for i, _ in rows}


def test_other_scripts_and_type_faces():
    same = [("αιρ", "aip"), ("օս", "ou"), ("ᏀᎪ", "GA"), ("𝐇𝑒𝗅𝕝𝚘", "Hello"), ("ό", "ó")]
    for a, b in same:
        x, y = u.consistent(pa.array([a, b])).to_pylist()
        assert x == y, (a, b)
    for a, b in [("ν", "v"), ("ı", "i"), ("①", "1")]:
        x, y = u.consistent(pa.array([a, b])).to_pylist()
        assert x != y, (a, b)
