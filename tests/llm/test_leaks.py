import random

import numpy as np
import pyarrow as pa
import pytest

from methyloom.llm import leaks as lk


def brute(docs, items, least):
    out = set()
    for d, t in docs:
        w = (t or "").lower().split()
        for i, s in items:
            v = (s or "").lower().split()
            if any(v[a : a + least] == w[b : b + least] for a in range(len(v) - least + 1) for b in range(len(w) - least + 1)):
                out.add((d, i))
    return out


def best(a, b):
    return max((n for i in range(len(a)) for j in range(len(b)) for n in [next((k for k in range(min(len(a) - i, len(b) - j)) if a[i + k] != b[j + k]), min(len(a) - i, len(b) - j))]), default=0)


@pytest.mark.parametrize("shard", [5, 60, 10**6])
def test_against_brute_force(spark, shard):
    rng = random.Random(shard)
    words = [f"w{i}" for i in range(12)]
    items = [(f"e{i}", " ".join(rng.choices(words, k=rng.randrange(0, 14)))) for i in range(12)] + [("null", None), ("same", "")]
    items.append(("copy", items[3][1]))
    docs = [(i, " ".join(rng.choices(words, k=rng.randrange(0, 30)))) for i in range(60)] + [(100, None), (101, "")]
    docs += [(200 + i, "x y " + items[i][1] + " z") for i in range(10)] * 2
    df = spark.createDataFrame([(i, t, 1, "c") for i, t in docs], "doc_id BIGINT, text STRING, words INT, item_id STRING").repartition(3)
    ev = spark.createDataFrame(items, "item_id STRING, text STRING")
    found = lk.leaked_passages(df, ev, least_words=5, shard_words=shard, block_bytes=40)
    got = [(r.doc_id, r.item_id, r.words, r.at_word) for r in found.collect()]
    assert {g[:2] for g in got} == brute(docs, items, 5)
    text, ev_text = dict(docs), dict(items)
    for d, i, n, at in got:
        a, b = text[d].split(), ev_text[i].split()
        assert n == best(a, b) and any(a[at : at + n] == b[k : k + n] for k in range(len(b)))
    assert lk.without_leaks(df, found).where("doc_id >= 200 AND text LIKE '%w%'").count() == sum(2 for i in range(10) if len(items[i][1].split()) < 5 and items[i][1])


def test_form_case_and_punctuation(spark):
    ev = spark.createDataFrame([("e", "Один два три Word, four five"), ("f", "Время Кот Тот вот как")], "item_id STRING, text STRING")
    df = spark.createDataFrame([(1, "ｏne OДИН\nдва... три - wоrd four/five"), (2, "время кот тот ВОТ КАК!"), (3, "один два три four five")], "doc_id BIGINT, text STRING")
    assert sorted((r.doc_id, r.item_id) for r in lk.leaked_passages(df, ev, least_words=5).collect()) == [(1, "e"), (2, "f")]


def test_texts_that_repeat_themselves():
    import resource
    import time

    began, before = time.perf_counter(), resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    texts = ["0 " * 40_000, "x " + "0 1 " * 20_000, "y " + "0 " * 200 + "z", None]
    shard = lk.Shard(*lk.word_codes(pa.array(texts)), 12)
    index = lk.Index(["0 " * 300, "0 1 " * 150 + "q", "0 " * 11], 12)
    d, i, n, at = shard.search(index)
    assert sorted(zip(d.tolist(), i.tolist(), n.tolist(), at.tolist())) == [(0, 0, 300, 0), (1, 1, 300, 1), (2, 0, 200, 1)]
    assert time.perf_counter() - began < 20 and resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 200_000  # KB


def test_array_is_built_once_for_all_blocks(spark, monkeypatch):
    rng = random.Random(1)
    words = [f"v{i}" for i in range(50)]
    ev = spark.createDataFrame([(f"e{i}", " ".join(rng.choices(words, k=20))) for i in range(40)], "item_id STRING, text STRING")
    docs = spark.createDataFrame([(i, " ".join(rng.choices(words, k=40))) for i in range(50)], "doc_id BIGINT, text STRING").coalesce(1)
    one, many = (lk.leaked_passages(docs, ev, least_words=3, block_bytes=n) for n in (1 << 20, 120))
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, many.collect())) != []
    plan = many._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1


def test_empty(spark):
    ev = spark.createDataFrame([("e", "a b c")], "item_id STRING, text STRING")
    df = spark.createDataFrame([(1, "a b c")], "doc_id BIGINT, text STRING")
    assert lk.leaked_passages(df.limit(0), ev, least_words=2).collect() == []
    assert lk.leaked_passages(df, ev.limit(0), least_words=2).collect() == []
    assert lk.leaked_passages(df, ev).collect() == []


def test_suffix_array():
    rng = np.random.default_rng(0)
    t = rng.integers(0, 4, 300).astype(np.uint64)
    order = lk.suffix_array(t, 300)
    assert [tuple(t[i:]) for i in order] == sorted(tuple(t[i:]) for i in range(300))
    assert lk.suffix_array(t[:0], 5).tolist() == []
    w, b = lk.word_codes(pa.array(["A b", None, "", "a B ab"]))
    assert b.tolist() == [0, 2, 2, 2, 5] and w[0] == w[2] and w[1] == w[3] and len(set(w.tolist())) == 3


def test_very_long_text(spark):
    rng = random.Random(1)
    words = [f"w{rng.randrange(5000)}" for _ in range(150_000)]
    item = [f"q{i}" for i in range(30)]
    words[140_000:140_000] = item[5:25]
    df = spark.createDataFrame([(1, " ".join(words)), (2, "x" * 300_000)], "doc_id BIGINT, text STRING")
    ev = spark.createDataFrame([("e", " ".join(item))], "item_id STRING, text STRING")
    assert [tuple(r) for r in lk.leaked_passages(df, ev, shard_words=1000).collect()] == [(1, "e", 20, 140_000)]
