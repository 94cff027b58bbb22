"""Search and similarity over whole texts, against brute force on small rows."""

import math
import random

import pytest
from pyspark.sql import functions as F

from hammerline.operators import joins, records
from hammerline.plans import catalogue

LONG = "filler " * 60


@pytest.fixture(scope="module")
def texts(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("texts")
    rows = [(1, LONG + "the tail"), (2, LONG + "tail"), (3, "the head"), (4, "other")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"file://{d}/documents.parquet")
    return f"file://{d}"


def test_words_past_a_prefix_count(spark, texts):
    got = {r.token: (r.df, r.idf) for r in catalogue.QUERIES["idf"](spark, texts).collect()}
    assert got["tail"] == (2, pytest.approx(math.log(2), abs=1e-6)) and got["the"][0] == 2
    assert sorted(r.id for r in catalogue.QUERIES["inverted_index_search"](spark, texts).collect()) == [1, 3]


def test_common_tokens_keep_their_postings(spark, tmp_path):
    rows = [(i, "common " + ("rare" if i == 7 else "third") + (" thus" if i % 3 == 0 else "")) for i in range(300)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"file://{tmp_path}/documents.parquet")
    t = catalogue._texts(spark, f"file://{tmp_path}")
    index = records.posting_chunks(t, "id", F.col("tokens"), 64).cache()
    got = {}
    for r in index.collect():
        assert r.n == len(r.postings) and r.postings == sorted(r.postings)
        got.setdefault(r.token, []).extend(r.postings)
    assert {k: sorted(v) for k, v in got.items()} == {w: [i for i, x in rows if w in x.split()] for w in ("common", "rare", "third", "thus")}
    for words, prefix in ((["common", "th"], True), (["common", "rare"], False), (["thus", "common"], False), (["absent", "common"], False)):
        want = [i for i, x in rows if all(any(y.startswith(w) if prefix and w == words[-1] else y == w for y in x.split()) for w in words)]
        assert sorted(r.id for r in records.index_search(index, words, prefix).collect()) == want


def test_frequent_tokens_count_for_similarity(spark, tmp_path):
    rows = [(1, "all often rare"), (2, "all often"), (3, "all often"), (4, "all"), (5, "all often other")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"file://{tmp_path}/documents.parquet")
    df = {w: sum(w in x.split() for _, x in rows) for _, t in rows for w in t.split()}
    vectors = {i: {w: math.log(len(rows) / df[w]) for w in x.split()} for i, x in rows}
    want = {}
    for a, x in vectors.items():
        for b, y in vectors.items():
            norms = math.sqrt(sum(v * v for v in x.values()) * sum(v * v for v in y.values()))
            if a < b and norms and sum(v * y.get(w, 0) for w, v in x.items()) / norms >= 0.7:
                want[a, b] = sum(v * y.get(w, 0) for w, v in x.items()) / norms
    got = {(r.a, r.b): r.cosine for r in catalogue.QUERIES["token_dot_similarity"](spark, f"file://{tmp_path}").collect()}
    assert (2, 3) in want and got == pytest.approx(want, abs=1e-6)


@pytest.mark.parametrize("floor", [0.3, 0.7, 0.95])
def test_similarity_loses_no_pair(spark, floor):
    draw = random.Random(3)
    vectors = {i: {f"t{int(draw.paretovariate(0.6)) % 60}": round(draw.uniform(0.1, 2), 2) for _ in range(draw.randint(1, 8))} for i in range(120)}
    for i in range(120, 150):
        vectors[i] = dict(vectors[draw.randrange(6)])
    for i in range(150, 190):
        vectors[i] = dict(vectors[draw.randrange(120)]) | {f"u{draw.randrange(9)}": 0.2}
    rows = [(i, t, w) for i, v in vectors.items() for t, w in v.items()] + [(200, "t1", 0.0), (201, "t1", 0.0), (None, "t1", 1.0)]
    got = {(r.a, r.b): r.cosine for r in joins.token_similarity(spark.createDataFrame(rows, "id long, token string, w double"), "id", "token", "w", floor).collect()}
    want = {}
    for a, x in vectors.items():
        for b, y in vectors.items():
            cosine = sum(w * y.get(t, 0) for t, w in x.items()) / math.sqrt(sum(w * w for w in x.values()) * sum(w * w for w in y.values()))
            if a < b and cosine >= floor - 1e-9:
                want[a, b] = cosine
    assert len(want) > 100 and got == pytest.approx(want, abs=1e-9)


def test_similarity_of_no_rows(spark):
    assert joins.token_similarity(spark.createDataFrame([], "id long, token string, w double"), "id", "token", "w", 0.7).isEmpty()
