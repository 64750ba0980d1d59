"""Searches by many queries against plain versions, and their edges."""

import math
from collections import Counter

from pyspark.sql import functions as F

from corpusloom.operators import retrieval, searches

TEXTS = [(1, "The cat, the dog"), (2, "a dog and THE dog"), (3, None), (4, ""), (5, "cat"), (5, "cat dog"), (None, "dog cat cat"), (7, "Việt nam")] + [(k, f"word{k % 3} dog {'cat ' * (k % 4)}") for k in range(10, 60)]
QUERIES = [(1, ["dog", "cat", "dog"]), (2, ["nothere"]), (3, []), (4, None), (5, ["viet"]), (6, ["word1"]), (6, ["cat"]), (7, ["dog", None])]


def _plain(k):
    words = [(i, [w.strip(",").replace("ệ", "e") for w in (t or "").lower().split()]) for i, t in TEXTS]
    n, mean = len(words), sum(len(w) for _, w in words) / len(words)
    df = Counter(w for _, ws in words for w in set(ws))
    asked = {}
    for q, terms in QUERIES:
        asked.setdefault(q, set()).update(t for t in terms or [] if t)
    out = []
    for q, terms in asked.items():
        hits = []
        for i, ws in words:
            if terms and terms <= set(ws):
                score = 0.0
                for t in terms:
                    idf = math.log((n - df[t] + 0.5) / (df[t] + 0.5))
                    tf = ws.count(t)
                    score -= (idf if idf > 0 else 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(ws) / mean))
                hits.append((round(score, 9), math.inf if i is None else i))
        out += [(q, None if i == math.inf else i, s, r) for r, (s, i) in enumerate(sorted(hits)[:k], 1)]
    return sorted(out, key=repr)


def test_keyword_search_by_many(spark):
    docs = spark.createDataFrame(TEXTS, "id int, t string").repartition(5)
    queries = spark.createDataFrame(QUERIES, "query int, terms array<string>")
    for k in (3, 100):
        got = searches.bm25_all(docs, queries, k, "id", "t").select("query", "id", "score", "rank").collect()
        key = lambda rows: sorted(((q, i, round(s, 7), r) for q, i, s, r in rows), key=repr)
        assert key(map(tuple, got)) == key(_plain(k))
    assert searches.bm25_all(docs.limit(0), queries, 3, "id", "t").count() == 0
    assert searches.bm25_all(docs, queries.limit(0), 3, "id", "t").count() == 0


def test_one_query_agrees(spark):
    docs = spark.createDataFrame([r for r in TEXTS if r[0] not in (5, None)], "id int, t string")
    one = retrieval.bm25(*retrieval.searched(docs, "id", "t", "dog cat"), "dog cat").select("id", F.round("score", 7).alias("s"))
    many = searches.bm25_all(docs, spark.createDataFrame([(0, ["cat", "dog"])], "query int, terms array<string>"), 100, "id", "t")
    assert {tuple(r) for r in one.collect()} == {tuple(r) for r in many.select("id", F.round("score", 7)).collect()}


def test_dense_embedding(spark):
    docs = spark.createDataFrame(TEXTS[:5] + [(9, "x " * 50_000 + "y")], "id int, t string")
    sparse = {(r["id"], r["dim"]): r["value"] for r in retrieval.hash_embedding(docs, "id", "t").collect()}
    dense = {r["id"]: r["v"] for r in searches.dense_embedding(docs, "id", "t").collect()}
    assert set(dense) == {1, 2, 3, 4, 5, 9} and all(len(v) == 256 for v in dense.values())
    assert all(math.isclose(x, sparse.get((i, d), 0), abs_tol=1e-12) for i, v in dense.items() for d, x in enumerate(v))


def test_hybrid_by_many(spark):
    docs = spark.createDataFrame([(1, "red apple"), (2, "green apple"), (3, "blue sky"), (4, None)], "id int, t string")
    queries = spark.createDataFrame([(10, ["apple"], "red apple"), (11, None, "blue sky"), (12, ["sky"], None), (13, None, None)], "query int, terms array<string>, text string")
    got = {}
    for r in searches.hybrid_all(docs, queries, 2, "id", "t").orderBy("query", "rank").collect():
        got.setdefault(r["query"], []).append((r["id"], r["score"]))
    assert [i for i, _ in got[10]] == [1, 2] and got[10][0][1] == round(2 / 61, 9)
    assert got[11][0] == (3, round(1 / 61, 9)) and got[12] == [(3, round(1 / 61, 9))] and 13 not in got
    terms = searches.frequent_terms(docs.union(spark.createDataFrame([(8, "bb aaaa cccc cccc dddd")], "id int, t string")), "id", "t", 2, 4)
    assert {r["query"]: r["terms"] for r in terms.collect()} == {1: ["apple"], 2: ["apple", "green"], 3: ["blue"], 8: ["aaaa", "cccc"]}
