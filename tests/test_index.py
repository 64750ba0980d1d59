"""The stored inverted index, its snippets, and the vector index, against plain versions."""

import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.operators import index, retrieval, searches, store, vectors

VOCABULARY = [f"{a}{b}" for a in "kmnprst" for b in ("a", "el", "io", "un")]


def _words(text):
    bare = re.sub("[̀-ͯ]", "", (text or "").lower().replace("é", "e"))
    return re.findall(r"[^\W_]+", bare)


def plain_search(rows, queries, k):
    """rows: id, file, text; queries: query -> list of phrases."""
    docs = [(i, _words(f), _words(t)) for i, f, t in rows]
    mean = sum(len(f) + len(t) for _, f, t in docs) / max(1, len(docs))

    def times(words, phrase):
        return sum(words[j : j + len(phrase)] == phrase for j in range(len(words) - len(phrase) + 1))

    out = []
    for q, parts in queries.items():
        parts = [list(p) for p in {tuple(p) for p in parts if p}]
        tf = {i: [times(f, p) + times(t, p) for p in parts] for i, f, t in docs}
        df = [sum(x[n] > 0 for x in tf.values()) for n in range(len(parts))]
        idf = [math.log((len(docs) - d + 0.5) / (d + 0.5)) for d in df]
        hits = []
        for i, f, t in docs:
            if parts and all(tf[i]):
                size = len(f) + len(t)
                score = -sum((w if w > 0 else 1e-6) * n * 2.2 / (n + 1.2 * (0.25 + 0.75 * size / mean)) for w, n in zip(idf, tf[i], strict=True))
                hits.append((round(score, 7), i))
        exact = sorted(hits)
        out += [(q, i, s) for s, i in exact[:k]]
    return sorted(out)


def _rows(n, seed):
    rng = np.random.default_rng(seed)
    weights = 1 / np.arange(1, len(VOCABULARY) + 1)
    weights /= weights.sum()
    out = [(i, f"{VOCABULARY[i % 9]}_{i}.txt", " ".join(rng.choice(VOCABULARY, rng.integers(0, 60), p=weights))) for i in range(n)]
    return [*out, (n, None, None), (n + 1, "Café.md", "un café é éel"), (n + 2, "", "")]


@pytest.mark.parametrize("bits", [12, 3])
def test_search_of_terms_and_phrases(spark, monkeypatch, bits):
    rows = _rows(700, bits)
    df = spark.createDataFrame(rows, "id long, f string, t string").repartition(3, "id")
    if bits != 12:  # small blocks: postings of a term lie in many, and few are read
        monkeypatch.setattr(index, "FIRST", 2)
    ix = index.build(df, "id", "t", "f")
    queries = {1: [["ka"]], 2: [["ka"], ["kel"]], 3: [["tun"], ["ka"], ["mio"]], 4: [["ka", "kel"]], 5: [["ka", "ka"], ["kun"]], 6: [["nothere"]], 7: [[]], 8: [["cafe"]], 9: [["kio", "5"]], 10: [["5", "txt"]], 11: [["txt", "ka"]], 12: [["un", "cafe", "e", "eel"]]}
    asked = spark.createDataFrame(list(queries.items()), "query int, parts array<array<string>>")
    for k in (5, 100):
        got = sorted((r["query"], r["id"], round(r["score"], 7)) for r in index.search(ix, asked, k).collect())
        want = plain_search(rows, queries, k)
        assert Counter(q for q, _, _ in got) == Counter(q for q, _, _ in want)
        assert sorted(s for _, _, s in got) == pytest.approx(sorted(s for _, _, s in want), abs=2e-7)
        if k == 100:
            full = {(q, i) for q, i, _ in plain_search(rows, queries, 10_000)}
            assert {(q, i) for q, i, _ in got} <= full
    assert not {r["query"] for r in index.search(ix, asked, 5).collect()} & {6, 7, 11}


def test_kept_and_loaded(spark, tmp_path):
    df = spark.createDataFrame(_rows(50, 1), "id long, f string, t string")
    ix = index.build(df, "id", "t", "f")
    index.write(ix, str(tmp_path / "ix"))
    asked = spark.createDataFrame([(1, [["ka"]])], "query int, parts array<array<string>>")
    rows = lambda i: sorted(map(tuple, index.search(i, asked, 100).collect()))
    again = index.load(spark, str(tmp_path / "ix"))
    assert rows(again) == rows(ix) and (again.n_docs, again.avgdl) == (ix.n_docs, ix.avgdl)
    empty = index.build(df.limit(0), "id", "t", "f")
    assert index.search(empty, asked, 3).count() == 0 and index.search(ix, asked.limit(0), 3).count() == 0


def test_postings_of_blocks(spark):
    """A term that every document has is spread over blocks, each with its bounds; numbers are unique."""
    df = spark.range(10_000).selectExpr("id", "concat('all ', repeat('more ', cast(id % 7 as int)), 'w', id) as t").repartition(2)
    ix = index.build(df, "id", "t")
    rows = ix.postings.filter("term = 'all'").collect()
    assert len(rows) >= 4 and sum(r["n"] for r in rows) == 10_000 and all(r["n"] == len(r["docs"]) <= 4096 and r["least"] == min(r["dls"]) and r["most"] == max(r["tfs"]) for r in rows)
    assert ix.documents.select("doc").distinct().count() == 10_000 and {r["id"] for r in ix.documents.collect()} == set(range(10_000))
    more = ix.postings.filter("term = 'more'").first()
    assert all(p == list(range(1, t + 1)) for p, t in zip(more["places"], more["tfs"], strict=True))


def plain_snippet(text, wanted):
    flat = re.sub(r"\s+", " ", text or "")
    spans = [(m.start(), m.end()) for m in re.finditer(r"[^\W_̀-ͯ][\ẁ-ͯ]*", flat)]
    words = [_words(flat[a:b])[0] for a, b in spans]
    if not words:
        return ""
    at = [i for i, w in enumerate(words) if w in wanted]
    best = min(at, key=lambda i: (-len({words[j] for j in at if i <= j < i + 24}), i), default=0)
    start = max(0, min(best, len(words) - 24))
    stop = min(len(words), start + 24)
    out, last = "" if start else flat[: spans[0][0]].lstrip(" "), None
    for i in range(start, stop):
        gap = "" if last is None else flat[last : spans[i][0]]
        word = flat[spans[i][0] : spans[i][1]]
        out += gap + (f"[[{word}]]" if words[i] in wanted else word)
        last = spans[i][1]
    return ("..." if start else "") + out + ("..." if stop < len(words) else flat[spans[-1][1] :].rstrip(" "))


def test_snippets(spark):
    rng = np.random.default_rng(4)
    texts = [" ".join(rng.choice(["fox", "dog", "Cat,", "a", "b", "c", "d", "e.", "f"], rng.integers(0, 90), p=[0.04, 0.03, 0.03, 0.3, 0.2, 0.1, 0.1, 0.1, 0.1])) for _ in range(120)]
    texts += ["", None, " \n ", "Fox!", "(the fox)\n\n said: \"dog\"", "café fox café", "x " * 100, "fox " * 3000 + "dog", "!!! ", "fox"]
    for wanted in (["fox", "dog"], ["cafe"], ["none"], []):
        df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
        q = F.array(*map(F.lit, wanted)).cast("array<string>")
        got = {r["i"]: r["s"] for r in df.select("i", index.snippet(F.col("t"), q).alias("s")).collect()}
        for i, t in enumerate(texts):
            assert got[i] == plain_snippet(t, wanted), (i, t, wanted)


def test_hits(spark):
    df = spark.createDataFrame([(1, "a.txt", "the red fox"), (2, "b.txt", "a dog and a fox"), (None, "c.txt", "fox fox")], "id int, file string, t string")
    asked = spark.createDataFrame([(7, [["fox"]]), (8, [["red", "fox"]]), (9, [["c", "txt"]])], "query int, parts array<array<string>>")
    found = index.hits(index.search(index.build(df, "id", "t", "file"), asked, 10), asked, df, "id", "t", "file")
    got = {(r["query"], r["id"]): (r["file"], r["snippet"]) for r in found.collect()}
    assert got == {(7, 1): ("a.txt", "the red [[fox]]"), (7, 2): ("b.txt", "a dog and a [[fox]]"), (7, None): ("c.txt", "[[fox]] [[fox]]"), (8, 1): ("a.txt", "the [[red]] [[fox]]"), (9, None): ("c.txt", "fox fox")}


def test_frequent_pairs(spark):
    df = spark.createDataFrame([(1, "a b a b c"), (2, "one"), (3, None), (4, "x y z y")], "id int, t string")
    assert {r["query"]: r["parts"] for r in searches.frequent_pairs(df, "id", "t").collect()} == {1: [["a", "b"]], 4: [["x", "y"]]}


# Vectors


def _cloud(n, dims, centres, seed):
    rng = np.random.default_rng(seed)
    middles = rng.normal(size=(centres, dims))
    return [(i, (middles[i % centres] + 0.05 * rng.normal(size=dims)).tolist()) for i in range(n)]


def test_vector_index_is_exact_and_leaves_rows_out(spark):
    rows = [*_cloud(3000, 12, 20, 1), (9000, None), (9001, [0.0] * 12), (9003, [1.0] * 12), (9003, [1.0] * 12)]
    df = spark.createDataFrame(rows, "id long, v array<double>").repartition(4)
    asked = df.filter("id % 20 = 0 or id > 8999")
    ix = vectors.build(df, "id", "v", 24)
    report = []
    for k in (5, 50):
        got = sorted(map(tuple, vectors.search(ix, asked, k, "id", "v", report=report).select("query", "id", "score", "rank").collect()))
        want = sorted(map(tuple, retrieval.vector_search_all(df, asked, k, "id", "v").select("query", "id", "score", "rank").collect()))
        assert got == want
    assert report[0] > 0.5


def test_vector_index_of_alike_and_of_nothing(spark, monkeypatch):
    monkeypatch.setattr(vectors, "BLOCK_ROWS", 100)
    df = spark.range(1000).selectExpr("id", "array(1D, 0D) as v")
    ix = vectors.build(df, "id", "v", 4)
    assert max(r["count"] for r in ix.rows.groupBy("cluster", "salt").count().collect()) < 200
    got = vectors.search(ix, df.filter("id = 500"), 3, "id", "v").orderBy("rank").collect()
    assert [(r["id"], r["score"]) for r in got] == [(0, 1.0), (1, 1.0), (2, 1.0)]
    none = vectors.build(df.limit(0), "id", "v")
    assert vectors.search(none, df.limit(3), 3, "id", "v").count() == 0
    assert vectors.search(ix, df.limit(0), 3, "id", "v").count() == 0


# Chunks by document


def test_chunk_store(spark, tmp_path):
    chunks = spark.range(2000).selectExpr("concat('D', id div 10) as doc_id", "cast(id % 10 + 1 as int) as idx", "concat('D', id div 10, '__c', lpad(id % 10 + 1, 3, '0')) as chunk_id", "concat('text ', id) as text").repartition(4)
    made = store.write(chunks, str(tmp_path / "s"), 8)
    assert sorted(p.name for p in (tmp_path / "s/buckets=8").iterdir() if p.is_dir()) == sorted(f"bucket={k}" for k in range(8))
    again = store.load(spark, str(tmp_path / "s"), 8)
    one = again.document("D7")
    assert [r["text"] for r in one.collect()] == [f"text {i}" for i in range(70, 80)] and one.columns == ["doc_id", "idx", "chunk_id", "text"]
    plan = again.chunks.filter((F.col("bucket") == again._bucket(F.lit("D7"))) & (F.col("doc_id") == "D7"))
    assert len(plan.inputFiles()) == 8 and "PartitionFilters: [isnotnull(bucket" in plan._jdf.queryExecution().executedPlan().toString()
    assert [r["idx"] for r in made.chunk("D7__c001", 2).collect()] == [1, 2, 3] and [r["idx"] for r in made.chunk("D7__c005", 1).collect()] == [4, 5, 6]
    assert made.chunk("D7__c099").count() == 0 and made.chunk("zz").count() == 0 and made.document("none").count() == 0
    wanted = spark.createDataFrame([("D1",), ("D150",), ("D1",), ("none",)], "doc_id string")
    got = made.of(wanted).orderBy("doc_id", "idx").collect()
    assert [(r["doc_id"], r["idx"], r["previous"], r["next"]) for r in got] == [(d, i, i - 1 or None, i + 1 if i < 10 else None) for d in ("D1", "D150") for i in range(1, 11)]


def test_asset_paths(tmp_path):
    (tmp_path / "o/assets").mkdir(parents=True)
    (tmp_path / "o/assets/a b.png").write_text("P")
    (tmp_path / "secret").write_text("s")
    (tmp_path / "o/link").symlink_to(tmp_path / "secret")
    folder = str(tmp_path / "o")
    assert store.asset(folder, "assets/a b.png") == f"{folder}/assets/a b.png" == store.asset(folder, "assets/../assets/a b.png")
    for bad in ("../secret", "/etc/passwd", "assets/../../secret", "link", "..\\secret", "."):
        with pytest.raises(ValueError, match="outside"):
            store.asset(folder, bad)
    for gone in ("none", "assets"):
        with pytest.raises(FileNotFoundError):
            store.asset(folder, gone)
