"""The queries that see whole texts, whole query sets and all indexed columns."""

from pyspark.sql import functions as F

from corpusloom.operators import retrieval
from corpusloom.plans import queries as Q


def test_markdown_keeps_lines(spark):
    lines = [f"{i} " + "abcdefghi " * 9 + f"end{i}" for i in range(25)]
    t = spark.createDataFrame([("\n".join(lines),)], "t string").select(Q.markdown(F.col("t"))).first()[0]
    assert all(x in t for x in lines)


def test_documents_keep_words(spark, data):
    got = {r["doc_id"]: r["text"] for r in Q.QUERIES["get_documents_whole"](spark, data).collect()}
    for r in spark.read.parquet(f"{data}/documents.parquet").filter("text rlike '[^ \\n]'").collect():
        assert sum(len(w) for w in r["text"].split()) <= sum(len(w) for w in got[r["doc_id"]].split())


def test_queries_over_markdown_are_the_whole_ones():
    assert len(Q.OVER_MARKDOWN) == 30 and all(f"{n}_whole" in Q.QUERIES and n not in Q.QUERIES for n in Q.OVER_MARKDOWN)
    assert not {"vector_search", "hybrid_search", "bm25_search", "bm25_search_files", "bm25_phrase"} & set(Q.QUERIES)


def test_vector_search_of_many(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "BLOCK_QUERIES", 3)
    rows = [(i, [float(i % 7), 1.0, float(i % 3)]) for i in range(200)] + [(500, None), (501, [0.0, 0.0, 0.0]), (None, [1.0, 1.0, 1.0])]
    e = spark.createDataFrame(rows, "id int, v array<float>")
    got = {}
    for r in retrieval.vector_search_all(e, e.filter("id % 20 = 0"), 5, "id", "v").orderBy("query", "rank").collect():
        got.setdefault(r["query"], []).append(r["id"])
    assert set(got) == {i for i in range(0, 200, 20)} | {500}
    for q in range(0, 200, 20):
        assert got[q] == [r["id"] for r in retrieval.vector_search(e, rows[q][1], 5, "id", "v").orderBy("rank").collect()]


def test_search_in_file_names(spark):
    df = spark.createDataFrame([(1, "Budget_2024.txt", "state of the art"), (2, None, "budget plan"), (3, "art.md", None)], "id int, f string, t string")
    index, stats = retrieval.postings(df, "id", "t", "f"), retrieval.lengths(df, "id", "t", "f")
    found = lambda q: {r["id"] for r in retrieval.bm25(index, stats, q).collect()}
    assert found("budget") == {1, 2} and found("2024 art") == {1} and found("art") == {1, 3}
    assert found("budget-2024-txt") == {1} and found("txt-state") == set() and found("state-of-the-art") == {1}
    assert stats.first()["avgdl"] == (7 + 2 + 2) / 3
