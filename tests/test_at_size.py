"""What shows only in larger tables: numbers of more digits, repeated names, work that must not grow with the square."""

import hashlib
import re

import duckdb
import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from corpusloom.functions.text import WS
from corpusloom.operators import bundling, index, pages, retrieval, searches
from corpusloom.operators import chunking as C
from corpusloom.plans import job
from corpusloom.plans import queries as Q
from corpusloom.sources import files


def agree(spark, folder, name, **tables):
    """The query over these rows (a DataFrame for each table) returns what its SQL returns."""
    con = duckdb.connect()
    for t, rows in tables.items():
        rows.write.parquet(f"{folder}/{t}.parquet")
        con.sql(f"create view {t} as select * from '{folder}/{t}.parquet/*.parquet'")
    df = Q.QUERIES[name](spark, str(folder))
    columns = sorted(df.columns)
    got = sorted(tuple(r) for r in df.select(columns).collect())
    assert got == sorted(con.sql(Q.SQL[name]).select(*columns).fetchall())
    return got


def test_parts_beyond_ninety_nine(spark):
    """ids of parts are different ones."""
    body = "\n\n".join(f"## H{i}\n\n" + "word " * 50 for i in range(105))
    df = spark.createDataFrame([("DOC_0001", "f", "f", ".md", body, "", 7000)], "doc_id string, source_file string, source_path string, extension string, body string, notes string, token_estimate int")
    got = {r["part"]: r["doc_id"] for r in bundling.split_at_headings(df, 100).collect()}
    assert len(set(got.values())) == len(got) == 105 and (got[9], got[10], got[105]) == ("DOC_0001_p09", "DOC_0001_p10", "DOC_0001_p105")


def test_names_beyond_the_widest(spark):
    """the names that the SQL of bundle_summary gives from 9,801 bundles on."""
    per = spark.createDataFrame([(b, 1, 1) for b in (1, 9801)], "bundle long, token_estimate long, n long")
    got = {r["bundle"]: r["name"] for r in bundling.summary(per, 10, "n", widest=4).collect()}
    assert got == {1: "200_BUNDLE_001.md", 9801: "10000_BUNDLE_9801.md"}
    assert {r["name"] for r in bundling.summary(per, 10, "n").collect()} == {"2000_BUNDLE_001.md", "11800_BUNDLE_9801.md"}


def _pages(spark):
    """Pages of which many share a url."""
    return spark.range(200).select(F.col("id").alias("page_id"), F.concat(F.lit("http://x/Guide"), (F.col("id") % 9).cast("string")).alias("url"), F.lit("").alias("html"))


def test_overrides_of_pages_of_one_url(spark, tmp_path):
    """an override is of one page."""
    assert len(agree(spark, tmp_path, "category_overrides", pages=_pages(spark))) == 200


def test_pages_of_one_url(spark, tmp_path):
    """F8: a page is taken by itself."""
    assert len(agree(spark, tmp_path, "include_paths", pages=_pages(spark))) == 29


def test_lists_are_moved_by_block(spark):
    """lists of postings go to their block's task, once for all queries; they are not copied for each query or phrase."""
    df = spark.range(300).selectExpr("id", "concat('one two ', repeat('two ', cast(id % 5 as int)), 'w', id) as t")
    ix = index.build(df, "id", "t")
    asked = spark.createDataFrame([(q, [["one", "two"], ["two"]] if q % 2 else [["two"], ["one"]]) for q in range(40)], "query int, parts array<array<string>>")
    found = index.search(ix, asked, 3)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapCoGroupsInArrow" in plan and "collect_list(struct(idf" not in plan
    rows = {}
    for r in found.collect():
        rows.setdefault(r["query"], []).append((r["rank"], r["id"], r["score"]))
    assert len(rows) == 40 and all(sorted(x) == sorted(rows[q % 2]) for q, x in rows.items()) and len(rows[0]) == 3
    assert "Exchange" not in ix.postings._jdf.queryExecution().executedPlan().toString()
    bare = index.build(df, "id", "t", placed=False)
    terms = asked.filter("query % 2 = 0")
    assert sorted(map(tuple, index.search(bare, terms, 3).collect())) == sorted(map(tuple, index.search(ix, terms, 3).collect()))


def test_vectors_are_not_copied_for_queries(spark, monkeypatch):
    """rows of vectors are neither copied for parts of the queries nor queries for parts of the rows."""
    monkeypatch.setattr(retrieval, "BLOCK_QUERIES", 2)
    v = spark.range(60).selectExpr("id", "array(cast(id % 7 as double), 1D, cast(id % 3 as double)) as v")
    best = retrieval.vector_search_all(v, v.filter("id % 5 = 0"), 4, "id", "v")
    assert "explode" not in best._jdf.queryExecution().optimizedPlan().toString().lower() and best.count() == 48


def planned(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_records_take_few_citations_along(spark, data):
    """a source's labels do not go along with each of its records; the text shows the first ones and counts all."""
    plan = planned(Q.QUERIES["record_documents"](spark, data))
    assert re.search(r"first_cited#\d+, n_cited#\d+", plan)


def test_running_lines_are_found_once(spark):
    """a text's running lines are not found again for each of its lines."""
    df = spark.createDataFrame([(1, "## Page 1\na\n## Page 2\na\n## Page 3\na\n## Page 4\na\nb")], "id int, t string")
    shown = pages.restructure(df, "id", "t")
    assert "array_contains(lambda" in shown._jdf.queryExecution().analyzed().toString() and shown.first()["t"] == "b\n"


def test_few_words_at_a_time(monkeypatch):
    """a batch is embedded in slices, however large it is."""
    monkeypatch.setattr(retrieval, "EMBED_ROWS", 5)
    monkeypatch.setattr(retrieval, "EMBED_WORDS", 20)
    rows = [["w"] * n for n in (3, 0, 50, 9, 9, 9, 1, 1, 1, 1, 1, 1, 0)]
    got = [part.column("w").to_pylist() for part in retrieval._few(pa.RecordBatch.from_pydict({"w": rows}).slice(1))]
    assert [r for part in got for r in part] == rows[1:] and all(len(p) == 1 or len(p) <= 5 and sum(map(len, p)) <= 20 for p in got) and len(got) < 8


def test_files_are_read_once(spark, tmp_path):
    """no second pass over the files for those that are repaired, and texts are not joined to their list."""
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.md").write_text("a")
    listed = files.scan(spark, str(tmp_path / "in"), [".md"])
    assert "Join" not in planned(files.read_files(listed, str(tmp_path / "in")))
    docs = job.documents(spark, str(tmp_path / "in"), job.Profile("all"))
    assert "LeftOuter" not in planned(docs) and [r["body"] for r in docs.collect()] == ["a\n"]


def test_chunks_carry_their_own_path(spark):
    """a chunk's row is not made with the paths of all chunks of its document."""
    df = spark.createDataFrame([(1, "# A\n\nw w w w\n\n## B\n\nv v v v")], "doc_id int, text string")
    cut = C.chunk_documents(df, C.Settings(3, "headings", 2, fence_aware=True), structures=False)
    generate = next(x for x in planned(cut).splitlines() if "Generate" in x)
    assert "zip_with" in generate and [r["heading_path"] for r in cut.orderBy("idx").collect()][-1] == ["A"]


def test_index_for_its_queries(spark):
    """an index for one search has postings of its queries' terms alone, in fewer, larger blocks, and finds the same."""
    odd = "".join(map(chr, range(2, 0x180))) + " été İx ΣΣ \x00zero \x01one " + "".join(map(chr, range(0x180, 1, -1)))
    rows = [(i, f"File_{i}.txt", f"one two {'two ' * (i % 5)} w{i} ÉtÉ naïve") for i in range(9000)] + [(9000, "Über.md", odd), (9001, "a\x01b", "ete x"), (9002, None, None), (9003, "", "")]
    df = spark.createDataFrame(rows, "id long, f string, t string").repartition(2)
    asked = spark.createDataFrame([(1, [["two"], ["ete"]]), (2, [["w17"]]), (3, [["uber"]]), (4, [["ete"], ["x"]]), (5, [["none"]]), (6, [["b"]])], "query int, parts array<array<string>>")
    own, whole = index.build(df, "id", "t", "f", asked=asked), index.build(df, "id", "t", "f")
    assert {r["term"] for r in own.postings.select("term").distinct().collect()} == {"two", "ete", "w17", "uber", "x", "b"}
    assert own.postings.filter("term = 'two'").count() <= 2 < whole.postings.filter("term = 'two'").count() and (own.n_docs, own.avgdl) == (whole.n_docs, whole.avgdl)
    words = df.select("id", F.concat(*[retrieval.terms(F.coalesce(F.col(c), F.lit(""))) for c in ("f", "t")]).alias("w"))
    assert {(r["id"], r["dl"]) for r in whole.documents.collect()} == {(r["id"], len(r["w"])) for r in words.collect()}
    want = {(r["term"], r["n"]) for r in words.select(F.explode(F.array_distinct("w")).alias("term")).groupBy("term").agg(F.count("*").alias("n")).collect()}
    assert {(r["term"], r["n"]) for r in whole.postings.groupBy("term").agg(F.sum("n").alias("n")).collect()} == want
    found = [sorted(map(tuple, index.search(i, asked, 5).collect())) for i in (own, whole)]
    assert found[0] == found[1] and {r[0] for r in found[0]} == {1, 2, 3, 4, 6}


def test_sets_are_not_joined_with_blocks(spark, monkeypatch):
    """no row is made and sorted for each set of a search and each block."""
    df = spark.range(300).selectExpr("id", "concat('one two ', repeat('two ', cast(id % 5 as int)), 'w', id) as t")
    asked = spark.createDataFrame([(q, [["one"], ["two"], [f"w{q}"]][: 1 + q % 3]) for q in range(40)], "query int, parts array<array<string>>")
    found = index.search(index.build(df, "id", "t"), asked, 3)
    assert "block" not in re.sub(r"xxhash64\(block[^)]*\)", "", "".join(x for x in planned(found).splitlines() if "Join" in x or "Window" in x))
    first = sorted(map(tuple, found.collect()))
    monkeypatch.setattr(index, "STEP", 2)
    assert sorted(map(tuple, index.search(index.build(df, "id", "t", asked=asked), asked, 3).collect())) == first and len(first) == 13 * 1 + 27 * 3


def test_rough_scores_leave_no_row_out(spark, monkeypatch):
    """scores are told in single precision first; rows that differ by less than it tells are ranked as in double precision."""
    monkeypatch.setattr(retrieval, "HELD_ROWS", 40)
    rng = np.random.default_rng(3)
    one = rng.normal(size=64)
    rows = [(i, (one + 10.0 ** -(3 + i % 6) * rng.normal(size=64)).tolist()) for i in range(400)] + [(1000 + i, one.tolist()) for i in range(30)] + [(2000, [0.0] * 64), (2001, None)]
    v = spark.createDataFrame(rows, "id long, v array<double>").repartition(3)
    m = np.array([x or [0.0] * 64 for _, x in rows])
    m /= np.maximum(np.sqrt((m * m).sum(axis=1, keepdims=True)), 1e-300)
    ids = np.array([i for i, _ in rows])
    for k in (5, 60):
        got = {}
        for r in retrieval.vector_search_all(v, v.filter("id % 50 = 0"), k, "id", "v").orderBy("query", "rank").collect():
            got.setdefault(r["query"], []).append((r["id"], r["score"]))
        assert len(got) == 10
        for q, found in got.items():
            scores = np.round(m @ m[ids == q][0], 6) + 0.0
            order = np.lexsort((ids, -scores))[:k]
            assert found == list(zip(ids[order].tolist(), scores[order].tolist(), strict=True))


def test_words_without_expressions(spark):
    """words of texts in Latin-1 are found in whole batches, as the expressions find them, and others by these."""
    every = [chr(c) for c in range(0x250)]
    texts = ["".join(every), " ".join(every), "Aé aé\tÉa\x1fb\x85c\xa0d \x00e \x01 f", "ΣΑΣ İx ﬁn été", None, "", " \n ", "x" * 5000 + " y", *(f"w{i} W{i % 7} ß" for i in range(2000))]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, t string").coalesce(1)
    words = F.array_remove(F.split(F.lower(F.coalesce("t", F.lit(""))), WS + "+"), "")
    want = {}
    for r in df.select("id", words.alias("w")).collect():
        for w in r["w"]:
            d = hashlib.md5(w.encode()).digest()
            key = (r["id"], int.from_bytes(d[:4], "little") % 256)
            want[key] = want.get(key, 0) + (1 if d[4] % 2 else -1)
    norms = {}
    for (i, _), n in want.items():
        norms[i] = norms.get(i, 0) + n * n
    got = {(r["id"], r["dim"]): r["value"] for r in retrieval.hash_embedding(df, "id", "t").collect()}
    assert set(got) == {x for x, n in want.items() if n} and all(abs(v - want[x] / norms[x[0]] ** 0.5) < 1e-12 for x, v in got.items())
    terms = searches.frequent_terms(df, "id", "t", 3, 1)
    assert "MapInArrow" in planned(terms)
    counts = df.select("id", F.explode(retrieval.terms(F.coalesce("t", F.lit("")))).alias("x")).groupBy("id", "x").count().collect()
    best = {}
    for r in sorted(counts, key=lambda r: (-r["count"], r["x"])):
        best.setdefault(r["id"], []).append(r["x"])
    assert {r["query"]: r["terms"] for r in terms.collect()} == {i: sorted(x[:3]) for i, x in best.items()}
