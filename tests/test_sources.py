"""Sources and sinks for spark.read and df.write, and pages as Markdown."""

import os
import sqlite3

import pytest
from pyspark.sql import functions as F

from corpusloom.plans import job
from corpusloom.sources import connect, files, records
from corpusloom.sources.html import html_text


@pytest.fixture(scope="module")
def session(spark):
    return connect.registered(spark)


@pytest.fixture
def tree(tmp_path):
    for name in ("x.md", "a/y.TXT", "a/b/z.html", "a/b/c/w.csv", ".git/no.txt", ".hid", "noext", "ab/other.md"):
        (tmp_path / "in" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "in" / name).write_text("hi")
    return tmp_path / "in"


ALL = {".hid", "a/b/c/w.csv", "a/b/z.html", "a/y.TXT", "ab/other.md", "noext", "x.md"}


@pytest.mark.parametrize("tasks", [1, 3, 64])
def test_each_file_once(session, tree, tmp_path, tasks):
    (tree / "a/up").symlink_to(tree)
    (tree / "a/b/up").symlink_to(tree / "a")
    (tree / "a/self").symlink_to(tree / "a/self")
    (tmp_path / "out").mkdir()
    (tmp_path / "out/far.txt").write_text("1")
    (tmp_path / "out/back").symlink_to(tree)
    (tree / "link").symlink_to(tmp_path / "out")
    (tree / "file.txt").symlink_to(tree / "x.md")
    rows = session.read.format("corpus_folder").option("tasks", tasks).load(str(tree)).collect()
    assert sorted(r["rel_path"] for r in rows) == sorted(ALL | {"link/far.txt", "file.txt"})
    assert {r["rel_path"]: (r["ext"], r["file_type"]) for r in rows}["a/y.TXT"] == (".txt", "text")


def test_filters_and_columns_of_a_folder(session, tree):
    df = session.read.format("corpus_folder").load(str(tree))
    plan = df.filter("rel_path like 'a/%' and ext = '.csv' and size > 1")._jdf.queryExecution().executedPlan().toString()
    assert "Filter" not in plan.replace("PushedFilters", "").replace("RuntimeFilters", "")
    for condition in ("rel_path like 'a/%'", "ext in ('.md', '.csv')", "size >= 2 and file_type = 'text'", "rel_path = 'a/b/z.html'", "rel_path like '%md'", "rel_path like '%b/%'", "size < 2", "ext <> '.md'", "length(rel_path) > 5"):
        assert sorted(r[0] for r in df.filter(condition).select("rel_path").collect()) == sorted(r[0] for r in df.cache().filter(condition).select("rel_path").collect())
        df.unpersist()
    assert session.read.format("corpus_folder").schema("size long").load(str(tree)).columns == ["size"]
    assert session.read.format("corpus_folder").option("exclude", "a\n.hid").load(str(tree)).count() == 4
    with pytest.raises(Exception, match="no such folder"):
        session.read.format("corpus_folder").load(str(tree / "none")).count()


def test_closed_folders_are_not_opened(tree):
    reader = connect.FolderReader({"path": str(tree)}, ["rel_path"])
    list(reader.pushFilters([connect.D.StringStartsWith(("rel_path",), "a/b/c")]))
    assert [os.path.relpath(p.path, tree) for p in reader.partitions()] == [".", "a", "a/b", "a/b/c"]
    assert reader._may_hold("") and reader._may_hold("a") and reader._may_hold("a/b/c/d") and not reader._may_hold("ab")


@pytest.fixture
def base(tmp_path):
    path = str(tmp_path / "cases.db")
    with sqlite3.connect(path) as con:
        con.execute("create table plain (final_id integer, final_title text, blob_ blob)")
        con.executemany("insert into plain (rowid, final_id, final_title, blob_) values (?, ?, ?, ?)", [(-5, 1, "a", b"x"), (0, 2, None, b"\xff"), (3, 3, "c", "y"), (10**12, "4", "d", None), (10**12 + 1, "x", "e", None)])
        con.execute("create view final_appeal_authority as select * from plain")
        con.execute("create table \"odd 'name\" (k text, n integer, v text, primary key (n, k)) without rowid")
        con.executemany("insert into \"odd 'name\" values (?, ?, ?)", [(f"k{i % 7}", i % 9, f"v{i}") for i in range(60)])
        con.execute("create table none_ (v text)")
        con.execute("create table hidden (rowid text, v text)")
        con.executemany("insert into hidden values (?, ?)", [(f"r{i}", f"v{i}") for i in range(25)])
    return path


def read(session, path, table, rows=2, **more):
    return session.read.format("corpus_sqlite").options(path=path, table=table, rows=str(rows), numbers="final_id,n", **more)


def test_any_table_and_view(session, base):
    want = {1: "a", 2: None, 3: "c", 4: "d", None: "e"}
    for table, parts in (("plain", 3), ("final_appeal_authority", 1)):
        df = read(session, base, table).load()
        assert dict(df.select("final_id", "final_title").collect()) == want and df.rdd.getNumPartitions() == parts
        assert {r["blob_"] for r in df.collect()} == {"x", "�", "y", None}
    df = read(session, base, "odd 'name", 7).load()
    assert sorted(r["v"] for r in df.collect()) == sorted(f"v{i}" for i in range(60)) and df.rdd.getNumPartitions() == 9
    assert read(session, base, "none_").load().count() == 0
    hidden = read(session, base, "hidden", 10).load()
    assert hidden.count() == 25 and hidden.rdd.getNumPartitions() == 3 and {r["rowid"] for r in hidden.collect()} == {f"r{i}" for i in range(25)}
    with pytest.raises(Exception, match="no table or view"):
        read(session, base, "nothing").load()
    tables = records.sqlite_tables(session, base, 2)
    assert set(tables) == {"final_appeal_authority"}
    docs = job.records_of(tables)
    assert [(r["place"], r["final_id"], r["status"]) for r in docs.orderBy("place").collect()][-4:] == [(k + 1, k, "ok") for k in (1, 2, 3, 4)] and docs.filter("status = 'failed'").count() == 1


def test_filters_and_columns_of_a_table(session, base):
    df = read(session, base, "odd 'name", 7).schema("v string, n long").load()
    assert df.columns == ["v", "n"]
    plan = df.filter("v = 'v31' and n > 3")._jdf.queryExecution().executedPlan().toString()
    assert "Filter" not in plan.replace("PushedFilters", "").replace("RuntimeFilters", "")
    for condition in ("v = 'v31'", "n > 3", "n >= 3 and n < 5", "n = 4", "v in ('v1', 'v2', 'zz')", "v like 'v1%'", "n is null", "v is not null", "n <= 0"):
        assert sorted(map(tuple, df.filter(condition).collect())) == sorted(map(tuple, df.cache().filter(condition).collect())), condition
        df.unpersist()
    ids = read(session, base, "plain").load()
    assert ids.filter("final_id = 4").count() == 1 and ids.filter("final_id is not null").count() == 4


def test_files_by_name(session, tmp_path):
    target = str(tmp_path / "o/files")
    rows = session.range(30).selectExpr("concat('f', id div 4, '.md') as name", "id", "concat('v', id, 'é\n') as value").repartition(3, "name").sortWithinPartitions("name", "id").drop("id")
    rows.write.format("corpus_files").mode("overwrite").save(target)
    assert {f: open(f"{target}/{f}", encoding="utf-8").read() for f in os.listdir(target)} == {f"f{k}.md": "".join(f"v{i}é\n" for i in range(4 * k, min(30, 4 * k + 4))) for k in range(8)}
    before = sorted(os.listdir(target))
    # A task that fails: nothing of the job is left, what was there stays.
    bad = session.range(8, numPartitions=4).select(F.concat(F.lit("g"), "id").alias("name"), F.when(F.col("id") == 6, F.raise_error(F.lit("stop"))).otherwise("x").cast("string").alias("value"))
    with pytest.raises(Exception, match="stop"):
        bad.write.format("corpus_files").mode("overwrite").save(target)
    assert sorted(os.listdir(target)) == before and os.listdir(tmp_path / "o") == ["files"]
    session.createDataFrame([("h.md", "new")], "name string, value string").write.format("corpus_files").mode("append").save(target)
    assert sorted(os.listdir(target)) == [*before, "h.md"]
    session.createDataFrame([("only.md", "x")], "name string, value string").write.format("corpus_files").mode("overwrite").save(target)
    assert os.listdir(target) == ["only.md"]


def test_one_file_of_many_tasks(session, tmp_path):
    target = str(tmp_path / "o/one.json")
    rows = session.range(1000, numPartitions=7).orderBy(F.desc("id")).select(F.col("id").cast("string").alias("value"))
    rows.write.format("corpus_file").options(head="[", between=",", tail="]").mode("overwrite").save(target)
    assert open(target).read() == "[" + ",".join(str(i) for i in reversed(range(1000))) + "]" and os.listdir(tmp_path / "o") == ["one.json"]
    rows.limit(0).write.format("corpus_file").options(head="[", tail="]").mode("overwrite").save(target)
    assert open(target).read() == "[]"


def test_job_files(session, tmp_path):
    root = tmp_path / "in"
    for name, content in {"a.md": "# A\n\nalpha, \"beta\" | gamma\n\n# B\n\nsecond", "policy guide.md": "# P\n\nrule", "c.md": "# C\n\n" + "word " * 200, "e.exe": "", "z.md": "# Z\n\none\n\n# Y\n\ntwo"}.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(content)
    p = job.Profile("x", project_name="Proj", max_bundle_tokens=60, classify_documents=True, default_source_folder=str(root), chunk_token_budget=20, chunk_strategy="headings", chunk_heading_level=1, chunk_exclude_headings=("b", "none*"))
    docs = job.documents(session, str(root), p)
    picks = session.createDataFrame([("Z.md", [2, 9]), ("c.md", []), ("gone.md", [1])], "path string, chunks array<int>")
    result = job.run(docs, p, selections=picks)
    result.write(str(tmp_path / "o"))
    said = (tmp_path / "o/warnings.txt").read_text().splitlines()
    assert said == ["Chunk selection ignored for unprocessed or excluded file: gone.md", "DOC_0002 c.md: all chunks deselected; document omitted from export.", "DOC_0005 z.md: chunk indices out of range were ignored: [9] (document has 2 chunks)"]
    assert set(said) < set(result.warnings) and "heading exclusion rule matched no chunks: 'none*'" in result.warnings
    import csv
    import json

    rows = {r["doc_id"]: r for r in csv.DictReader(open(tmp_path / "o/manifest.csv", encoding="utf-8"))}
    assert list(rows) == [f"DOC_000{k}" for k in range(1, 6)] and rows["DOC_0002"]["status"] == "skipped" and rows["DOC_0002"]["token_estimate"] == "0" and rows["DOC_0003"]["status"] == "skipped"
    whole = json.loads((tmp_path / "o/manifest.json").read_text())
    assert whole["project_name"] == "Proj" and whole["token_estimator"] == "heuristic (chars/4)" and [e["doc_id"] for e in whole["entries"]] == list(rows)
    text = (tmp_path / "o/01_SOURCE_MANIFEST.md").read_text()
    assert "- **OK:** 3  |  **Skipped:** 2  |  **Failed:** 0" in text and text.count("\n| DOC_0") == 5
    names = sorted(os.listdir(tmp_path / "o/bundles"))
    assert names == ["02_BUNDLE_001.md", "03_BUNDLE_002.md"][: len(names)] and {r["output_bundle"] for r in rows.values()} - {""} == set(names)
    first = (tmp_path / "o/bundles" / names[0]).read_text()
    assert first.startswith("# BUNDLE_001\n\n- **Project:** Proj\n") and "Token estimator backend:** heuristic (chars/4)" in first and "rule" in first and "alpha" not in first  # the policy's tier comes first
    view = (tmp_path / "o/00_CORPUS_OVERVIEW.md").read_text()
    assert "- policy: 1 document(s)\n- other: 2 document(s)" in view and "| DOC_0004 | policy guide.md | policy |" in view and (tmp_path / "o/00_INSTRUCTIONS.md").read_text().startswith("# How to use Proj")
    every = "".join((tmp_path / "o/bundles" / n).read_text() for n in names)
    assert "second" not in every and "two" in every and "one\n" not in every and "word word" not in every
    assert [r["idx"] for r in job.preview(session, str(root), "z.md", p).orderBy("idx").collect()] == [1, 2]
    assert job.export.manifest_entry(result.manifest, "DOC_0005").first()["source_file"] == "z.md" and job.export.manifest_entry(result.manifest, "DOC_9").count() == 0


def test_search_job_and_metadata(session, tmp_path):
    from corpusloom.operators import index
    from corpusloom.plans import export

    docs = session.createDataFrame([(1, "cases/a.md", "a.md", "alpha beta", {"region": "9"}), (2, "cases/b.md", "b.md", "beta gamma", {})], "place long, source_path string, source_file string, body string, metadata map<string,string>")
    docs = docs.selectExpr("place", "source_file", "source_path", "'.md' as extension", "'text' as file_type", "body", "'ok' as status", "'' as notes", "'other' as category", "metadata")
    job.run(docs, job.Profile("x", target="cowork")).write(str(tmp_path / "o"))
    back = {r["doc_id"]: r for r in export.read_records(session, str(tmp_path / "o/chunks_jsonl")).collect()}
    assert back["DOC_0001"]["metadata"] == {"region": "9"} and back["DOC_0002"]["metadata"] in (None, {})
    asked = session.createDataFrame([(1, [["beta"]]), (2, [["a", "md"], ["alpha"]])], "query int, parts array<array<string>>")
    found = index.search(index.load(session, str(tmp_path / "o/index")), asked, 10)
    assert {(r["query"], r["id"]) for r in found.collect()} == {(1, "DOC_0001__c001"), (1, "DOC_0002__c001"), (2, "DOC_0001__c001")}
    assert session.read.parquet(str(tmp_path / "o/vectors")).count() == 2


def test_a_long_csv_field():
    assert files.csv_text("a,b\n" + "x" * 200_000 + ",1\n").count("x" * 200_000) == 1


PAGES = [
    ("", ""), ("plain", "plain"), ("a<br>b", "a\nb"), ("<h1>T</h1>x", "# T\n\nx"), ("<h3> a <b>c</b>\n d </h3>", "### a **c** d"), ("<p>a<p>b", "a\n\nb"), ("<p>a</p>b<p>c", "a\n\nb\n\nc"),
    ("<b> x </b>y", "**x** y"), ("<i></i><em>e</em><strong>s</strong>", "*e***s**"), ("<a href='u'>t</a><a>n</a>", "[t](u)n"), ("<code>a`b</code>", "``a`b``"), ("<img src=i alt='a b'>", "![a b](i)"),
    ("<ul><li>x<li>y</ul>", "- x\n- y"), ("<ol><li>x</li><li>y</li></ol>", "1. x\n2. y"), ("<ol start=9><li>x<li>y</ol>", "9. x\n10. y"), ("<ul><li>x<ul><li>y</ul><li>z</ul>", "- x\n  - y\n- z"),
    ("<ol><li>x<ul><li>y<li>w</ul></ol>", "1. x\n   - y\n   - w"), ("<ul><li><p>a</p><p>b</p></ul>", "- a\n\n  b"), ("<ul> <ul><li>in</ul></ul>", "  - in"), ("<ul><li></ul>x", "x"),
    ("<blockquote>q<p>r</blockquote>", "> q\n>\n> r"), ("<pre>a\n  b\n\nc</pre>", "```\na\n  b\n\nc\n```"), ("<pre><code class='language-py'>x = 1</code></pre>", "```py\nx = 1\n```"), ("<pre>```\n</pre>", "````\n```\n````"),
    ("<table><tr><th>A<th>B<tr><td>1<td>2|3</table>", "| A | B |\n| --- | --- |\n| 1 | 2\\|3 |"), ("<table><tr><td>1<td>2</table>", "|  |  |\n| --- | --- |\n| 1 | 2 |"),
    ("<table><caption>C</caption><thead><tr><td>A</thead><tbody><tr><td>1<td>2</table>x", "C\n\n| A |  |\n| --- | --- |\n| 1 | 2 |\n\nx"), ("<table><tr><th colspan=2>A<tr><td><p>1</p><p>2</p><td>b</table>", "| A |  |\n| --- | --- |\n| 1 2 | b |"),
    ("<table><tr><td><ul><li>x<li>y</ul></table>", "|  |\n| --- |\n| x y |"), ("<dl><dt>t<dd>d<dd>e</dl>", "t\n\n:   d\n\n:   e"), ("a<hr>b", "a\n\n---\n\nb"), ("<nav>m</nav><script>s<p></script><style>s</style>x<footer>f</footer>", "x"),
    ("<nav>menu<h1>T</h1>x", "# T\n\nx"), ("<head><title>t</title></head><body>b", "b"), ("<span><div>x</div>y</span>", "x\n\ny"), ("&lt;p&gt; &amp;amp;", "<p> &amp;"), ("<p>a</div></p>b</table>", "a\n\nb"), ("<!-- c -->x<!DOCTYPE html>", "x"),
    ("<p><b>Head.<br><p>Text", "**Head.**\n\nText"), ("<s>old</s> <del>x</del>", "~~old~~ ~~x~~"), ("<div>" * 2000 + "deep" + "</div>" * 2000 + "<p>end", "deep\n\nend"), ("<li>a<li>b", "a\n\nb"),
]


@pytest.mark.parametrize("page,text", PAGES)
def test_pages(page, text):
    assert html_text(page) == text


def test_pages_never_fail():
    import random

    rng = random.Random(8)
    parts = ["<p>", "</p>", "<table>", "<tr>", "<td>", "</table>", "<ul>", "<li>", "</ul>", "<b>", "</b>", "<a href=x>", "</a>", "<pre>", "</pre>", "text", " ", "\n", "<h2>", "</h2>", "<nav>", "</nav>", "<br>", "<dl>", "<dd>", "<blockquote>", "<", "&", "<img>", "<ol start=x>", "<td colspan=99999999999>"]
    for _ in range(3000):
        html_text("".join(rng.choice(parts) for _ in range(rng.randint(0, 40))))


def test_tokens_by_both_backends(session, tmp_path):
    import json

    import public_tokenizers
    import tiktoken  # noqa: F401
    from tokenizers import Tokenizer

    from corpusloom.functions import tokens

    vocabulary, whole = public_tokenizers.path("byte_bpe_50k.tiktoken"), Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    whole.encode_special_tokens = True
    texts = [r["text"] for r in session.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()] + ["", None, "don't  stop\n\n12 ünï <|endoftext|> 文"]
    df = session.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = {r["i"]: (r["a"], r["b"]) for r in df.select("i", tokens.count_tokens(F.col("t")).alias("a"), tokens.count_tokens(F.col("t"), vocabulary).alias("b")).collect()}
    assert got == {i: (-(-len(t or "") // 4), len(whole.encode(t or "", add_special_tokens=False).ids)) for i, t in enumerate(texts)}
    assert tokens.label() == "heuristic (chars/4)" and tokens.label(vocabulary) == "tiktoken (byte_bpe_50k)"
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.md").write_text("alpha beta gamma " * 40)
    p = job.Profile("x", token_vocabulary=vocabulary, default_source_folder=str(tmp_path / "in"))
    assert p.validate_source() is p
    job.run(job.documents(session, str(tmp_path / "in"), p), p).write(str(tmp_path / "o"))
    said = json.loads((tmp_path / "o/manifest.json").read_text())
    assert said["token_estimator"] == "tiktoken (byte_bpe_50k)" and "tiktoken (byte_bpe_50k)" in (tmp_path / "o/bundles/02_BUNDLE_001.md").read_text()
    for bad in (job.Profile("x", default_source_folder=str(tmp_path / "none")), job.Profile("x", token_vocabulary="/none", default_source_folder=str(tmp_path / "in"))):
        with pytest.raises(ValueError):
            bad.validate_source()
    with pytest.raises(ValueError, match="case records"):
        p.validate_source(str(tmp_path / "none.db"))


@pytest.mark.parametrize("target", ["claude", "cowork"])
def test_a_job_of_nothing(session, tmp_path, target):
    (tmp_path / "in").mkdir()
    p = job.Profile("x", target=target, bundling_mode="medium", default_source_folder=str(tmp_path / "in"))
    for docs in (job.documents(session, str(tmp_path / "in"), p), job.documents(session, str(tmp_path / "in"), p).limit(0)):
        result = job.run(docs, p)
        result.write(str(tmp_path / "o"))
        assert result.warnings == [] and (tmp_path / "o/manifest.csv").read_text().count("\n") in (1, 2)


def test_counts_taken_while_rows_are_written(session):
    from corpusloom.operators import bundling

    out, figures = bundling.counted(session.range(100).repartition(4), n=F.count("*"), s=F.sum("id"), odd=F.count_if(F.col("id") % 2 == 1))
    assert figures == {"n": 100, "s": 4950, "odd": 50} and out.count() == 100
    _, figures = bundling.counted(session.range(0), n=F.count("*"), s=F.sum("id"))
    assert figures == {"n": 0, "s": 0}
