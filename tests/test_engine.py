"""Text functions, bundling, retrieval, sources and jobs."""

import fnmatch
import json
import math
import random
import sqlite3
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from corpusloom import cli
from corpusloom.functions import text as T
from corpusloom.operators import audit, bundling, retrieval, rules
from corpusloom.operators.chunking import Settings
from corpusloom.operators.pages import restructure
from corpusloom.plans import export, job, probe
from corpusloom.sources import files, records
from corpusloom.streaming import ingest


def one(spark, column, *values):
    df = spark.createDataFrame([tuple(values)], ", ".join(f"v{i} {'string' if isinstance(v, str | None) else 'long'}" for i, v in enumerate(values)))
    return df.select(column(*[F.col(c) for c in df.columns])).first()[0]


@pytest.mark.parametrize("t", ["", "a", "abcde", "  x\x1c", "a \r\nb\t\rc　\n\n", "\n", "é\x85\n z"])
def test_text(spark, t):
    assert one(spark, T.strip, t) == t.strip()
    assert one(spark, T.word_count, t) == len(t.split())
    assert one(spark, T.estimate_tokens, t) == (max(1, (len(t) + 3) // 4) if t else 0)
    want = "\n".join(x.rstrip() for x in t.replace("\r\n", "\n").replace("\r", "\n").split("\n")).strip() + "\n" if t else ""
    assert one(spark, T.normalize_newlines, t) == want


@pytest.mark.parametrize("glob", ["*", "a*", "*.md", "?b", "[a-c]*", "[!a-c]*", "x[", "a.b", "*(1)*", "[]a]", "A\\b"])
def test_globs(spark, glob):
    names = ["a", "ab", "x.md", "bb", "zz", "x[", "a.b", "axb", "f(1).txt", "]", "a\\b", "A.MD"]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    got = {r["n"] for r in df.filter(F.size(T.matching_globs(F.col("n"), [glob, ""])) > 0).collect()}
    assert got == {n for n in names if fnmatch.fnmatchcase(n.lower(), glob.lower())}


def test_names(spark):
    assert one(spark, T.safe_filename, " a<b>:c  d.txt. ") == "a_b__c_d.txt"
    assert one(spark, T.safe_filename, "...") == "untitled"
    assert one(spark, T.safe_filename, "x" * 200 + ".md") == "x" * 117 + ".md"
    for n, first, last in [(1, "02", "02"), (98, "02", "99"), (99, "020", "118"), (980, "020", "999"), (981, "0200", "1180")]:
        got = [one(spark, T.bundle_name, k, n).split("_")[0].lstrip("0") for k in (1, n)]
        assert got == [first.lstrip("0"), last.lstrip("0")]
    assert one(spark, T.category, "FEMA-1174-DR.html") == "appeal" and one(spark, T.category, "appeal guide.pdf") == "policy"


def plain_bundles(tokens, budget):
    out, total = [], None
    for t in tokens:
        if total is None or total + t > budget:
            out.append(out[-1] + 1 if out else 1)
            total = t
        else:
            out.append(out[-1])
            total += t
    return out


@pytest.mark.parametrize("budget", [1, 10, 37, 1000, 10**6])
def test_greedy(spark, budget):
    rng = random.Random(budget)
    tokens = [rng.choice([0, 1, 3, 9, 30, 60]) for _ in range(700)]
    df = spark.createDataFrame(list(enumerate(tokens)), "place int, token_estimate int").repartition(7)
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # several ranges
    try:
        got = {r["place"]: r["bundle"] for r in bundling.greedy(df, budget, ["place"]).collect()}
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert [got[i] for i in range(700)] == plain_bundles(tokens, budget)


def test_split_at_headings(spark):
    body = "# A\n\n" + "word " * 400 + "\n\n## B\n\n" + "term " * 400
    df = spark.createDataFrame([("DOC_0001", "f", "f", ".md", body, "", 1010), ("DOC_0002", "g", "g", ".md", "small", "n", 20)], "doc_id string, source_file string, source_path string, extension string, body string, notes string, token_estimate int")
    got = {r["doc_id"]: r for r in bundling.split_at_headings(df, 600).collect()}
    assert set(got) == {"DOC_0001_p01", "DOC_0001_p02", "DOC_0002"}
    assert got["DOC_0001_p02"]["notes"] == "Part 2 of 2 (medium heading split)" and got["DOC_0001_p02"]["body"].startswith("## B")


def test_retrieval(spark):
    df = spark.createDataFrame([(1, "Café au lait, state-of-the-art"), (2, "cafe noir"), (3, None), (4, "art of the state")], "id int, t string")
    index, stats = retrieval.postings(df, "id", "t"), retrieval.lengths(df, "id", "t")
    assert {r["id"] for r in retrieval.bm25(index, stats, "CAFÉ").collect()} == {1, 2}
    assert {r["id"] for r in retrieval.bm25(index, stats, "state-of-the-art").collect()} == {1}
    assert {r["id"] for r in retrieval.bm25(index, stats, "state art").collect()} == {1, 4}
    assert retrieval.bm25(index, stats, '"!').collect() == []
    v = retrieval.hash_embedding(df, "id", "t")
    norms = v.groupBy("id").agg(F.sum(F.col("value") * F.col("value")).alias("n")).collect()
    assert all(math.isclose(r["n"], 1) for r in norms)
    best = retrieval.sparse_search(v, v.filter("id = 2"), 2).collect()
    assert best[0]["id"] == 2 and best[0]["score"] == 1


def test_pages(spark):
    text = "intro\n" + "".join(f"## Page {i}\nHeader\n{i}\nChapter {i}: Title\nsome text {i}\nwraps {i} here\n• item {i}\nA. Part {i}\n\nend {i}.\n" for i in range(1, 6))
    df = spark.createDataFrame([(1, text), (2, "no pages")], "id int, t string")
    got = {r["id"]: r["t"] for r in restructure(df, "id", "t").collect()}
    assert got[2] == "no pages"
    across = spark.createDataFrame([(1, "## Page 1\none\n## Page 2\ntwo\n## Page 3\n## Page 4\nthree\n\nfour\n## Page 5\n")], "id int, t string")
    assert restructure(across, "id", "t").first()["t"] == "one two three\n\nfour\n"
    assert got[1].startswith("## Chapter 1: Title\n\nsome text 1 wraps 1 here\n\n- item 1\n\n### A. Part 1\n\nend 1.\n\n## Chapter 2") and "Header" not in got[1]


def test_readers():
    html = "<html><head><title>t</title></head><body><nav>skip</nav><h1>Top</h1><p>one <b>two</p><ul><li>x<li>y</ul><table><tr><th>a</th><td>b</td></tr></table><img src='i.png' alt='z'></body></html>"
    assert files.html_text(html) == "# Top\n\none **two**\n\n- x\n- y\n\n|  |  |\n| --- | --- |\n| a | b |\n\n![z](i.png)"
    assert files.json_text(json.loads('{"a": null, "b": [1, true], "c": [{"d": 2}], "e": {}}')) == "## a\n\n(null)\n\n## b\n\n- 1\n- true\n\n## c\n\n### item 1\n\n#### d\n\n2\n\n## e\n\n(empty object)"
    assert files._read("json", b"{", "x")[1] == "failed" and files._read("text", b"\xff", "x")[0] == "ÿ"


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    root = tmp_path_factory.mktemp("in")
    for name, content in {"notes/a.md": "# A\n\nbody", "_b.txt": "plain", ".c.md": "hidden", "d.csv": "x,y\n1,a|b\n", "e.exe": "?", "node_modules/f.md": "no", "manual.html": "<h2>H</h2><p>text</p>"}.items():
        path = root / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(content)
    return str(root)


def test_html_marks():
    assert files.html_text("<nav>menu<h1>Top</h1><p>see <a href='u'>the <b>site</b></a> <i></i>and <em>more</em></p>") == "# Top\n\nsee [the **site**](u) and *more*"
    assert files.html_text("<head><title>x<body><p>in</p>") == "in"


def test_scan(spark, folder):
    got = {r["rel_path"]: r["file_type"] for r in files.scan(spark, folder, [".md", ".txt", ".html"]).collect()}
    assert got == {"notes/a.md": "text", "_b.txt": "text", ".c.md": "text", "e.exe": "unsupported", "manual.html": "html"}


def test_assets(spark, tmp_path):
    root = tmp_path / "in"
    page = "<p>x<img src='../i%20a.png?v=1' alt='z'><img src='http://h/w.png'><img src='no.png'><img src='../../secret.png'><img src='/etc/passwd'><img src=''></p>"
    for name, content in {"sub/p.html": page, "i a.png": "P", "t.csv": "x,y\n1,a|b\n2,c\n", "e.csv": "", "h.csv": "x\n", "_h.md": "hidden", "deep/er/.d/f.md": "f", "bad.json": "{"}.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(content)
    (tmp_path / "secret.png").write_text("s")
    (root / "empty").mkdir()
    p = job.Profile("x", target="rag", default_source_folder=str(root))
    docs = job.documents(spark, str(root), p)
    rows = {r["source_path"]: r for r in docs.collect()}
    assert rows["sub/p.html"]["body"] == "x ![z](assets/i a.png) ![](http://h/w.png) ![](MISSING/no.png) ![](MISSING/../../secret.png) ![](MISSING//etc/passwd) ![]()\n"
    assert rows["sub/p.html"]["notes"] == "Missing image asset: no.png; Missing image asset: ../../secret.png; Missing image asset: /etc/passwd"
    assert rows["t.csv"]["body"] == "# CSV: t.csv\n\n- **Row count:** 2\n- **Column count:** 2\n- **Columns:** x, y\n- **Original copied to:** `assets/t.csv`\n\n## Preview (first 2 rows)\n\n| x | y |\n| --- | --- |\n| 1 | a\\|b |\n| 2 | c |\n"
    assert rows["e.csv"]["body"] == "[CSV is empty.]\n" and rows["h.csv"]["body"].endswith("[No data rows.]\n") and rows["bad.json"]["status"] == "failed"
    assert {"_h.md", "deep/er/.d/f.md"} <= set(rows)
    out = tmp_path / "out"
    job.run(docs, p).write(str(out))
    assert {r["path"]: r["size"] for r in spark.read.json(str(out / "asset_list")).collect()} == {"i a.png": 1, "t.csv": 14, "e.csv": 0, "h.csv": 2}
    assert sorted(x.name for x in (out / "assets").iterdir()) == ["e.csv", "h.csv", "i a.png", "t.csv"] and (out / "assets/i a.png").read_text() == "P"
    (tmp_path / "none").mkdir()
    assert job.documents(spark, str(tmp_path / "none"), p).count() == 0
    with pytest.raises(FileNotFoundError):
        files.scan(spark, str(tmp_path / "not there"), [".md"])


def test_job(spark, folder, tmp_path):
    assert cli.main([folder, "--target", "chatgpt", "--output", str(tmp_path / "out")], spark) == 0
    rows = {r["source_path"]: r for r in spark.read.option("header", True).csv(str(tmp_path / "out/manifest_csv")).collect()}
    assert rows["e.exe"]["status"] == "skipped" and rows["manual.html"]["status"] == "ok" and rows["d.csv"]["doc_id"] == "DOC_0003"
    text = "".join(r["value"] for r in spark.read.text(str(tmp_path / "out/bundles"), wholetext=True).collect())
    assert text.index("plain") < text.index("## H\n") < text.index("# A")
    assert cli.main([folder, "--profile", "local search", "--output", str(tmp_path / "rag")], spark) == 0
    lines = [json.loads(r["value"]) for r in spark.read.text(str(tmp_path / "rag/chunks_jsonl")).collect()]
    assert {x["doc_id"] for x in lines} == {"DOC_0001", "DOC_0002", "DOC_0003", "DOC_0005", "DOC_0006"}
    assert spark.read.parquet(str(tmp_path / "rag/vectors")).count() > 0
    assert cli.main([]) == 2 and cli.main([folder, "--profile", "none such"]) == 2


def test_profiles(tmp_path):
    p = job.Profile("My Own", target="rag", exclude_files=("*.tmp",))
    job.save(p, str(tmp_path))
    (tmp_path / "broken.json").write_text("{")
    assert job.saved(str(tmp_path)) == {"My Own": p}
    assert job.Profile.from_json('{"profile_name": "x", "unknown": 1}').profile_name == "x"
    for bad in ({"target": "x"}, {"mode": "x"}, {"chunk_heading_level": 7}, {"max_bundle_tokens": 0}, {"chunk_min_tokens": -1}, {"bundling_mode": "x"}, {"destination": "x"}):
        with pytest.raises(ValueError):
            job.Profile("x", **bad).validate()
    assert job.budget("rag", "full") == 50_000 and job.Profile("x", target="rag", chunk_token_budget=10, chunk_overlap_tokens=10).warnings()
    assert {p.target for p in job.TEMPLATES.values()} == set(job.BUDGETS) and all(p.validate() for p in job.TEMPLATES.values())
    assert job.delete("My Own", str(tmp_path)) and not job.delete("My Own", str(tmp_path)) and job.saved(str(tmp_path)) == {}
    assert job.embedder("") == 256 and job.embedder("hashing:64") == 64
    with pytest.raises(ValueError, match="voyage"):
        job.Profile("x", embedding_model="voyage:voyage-3").validate()
    assert job.folder_name(job.Profile("x", project_name="a b"), datetime(2024, 1, 2, 3, 4, 5)) == "a_b_chatgpt_balanced_20240102_030405"


def test_probe(spark):
    rows = probe.bundles(spark, 3, 200).collect()
    assert len({r["code"] for r in rows}) == 3 and all(r["text"].count(r["code"]) == 2 for r in rows)
    assert probe.depths(spark).count() == 7


def test_stream(spark, data, tmp_path):
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").limit(20)
    docs.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(docs.schema).parquet(str(tmp_path / "in"))
    ingest.to_parquet(ingest.chunk_stream(stream, Settings(100)), str(tmp_path / "out"), str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).count() == ingest.chunk_documents(docs, Settings(100)).count()


def test_greedy_with_equal_keys(spark):
    df = spark.createDataFrame([("a", 3), ("a", 3), ("b", 5), ("b", 1), (None, 9)], "k string, token_estimate int")
    got = bundling.greedy(df, 8, ["k"]).collect()
    assert len(got) == 5 and sorted((r["k"] or "", r["token_estimate"]) for r in got) == [("", 9), ("a", 3), ("a", 3), ("b", 1), ("b", 5)]
    sums = {}
    for r in got:
        sums[r["bundle"]] = sums.get(r["bundle"], 0) + r["token_estimate"]
    assert all(v <= 9 for v in sums.values())


def test_human_size(spark):
    for n in (0, 1023, 1024, 1280, 1792, 1536, 10_000_000, 5 * 2**40):
        size, unit = float(n), "B"
        for unit in ("B", "KB", "MB", "GB", "TB"):
            if size < 1024 or unit == "TB":
                break
            size /= 1024
        assert one(spark, T.human_size, n) == (f"{n} B" if unit == "B" else f"{size:.1f} {unit}")


def test_unique_names(spark):
    rng = random.Random(3)
    for names in (["a.txt", "a.txt", "a_1.txt"], ["a_1.txt", "a.txt", "a.txt"], ["x", "x", "x_1", "x_1", "x_1_1"], [rng.choice(["b.md", "b_1.md", "b_2.md", "b_1_1.md", "c.md", "c_7.md"]) for _ in range(60)]):
        rows = [(f"p{i:03}", "f" if i % 5 else "g", n) for i, n in enumerate(names)]
        want, used = {}, set()
        for p, folder, n in rows:
            stem, dot, ext = n.partition(".")
            free, k = n, 0
            while (folder, free) in used:
                k += 1
                free = f"{stem}_{k}{dot}{ext}"
            used.add((folder, free))
            want[p] = free
        got = {r["path"]: r["unique_name"] for r in export.unique_names(spark.createDataFrame(rows, "path string, folder string, name string"), "folder", "name").collect()}
        assert got == want


def test_source_map_of_many_chunks(spark):
    rows = [("D", "f", "p", f"D__c{i:03}", 1) for i in range(1, 1102)]
    df = spark.createDataFrame(rows, "doc_id string, source_file string, source_path string, chunk_id string, token_estimate int").repartition(3)
    assert export.source_map(df).first()["chunk_ids"] == [r[3] for r in rows]


def test_search_in_one_pass(spark):
    df = spark.createDataFrame([(1, "a.txt", "tiếng Việt của tôi"), (2, "b.txt", "viet tieng"), (3, "c.txt", None), (4, "d.txt", "Việt, Việt!")], "id int, f string, t string")
    for query in ("việt", "tieng-viet", "a-txt tieng", "none", "!"):
        for file in (None, "f"):
            index, stats = retrieval.postings(df, "id", "t", file), retrieval.lengths(df, "id", "t", file)
            want = {(r["id"], round(r["score"], 12)) for r in retrieval.bm25(index, stats, query).collect()}
            got = {(r["id"], round(r["score"], 12)) for r in retrieval.bm25(*retrieval.searched(df, "id", "t", query, file), query).collect()}
            assert got == want
    assert {r["id"] for r in retrieval.bm25(*retrieval.searched(df, "id", "t", "việt"), "việt").collect()} == {1, 2, 4}
    assert one(spark, lambda t: retrieval.snippet(t, "fox"), "x " * 60 + "the quick Fox\njumps " + "y " * 200).count("[Fox] jumps") == 1
    assert one(spark, lambda t: retrieval.snippet(t, "fox"), "nothing here") == "nothing here"


def test_hybrid_and_chunk(spark):
    kw = spark.createDataFrame([(i, -float(i)) for i in range(1, 80)], "id int, score double")
    v = spark.createDataFrame([(1, 0, 1.0), (2, 0, 0.6), (2, 1, 0.8)], "id int, dim int, value double")
    assert [r["id"] for r in retrieval.hybrid(kw, None, None, 3).orderBy("rank").collect()] == [79, 78, 77]
    both = {r["id"]: r["score"] for r in retrieval.hybrid(kw, v, v.filter("id = 1"), 80).collect()}
    assert len(both) == 79 and math.isclose(both[1], round(1 / 61 + 1 / 139, 9)) and math.isclose(both[79], round(1 / 61, 9))
    chunks = spark.createDataFrame([(f"d__c{i}", "d", i) for i in range(5)], "chunk_id string, doc_id string, idx int")
    assert [r["idx"] for r in retrieval.chunk(chunks, "d__c2", 1).collect()] == [1, 2, 3] and retrieval.chunk(chunks, "zz").count() == 0


def test_job_rules(spark, tmp_path):
    root = tmp_path / "in"
    for name, content in {"a.md": "# Keep\n\nbody\n\n# Drop me\n\ngone", "b.md": "# Drop it\n\nall gone", "sub/c.md": "## X\n\n" + "word " * 900 + "\n\n## Y\n\n" + "term " * 900, "out/old.md": "old", "d.md": "word " * 3000}.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(content)
    p = job.Profile("x", default_output_folder=str(root / "out"), exclude_files=("*.none",), included_files=("A.md", "b.md", "sub\\c.md", "zz.md", "d.md"), chunk_exclude_headings=("drop*",), chunk_strategy="headings", chunk_heading_level=1, bundling_mode="medium", max_bundle_tokens=1500)
    said = []
    docs = job.documents(spark, str(root), p, said)
    assert said == ["included file was not found: zz.md", "exclusion pattern matched no files: '*.none'"]
    p = job.with_overrides(p, chunk_heading_level=2)
    result = job.run(docs, p, said)
    rows = {r["doc_id"]: r for r in result.manifest.collect()}
    assert rows["DOC_0002"]["status"] == "skipped" and rows["DOC_0001"]["status"] == "ok" and "out/old.md" not in {r["source_path"] for r in rows.values()}
    assert {"DOC_0004_p01", "DOC_0004_p02"} <= set(rows) and "DOC_0004" not in rows and rows["DOC_0004_p02"]["bundle"]
    assert any("DOC_0003" in w and "no headings" in w for w in result.warnings)
    picked = spark.createDataFrame([("DOC_0001", 2)], "doc_id string, idx int")
    assert "gone" in job.run(docs, p, selected=picked).bundles.filter("doc_id = 'DOC_0001'").first()["body"]
    over = spark.createDataFrame([("/B.md", " Policy "), ("a.md", "nonsense")], "path string, category string")
    assert {r["source_file"]: r["category"] for r in rules.categories(docs.drop("category"), over, "source_path").collect()} == {"a.md": "other", "b.md": "policy", "c.md": "other", "d.md": "other"}
    tiers = audit.tier_counts(docs.withColumn("category", F.when(F.col("place") < 3, "b").otherwise("a")), "place").orderBy("first_seen").collect()
    assert [(r["category"], r["documents"]) for r in tiers] == [("b", 2), ("a", 2)]
    assert bundling.rough_bundles(spark.createDataFrame([(k, 400) for k in range(10)], "k int, size long"), 250, ["k"]).first()["bundles"] == 5
    result.write(str(tmp_path / "o"))
    assert spark.read.text(str(tmp_path / "o/instructions"), wholetext=True).first()[0].startswith("# How to use")
    assert audit.folder_listing(spark, str(tmp_path / "o")).count() > 3


def test_records_read_back(spark, tmp_path):
    (tmp_path / "c.jsonl").write_text('{"chunk_id": "D__c002", "doc_id": "D", "text": "b"}\n\nbroken\n{"chunk_id": "D__c001", "doc_id": "D", "text": "a"}\n')
    assert [(r["idx"], r["text"]) for r in export.read_records(spark, str(tmp_path / "c.jsonl")).orderBy("idx").collect()] == [(1, "a"), (2, "b")]
    assert all(len(export.instructions(t, "p", 3, 4, "claude_project")) > 80 for t in job.BUDGETS)


def test_case_records(spark, tmp_path):
    path = tmp_path / "cases.sqlite3"
    columns = ["final_id", "html_id", *[c for _, c in (*records.FIELDS, *records.SECTIONS) if c.startswith("final_")], "final_title", "final_disaster_number_raw", "final_disaster_number_norm", "final_body_text"]
    with sqlite3.connect(path) as con:
        con.execute(f"create table final_appeal_authority ({', '.join(columns)})")
        row = dict.fromkeys(columns)
        for extra in ({"final_id": 2, "html_id": 7, "final_title": " T ", "final_disaster_number_raw": "FEMA-1-DR", "final_disaster_number_norm": "1", "final_analysis_text": "why"}, {"final_id": 1, "final_recipient": "R", "final_body_text": "text"}, {"final_id": 3}):
            con.execute(f"insert into final_appeal_authority values ({', '.join('?' * len(columns))})", list((row | extra).values()))
        con.execute("create table src_html_appeal (html_id, html_doc_key)")
        con.execute("insert into src_html_appeal values (7, 'k')")
        con.execute("create table document_citation (parent_doc_key, citation_id)")
        con.execute("create table citation_reference (citation_id, canonical_label)")
        for k in range(43):
            con.execute("insert into citation_reference values (?, ?)", (k, f"L{k:02}"))
            con.executemany("insert into document_citation values ('k', ?)", [(k,)] * (2 if k == 42 else 1))
    tables = records.sqlite_tables(spark, str(path), 2)
    got = {r["final_id"]: r for r in job.records_of(tables).collect()}
    assert [got[k]["place"] for k in (1, 2, 3)] == [1, 2, 3] and got[2]["source_file"] == "appeal_2_T.md"
    cited = "; ".join(["L42", *[f"L{k:02}" for k in range(39)]])
    assert got[2]["body"] == f"# T\n\n## Appeal Overview\n\n- **Disaster:** FEMA-1-DR (norm 1)\n- **FEMA source key:** k\n- **Cited authorities:** {cited} (+3 more)\n\n## Analysis\n\nwhy\n"
    assert got[1]["body"] == "# R\n\n## Appeal Overview\n\n- **Recipient:** R\n- **Cited authorities:** none extracted\n\n## Decision\n\ntext\n"
    assert got[3]["title"] == "Appeal 3" and got[2]["metadata"]["disaster_number"] == "1" and job.records_of(tables, 1).count() == 1
    assert cli.main(["--appeals-db", str(path), "--target", "rag", "--output", str(tmp_path / "o")], spark) == 0
    assert cli.main(["--context-probe", "2", "--max-bundle-tokens", "100", "--output", str(tmp_path / "p")], spark) == 0
    assert spark.read.option("header", True).csv(str(tmp_path / "p/probe_key")).count() == 2
    with pytest.raises(ValueError, match="final_appeal_authority"):
        records.documents({})
