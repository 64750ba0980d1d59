"""The pipeline against plain versions of its stages, and the SQL oracles against the queries."""

import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from test_operators import WORD, classes, fill, lower, plain_fingerprint, plain_targets
from tokenizers import Tokenizer

import corpus_pipeline
from corpusloom.llm import exact_dedup, quality_rules
from corpusloom.llm.oracles import ORACLES
from corpusloom.llm.queries import queries

TABLES = "documents conversations labels"


def test_run(spark, data):
    """Each stage anew in plain Python from the one before it; only the verdict of the quality rules is taken as it is (they have SQL)."""
    docs = spark.read.parquet(f"{data}/documents.parquet")
    all_ = {r["doc_id"]: r for r in docs.collect()}
    kept = {r["doc_id"] for r in quality_rules.judge(docs).collect() if r["kept"]}
    groups: dict = {}
    for i in kept:
        groups.setdefault(lower(all_[i]["text"]), []).append(i)
    kept = {max(g) for g in groups.values()}
    fp = {i: plain_fingerprint(all_[i]["text"]) for i in kept}
    root = classes([(a, b) for a in fp for b in fp if a < b and (fp[a] ^ fp[b]).bit_count() <= 2], fp)
    kept = set(root.values())
    stay = spark.createDataFrame([all_[i] for i in sorted(kept)], docs.schema)
    of = defaultdict(list)
    for i in kept:
        of[all_[i]["source"]].append((i, len(WORD.findall(all_[i]["text"]))))
    order = sorted(of, key=lambda s: (s is None, s or ""))
    target = dict(zip(order, plain_targets([(s, sum(n for _, n in of[s])) for s in order]), strict=True))
    got = corpus_pipeline.run(spark, data).collect()
    copies = Counter(r["doc_id"] for r in got if r["piece"] == 0)
    assert set(copies) <= kept
    for s, members in of.items():
        total = sum(n for _, n in members)
        assert {copies[i] for i, _ in members} <= {target[s] // total, target[s] // total + 1}
        assert abs(sum(copies[i] * n for i, n in members) - target[s]) <= max(n for _, n in members) / 2 + 1
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tokens = {i: [*t.encode(all_[i]["text"], add_special_tokens=False).ids, 0] for i in kept}
    want = Counter()
    for i, n in copies.items():
        ids = tokens[i]
        first = len(ids) % 2048 or 2048
        cuts = [0, *range(min(first, len(ids)), len(ids) + 1, 2048)]
        for p, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
            want[i, p, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())] += n
    assert Counter(tuple(r[c] for c in ("doc_id", "piece", "start", "length", "ids_crc32")) for r in got) == want
    assert fill(got, 2048) <= 1.02 * -(-sum(len(tokens[i]) * n for i, n in copies.items()) // 2048) + 1
    assert sorted(docs.columns) == sorted(corpus_pipeline.mixed(spark, stay, data).columns)


def test_one_of_repeated_rows_stays(spark, data):
    text = " ".join(f"word{i} of the and to" for i in range(30))
    docs = spark.createDataFrame([(5, text, "en", "s", 1)] * 3 + [(5, text + " more", "en", "s", 1), (None, text, "en", "s", 1)], "doc_id long, text string, lang string, source string, n_chars long")
    exact = corpus_pipeline.distinct_texts(spark, docs, data)
    assert sorted((r["doc_id"], len(r["text"])) for r in exact.collect()) == [(5, len(text)), (5, len(text) + 5)]
    one, other = {plain_fingerprint(r["text"]) for r in docs.collect()}
    assert corpus_pipeline.distinct_fingerprints(spark, docs, data).count() == 1 + ((one ^ other).bit_count() > 2)


def test_stages_on_nothing(spark, data):
    none = spark.read.parquet(f"{data}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, data).collect() == []


def test_null_ids_stay(spark, data):
    docs = spark.createDataFrame([(None, "some words here", "en", "s", 15), (1, "other words here", "en", "s", 16)], "doc_id long, text string, lang string, source string, n_chars long")
    assert corpus_pipeline.distinct_texts(spark, docs, data).count() == 2
    assert corpus_pipeline.distinct_fingerprints(spark, docs, data).count() == 2
    assert {r["doc_id"] for r in corpus_pipeline.mixed(spark, docs, data).collect()} == {None, 1}
    assert exact_dedup.exact_dedup(docs).filter("kept").count() == 2


@pytest.mark.parametrize("name", ORACLES)
def test_oracle(name, spark, data):
    con = duckdb.connect()
    for t in TABLES.split():
        con.sql(f"create view {t} as select * from '{data}/{t}.parquet'")
    sql = con.sql(ORACLES[name])
    got = queries()[name](spark, data)
    columns = sorted(got.columns)
    assert columns == sorted(sql.columns)
    key = lambda rows: sorted((tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in rows), key=repr)
    assert key(tuple(r) for r in got.select(columns).collect()) == key(sql.select(*columns).fetchall())


def test_quality_oracle_without_languages(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").withColumn("lang", F.expr("case doc_id % 4 when 0 then lang when 1 then 'it' when 2 then '' end"))
    con = duckdb.connect()
    con.register("documents", docs.toPandas())
    columns = ["doc_id", "kept", "class_distance", "common_distance", "n_repeat_words"]
    got = quality_rules.judge(docs).select(columns).collect()
    close = lambda rows: sorted(tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in rows)
    assert close([tuple(-1.0 if v is None else v for v in r) for r in got]) == close([tuple(-1.0 if v is None else v for v in r) for r in con.sql(ORACLES["op2_quality_rules"]).select(*columns).fetchall()])
