"""Exports of a chunked and bundled corpus: manifest, chunk records, source map, overview, bundle files."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.functions.text import _EACH, CATEGORIES, ESTIMATOR, bundle_name, document_id, exploded, identity_header, strip, table_cell, word_count
from corpusloom.functions.tokens import count_tokens
from corpusloom.operators.bundling import RANGE, stored
from corpusloom.operators.chunking import Settings, chunk_array, heading_paths, overlap
from corpusloom.sources.connect import registered

#: What stands between documents in a bundle: a fixed value.
DIVIDER = "\n\n<!-- ================================================== -->\n\n"


def manifest(docs: DataFrame, vocabulary: str = "") -> DataFrame:
    """docs (place, source_file, source_path, extension, file_type, body, status, notes) as manifest rows. `vocabulary`: as count_tokens() takes it."""
    ident = document_id(F.col("place"))
    header = identity_header(ident, F.col("source_file"), F.col("source_path"), F.col("extension"))
    return docs.select(
        ident.alias("doc_id"), "source_file", "source_path", F.col("extension").alias("original_extension"), "file_type", "status",
        count_tokens(F.concat(header, F.lit("\n"), F.col("body")), vocabulary).alias("token_estimate"), F.length("body").alias("char_count"), word_count(F.col("body")).alias("word_count"), "notes",
    )


def manifest_totals(rows: DataFrame) -> DataFrame:
    return rows.groupBy("status").agg(F.count("*").alias("files"), F.sum("token_estimate").alias("tokens"))


def chunk_records(docs: DataFrame, s: Settings, overlap_tokens: int = 0, path_mode: str = "off", vocabulary: str = "") -> DataFrame:
    """docs (doc_id, source_file, source_path, body and, of case records, metadata): a row per chunk as it is exported. Paths are those
    of the chunks before they overlap; the estimate is that of the final text, or its count under `vocabulary` (chunks are cut by the
    estimate). A blank body still gives one empty chunk."""
    more = ["metadata"] if "metadata" in docs.columns else []
    d = docs.withColumn("__c", chunk_array(strip(F.coalesce("body", F.lit(""))), s)).withColumn("__p", heading_paths(F.transform("__c", lambda c: c["text"])))
    empty = F.array(F.struct(F.lit("").alias("text"), F.lit("").alias("reason")))
    d = d.withColumn("__o", F.when(F.size("__c") == 0, empty).otherwise(overlap(F.col("__c"), overlap_tokens)))
    rows = exploded(d, F.col("__o"), "doc_id", "source_file", "source_path", *more, "__p", each="__t")
    crumb = F.array_join(F.coalesce(F.get("__p", F.col("__i")), F.array().cast("array<string>")), " > ")
    text = F.col("__t.text")
    if path_mode in ("prefix", "both"):
        text = F.when(crumb != "", F.concat(crumb, F.lit("\n\n"), text)).otherwise(text)
    out = rows.withColumn("text", text).withColumn("heading_path", crumb)
    chunk_id = F.concat("doc_id", F.lit("__c"), F.when(F.col("__i") < 999, F.lpad((F.col("__i") + 1).cast("string"), 3, "0")).otherwise((F.col("__i") + 1).cast("string")))
    columns = [chunk_id.alias("chunk_id"), "doc_id", "source_file", "source_path", "text", count_tokens(F.col("text"), vocabulary).alias("token_estimate")]
    return out.select(*columns, *(["heading_path"] if path_mode in ("metadata", "both") else []), *more)


def json_lines(rows: DataFrame) -> DataFrame:
    return rows.select(F.to_json(F.struct(*rows.columns)).alias("value"))


def manifest_entry(rows: DataFrame, doc_id: str) -> DataFrame:
    """The manifest's row of a document; no rows for an unknown one."""
    return rows.filter(F.col("doc_id") == doc_id)


#: The columns of a manifest file: fixed values.
MANIFEST = ("doc_id", "source_file", "source_path", "original_extension", "file_type", "status", "token_estimate", "char_count", "word_count", "notes", "output_bundle")


def _thousands(n: Column) -> Column:
    return F.format_number(n, 0)


def _in_order(rows: DataFrame) -> DataFrame:
    """By document, whose ids grow longer with their numbers: sorted into ranges, so that tasks write one after another's part."""
    return rows.orderBy(F.length(F.regexp_extract("doc_id", r"^[^_]*_[^_]*", 0)), "doc_id")


def write_manifest(rows: DataFrame, folder: str, project: str, target: str, mode: str, backend: str = ESTIMATOR) -> None:
    """The manifest as manifest.csv, manifest.json and 01_SOURCE_MANIFEST.md, each one file in the order of documents, whose rows
    tasks write."""
    registered(rows.sparkSession)
    bundle = F.col("output_bundle") if "output_bundle" in rows.columns else F.lit(None).cast("string")
    rows = _in_order(rows.withColumn("output_bundle", F.coalesce(bundle, F.lit(""))).select(*MANIFEST))
    put = lambda df, name, **options: df.write.format("corpus_file").options(**options).mode("overwrite").save(f"{folder}/{name}")
    put(rows.select(F.to_csv(F.struct(*MANIFEST), {"escape": '"'}).alias("value")), "manifest.csv", head=",".join(MANIFEST) + "\n", tail="\n")
    said = {"project_name": project, "target": target, "mode": mode, "token_estimator": backend}
    put(rows.select(F.concat(F.lit("    "), F.to_json(F.struct(*MANIFEST))).alias("value")), "manifest.json", head=json.dumps(said, ensure_ascii=False)[:-1] + ', "entries": [\n', between=",\n", tail="\n]}\n")
    c = rows.agg(F.count("*").alias("n"), *[F.count_if(F.col("status") == x).alias(x) for x in ("ok", "skipped", "failed")], F.coalesce(F.sum("token_estimate"), F.lit(0)).alias("t")).first()  # five numbers
    # The labels of the head and of the columns.
    head = [f"# Source Manifest — {project}", "", f"- **Target:** {target}", f"- **Mode:** {mode}", f"- **Token estimator backend:** {backend}", f"- **Total documents:** {c['n']}", f"- **OK:** {c['ok']}  |  **Skipped:** {c['skipped']}  |  **Failed:** {c['failed']}", f"- **Estimated total tokens:** {c['t']:,}", ""]
    names = ("DOC_ID", "Source File", "Path", "Type", "Status", "Tokens", "Chars", "Words", "Bundle", "Notes")
    cells = ["doc_id", "source_file", "source_path", "file_type", "status", *[_thousands(F.col(x)) for x in ("token_estimate", "char_count", "word_count")], *[F.when(F.col(x) == "", "-").otherwise(F.col(x)) for x in ("output_bundle", "notes")]]
    line = F.concat(F.lit("| "), F.array_join(F.array(*[table_cell(F.col(x) if isinstance(x, str) else x) for x in cells]), " | "), F.lit(" |"))
    rule = "| " + " | ".join(names) + " |\n| " + " | ".join(["---"] * len(names)) + " |\n"
    put(rows.select(line.alias("value")), "01_SOURCE_MANIFEST.md", head="\n".join(head) + "\n" + rule, tail="\n")


def write_overview(rows: DataFrame, packed: DataFrame, folder: str, project: str) -> None:
    """00_CORPUS_OVERVIEW.md: each document that is ok with its tokens and bundle file and, where packed has category, its tier, after the
    counts of the tiers. packed: doc_id, output_bundle and perhaps category."""
    registered(rows.sparkSession)
    tiers = "category" in packed.columns
    joined = _in_order(rows.filter("status = 'ok'").drop("output_bundle").join(packed, "doc_id", "left"))
    c = joined.agg(F.count("*").alias("n"), F.count_distinct("output_bundle").alias("b"), F.coalesce(F.sum("token_estimate"), F.lit(0)).alias("t")).first()  # three numbers
    head = [f"# Corpus Overview — {project}", "", f"- **Documents:** {c['n']}", f"- **Bundles:** {c['b']}", f"- **Estimated total tokens:** {c['t']:,}", "", "Look a document up here, then open the bundle file that it names.", ""]
    if tiers:
        counts = {r[0]: r[1] for r in joined.groupBy("category").count().collect()}  # a row for each category
        head += ["**Tiers, the highest authority first:**", "", *[f"- {k}: {counts[k]} document(s)" for k in (*CATEGORIES, None) if k in counts], ""]
    names = ("DOC_ID", "Source File", *(("Tier",) if tiers else ()), "Tokens", "Bundle")
    cells = [F.col("doc_id"), F.col("source_file"), *([F.coalesce("category", F.lit("-"))] if tiers else []), _thousands(F.col("token_estimate")), F.coalesce("output_bundle", F.lit("-"))]
    line = F.concat(F.lit("| "), F.array_join(F.array(*map(table_cell, cells)), " | "), F.lit(" |"))
    rule = "| " + " | ".join(names) + " |\n| " + " | ".join(["---"] * len(names)) + " |\n"
    joined.select(line.alias("value")).write.format("corpus_file").options(head="\n".join(head) + "\n" + rule, tail="\n").mode("overwrite").save(f"{folder}/00_CORPUS_OVERVIEW.md")


def source_map(records: DataFrame) -> DataFrame:
    # Ids of one document differ in their number alone: the longer is the later.
    ids = F.transform(F.array_sort(F.collect_list(F.struct(F.length("chunk_id").alias("n"), F.col("chunk_id").alias("id")))), lambda x: x["id"])
    return records.groupBy("doc_id", "source_file", "source_path").agg(ids.alias("chunk_ids"), F.sum("token_estimate").alias("token_estimate"))


def overview(rows: DataFrame, bundles: DataFrame) -> DataFrame:
    """A Markdown table row for each document that is ok, with its bundle."""
    joined = rows.filter("status = 'ok'").join(bundles.select("doc_id", "bundle"), "doc_id", "left")
    name = F.coalesce(F.format_string("BUNDLE_%03d", "bundle"), F.lit(""))
    return joined.select("doc_id", F.concat(F.lit("| "), F.array_join(F.array("doc_id", table_cell(F.col("source_file")), F.col("token_estimate").cast("string"), name), " | "), F.lit(" |")).alias("line"))


def overview_tiers(rows: DataFrame, bundles: DataFrame) -> DataFrame:
    """As overview(), with the category of the document's bundle (bundles: doc_id, bundle, category)."""
    joined = rows.filter("status = 'ok'").join(bundles.select("doc_id", "bundle", "category"), "doc_id", "left")
    name = F.coalesce(F.format_string("BUNDLE_%03d", "bundle"), F.lit(""))
    cells = F.array("doc_id", table_cell(F.col("source_file")), F.coalesce("category", F.lit("-")), F.col("token_estimate").cast("string"), name)
    return joined.select("doc_id", F.concat(F.lit("| "), F.array_join(cells, " | "), F.lit(" |")).alias("line"))


#: Chunk records as they are written, one JSON object a line.
RECORD = "chunk_id string, doc_id string, source_file string, source_path string, text string, token_estimate int, heading_path string, metadata map<string,string>"


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """Chunk records read back from JSON lines, with idx (from 1, by id) in their document; blank and broken lines are left out."""
    rows = spark.read.schema(RECORD).option("mode", "DROPMALFORMED").json(path).filter("chunk_id is not null")
    order = Window.partitionBy("doc_id").orderBy(F.length("chunk_id"), "chunk_id")
    return rows.withColumn("idx", F.row_number().over(order))


#: How answers are to be given from an export, to be pasted where a reader takes standing instructions.
RULES = (
    "Answer from the documents of this export alone; say so where they do not settle a question.",
    "With each fact name the DOC_ID and the SOURCE_FILE of the document it comes from.",
    "Quote figures, dates, limits and warnings word for word.",
    "Where documents disagree, show each of them and which is newer or of higher authority, if that is told.",
    "A passage that looks damaged was converted badly: point to the original by its SOURCE_PATH.",
)
#: By target: a title, what to do with the export step by step, and whether RULES go along. {parts} and {documents} are filled in.
INSTRUCTIONS = {
    "chatgpt": (
        "In a ChatGPT project", True,
        ["Create a project, or open the one that this export renews.", "Upload the {parts} files of `bundles/`, `01_SOURCE_MANIFEST.md` and, if there is one, `00_CORPUS_OVERVIEW.md`.", "Add files of `assets/` only where pictures or tables matter to the answers.", "Paste the instructions below into the project's instructions.", "Ask for something that one document alone tells, and check that its DOC_ID is named."],
    ),
    "claude": (
        "In a Claude project", True,
        ["Create a project and open its knowledge.", "Add the {parts} files of `bundles/` and `01_SOURCE_MANIFEST.md`: together they hold the text of {documents} documents.", "Paste the instructions below into the project's instructions.", "When documents change, export anew and replace all files, as bundles shift."],
    ),
    "generic": (
        "With any assistant", True,
        ["Open `01_SOURCE_MANIFEST.md` to see which bundle holds what.", "Attach or paste the bundles that a question needs, or all {parts} of them where there is room.", "Put the instructions below before the first question.", "Each document opens with its DOC_ID, which answers are to name."],
    ),
    "rag": (
        "In a retrieval index", False,
        ["Read `chunks_jsonl`: {parts} records of {documents} documents, a JSON object a line.", "Index `text`; keep `chunk_id`, `doc_id`, `source_file`, `source_path`, `heading_path` and `metadata`, where there are any, as fields.", "A record's text may begin with its path of headings or with lines of the chunk before it, as the settings said; `token_estimate` counts the whole.", "`source_map` leads from each document to its chunks, so that neighbours of a hit can be fetched.", "Have answers name chunk_id and source_file."],
    ),
    "cowork": (
        "As a local search", False,
        ["`index/` holds the keyword index of {parts} chunks of {documents} documents, over texts and file names: `operators/index.py` loads and searches it, phrases too.", "`vectors` holds a vector for each chunk; `operators/vectors.py` finds the nearest.", "Both lists go together by reciprocal ranks.", "`chunks_jsonl` has the texts themselves; `operators/store.py` lays them out for reading by document.", "Have answers name chunk_id and source_file."],
    ),
}
#: What matters where an export goes.
ADVICE = {
    "claude_project": ("Few, whole files serve best: the place cuts and indexes them itself.", "Leave chunk settings alone and choose contents with care."),
    "chatgpt_project": ("Files are cut anew on arrival, so bundles by topic serve better than chunks.", "Mind the number of files that fit."),
    "chatgpt_enterprise": ("Files of middle size: much beyond 110,000 tokens is found by search alone.", "Split very long documents at headings and put overviews first."),
    "self_hosted_rag": ("The chunk is what is found: cut at headings, merge scraps.", "Keep the path of headings with each chunk; search by words and vectors together."),
}


def instructions(target: str, project: str, documents: int, parts: int, destination: str = "", mode: str = "", budget: int = 0, tokens: int = 0, backend: str = ESTIMATOR) -> str:
    """The Markdown file that tells what an export holds and how to use it."""
    title, rules, steps = INSTRUCTIONS[target]
    facts = [("Project", project), ("Target", target), ("Mode", mode), ("Documents", f"{documents:,}"), ("Chunks" if not rules else "Bundles", f"{parts:,}"), ("Estimated tokens", f"{tokens:,}" if tokens else ""), ("Token budget of each", f"{budget:,}" if budget else ""), ("Token estimator backend", backend)]
    lines = [f"# How to use {project or 'this export'}", "", *[f"- **{k}:** {v}" for k, v in facts if v], "", f"## {title}", ""]
    lines += [f"{i}. {x.format(documents=documents, parts=parts)}" for i, x in enumerate(steps, 1)]
    if rules:
        lines += ["", "## Instructions to paste", "", *[f"- {x}" for x in RULES]]
    if destination in ADVICE:
        lines += ["", "## Advice", "", *[f"- {x}" for x in ADVICE[destination]]]
    lines += ["", "## Files", "", "- `01_SOURCE_MANIFEST.md`, `manifest.csv`, `manifest.json`: every source document, with its status", "- `warnings.txt`, if there is one: what was passed over or kept whole", "- `assets/`: copied pictures and tables"]
    return "\n".join(lines) + "\n"


def rendered(header: Column, body: Column) -> Column:
    """A document as a bundle holds it."""
    return F.concat(header, F.lit("\n"), F.rtrim(body, F.lit(_EACH)), F.lit("\n"))


def bundle_heads(docs: DataFrame, budget: int, project: str = "", backend: str = ESTIMATOR) -> DataFrame:
    """bundle, place (before all documents) and the lines that open each bundle's file. A bundle's list of ids is as short as
    its budget."""
    ids = F.transform(F.sort_array(F.collect_list(F.struct("place", "doc_id"))), lambda x: x["doc_id"])
    by = docs.groupBy("bundle").agg(F.count("*").alias("n"), F.sum("token_estimate").alias("t"), F.array_join(ids, ", ").alias("ids"))
    # The labels.
    lines = [("Bundle", F.col("bundle")), ("Estimated tokens", _thousands(F.col("t"))), ("Token budget", F.lit(f"{budget:,}")), ("Token estimator backend", F.lit(backend)), ("Documents in bundle", F.col("n")), ("Included DOC_IDs", F.col("ids"))]
    items = F.concat_ws("\n", *[F.concat(F.lit(f"- **{k}:** "), v.cast("string")) for k, v in ([("Project", F.lit(project))] if project else []) + lines])
    cite = "## How to cite\n\nName the `DOC_ID` and the `SOURCE_FILE` of each document that an answer rests on, and quote figures and dates exactly.\n"
    return by.select("bundle", F.lit(0).cast("long").alias("place"), F.concat(F.format_string("# BUNDLE_%03d\n\n", "bundle"), items, F.lit(f"\n\n{cite}")).alias("markdown"))


def bundle_names(packed: DataFrame) -> DataFrame:
    """bundle and output_bundle, the name of its file, which depends on how many bundles there are."""
    bundles = packed.select("bundle").distinct()
    total = bundles.agg(F.max("bundle").alias("__n"))
    return bundles.join(F.broadcast(total)).select("bundle", bundle_name(F.col("bundle"), F.col("__n")).alias("output_bundle"))  # one row


def write_bundles(docs: DataFrame, path: str, budget: int, project: str = "", backend: str = ESTIMATOR) -> None:
    """docs (bundle, place, doc_id, token_estimate, markdown) as a Markdown file for each bundle, by the names of bundle_names(). A task
    writes whole bundles; files take their names once all tasks are done."""
    registered(docs.sparkSession)
    parts = docs.select("bundle", "place", F.concat(F.lit(DIVIDER), F.col("markdown")).alias("value")).unionByName(bundle_heads(docs, budget, project, backend).withColumnRenamed("markdown", "value"))
    rows = parts.join(bundle_names(docs), "bundle").withColumnRenamed("output_bundle", "name")
    rows.repartition("name").sortWithinPartitions("name", "place").select("name", "value").write.format("corpus_files").mode("overwrite").save(path)


def places(docs: DataFrame, order: list[str]) -> DataFrame:
    """docs with place, from 1, in order: rows are numbered within ranges, which grow in number with the input and whose counts give each
    its start."""
    docs = stored(docs)
    ranges = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-docs.count() // RANGE))
    ranged = stored(docs.repartitionByRange(ranges, *order).withColumn("__r", F.spark_partition_id()))
    counts = ranged.groupBy("__r").agg(F.count("*").alias("__n"))  # a row for each range
    starts = counts.select("__r", F.coalesce(F.sum("__n").over(Window.orderBy("__r").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__s"))
    within = F.row_number().over(Window.partitionBy("__r").orderBy(*order))
    return ranged.withColumn("__k", within).join(F.broadcast(starts), "__r").withColumn("place", F.col("__s") + F.col("__k")).select(*docs.columns, "place")


def unique_names(files: DataFrame, folder_col: str, name_col: str) -> DataFrame:
    """Files (with path, unique in its folder) and the names they get in a shared folder, in the order of paths: a name that is
    taken gets _1, _2, ... before its extension, the first that is free.

    Where no such name is itself a file's, the k-th of a name gets _k. Only files whose names do get in each other's way
    (a.txt twice and a_1.txt) are gone through one by one, by the name that is left without such endings.
    """
    import pandas as pd

    stem, ext = F.regexp_extract(name_col, r"(?s)\A(.+?)(\.[^.]*)?\z", 1), F.regexp_extract(name_col, r"(?s)\A.+?(\.[^.]*)?\z", 1)
    files = files.withColumn("__stem", stem).withColumn("__ext", ext).withColumn("__root", F.regexp_replace(stem, r"(_\d+)+\z", ""))
    family = [folder_col, "__root", "__ext"]
    names = files.groupBy(*family, F.col("__stem")).agg(F.count("*").alias("n"))
    parents = names.filter("n > 1").select(*family, F.col("__stem").alias("__of")).distinct()
    made = names.withColumn("__of", F.regexp_replace("__stem", r"_\d+\z", "")).filter(F.col("__of") != F.col("__stem"))
    entangled = stored(made.join(parents, [*family, "__of"], "left_semi").select(*family).distinct())
    k = F.row_number().over(Window.partitionBy(folder_col, name_col).orderBy("path")) - 1
    plain = files.join(entangled, family, "left_anti").withColumn("unique_name", F.when(k == 0, F.col(name_col)).otherwise(F.concat("__stem", F.lit("_"), k.cast("string"), "__ext")))
    columns = [*files.columns, "unique_name"]

    def one_by_one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, used, last, out = pdf.sort_values("path"), set(), {}, []
        for base, end in zip(pdf["__stem"], pdf["__ext"], strict=True):
            name, n = f"{base}{end}", last.get(base, 0)
            while name in used:
                n += 1
                name = f"{base}_{n}{end}"
            last[base] = n
            used.add(name)
            out.append(name)
        return pdf.assign(unique_name=out)

    shape = ", ".join(f"`{c}` {t}" for c, t in files.dtypes) + ", unique_name string"
    others = files.join(entangled, family, "left_semi").groupBy(*family).applyInPandas(one_by_one, shape)
    return plain.select(*columns).unionByName(others).drop("__stem", "__ext", "__root")
