"""Relational case records as Markdown documents: joins, citations, overview and sections, all as one plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions.text import clean, let, normalize_newlines, safe_filename, strip
from corpusloom.sources.connect import registered

MOST_CITATIONS = 40


def first_names(links: DataFrame, names: DataFrame, key: str, on: str, name: str) -> DataFrame:
    """For each key the least non-blank name linked to it."""
    return links.join(names, on).filter(F.col(name).isNotNull() & (strip(F.col(name)) != "")).groupBy(key).agg(F.min(name).alias("name"))


def citations(rows: DataFrame, key: str, label: str) -> DataFrame:
    """For each key its labels, the most frequent first, then by name."""
    counts = rows.filter(F.col(key).isNotNull() & F.col(label).isNotNull() & (strip(F.col(label)) != "")).groupBy(key, label).agg(F.count("*").alias("n"))
    ordered = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), F.col(label).alias("label"))))
    return counts.groupBy(key).agg(F.transform(ordered, lambda x: x["label"]).alias("citations"))


def first_filled(*values: Column) -> Column:
    return F.coalesce(*[F.when(clean(v) != "", clean(v)) for v in values])


def render(title: Column, overview: list[tuple[str, Column]], cited: Column, sections: list[tuple[str, Column]], body: Column, n_cited: Column | None = None) -> Column:
    """A title, an overview of the filled fields with up to MOST_CITATIONS citations, then the filled sections, or the body
    where none is filled. `n_cited`: how many citations there are, where `cited` has the first alone."""
    field = lambda k, v: F.when(clean(v) != "", F.concat(F.lit(f"- **{k}:** "), clean(v)))
    n = F.coalesce(F.size(F.coalesce(cited, F.array().cast("array<string>"))) if n_cited is None else n_cited, F.lit(0))
    more = F.when(n > MOST_CITATIONS, F.concat(F.lit(" (+"), (n - MOST_CITATIONS).cast("string"), F.lit(" more)"))).otherwise("")
    names = F.when(n > 0, F.concat(F.array_join(F.slice(cited, 1, MOST_CITATIONS), "; "), more)).otherwise("none extracted")
    part = lambda k, v: F.when(clean(v) != "", F.concat(F.lit(f"\n## {k}\n\n"), clean(v)))
    filled = F.filter(F.array(*[part(k, v) for k, v in sections]), lambda x: x.isNotNull())
    whole = let(filled, lambda x: F.when(F.size(x) > 0, F.array_join(x, "\n")).otherwise(F.coalesce(part("Decision", body), F.lit(""))))
    lines = F.filter(F.array(*[field(k, v) for k, v in overview]), lambda x: x.isNotNull())
    head = F.concat(F.lit("# "), title, F.lit("\n\n## Appeal Overview\n\n"))
    return let(F.concat(head, F.array_join(F.concat(lines, F.array(F.concat(F.lit("- **Cited authorities:** "), names))), "\n"), F.lit("\n"), whole), normalize_newlines)


def metadata(fields: dict[str, Column]) -> Column:
    """The filled fields as a map."""
    return F.map_filter(F.create_map(*[x for k, v in fields.items() for x in (F.lit(k), clean(v))]), lambda _, v: v != "")


#: The overview's fields with the columns they come from, and the sections in their order: fixed values.
FIELDS = (
    ("Appellant", "final_appellant"), ("Recipient", "final_recipient"), ("PA ID", "final_pa_id"), ("URL", "source_url"), ("Source PDF", "pdf_name"), ("Disaster", "disaster"),
    ("Decision signed", "final_decision_signed_date"), ("Declaration date", "final_declaration_date"), ("Region", "final_region"), ("Status", "final_status"),
    ("PW / GMP", "final_pw_gmp_compact"), ("GMP number", "final_gmp_number"), ("PW number", "final_pw_number"), ("FEMA source key", "html_doc_key"),
)
SECTIONS = (
    ("Summary", "final_summary_text"), ("Analysis", "final_analysis_text"), ("Conclusion", "final_conclusion_text"), ("Decision Letter", "final_letter_text"),
    ("Headnotes", "final_headnotes_text"), ("Authorities", "final_authorities_text"), ("Footnotes", "final_footnotes_text"),
)
METADATA = (
    ("appellant", "final_appellant"), ("recipient", "final_recipient"), ("pa_id", "final_pa_id"), ("decision_date", "final_decision_signed_date"), ("region", "final_region"), ("status", "final_status"),
    ("url", "source_url"), ("pdf_filename", "pdf_name"), ("source_key", "html_doc_key"),
)
MAIN, PAGES, LINKS, FILES, CITED, LABELS = "final_appeal_authority", "src_html_appeal", "link_html_filename", "src_filename_pdf", "document_citation", "citation_reference"


def probed(tables: dict[str, DataFrame], name: str, *columns: str) -> DataFrame | None:
    """A table with these columns, those it lacks as nulls; None where there is no such table."""
    df = tables.get(name)
    return None if df is None else df.select(*[F.col(c) if c in df.columns else F.lit(None).cast("string").alias(c) for c in columns])


def documents(tables: dict[str, DataFrame], limit: int | None = None) -> DataFrame:
    """Case records as documents, in the order of final_id: place, final_id, source_file, source_path, extension, file_type,
    body, status, notes, category, title and metadata (a map). All tables but MAIN may be absent, and so may columns.

    A record without an id cannot be ordered and is failed. Titles: title, appellant, recipient, else the id. The tables
    are joined by their keys; citations and file names are aggregated before they are joined."""
    if MAIN not in tables:
        raise ValueError(f"no table {MAIN}: not a database of case records")
    columns = ["final_id", "html_id", "final_title", "final_disaster_number_raw", "final_disaster_number_norm", "final_body_text"]
    columns += [c for _, c in (*FIELDS, *SECTIONS) if c.startswith("final_")]
    rows = probed(tables, MAIN, *columns)
    if limit is not None:
        rows = rows.orderBy("final_id").limit(limit)
    pages = probed(tables, PAGES, "html_id", "html_doc_key", "source_url")
    rows = rows.join(pages, "html_id", "left") if pages is not None else rows.withColumns({c: F.lit(None).cast("string") for c in ("html_doc_key", "source_url")})
    links, names = probed(tables, LINKS, "html_id", "filename_id"), probed(tables, FILES, "filename_id", "name")
    files = first_names(links, names, "html_id", "filename_id", "name").withColumnRenamed("name", "pdf_name") if links is not None and names is not None else None
    rows = rows.join(files, "html_id", "left") if files is not None else rows.withColumn("pdf_name", F.lit(None).cast("string"))
    cited, labels = probed(tables, CITED, "parent_doc_key", "citation_id"), probed(tables, LABELS, "citation_id", "canonical_label")
    if cited is not None and labels is not None:
        # A record takes what its text shows; all of a source's labels, which are many in many records, go along only where they are read.
        lists = citations(cited.join(labels, "citation_id"), "parent_doc_key", "canonical_label")
        lists = lists.select("parent_doc_key", F.slice("citations", 1, MOST_CITATIONS).alias("first_cited"), F.size("citations").alias("n_cited"), F.array_join("citations", "; ").alias("citations"))
        rows = rows.join(lists, clean(F.col("html_doc_key")) == F.col("parent_doc_key"), "left").drop("parent_doc_key")
    else:
        rows = rows.withColumns({"first_cited": F.lit(None).cast("array<string>"), "n_cited": F.lit(0), "citations": F.lit(None).cast("string")})
    norm = F.col("final_disaster_number_norm")
    rows = rows.withColumn("disaster", F.concat_ws(" ", first_filled(F.col("final_disaster_number_raw")), F.when(clean(norm) != "", F.concat(F.lit("(norm "), clean(norm), F.lit(")")))))
    number = F.col("final_id").cast("string")
    rows = rows.withColumn("title", F.coalesce(first_filled(F.col("final_title"), F.col("final_appellant"), F.col("final_recipient")), F.concat(F.lit("Appeal "), number)))
    body = render(F.col("title"), [(k, F.col(c)) for k, c in FIELDS], F.col("first_cited"), [(k, F.col(c)) for k, c in SECTIONS], F.col("final_body_text"), F.col("n_cited"))
    said = {k: F.col(c) for k, c in METADATA} | {"title": F.col("title"), "final_id": number, "disaster_number": first_filled(norm, F.col("final_disaster_number_raw")), "citations": F.col("citations")}
    name = F.concat(safe_filename(F.concat(F.lit("appeal_"), number, F.lit("_"), F.col("title")), 100), F.lit(".md"))
    good = F.col("final_id").isNotNull()
    return rows.select(
        "final_id", F.when(good, name).otherwise("appeal_unknown.md").alias("source_file"), F.when(good, F.concat(F.lit("appeals/"), name)).otherwise("appeals/appeal_unknown.md").alias("source_path"),
        F.lit(".md").alias("extension"), F.lit("appeal").alias("file_type"), F.when(good, body).otherwise("").alias("body"), F.when(good, "ok").otherwise("failed").alias("status"),
        F.when(good, F.concat(F.lit("final_appeal_authority.final_id="), number)).otherwise("a record without an id").alias("notes"), F.lit("appeal").alias("category"), "title", metadata(said).alias("metadata"),
    )


#: The columns that are whole numbers.
NUMBERS = ("final_id", "html_id", "filename_id", "citation_id")


def sqlite_tables(spark: SparkSession, path: str, rows_a_task: int = 50_000) -> dict[str, DataFrame]:
    """The tables and views of a SQLite file that record sources use, as strings (ids as numbers), by the source corpus_sqlite. The path
    must be one that every machine sees; the driver reads names, columns and the bounds of partitions."""
    import sqlite3
    from contextlib import closing

    with closing(sqlite3.connect(f"file:{path}?mode=ro", uri=True)) as con:
        names = [r[0] for r in con.execute("select name from sqlite_master where type in ('table', 'view')")]
    source = lambda n: registered(spark).read.format("corpus_sqlite").options(path=path, table=n, rows=str(rows_a_task), numbers=",".join(NUMBERS))
    return {n: source(n).load() for n in names if n in (MAIN, PAGES, LINKS, FILES, CITED, LABELS)}
