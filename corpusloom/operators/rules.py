"""Which paths, chunks and documents are kept."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.text import CATEGORIES, category, estimate_tokens, exploded, glob_pattern, matching_globs, path_key, strip


def include_paths(files: DataFrame, wanted: DataFrame, path_col: str) -> DataFrame:
    """Files whose path is among `wanted` (column path), ignoring case."""
    keys = wanted.select(path_key(F.col("path")).alias("__k"))
    return files.join(keys, path_key(F.col(path_col)) == F.col("__k"), "left_semi")


def missing_paths(files: DataFrame, wanted: DataFrame, path_col: str) -> DataFrame:
    """The wanted paths (path, in the form in which they are compared) that no file has."""
    keys = wanted.select(path_key(F.col("path")).alias("path")).distinct()
    return keys.join(files.select(path_key(F.col(path_col)).alias("__k")), F.col("path") == F.col("__k"), "left_anti")


def categories(files: DataFrame, overrides: DataFrame, path_col: str) -> DataFrame:
    """The files with category: what an override (path, category) says, `other` if it says none that is known; without an
    override, what the path tells. Several overrides of a path: the first by name."""
    said = F.lower(strip(F.col("category")))
    known = overrides.select(path_key(F.col("path")).alias("__k"), F.when(said.isin(*CATEGORIES), said).otherwise("other").alias("__c"))
    known = known.groupBy("__k").agg(F.min("__c").alias("__c"))
    joined = files.join(known, path_key(F.col(path_col)) == F.col("__k"), "left")
    return joined.withColumn("category", F.coalesce("__c", category(F.col(path_col)))).drop("__k", "__c")


def exclude_paths(files: DataFrame, globs: list[str], path_col: str) -> DataFrame:
    """Files that no pattern matches."""
    return files.filter(F.size(matching_globs(F.col(path_col), globs)) == 0)


def glob_hits(files: DataFrame, globs: list[str], path_col: str) -> DataFrame:
    """How many files each pattern matches, none included: one pass, a sum for each pattern."""
    p = F.lower(path_col)
    sums = files.agg(*[F.count_if(p.rlike(glob_pattern(g))).alias(f"h{i}") for i, g in enumerate(globs)])
    return sums.select(F.explode(F.array(*[F.struct(F.lit(g).alias("pattern"), F.col(f"h{i}").alias("hits")) for i, g in enumerate(globs)])).alias("x")).select("x.*")


def apply_heading_rules(chunks: DataFrame, globs: list[str]) -> DataFrame:
    """Documents rebuilt without the chunks whose first heading matches a pattern: body, kept and total chunks, status
    (skipped if none is left), token_estimate of the body, note."""
    first = F.coalesce(F.get("structure.headings", F.lit(0)), F.lit(""))
    hit = F.size(matching_globs(strip(first), globs)) > 0
    return _rebuilt(chunks.withColumn("__keep", ~hit), "chunk(s) excluded by heading rules")


def apply_selection(chunks: DataFrame, selected: DataFrame) -> DataFrame:
    """Documents rebuilt from selected chunks (doc_id, idx). A document without a selection is whole; a selection of no
    existing chunk is as none; of all, the whole document."""
    marks = selected.select("doc_id", "idx").distinct().withColumn("__sel", F.lit(True))
    named = selected.select("doc_id").distinct().withColumn("__named", F.lit(True))
    m = chunks.join(marks, ["doc_id", "idx"], "left").join(named, "doc_id", "left")
    valid = m.groupBy("doc_id").agg(F.count("__sel").alias("__valid"))
    m = m.join(valid, "doc_id").withColumn("__keep", F.col("__named").isNull() | (F.col("__valid") == 0) | F.col("__sel").isNotNull())
    return _rebuilt(m, "chunk(s) deselected")


def select_by_path(chunks: DataFrame, docs: DataFrame, selections: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What a review of chunks decided: documents rebuilt as by apply_selection(), with their warning, and the warnings (text) of
    all selections.

    selections: path, chunks (array of places from 1; of rows of one path, all). chunks: doc_id, idx, text of documents (doc_id,
    source_path). An empty selection takes all chunks away: the document is skipped, with no tokens. Places that are not there are
    passed over and told; where none or all are there, the document is whole. Paths without a document are told."""
    wanted = selections.groupBy(path_key(F.col("path")).alias("__k")).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("chunks")))).alias("__w"))
    named = docs.select("doc_id", "source_path", path_key(F.col("source_path")).alias("__k"))
    of = named.join(wanted, "__k")
    counts = chunks.join(of.select("doc_id"), "doc_id", "left_semi").groupBy("doc_id").agg(F.max("idx").alias("__n"))
    of = of.join(counts, "doc_id", "left").withColumn("__n", F.coalesce("__n", F.lit(0)))
    lost = F.filter("__w", lambda i: (i < 1) | (i > F.col("__n")))
    none = F.size("__w") == 0
    label = F.concat("doc_id", F.lit(" "), "source_path", F.lit(": "))
    told = F.when(none, F.concat(label, F.lit("all chunks deselected; document omitted from export."))).when(
        F.size(lost) > 0, F.concat(label, F.lit("chunk indices out of range were ignored: ["), F.array_join(lost.cast("array<string>"), ", "), F.lit("] (document has "), F.col("__n").cast("string"), F.lit(" chunks)"))
    )
    of = of.select("doc_id", none.alias("__none"), F.col("__w"), told.alias("warning"))
    picked = exploded(of, F.col("__w"), "doc_id", each="idx").select("doc_id", "idx")
    kept = apply_selection(chunks.join(of.select("doc_id"), "doc_id", "left_semi"), picked).join(of.select("doc_id", "__none", "warning"), "doc_id")
    omitted = "All chunks were deselected during chunk review; content omitted."
    rebuilt = kept.select(
        "doc_id", "total", F.when(F.col("__none"), 0).otherwise(F.col("kept")).alias("kept"), F.when(F.col("__none"), "").otherwise(F.col("body")).alias("body"), F.when(F.col("__none"), "skipped").otherwise(F.col("status")).alias("status"),
        F.when(F.col("__none"), 0).otherwise(F.col("token_estimate")).alias("token_estimate"), F.when(F.col("__none"), omitted).otherwise(F.col("note")).alias("note"), "warning",
    )
    strange = wanted.join(named, "__k", "left_anti").select(F.concat(F.lit("Chunk selection ignored for unprocessed or excluded file: "), "__k").alias("text"))
    return rebuilt, rebuilt.filter("warning is not null").select(F.col("warning").alias("text")).unionByName(strange)


def unmatched_rules(chunks: DataFrame, globs: list[str]) -> list[str]:
    """The heading patterns that match no chunk: one pass, a count for each pattern."""
    globs = [g.strip() for g in globs if g and g.strip()]
    if not globs:
        return []
    first = strip(F.coalesce(F.get("structure.headings", F.lit(0)), F.lit("")))
    found = chunks.agg(*[F.count_if(F.size(matching_globs(first, [g])) > 0).alias(f"h{i}") for i, g in enumerate(globs)]).first()
    return [g for i, g in enumerate(globs) if not found[f"h{i}"]]


def _rebuilt(marked: DataFrame, what: str) -> DataFrame:
    kept = F.sort_array(F.collect_list(F.when(F.col("__keep"), F.struct("idx", "text"))))
    by = marked.groupBy("doc_id").agg(F.count("*").alias("total"), F.count_if("__keep").alias("kept"), F.array_join(F.transform(kept, lambda c: c["text"]), "\n\n").alias("body"))
    gone = F.col("total") - F.col("kept")
    note = F.when(gone > 0, F.concat(gone.cast("string"), F.lit(" of "), F.col("total").cast("string"), F.lit(f" {what}"))).otherwise("")
    return by.select("doc_id", "total", "kept", "body", F.when(F.col("kept") == 0, "skipped").otherwise("ok").alias("status"), estimate_tokens(F.col("body")).alias("token_estimate"), note.alias("note"))


def partial_selections(chunks: DataFrame, selected: DataFrame) -> DataFrame:
    """Documents of which some but not all chunks are selected, with both numbers."""
    marks = selected.select("doc_id", "idx").distinct().withColumn("__sel", F.lit(True))
    by = chunks.join(marks, ["doc_id", "idx"], "left").groupBy("doc_id").agg(F.count("__sel").alias("selected"), F.count("*").alias("total"))
    return by.filter((F.col("selected") > 0) & (F.col("selected") < F.col("total")))
