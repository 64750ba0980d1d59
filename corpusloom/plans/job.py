"""A packaging job from settings to exported tables, and the stored profiles that fill the settings."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field, fields, replace
from datetime import datetime
from functools import reduce
from pathlib import Path, PurePosixPath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.functions.tokens import count_tokens, label
from corpusloom.operators import bundling, chunking, index, pages, retrieval, rules
from corpusloom.plans import export
from corpusloom.sources import files, records
from corpusloom.sources.connect import registered

#: Token budgets by target and mode: fixed values.
MODES = ("lean", "balanced", "full", "visual_manual")
BUDGETS = {
    "chatgpt": (60_000, 90_000, 120_000, 90_000),
    "claude": (80_000, 120_000, 160_000, 120_000),
    "generic": (40_000, 60_000, 90_000, 60_000),
    "rag": (25_000, 40_000, 50_000, 40_000),
    "cowork": (1_500, 2_500, 4_000, 2_500),
}
CHUNKED = ("rag", "cowork")
DESTINATIONS = ("claude_project", "chatgpt_project", "chatgpt_enterprise", "self_hosted_rag")
SCHEMA = 1


def budget(target: str, mode: str) -> int:
    if target not in BUDGETS or mode not in MODES:
        raise ValueError(f"no token budget for target {target!r} and mode {mode!r}")
    return BUDGETS[target][MODES.index(mode)]


def embedder(spec: str) -> int:
    """The dimensions of the hashing embedder that `hashing` or `hashing:N` names; other kinds need a network and are errors."""
    kind, _, model = (spec.strip() or "hashing").partition(":")
    if kind.lower() == "hashing":
        return int(model) if model.isdigit() and int(model) else 256
    raise ValueError(f"unknown embedder {kind!r}: only 'hashing' or 'hashing:<dimensions>' is built")


@dataclass(frozen=True)
class Profile:
    """All settings of a job. Lists are tuples; a missing budget is the target's and mode's own."""

    profile_name: str
    project_name: str = ""
    default_source_folder: str = ""
    default_output_folder: str = "exports"
    target: str = "chatgpt"
    mode: str = "balanced"
    max_bundle_tokens: int | None = None
    include_extensions: tuple[str, ...] = tuple(T.FILE_TYPES)
    exclude_dirs: tuple[str, ...] = ()
    exclude_files: tuple[str, ...] = ()
    chunk_exclude_headings: tuple[str, ...] = ()
    chunk_token_budget: int | None = None
    chunk_strategy: str = "tokens"
    chunk_heading_level: int = 2
    chunk_min_tokens: int = 0
    chunk_overlap_tokens: int = 0
    chunk_split_sentences: bool = False
    chunk_fence_aware: bool = False
    chunk_heading_path_mode: str = "off"
    bundling_mode: str = "greedy"
    destination: str = ""
    embedding_model: str = ""
    classify_documents: bool = False
    included_files: tuple[str, ...] = ()
    #: A .tiktoken file, to count tokens exactly in place of estimating them.
    token_vocabulary: str = ""

    def validate(self) -> Profile:
        checks = [
            (bool(self.profile_name.strip()), "profile_name must not be empty"),
            (self.target in BUDGETS, f"unknown target {self.target!r}"),
            (self.mode in MODES, f"unknown mode {self.mode!r}"),
            (self.max_bundle_tokens is None or self.max_bundle_tokens > 0, "max_bundle_tokens must be positive"),
            (self.chunk_token_budget is None or self.chunk_token_budget > 0, "chunk_token_budget must be positive"),
            (self.chunk_strategy in ("tokens", "headings"), f"unknown chunk_strategy {self.chunk_strategy!r}"),
            (1 <= self.chunk_heading_level <= 6, "chunk_heading_level must be 1 to 6"),
            (self.chunk_min_tokens >= 0, "chunk_min_tokens must not be negative"),
            (self.chunk_overlap_tokens >= 0, "chunk_overlap_tokens must not be negative"),
            (self.chunk_heading_path_mode in ("off", "metadata", "prefix", "both"), f"unknown chunk_heading_path_mode {self.chunk_heading_path_mode!r}"),
            (self.bundling_mode in ("greedy", "medium"), f"unknown bundling_mode {self.bundling_mode!r}"),
            (self.destination in ("", *DESTINATIONS), f"unknown destination {self.destination!r}"),
        ]
        for good, said in checks:
            if not good:
                raise ValueError(said)
        if self.embedding_model:
            embedder(self.embedding_model)
        return self

    def validate_source(self, records_path: str | None = None) -> Profile:
        """That there is something to read: the file of case records, if one is named, else the folder; and that the job has a name."""
        if records_path is not None:
            if not records_path or not Path(records_path).is_file():
                raise ValueError(f"case records do not exist or are not a file: {records_path or '(none)'}")
        elif not files.is_folder(self.default_source_folder):
            raise ValueError(f"source folder does not exist or is not a folder: {self.default_source_folder or '(none)'}")
        if self.token_vocabulary and not Path(self.token_vocabulary).is_file():
            raise ValueError(f"token vocabulary is not a file: {self.token_vocabulary}")
        return self

    @property
    def budget(self) -> int:
        own = self.chunk_token_budget if self.target in CHUNKED else self.max_bundle_tokens
        return own or self.max_bundle_tokens or budget(self.target, self.mode)

    @property
    def settings(self) -> chunking.Settings:
        return chunking.Settings(self.budget, self.chunk_strategy, self.chunk_heading_level, self.chunk_min_tokens, self.chunk_split_sentences, self.chunk_fence_aware)

    def warnings(self) -> list[str]:
        out = []
        if self.chunk_min_tokens >= self.budget:
            out.append("chunk_min_tokens is not below the budget")
        if self.chunk_overlap_tokens >= self.budget:
            out.append("chunk_overlap_tokens is not below the budget")
        return out

    def to_json(self) -> str:
        return json.dumps({"_schema_version": SCHEMA} | asdict(self), indent=2)

    @classmethod
    def from_json(cls, text: str) -> Profile:
        """Unknown keys are left out."""
        known = {f.name for f in fields(cls)}
        found = {k: tuple(v) if isinstance(v, list) else v for k, v in json.loads(text).items() if k in known}
        return cls(**found)


def _templates() -> dict[str, Profile]:
    """A template for each target as it is, and some for common ends."""
    plain = [Profile(f"{target} bundles", target=target) for target in BUDGETS if target not in CHUNKED]
    ends = [
        Profile("short chunks", target="rag", chunk_token_budget=400, chunk_strategy="headings", chunk_min_tokens=40, chunk_heading_path_mode="metadata"),
        Profile("sentence chunks", target="rag", chunk_token_budget=256, chunk_split_sentences=True, chunk_fence_aware=True),
        Profile("local search", target="cowork", chunk_strategy="headings", chunk_min_tokens=50, chunk_heading_path_mode="both", embedding_model="hashing"),
        Profile("large files split at headings", target="claude", mode="full", bundling_mode="medium"),
        Profile("by authority", target="claude", classify_documents=True),
    ]
    return {p.profile_name: p for p in (*plain, *ends)}


TEMPLATES = _templates()


def save(profile: Profile, folder: str) -> Path:
    path = Path(folder) / f"{''.join(c if c.isalnum() or c in '-_.' else '_' for c in profile.validate().profile_name)}.json"
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(profile.to_json(), encoding="utf-8")
    return path


def delete(name: str, folder: str) -> bool:
    """Removes the saved profiles of this name; whether there were any."""
    gone = [path for path in Path(folder).glob("*.json") if name in saved_in(path)]
    for path in gone:
        path.unlink()
    return bool(gone)


def saved_in(path: Path) -> dict[str, Profile]:
    """The profile of a file by its name; none if the file is broken."""
    try:
        p = Profile.from_json(path.read_text(encoding="utf-8")).validate()
    except (ValueError, TypeError):
        return {}
    return {p.profile_name: p}


def saved(folder: str) -> dict[str, Profile]:
    """The profiles of a folder by name, in order without regard to case; broken files are left out."""
    found = {name: p for path in Path(folder).glob("*.json") for name, p in saved_in(path).items()}
    return dict(sorted(found.items(), key=lambda kv: kv[0].lower()))


@dataclass
class Result:
    """The tables of a job, lazily; write() puts them out."""

    manifest: DataFrame
    bundles: DataFrame | None = None
    records: DataFrame | None = None
    tables: dict[str, DataFrame] = field(default_factory=dict)
    warnings: list[str] = field(default_factory=list)
    budget: int = 0
    guide: str = ""
    assets: DataFrame | None = None
    source: str = ""
    #: All that is to be told about documents (text); `warnings` has the first of it.
    notices: DataFrame | None = None
    profile: Profile | None = None
    index: index.Index | None = None

    def write(self, path: str) -> None:
        """Tables as folders, and for people: the manifest (CSV, JSON, Markdown), the overview, the instructions and the warnings as one
        file each, and a file for each bundle."""
        registered(self.manifest.sparkSession)
        p = self.profile or Profile("export")
        project = p.project_name or p.profile_name
        export.write_manifest(self.manifest, path, project, p.target, p.mode, label(p.token_vocabulary))
        if self.guide:
            lines = self.manifest.sparkSession.createDataFrame([(self.guide,)], "value string")
            lines.write.format("corpus_file").mode("overwrite").save(f"{path}/00_INSTRUCTIONS.md")
        if self.notices is not None:
            self.notices.orderBy("text").select(F.col("text").alias("value")).write.format("corpus_file").option("tail", "\n").mode("overwrite").save(f"{path}/warnings.txt")
        if self.index is not None:
            index.write(self.index, f"{path}/index")
        self.manifest.write.mode("overwrite").option("header", True).csv(f"{path}/manifest_csv")
        if self.guide:
            lines.write.mode("overwrite").text(f"{path}/instructions")
        self.manifest.write.mode("overwrite").json(f"{path}/manifest_json")
        if self.bundles is not None:
            export.write_bundles(self.bundles, f"{path}/bundles", self.budget, project, label(p.token_vocabulary))
            packed = self.bundles.select("doc_id", "bundle", *(["category"] if p.classify_documents else [])).join(export.bundle_names(self.bundles), "bundle").drop("bundle")
            export.write_overview(self.manifest, packed, path, project)
        if self.records is not None:
            export.json_lines(self.records).write.mode("overwrite").text(f"{path}/chunks_jsonl")
            export.source_map(self.records).write.mode("overwrite").json(f"{path}/source_map")
        if self.assets is not None:
            files.copy_assets(self.assets, self.source, f"{path}/{files.ASSETS}").write.mode("overwrite").json(f"{path}/asset_list")
        for name, df in self.tables.items():
            df.write.mode("overwrite").parquet(f"{path}/{name}")


#: How many of the notices about documents are among a job's warnings; all are in its notices.
NAMED = 100


def documents(spark: SparkSession, folder: str, p: Profile, said: list[str] | None = None) -> DataFrame:
    """The folder's files, converted, in the order of their paths: place, source_file, source_path, extension, file_type,
    body, status, notes, category, assets. The output folder, if it lies in the source, is passed over. Files that are asked for but not there, and
    patterns that match nothing, are told in `said`."""
    said = [] if said is None else said
    own = PurePosixPath(p.default_output_folder)
    inside = own.parent == PurePosixPath(folder) or PurePosixPath(folder) in own.parents
    extensions = [*p.include_extensions, *{PurePosixPath(f).suffix.lower() for f in p.included_files}]
    found = files.scan(spark, folder, extensions, files.EXCLUDED + p.exclude_dirs + ((own.relative_to(folder).parts[0],) if inside else ()))
    if p.included_files:
        wanted = spark.createDataFrame([(f,) for f in p.included_files], "path string")
        lost = rules.missing_paths(found, wanted, "rel_path").orderBy("path").collect()  # some of those that the settings name
        said += [f"included file was not found: {r['path']}" for r in lost]
        found = rules.include_paths(found, wanted, "rel_path")
    globs = [g.strip() for g in p.exclude_files if g.strip()]
    if globs:
        said += [f"exclusion pattern matched no files: {r['pattern']!r}" for r in rules.glob_hits(found, globs, "rel_path").filter("hits = 0").collect()]
    read = files.read_files(rules.exclude_paths(found, globs, "rel_path"), folder)
    rows = export.places(read.withColumn("__o", F.lower("rel_path")), ["__o", "rel_path"])
    rows = rows.select(
        "place", F.regexp_extract("rel_path", r"([^/]*)\z", 1).alias("source_file"), F.col("rel_path").alias("source_path"), F.col("ext").alias("extension"), "file_type",
        T.normalize_newlines(F.coalesce("markdown", F.lit(""))).alias("body"), "status", F.coalesce("notes", F.lit("")).alias("notes"), T.category(F.col("rel_path")).alias("category"), "assets",
    )
    policy = (F.col("file_type") == "pdf") & (F.col("category") == "policy")
    return rows.withColumn("body", F.when(policy, T.let(F.col("body"), pages.restructured)).otherwise(F.col("body")))


def records_of(tables: dict[str, DataFrame], limit: int | None = None) -> DataFrame:
    """The documents of a case database, as run() takes them: numbered in the order of final_id."""
    return export.places(records.documents(tables, limit), ["final_id"])


def preview(spark: SparkSession, folder: str, path: str, p: Profile) -> DataFrame:
    """The chunks that the settings would make of one file of the folder: idx, text on one line, tokens and reason; nothing is written."""
    docs = documents(spark, folder, replace(p, included_files=(path,)))
    cut = chunking.chunk_documents(docs.filter("status = 'ok'").select(F.lit("DOC_0000").alias("doc_id"), F.col("body").alias("text")), p.settings)
    return cut.select("idx", T.preview(F.col("text")).alias("preview"), "token_estimate", "reason")


def run(docs: DataFrame, p: Profile, said: list[str] | None = None, overrides: DataFrame | None = None, selected: DataFrame | None = None, selections: DataFrame | None = None) -> Result:
    """The job over documents (as documents() or records_of() gives them). `said`: warnings so far. `overrides` (path, category)
    decide on categories. `selected` (doc_id, idx): the chunks to keep of the documents that it names; `selections` (path, chunks): the
    same by path, where an empty array means none.

    Documents and chunks are worked out once, stored, and counted as they are written."""
    p.validate()
    said = [*(said or []), *p.warnings()]
    assets = docs.select(F.explode("assets").alias("path")) if "assets" in docs.columns else None
    docs = docs.drop("assets")
    if overrides is not None:
        docs = rules.categories(docs.drop("category"), overrides, "source_path")
    docs = bundling.stored(docs)
    manifest, notices = export.manifest(docs, p.token_vocabulary), []
    good = docs.filter("status = 'ok'").withColumn("doc_id", T.document_id(F.col("place")))
    if p.chunk_exclude_headings or selected is not None or selections is not None:
        cut = bundling.stored(chunking.chunk_documents(good.select("doc_id", F.col("body").alias("text")), p.settings))
        rest, rebuilt = cut, None
        if selected is not None:  # a document with a selection goes by that alone
            named = selected.select("doc_id").distinct()
            rest, rebuilt = cut.join(named, "doc_id", "left_anti"), rules.apply_selection(cut.join(named, "doc_id", "left_semi"), selected)
        if selections is not None:
            by_path, told = rules.select_by_path(rest, good, selections)
            by_path = bundling.stored(by_path)
            notices.append(told)
            rest = rest.join(by_path.select("doc_id"), "doc_id", "left_anti")
            rebuilt = by_path.drop("warning") if rebuilt is None else rebuilt.unionByName(by_path.drop("warning"))
        ruled = rules.apply_heading_rules(rest, list(p.chunk_exclude_headings))
        rebuilt = ruled if rebuilt is None else ruled.unionByName(rebuilt)
        said += [f"heading exclusion rule matched no chunks: {g!r}" for g in rules.unmatched_rules(rest, list(p.chunk_exclude_headings))]
        rebuilt = bundling.stored(rebuilt.select("doc_id", F.col("body").alias("__b"), F.col("status").alias("__s"), F.col("note").alias("__n"), F.when(F.col("status") != "ok", 0).alias("__t")))
        manifest = manifest.join(rebuilt.drop("__b"), "doc_id", "left").withColumn("status", F.coalesce("__s", "status")).withColumn("token_estimate", F.coalesce("__t", "token_estimate"))
        manifest = manifest.withColumn("notes", T.joined_notes("notes", "__n")).drop("__s", "__n", "__t")
        good = good.join(rebuilt.select("doc_id", "__b", "__s"), "doc_id", "left").filter("__s is null or __s = 'ok'")  # no chunks: as it is
        good = good.withColumn("body", F.coalesce("__b", "body")).drop("__b", "__s")
    done = replace(_exported(good, manifest, p, said, notices), assets=assets, source=p.default_source_folder, profile=p)
    if notices:
        every = reduce(DataFrame.unionByName, notices)
        first = [r["text"] for r in every.orderBy("text").limit(NAMED + 1).collect()]
        more = [f"more than {NAMED} notices about documents: all are in warnings.txt"] if len(first) > NAMED else []
        done = replace(done, notices=every, warnings=[*said, *first[:NAMED], *more])
    return done


def _exported(good: DataFrame, manifest: DataFrame, p: Profile, said: list[str], notices: list[DataFrame]) -> Result:
    if p.target in CHUNKED:
        made = export.chunk_records(good, p.settings, p.chunk_overlap_tokens, p.chunk_heading_path_mode, p.token_vocabulary)
        chunks, figures = bundling.counted(made, chunks=F.count("*"), tokens=F.sum("token_estimate"))
        tables, found = {}, None
        if p.target == "cowork":
            found = index.build(chunks, "chunk_id", "text", "source_file")
            tables = {"vectors": retrieval.dense_embedding(chunks, "chunk_id", "text", embedder(p.embedding_model))}
        guide = export.instructions(p.target, p.project_name, good.count(), figures["chunks"], p.destination, p.mode, p.budget, figures["tokens"], label(p.token_vocabulary))
        return Result(manifest, records=chunks, tables=tables, warnings=said, guide=guide, index=found)
    header = T.identity_header(F.col("doc_id"), F.col("source_file"), F.col("source_path"), F.col("extension"))
    sized = good.withColumn("token_estimate", count_tokens(F.concat(header, F.lit("\n"), F.col("body")), p.token_vocabulary)).withColumn("part", F.lit(0))
    order = ["place", "part"]
    if p.bundling_mode == "medium":
        sized = bundling.split_at_headings(sized.drop("part"), p.budget, p.chunk_heading_level)
    sized, figures = bundling.counted(sized, tokens=F.sum("token_estimate"), whole=F.count_if(F.col("part") <= 1))
    if p.bundling_mode == "medium":
        whole = sized.filter((F.col("part") == 0) & (F.col("token_estimate") > p.budget))
        notices.append(whole.select(F.concat("doc_id", F.lit(" ("), "source_file", F.lit(") is over the budget and has no headings to split at; kept whole")).alias("text")))
    packed = bundling.stored(bundling.tiered(sized, p.budget, order) if p.classify_documents else bundling.greedy(sized, p.budget, order))
    bundles = packed.withColumn("markdown", export.rendered(T.identity_header(F.col("doc_id"), F.col("source_file"), F.col("source_path"), F.col("extension")), F.col("body")))
    where = packed.groupBy("place").agg(F.min("bundle").alias("bundle")).select(T.document_id(F.col("place")).alias("doc_id"), "bundle")
    if p.bundling_mode == "medium":  # the parts of a split document stand in its place
        parts = sized.filter("part > 0")
        texts = parts.select(
            "doc_id", "source_file", "source_path", F.col("extension").alias("original_extension"), "file_type", F.lit("ok").alias("status"), "token_estimate", F.length("body").alias("char_count"), T.word_count(F.col("body")).alias("word_count"), "notes"
        )
        split = parts.select(T.document_id(F.col("place")).alias("doc_id")).distinct()
        manifest = manifest.join(split, "doc_id", "left_anti").unionByName(texts)
        where = packed.select("doc_id", "bundle")
    where = where.join(export.bundle_names(packed), "bundle", "left")
    guide = export.instructions(p.target, p.project_name, figures["whole"], packed.agg(F.max("bundle")).first()[0] or 0, p.destination, p.mode, p.budget, figures["tokens"], label(p.token_vocabulary))
    return Result(manifest.join(where, "doc_id", "left"), bundles=bundles, warnings=said, budget=p.budget, guide=guide)


def folder_name(p: Profile, at: datetime) -> str:
    """The name of an export's folder: project, target, mode and time."""
    name = "_".join(x for x in (p.project_name or "export", p.target, p.mode, at.strftime("%Y%m%d_%H%M%S")) if x)
    return "".join(c if c.isalnum() or c in "-_." else "_" for c in name)


def with_overrides(p: Profile, **given) -> Profile:
    return replace(p, **{k: v for k, v in given.items() if v is not None})
