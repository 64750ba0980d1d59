"""Quality rules: a document's distributions against those of its language."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import SPACES, stored, words

#: Frequent function words of some languages; each is a bin of the word histogram of that language.
COMMON = {
    "en": ["the", "of", "and", "to", "in", "a", "is", "that", "it", "for", "on", "was", "be", "with", "as", "by"],
    "de": ["der", "die", "und", "den", "von", "zu", "das", "mit", "des", "auf", "für", "ist", "im", "ein", "eine", "nicht"],
    "fr": ["de", "la", "le", "et", "les", "des", "en", "un", "du", "une", "est", "pour", "que", "dans", "qui", "par"],
    "es": ["de", "la", "que", "el", "en", "y", "a", "los", "del", "se", "las", "por", "un", "con", "una", "para"],
}
#: Of any other language: the first of each in turn, none twice, as many as a language has.
OTHER = list(dict.fromkeys(w for four in zip(*COMMON.values(), strict=True) for w in four))[: len(COMMON["en"])]

MIN_WORDS = 50
FEW = 64
#: The guards: with fewer characters or words a histogram says too little to be held against a document.
MIN_CHARS_FOR_CLASSES, MIN_WORDS_FOR_COMMON = 200, 100
#: The largest Jensen-Shannon distances (base 2, 0 to 1) of a kept document.
MAX_CLASSES, MAX_COMMON = 0.3, 0.26


def _repeated() -> Column:
    """How many words stand in windows found twice or more, from the columns of features(); null where none is."""
    pairs = F.col("sorted")
    by_sort = F.transform(pairs, lambda x, j: F.when((x["t"] == F.get(pairs, j - 1)["t"]) | (x["t"] == F.get(pairs, j + 1)["t"]), x["i"]))
    by_look = F.transform("tri", lambda x, i: F.when(F.array_contains("twice", x), i))
    places = F.when(F.size("twice") > FEW, F.sort_array(F.filter(by_sort, lambda i: i.isNotNull()))).otherwise(F.filter(by_look, lambda i: i.isNotNull()))
    start = F.struct(F.lit(-3).alias("last"), F.lit(0).cast("long").alias("n"))
    return F.aggregate(places, start, lambda a, i: F.struct(i.alias("last"), (a["n"] + F.least(F.lit(3), i - a["last"])).alias("n")), lambda a: a["n"])


def features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", carry: tuple[str, ...] = ()) -> DataFrame:
    """The counts of every whole text: base rules, character classes, common words (last: all others). One pass, no shuffle.

    Windows of three words are compared by their 64-bit hash within one document.
    """
    t = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(lang_col).cast("string"), F.lit("")).alias("lang"), F.coalesce(F.col(text_col), F.lit("")).alias("t"), F.struct(F.lit(0), *carry).alias("carry"))
    t = t.withColumn("w", words(F.col("t")))
    n = F.size("w")
    t = t.withColumn("n_words", n.cast("long")).withColumn("bare", F.array_join("w", ""))
    lines = F.filter(F.split("t", "\n"), lambda x: F.length(F.regexp_replace(x, SPACES, "")) > 0)
    t = t.withColumn("lines", lines)
    w = F.col("w")
    windows = F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))
    t = t.withColumn("tri", F.when(n >= 3, windows).otherwise(F.array().cast("array<bigint>")))
    t = t.withColumn("ordered", F.when(F.size(F.array_distinct("tri")) < F.size("tri"), F.sort_array("tri")))
    after = F.col("ordered")
    t = t.withColumn("twice", F.array_distinct(F.filter("ordered", lambda x, j: x == F.get(after, j + 1))))
    # Many different windows that repeat: windows and places are sorted together. Few: each window is looked up.
    t = t.withColumn("sorted", F.when(F.size("twice") > FEW, F.sort_array(F.transform("tri", lambda x, i: F.struct(x.alias("t"), i.alias("i"))))))
    # What is left after each class of characters is taken out in turn.
    t = t.withColumn("c1", F.regexp_replace("bare", r"\p{Ll}+", ""))
    t = t.withColumn("c2", F.regexp_replace("c1", r"\p{Lu}+", ""))
    t = t.withColumn("c3", F.regexp_replace("c2", r"\p{N}+", ""))
    t = t.withColumn("c4", F.regexp_replace("c3", r"""[.,;:?'"()-]+""", ""))
    t = t.withColumn("c5", F.regexp_replace("c4", r"[#*$%&|<>]+", ""))
    sizes = [F.length(c).cast("long") for c in ("bare", "c1", "c2", "c3", "c4", "c5")]
    classes = F.array(*[a - b for a, b in zip(sizes, sizes[1:], strict=False)], sizes[-1])
    lists = F.coalesce(F.element_at(F.create_map(*[x for k, v in COMMON.items() for x in (F.lit(k), F.array(*map(F.lit, v)))]), F.col("lang")), F.array(*map(F.lit, OTHER)))
    every = sorted({w for v in COMMON.values() for w in v} | set(OTHER))
    of_any = F.filter("w", lambda x: x.isin(every))
    # Without a language: that of the list which has most of the text's words; none if no list has any.
    of = lambda v: F.size(F.filter("any", lambda x: x.isin(v)))
    hits = [F.struct(of(v).alias("n"), F.lit(k).alias("k")) for k, v in COMMON.items()]
    t = t.withColumn("given", F.col("lang") != "").withColumn("any", F.when(~F.col("given"), of_any))
    t = t.withColumn("best", F.when(~F.col("given"), F.array_max(F.array(*hits))))
    t = t.withColumn("lang", F.when(F.col("best.n") > 0, F.col("best.k")).otherwise(F.col("lang")))
    t = t.withColumn("list", lists)
    t = t.withColumn("found", F.filter(of_any, lambda x: F.array_contains("list", x)))
    common = F.transform("list", lambda k: F.size(F.filter("found", lambda x: x == k)).cast("long"))
    # `found` is read twice on purpose: Spark then computes it once, not once for each word of the list.
    common = F.concat(common, F.array((n - F.size("found")).cast("long")))
    return t.select(
        "id", "lang", "given", "n_words", sizes[0].alias("word_chars"), (sizes[4] - sizes[5]).alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.coalesce(F.when(F.size("twice") > 0, _repeated()), F.lit(0)).cast("long").alias("n_repeat_words"),
        classes.alias("classes"), common.alias("common"), "carry",
    )


def _shares(counts: Column, total: Column) -> Column:
    return F.transform(counts, lambda x: F.when(total > 0, x / total).otherwise(F.lit(0.0)))


def _distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance, base 2."""
    part = lambda a, m: F.when(a > 0, a * F.log2(a / m)).otherwise(F.lit(0.0))
    terms = F.zip_with(p, q, lambda a, b: part(a, (a + b) / 2) + part(b, (a + b) / 2))
    return F.sqrt(F.greatest(F.lit(0.0), F.aggregate(terms, F.lit(0.0), lambda s, x: s + x) / 2))


def references(counted: DataFrame) -> DataFrame:
    """Of each language, the mean shares over its documents that pass the base rules and the guards: a row each.

    Documents whose language is a guess count only where no other document has that language. Those without any: no row.
    """
    sound = counted.filter((F.col("lang") != "") & ~F.col("base_failed") & (F.col("word_chars") >= MIN_CHARS_FOR_CLASSES) & (F.col("n_words") >= MIN_WORDS_FOR_COMMON))
    n_common = len(COMMON["en"]) + 1
    share = lambda c, i: F.coalesce(F.avg(F.when(F.col("given"), F.get(c, F.lit(i)))), F.avg(F.get(c, F.lit(i))))
    means = [share("p_classes", i).alias(f"c{i}") for i in range(6)] + [share("p_common", i).alias(f"w{i}") for i in range(n_common)]
    r = sound.groupBy("lang").agg(*means)
    return r.select("lang", F.array(*[f"c{i}" for i in range(6)]).alias("q_classes"), F.array(*[f"w{i}" for i in range(n_common)]).alias("q_common"))


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", carry: tuple[str, ...] = ()) -> DataFrame:
    """Base counts, the two distances to the language's reference, and the verdict of every document.

    A row per input row (repeated ids: a row each). Null or empty text: no words, so base_failed. Null or
    empty language: that of COMMON with most of the text's words; no reference if the text has none of them. A document
    that the guards exempt, or whose language has no reference, has null distances
    and is kept if the base rules keep it. Distances equal to a threshold keep. `carry`: further columns to return; no others
    are read.
    The references are one row a language, joined by language; texts are never shuffled.
    """
    f = features(docs, id_col, text_col, lang_col, carry)
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    f = stored(
        f.withColumn("base_failed", failed)
        .withColumn("p_classes", _shares(F.col("classes"), F.col("word_chars")))
        .withColumn("p_common", _shares(F.col("common"), F.col("n_words")))
        .drop("classes", "common")
    )
    j = f.join(references(f), "lang", "left")
    j = j.withColumn("class_distance", F.when(F.col("word_chars") >= MIN_CHARS_FOR_CLASSES, _distance(F.col("p_classes"), F.col("q_classes"))))
    j = j.withColumn("common_distance", F.when(F.col("n_words") >= MIN_WORDS_FOR_COMMON, _distance(F.col("p_common"), F.col("q_common"))))
    sound = (F.coalesce("class_distance", F.lit(0.0)) <= MAX_CLASSES) & (F.coalesce("common_distance", F.lit(0.0)) <= MAX_COMMON)
    return j.select(
        F.col("id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & sound).alias("kept"), "class_distance", "common_distance", *[F.col("carry")[c].alias(c) for c in carry],
    )
