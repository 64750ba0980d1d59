"""Chunks of Markdown documents within a token budget, without a shuffle: a document's row becomes an array of chunks.

Each step is an expression over arrays of the row: regular expressions cut a text at fences, headings or blank lines, and a
fold over the costs of the pieces finds where chunks start. The fold carries places, never text.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.text import HS, WS, estimate_tokens, exploded, let, strip

#: Why a chunk ends or begins where it does: fixed values.
WHOLE = "entire document fits in one chunk"
BUDGET = "token budget reached; split before the next paragraph"
BEFORE_OVERSIZE = "flushed before a paragraph larger than the budget"
OVERSIZE = "oversize paragraph split at line boundaries"
END = "end of document"
SECTION = "section starts at a heading"
PREAMBLE = "content before the first heading"
MERGED = "undersized chunk merged into its neighbor"
SENTENCE = "oversize line split at sentence boundaries"
FENCE = "oversize fenced code block kept whole"

_MARK, _JOINT = "\x01", "\x03"
_CHUNKS = "array<struct<text:string,reason:string>>"


def _by_fence(text: Column, outside=None, inside=None) -> Column:
    """The text with functions applied to what stands outside and inside of fences. Cut before each line that starts with
    three backticks: pieces at even places are outside (but for a closing line at their start)."""
    keep = lambda p: p
    pieces = F.split(F.concat(F.lit("\n"), text), rf"(?md)(?=^{HS}*```)")
    done = F.transform(pieces, lambda p, i: F.when(i % 2 == 0, (outside or keep)(p)).otherwise((inside or keep)(p)))
    return F.substring(F.array_join(done, ""), F.lit(2), F.lit(1 << 30))


def _pieces(marked: Column) -> Column:
    return F.filter(F.transform(F.split(marked, _MARK), strip), lambda x: x != "")


def _heading(level: int) -> str:
    return rf"(?md)^{HS}*#{{1,{level}}}(?!#){HS}+(?!{WS})"


def paragraphs(text: Column, fence_aware: bool = False) -> Column:
    """Blocks between empty lines; if fence_aware, between blank lines outside of fences."""
    if fence_aware:
        return _pieces(_by_fence(text, lambda p: F.regexp_replace(p, rf"(?md)^{HS}*\n", _MARK)))
    return F.filter(F.transform(F.split(text, "\n\n"), strip), lambda x: x != "")


def sections(text: Column, level: int) -> Column:
    """Parts that begin at headings of the level or above, outside of fences; what comes before is a part too."""
    return _pieces(_by_fence(text, lambda p: F.regexp_replace(p, f"({_heading(level)})", f"{_MARK}$1")))


def _lines(paragraph: Column, fence_aware: bool) -> Column:
    if not fence_aware:
        return F.split(paragraph, "\n")
    joined = _by_fence(paragraph, inside=lambda p: F.replace(p, F.lit("\n"), F.lit(_JOINT)))
    return F.transform(F.split(joined, "\n"), lambda x: F.replace(x, F.lit(_JOINT), F.lit("\n")))


def _unit(kind: str | Column, par: Column, line: Column, text: Column) -> Column:
    """A unit of packing: kind p(aragraph), l(ine), f(ence) or s(entence); units of one (par, line) may share a chunk."""
    kind = F.lit(kind) if isinstance(kind, str) else kind
    return F.struct(kind.alias("kind"), par.cast("int").alias("par"), line.cast("int").alias("line"), text.alias("text"))


def _units(paras: Column, budget: int, sentences: bool, fence_aware: bool) -> Column:
    none = F.lit(-1)

    def of_line(line: Column, par: Column, at: Column) -> Column:
        plain = F.array(_unit("l", par, none, line))
        fence = line.contains("\n") | F.ltrim(line).startswith("```")
        large = estimate_tokens(line) > budget
        out = F.when(~large, plain)
        if fence_aware:
            out = out.when(fence, F.array(_unit("f", par, at, line)))
        if sentences:
            split = F.filter(F.transform(F.split(line, rf"(?<=[.!?]){WS}+"), strip), lambda x: x != "")
            parts = F.flatten(F.transform(split, lambda s: F.when(estimate_tokens(s) > budget, F.array_remove(F.split(s, WS + "+"), "")).otherwise(F.array(s))))
            out = out.otherwise(F.transform(parts, lambda s: _unit("s", par, at, s)))
        else:
            out = out.otherwise(plain)
        return out

    def of_paragraph(p: Column, i: Column) -> Column:
        lines = F.flatten(F.transform(_lines(p, fence_aware), lambda line, j: of_line(line, i, j)))
        return F.when(estimate_tokens(p) <= budget, F.array(_unit("p", none, none, p))).otherwise(lines)

    return F.flatten(F.transform(paras, of_paragraph))


#: How many elements a fold gathers before they are set aside: an append copies no more, however long the result.
RUN = 256


def _gathered(kind: str) -> list[Column]:
    """What a fold gathers elements in: the open run and the full ones."""
    return [F.array().cast(f"array<{kind}>").alias("run"), F.array().cast(f"array<array<{kind}>>").alias("full")]


def _with(a: Column, x: Column) -> list[Column]:
    room = F.size(a["run"]) < RUN
    return [F.when(room, F.concat(a["run"], F.array(x))).otherwise(F.array(x)).alias("run"), F.when(room, a["full"]).otherwise(F.concat(a["full"], F.array(a["run"]))).alias("full")]


def _all(a: Column) -> Column:
    return F.flatten(F.concat(a["full"], F.array(a["run"])))


def _starts(units: Column, budget: int) -> Column:
    """The places of the units that begin a chunk: those that may not join the one before or no longer fit."""
    state = F.struct(F.lit(0).alias("i"), F.lit(0).cast("long").alias("sum"), F.lit(-2).alias("par"), F.lit(-2).alias("line"), *_gathered("int"))

    def step(a: Column, u: Column) -> Column:
        sentence = u["kind"] == "s"
        cost = F.when(sentence, F.length(u["text"])).otherwise(estimate_tokens(u["text"])).cast("long")

        def of_cost(c: Column) -> Column:
            joined = F.when(sentence, a["sum"] + 1 + c).otherwise(a["sum"] + c)
            fits = (a["i"] > 0) & (a["par"] == u["par"]) & (a["line"] == u["line"]) & (F.when(sentence, F.shiftright(joined + 3, 2)).otherwise(joined) <= budget)
            on = lambda same, *new: F.when(fits, F.struct((a["i"] + 1).alias("i"), joined.alias("sum"), *same)).otherwise(F.struct((a["i"] + 1).alias("i"), c.alias("sum"), *new))
            group = [u["par"].alias("par"), u["line"].alias("line")]
            return on([*group, a["run"].alias("run"), a["full"].alias("full")], *group, *_with(a, a["i"]))

        return let(cost, of_cost)

    return F.aggregate(units, state, step, _all)


def pack(text: Column, budget: int, sentences: bool = False, fence_aware: bool = False) -> Column:
    """Chunks (text, reason) of paragraphs within the budget; larger paragraphs by lines; then, if asked for, by sentences
    and words. A single unit larger than the budget stays whole."""
    whole = F.array(F.struct(text.alias("text"), F.lit(WHOLE).alias("reason")))
    if budget <= 0:
        return whole

    def chunks(units: Column, at: Column) -> Column:
        kind = lambda k: F.get(units, F.get(at, k))["kind"]

        def chunk(start: Column, k: Column) -> Column:
            end = F.coalesce(F.get(at, k + 1), F.size(units))
            parts = F.transform(F.slice(units, start + 1, end - start), lambda u: u["text"])
            own = kind(k)
            last = F.when(k == 0, WHOLE).otherwise(END)
            after = kind(k + 1)
            reason = F.when(own == "s", SENTENCE).when(own == "f", FENCE).when(own == "l", OVERSIZE).when(after.isNull(), last).when(after == "p", BUDGET).otherwise(BEFORE_OVERSIZE)
            joined = F.when(own == "p", F.array_join(parts, "\n\n")).when(own == "s", F.array_join(parts, " ")).otherwise(F.array_join(parts, "\n"))
            return F.struct(joined.alias("text"), reason.alias("reason"))

        return F.transform(at, chunk)

    done = lambda paras: let(_units(paras, budget, sentences, fence_aware), lambda u: let(_starts(u, budget), lambda at: chunks(u, at)))
    return let(paragraphs(text, fence_aware), lambda paras: F.when(F.size(paras) == 0, whole).otherwise(done(paras)))


def pack_sections(text: Column, budget: int, level: int = 2, sentences: bool = False, fence_aware: bool = False) -> Column:
    """Chunks aligned with headings: a section each, larger ones packed; without any such heading, as pack()."""
    headed = lambda s: F.substring_index(s, "\n", 1).rlike(_heading(level))

    def of_section(s: Column) -> Column:
        one = F.array(F.struct(s.alias("text"), F.when(headed(s), SECTION).otherwise(PREAMBLE).alias("reason")))
        return one if budget <= 0 else F.when(estimate_tokens(s) <= budget, one).otherwise(pack(s, budget, sentences, fence_aware))

    def of_all(parts: Column) -> Column:
        first = F.get(parts, F.lit(0))
        return F.when(F.size(parts) == 0, F.array().cast(_CHUNKS)).when((F.size(parts) == 1) & ~headed(first), pack(first, budget, sentences, fence_aware)).otherwise(F.flatten(F.transform(parts, of_section)))

    return let(sections(text, level), of_all)


def merge_small(chunks: Column, least: int, budget: int) -> Column:
    """Chunks below `least` tokens joined to the one before (or it to them) where both fit the budget (0: always)."""
    if least <= 0:
        return chunks

    # The fold sees lengths alone and finds where chunks start; texts are joined once.
    state = F.struct(F.lit(0).alias("i"), F.lit(0).cast("long").alias("sum"), *_gathered("int"))

    def step(a: Column, c: Column) -> Column:
        n = F.length(c["text"]).cast("long")
        joined = a["sum"] + n + 2
        small = (F.shiftright(n + 3, 2) < least) | (F.shiftright(a["sum"] + 3, 2) < least)
        fits = F.lit(True) if budget <= 0 else F.shiftright(joined + 3, 2) <= budget
        i = (a["i"] + 1).alias("i")
        return F.when((a["i"] > 0) & small & fits, F.struct(i, joined.alias("sum"), a["run"].alias("run"), a["full"].alias("full"))).otherwise(F.struct(i, n.alias("sum"), *_with(a, a["i"])))

    def merged(cs: Column, at: Column) -> Column:
        def one(parts: Column) -> Column:
            text = F.array_join(F.transform(parts, lambda x: x["text"]), "\n\n")
            return F.when(F.size(parts) == 1, F.get(parts, F.lit(0))).otherwise(F.struct(text.alias("text"), F.lit(MERGED).alias("reason")))

        return F.transform(at, lambda start, k: let(F.slice(cs, start + 1, F.coalesce(F.get(at, k + 1), F.size(cs)) - start), one))

    return let(chunks, lambda cs: let(F.aggregate(cs, state, step, _all), lambda at: merged(cs, at)))


def overlap(chunks: Column, tokens: int) -> Column:
    """Each text but the first, after the whole last lines of the one before that hold at least so many tokens."""
    if tokens <= 0:
        return chunks

    def tail(text: Column) -> Column:
        lines = F.split(text, "\n")
        state = F.struct(F.lit(0).alias("n"), F.lit(0).alias("sum"))
        n = F.aggregate(F.reverse(lines), state, lambda a, x: F.when(a["sum"] >= tokens, a).otherwise(F.struct((a["n"] + 1).alias("n"), (a["sum"] + estimate_tokens(x)).alias("sum"))), lambda a: a["n"])
        return let(lines, lambda x: strip(F.array_join(F.slice(x, F.size(x) - n + 1, n), "\n")))

    def joined(all_: Column) -> Column:
        def one(c: Column, i: Column) -> Column:
            text = let(tail(F.get(all_, i - 1)["text"]), lambda t: F.when(t != "", F.concat(t, F.lit("\n\n"), c["text"])).otherwise(c["text"]))
            return F.struct(F.when(i == 0, c["text"]).otherwise(text).alias("text"), c["reason"].alias("reason"))

        return F.transform(all_, one)

    return let(chunks, joined)


def _outside(text: Column) -> Column:
    """The text without its fences and what is in them."""
    return _by_fence(text, lambda p: F.regexp_replace(p, rf"(?md)^{HS}*```[^\n]*\n?", ""), lambda p: F.lit(""))


def headings(text: Column) -> Column:
    """level and title of each heading outside of fences."""
    found = F.regexp_extract_all(_outside(text), F.lit(rf"(?md)(^{HS}*#{{1,6}}(?!#){HS}+(?!{WS})[^\n]*)"), 1)
    title = lambda x: strip(F.regexp_extract(strip(x), rf"(?sd)^#{{1,6}}{WS}+(.+?){WS}*#*{WS}*$", 1))
    return F.transform(found, lambda x: F.struct(F.length(F.regexp_extract(strip(x), "^(#+)", 1)).alias("level"), title(x).alias("title")))


def structure(text: Column) -> Column:
    """What a text holds: heading titles, blocks between empty lines, list items and table rows (outside of fences)."""
    plain = F.regexp_replace(_outside(text), rf"(?md)^{HS}*#{{1,6}}(?!#){HS}+(?!{WS})[^\n]*", "")
    items = rf"(?md)^{HS}*(?:[-*+]|\d+[.)]){HS}+(?!{WS})"
    rows = F.size(F.filter(F.split(plain, "\n"), lambda x: x.rlike(rf"(?d)^{HS}*\|.*\|{HS}*$") & ~x.rlike(items)))
    blocks = F.size(F.filter(F.split(text, "\n\n"), lambda x: strip(x) != ""))
    return F.struct(
        F.transform(headings(text), lambda h: h["title"]).alias("headings"), blocks.alias("paragraph_count"),
        F.regexp_count(plain, F.lit(items)).alias("list_item_count"), rows.alias("table_row_count"),
    )


def described(s: Column) -> Column:
    """A structure in words; what there is none of is left out, but for paragraphs."""
    some = lambda n, what: F.when(n > 0, F.concat(n.cast("string"), F.lit(f" {what}(s)")))
    paragraphs_ = F.concat(s["paragraph_count"].cast("string"), F.lit(" paragraph(s)"))
    return F.concat_ws(", ", some(F.size(s["headings"]), "heading"), paragraphs_, some(s["list_item_count"], "list item"), some(s["table_row_count"], "table row"))


def outline(text: Column) -> Column:
    """level and title of each heading line, those in fences too."""
    found = F.filter(F.split(text, "\n"), lambda x: x.rlike(rf"\A#{{1,6}}{WS}"))
    return F.transform(found, lambda x: F.struct(F.length(F.regexp_extract(x, "^(#+)", 1)).alias("level"), strip(F.regexp_extract(x, rf"\A#{{1,6}}{WS}+(.*)\z", 1)).alias("title")))


def heading_paths(texts: Column) -> Column:
    """For each text, the titles that enclose it: of each level the last before it, unless a higher one came later."""
    empty = F.array_repeat(F.lit(None).cast("string"), 6)

    def push(stack: Column, h: Column) -> Column:
        return F.transform(stack, lambda t, i: F.when(i + 1 < h["level"], t).when(i + 1 == h["level"], h["title"]))

    state = F.struct(empty.alias("stack"), *_gathered("array<string>"))

    def step(a: Column, text: Column) -> Column:
        now = F.aggregate(headings(text), a["stack"], push)
        return F.struct(now.alias("stack"), *_with(a, F.filter(a["stack"], lambda t: t.isNotNull())))

    return F.aggregate(texts, state, step, _all)


@dataclass(frozen=True)
class Settings:
    budget: int
    strategy: str = "tokens"
    level: int = 2
    least: int = 0
    sentences: bool = False
    fence_aware: bool = False


def chunk_array(text: Column, s: Settings) -> Column:
    """The chunks (text, reason) of a document's body; none of a blank one."""
    make = pack_sections(text, s.budget, s.level, s.sentences, s.fence_aware) if s.strategy == "headings" else pack(text, s.budget, s.sentences, s.fence_aware)
    return F.when(F.length(text) > 0, merge_small(make, s.least, s.budget)).otherwise(F.array().cast(_CHUNKS))


def chunk_documents(docs: DataFrame, s: Settings, text_col: str = "text", paths: bool = True, structures: bool = True) -> DataFrame:
    """A row per chunk: the document's other columns, idx (from 1), text, token_estimate, reason, heading_path, structure."""
    others = [c for c in docs.columns if c != text_col]
    cut = docs.withColumn("__body", strip(F.coalesce(F.col(text_col), F.lit("")))).withColumn("__chunks", chunk_array(F.col("__body"), s))
    if paths:
        cut = cut.withColumn("__paths", heading_paths(F.transform("__chunks", lambda c: c["text"])))
    each = F.zip_with("__chunks", "__paths", lambda c, p: F.struct(c["text"].alias("text"), c["reason"].alias("reason"), p.alias("path"))) if paths else F.col("__chunks")
    rows = exploded(cut, each, *others)  # a row has its own path alone
    text = F.col("__c.text")
    out = [*others, (F.col("__i") + 1).alias("idx"), text.alias("text"), estimate_tokens(text).alias("token_estimate"), F.col("__c.reason").alias("reason")]
    if paths:
        out.append(F.col("__c.path").alias("heading_path"))
    if structures:
        out.append(structure(text).alias("structure"))
    return rows.select(*out)
