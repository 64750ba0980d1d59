"""Page-segmented text (as PDF extraction gives it) rebuilt as structured Markdown."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.text import HS, WS, exploded, let, strip, word_count

#: What repeats on this share of the pages (two at least, of four pages or more) is a running header, if it is short.
SHARE, LONGEST, LEAST_PAGES = 0.35, 60, 4
_PAGE = rf"(?mid)^##{HS}+Page{HS}+\d+{HS}*$\n?"
_NUMBER = r"\A\d{1,4}\z"


def pages(text: Column) -> Column:
    """The lines after each page marker; what comes before the first is left out, and so is a last page without lines."""
    lines = lambda p: F.when(p == "", F.array().cast("array<string>")).otherwise(F.split(F.regexp_replace(p, r"\n\z", ""), "\n"))
    after = lambda parts: F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1 - (F.element_at(parts, -1) == "").cast("int"), F.lit(0)))
    return F.transform(let(F.split(text, _PAGE), after), lines)


def _running(p: Column) -> Column:
    lines = lambda p: F.filter(F.array_distinct(F.transform(p, strip)), lambda x: (F.length(x) > 0) & (F.length(x) <= LONGEST) & ~x.rlike(_NUMBER))
    most = F.greatest(F.lit(2), F.floor(F.size(p) * SHARE).cast("int"))
    often = let(F.sort_array(F.flatten(F.transform(p, lines))), lambda all_: F.array_distinct(F.filter(all_, lambda x, i: x == F.get(all_, i + most - 1))))
    return F.when(F.size(p) >= LEAST_PAGES, often).otherwise(F.array().cast("array<string>"))


def running(text: Column) -> Column:
    """The short lines that are on many pages of a text. Within the row: each page's distinct lines are sorted together, so a
    line is on so many pages if it still stands that many places on."""
    return let(pages(text), _running)


def boilerplate(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id and line: short lines that are on many of a document's pages."""
    return exploded(docs, running(F.col(text_col)), F.col(id_col).alias("id"), each="line").select("id", "line")


def _rendered(line: Column) -> Column:
    # What tells a chapter, a lettered heading and a bullet in the text of a page: fixed values.
    chapter = line.rlike(r"\AChapter\s+\d+:\s+[A-Z]") & ~line.contains("....") & ~line.rlike(r"[.;,]\z")
    letter = line.rlike(r"\A[A-Z]\.\s+[A-Z(]") & (F.length(line) <= 80) & ~line.contains("....") & (word_count(line) <= 10) & ~line.rlike(r"[.:;]\z")
    bullet = F.concat(F.lit("- "), strip(F.regexp_replace(line, rf"\A[•▪●]{WS}*", "")))
    sub = F.concat(F.lit("  - "), strip(F.substring(line, F.lit(3), F.length(line))))
    return F.when(line.rlike(r"\A[•▪●]"), bullet).when(line.startswith("o ") & (F.length(line) > 2), sub).when(chapter, F.concat(F.lit("## "), line)).when(letter, F.concat(F.lit("### "), line)).otherwise(line)


def restructured(text: Column) -> Column:
    """The text without running headers and page numbers, headings and bullets marked, wrapped lines joined into paragraphs. A text
    without page markers is unchanged. Pages and running lines are found once for a text, not for each of its lines."""
    alone = lambda x: x.startswith("#") | F.ltrim(x).startswith("- ")

    def shown(x: Column) -> Column:
        kept = F.filter(F.transform(F.flatten(x["pages"]), strip), lambda line: ~F.array_contains(x["running"], line) & ~line.rlike(_NUMBER))
        # Headings and list items stand alone: blank lines on both sides; then blank lines part the blocks.
        spaced = F.transform(kept, lambda line: let(_rendered(line), lambda r: F.when(alone(r), F.concat(F.lit("\n"), r, F.lit("\n"))).otherwise(r)))
        blocks = F.filter(F.transform(F.split(F.array_join(spaced, "\n"), "\n\n+"), lambda b: F.replace(F.regexp_replace(b, r"\A\n+|\n+\z", ""), F.lit("\n"), F.lit(" "))), lambda b: b != "")
        return F.concat(strip(F.array_join(blocks, "\n\n")), F.lit("\n"))

    found = let(pages(text), lambda p: F.struct(p.alias("pages"), _running(p).alias("running")))
    return F.when(text.rlike(_PAGE), let(found, shown)).otherwise(text)


def restructure(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id and text: restructured()."""
    return docs.select(id_col, let(F.col(text_col), restructured).alias(text_col))
