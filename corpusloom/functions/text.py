"""Text functions as Column expressions: everything here stays inside Spark's own operators."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: White space as Python's str methods see it; Java's own class is narrower.
_BLANKS = r"\x1c-\x1f\x85   -     　"
WS = rf"[\s{_BLANKS}]"
#: The same within a line.
HS = rf"[\t\x0b\f\r {_BLANKS}]"


def exploded(df: DataFrame, array: Column, *columns: str | Column, at: str = "__i", each: str = "__c") -> DataFrame:
    """The columns with a row for each element: its place from 0 and the element. No row for an empty or null array.

    The plain explode lets the optimiser infer that the array is not empty and work it out once more below, on whatever
    partitions are there; the outer one does not, and what it adds is filtered out after it."""
    return df.select(*columns, F.posexplode_outer(array).alias(at, each)).filter(F.col(at).isNotNull())


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with the value computed once however often the body reads it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


#: The same characters, one by one.
_EACH = "".join(c for c in map(chr, range(0x3001)) if c.isspace())


def strip(text: Column) -> Column:
    return F.trim(text, F.lit(_EACH))


def clean(value: Column) -> Column:
    """Null as an empty string, all else without white space around it."""
    return F.coalesce(strip(value.cast("string")), F.lit(""))


#: How tokens are counted, as results say it.
ESTIMATOR = "heuristic (chars/4)"


def estimate_tokens(text: Column) -> Column:
    """A token for every four code points or fewer; none for an empty text."""
    return F.shiftright(F.length(text) + 3, 2)


def joined_notes(*notes: str) -> Column:
    """Notes put together; blank ones are left out."""
    filled = F.filter(F.array(*[strip(F.coalesce(F.col(n), F.lit(""))) for n in notes]), lambda n: n != "")
    return F.array_join(filled, "; ")


def word_count(text: Column) -> Column:
    return F.size(F.array_remove(F.split(text, WS + "+"), ""))


def normalize_newlines(text: Column) -> Column:
    """LF line ends, no white space at line ends or around the text, one final LF; empty stays empty."""
    lines = F.regexp_replace(F.regexp_replace(text, r"\r\n?", "\n"), rf"{HS}+(?=\n)", "")
    return F.when(F.length(text) == 0, "").otherwise(F.concat(strip(lines), F.lit("\n")))


def document_id(place: Column) -> Column:
    """DOC_0001 for 1; more digits from 10000 on."""
    return F.concat(F.lit("DOC_"), F.when(place < 10000, F.lpad(place.cast("string"), 4, "0")).otherwise(place.cast("string")))


def identity_header(doc_id: Column, source_file: Column, source_path: Column, extension: Column) -> Column:
    fields = (("DOC_ID", doc_id), ("SOURCE_FILE", source_file), ("SOURCE_PATH", source_path), ("ORIGINAL_EXTENSION", extension))
    return F.concat(F.lit("---\n"), *[x for k, v in fields for x in (F.lit(f"{k}: "), v, F.lit("\n"))], F.lit("---\n"))


def table_cell(value: Column) -> Column:
    """A value as it may stand in a Markdown table."""
    s = F.replace(F.replace(F.coalesce(value.cast("string"), F.lit("")), F.lit("\\"), F.lit("\\\\")), F.lit("|"), F.lit("\\|"))
    return F.regexp_replace(s, r"\r\n|\n|\r", " ")


def table_row(cells: Column) -> Column:
    return F.concat(F.lit("| "), F.array_join(cells, " | "), F.lit(" |"))


def markdown_table(headers: list[str], rows: Column) -> Column:
    """Headers and an array of arrays of strings; rows are cut or filled to the headers' number."""
    n = len(headers)
    head = F.array(*[table_cell(F.lit(h)) for h in headers])
    fit = lambda r: F.slice(F.concat(F.transform(r, table_cell), F.array_repeat(F.lit(""), n)), 1, n)
    return F.array_join(F.concat(F.array(table_row(head), table_row(F.array_repeat(F.lit("---"), n))), F.transform(rows, lambda r: table_row(fit(r)))), "\n")


def safe_filename(name: Column, longest: int = 120) -> Column:
    s = F.regexp_replace(F.regexp_replace(strip(name), r'[<>:"/\\|?*\x00-\x1f]', "_"), WS + "+", "_")
    s = F.regexp_replace(s, r"^[._]+|[._]+$", "")

    def short(s: Column) -> Column:
        end = F.regexp_extract(s, r"(?s)\.([^.]*)$", 1)
        stem = F.regexp_extract(s, r"(?s)^(.*)\.[^.]*$", 1)
        kept = F.concat(F.substring(stem, F.lit(1), longest - F.length(end) - 1), F.lit("."), end)
        return F.when(F.length(s) == 0, "untitled").when(F.length(s) <= longest, s).when(s.contains(".") & (F.length(end) <= 8), kept).otherwise(F.substring(s, 1, longest))

    return let(s, short)


#: File types by extension: fixed values.
FILE_TYPES = {
    ".txt": "text", ".md": "text", ".markdown": "text", ".html": "html", ".htm": "html", ".pdf": "pdf", ".docx": "docx", ".csv": "csv", ".xlsx": "xlsx",
    ".json": "json", ".png": "image", ".jpg": "image", ".jpeg": "image", ".gif": "image", ".webp": "image", ".svg": "image",
}


def file_type(extension: Column) -> Column:
    known = F.create_map(*[F.lit(x) for kv in FILE_TYPES.items() for x in kv])
    return F.coalesce(F.try_element_at(known, F.lower(extension)), F.lit("unsupported"))


#: Words in a path that tell its category: fixed values.
POLICY = ("pappg", "policy", "guidance", "guide", "manual", "handbook", "directive", "stafford", "cfr", "fact sheet", "factsheet")
APPEAL = ("appeal", "second appeal", "project worksheet", " pw", "pws", "gmp", "dsr", "pa id", "determination")
DISASTER = r"\b\d{3,4}\s*-\s*(dr|em)\b"
CATEGORIES = ("policy", "appeal", "other")


def category(path: Column) -> Column:
    p = F.lower(path)
    some = lambda words: F.exists(F.array(*map(F.lit, words)), lambda w: p.contains(w))
    return F.when(some(POLICY), "policy").when(p.rlike(DISASTER) | some(APPEAL), "appeal").otherwise("other")


def path_key(path: Column) -> Column:
    """A path as it is compared: forward slashes, none around it, lower case."""
    return F.lower(F.regexp_replace(F.replace(path, F.lit("\\"), F.lit("/")), r"\A/+|/+\z", ""))


def glob_pattern(glob: str) -> str:
    """A shell pattern (* ? [seq] [!seq]) as a regular expression over the whole lower-cased text."""
    out, i, glob = [], 0, glob.strip().lower()
    while i < len(glob):
        c = glob[i]
        end = glob.find("]", i + 2 + (glob[i + 1 : i + 2] == "!")) if c == "[" else -1
        if c == "*":
            out.append(".*")
        elif c == "?":
            out.append(".")
        elif end > 0:
            inside = glob[i + 1 : end]
            inverse = inside.startswith("!")
            out.append(f"[{'^' * inverse}{re.sub(r'([\[\]\\^&~|])', r'\\\1', inside[inverse:])}]")
            i = end
        else:
            out.append(re.sub(r"([^\w\s])", r"\\\1", c))
        i += 1
    return rf"(?s)\A{''.join(out)}\z"


def matching_globs(text: Column, globs: list[str]) -> Column:
    """The patterns that match, ignoring case, in their order; none for blank texts and patterns."""
    hits = [F.when(F.lower(text).rlike(glob_pattern(g)), F.lit(g)) for g in globs if g and g.strip()]
    return F.when(F.length(strip(text)) > 0, F.filter(F.array(*hits).cast("array<string>"), lambda x: x.isNotNull())).otherwise(F.array().cast("array<string>"))


def bundle_name(place: Column, total: Column, widest: int = 11) -> Column:
    """The place's prefix in the least width that fits all bundles, from 20, 200, ... on. From `widest` digits on, where a prefix
    begins no longer moves with the number of bundles."""
    width = F.lit(2)
    for w in range(3, widest + 1):
        width = F.when(total > 10 ** (w - 1) - 2 * 10 ** (w - 3), w).otherwise(width)
    prefix = (F.lit(2) * F.pow(F.lit(10), width - 2) + place - 1).cast("long").cast("string")
    return F.concat(F.when(F.length(prefix) < 2, F.lpad(prefix, 2, "0")).otherwise(prefix), F.lit("_BUNDLE_"), F.when(place < 1000, F.lpad(place.cast("string"), 3, "0")).otherwise(place.cast("string")), F.lit(".md"))


def human_size(n: Column) -> Column:
    """Bytes in the largest unit below them, to one digit; halves go to the even digit."""
    out = F.when(n < 1024, F.concat(n.cast("string"), F.lit(" B")))
    for k, unit in enumerate(("KB", "MB", "GB"), 1):
        out = out.when(n < 1024 ** (k + 1), F.format_string(f"%.1f {unit}", F.bround(n / float(1024**k), 1)))
    return out.otherwise(F.format_string("%.1f TB", F.bround(n / float(1024**4), 1)))


#: The letters of canary codes: a fixed value.
CANARY = "ABCDEFGHJKLMNPQRSTUVWXYZ23456789"


def canary_code(i: Column) -> Column:
    """Four letters from the low bits of i times a fixed odd number."""
    v = (i.cast("long") * 2654435761).bitwiseAND((1 << 32) - 1)
    return F.concat(F.lit("PROBE-"), *[F.substring(F.lit(CANARY), (F.shiftrightunsigned(v, 5 * k).bitwiseAND(31) + 1).cast("int"), F.lit(1)) for k in range(4)])


def preview(text: Column, most: int = 160) -> Column:
    """The text on one line, cut with an ellipsis."""
    t = strip(F.regexp_replace(text, WS + "+", " "))
    return F.when(F.length(t) > most, F.concat(F.substring(t, 1, most), F.lit("…"))).otherwise(t)
