"""How far the word use of each source lies from the others of its language: joint tables of counts by one-hot products."""

from __future__ import annotations

from collections import Counter

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.llm.common import hot_join, stored

#: A term is kept with so many documents of its language; its share is in parts of SCALE; ranks of terms that are returned.
LEAST_DOCUMENTS, SCALE, TERM_RANKS = 3, 1_000_000_000, 200
#: Different terms a counting task holds before it hands them on; bytes of a text that are cut into words at once.
HELD, SPAN = 300_000, 1 << 20
#: Sources of a tile; about how many counts a product's task holds; terms of a block and columns it may have (above FEWEST terms).
TILE, PER_TASK, TERMS, COLUMNS, FEWEST = 32, 400_000, 4096, 2048, 64
#: All bytes: capitals to small letters, other ASCII but letters to spaces, the rest as they are.
_LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def _pieces(text: bytes):
    """The text's words, in lists from about SPAN bytes each."""
    at = 0
    while at < len(text):
        end = text.find(b" ", at + SPAN)
        end = len(text) if end < 0 else end
        yield text[at:end].split()
        at = end


def _counted(batches):
    """Counts of terms and of documents with the term, for each language and source; a row without a term for each of them."""
    import pyarrow as pa

    held: dict[tuple[str, str], tuple[Counter, Counter]] = {}
    new = lambda: (Counter(), Counter())

    def handed_on():
        for (lang, source), (found, documents) in held.items():
            terms = [None, *found]
            yield pa.RecordBatch.from_pydict({
                "lang": pa.array([lang] * len(terms)), "source": pa.array([source] * len(terms)), "term": pa.array(terms, pa.binary()).cast(pa.string()),
                "n": pa.array([0, *found.values()], pa.int64()), "docs": pa.array([0, *(documents[t] for t in found)], pa.int64()),
            })
        held.clear()

    size = 0
    for batch in batches:
        lang, source = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        for k in range(batch.num_rows):
            found, documents = held.setdefault((lang[k], source[k]), new())
            before, own = len(found), set()
            for words in _pieces(batch.column(2)[k].as_buffer().to_pybytes().translate(_LETTERS)):
                found.update(words)
                own.update(words)
            documents.update(own)
            size += len(found) - before + 1
            if size > HELD:
                yield from handed_on()
                size = 0
    yield from handed_on()


def counts(docs: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """lang, source, term, n (occurrences) and docs (documents with it); and for every language and source a row without a term."""
    named = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(a) for c, a in ((lang_col, "lang"), (source_col, "source"))]
    rows = docs.select(*named, F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("t"))
    found = rows.mapInArrow(_counted, "lang string, source string, term string, n long, docs long")
    return found.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def _share(n: str, of: str) -> Column:
    """1 + floor(SCALE * (n + 1) / of), exactly: in decimals, as a count may be large."""
    return F.expr(f"cast(1 + (cast({SCALE} as decimal(12, 0)) * (cast({n} as decimal(20, 0)) + 1)) div cast({of} as decimal(20, 0)) as bigint)")


def levels(docs: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text", least: int = LEAST_DOCUMENTS) -> tuple[DataFrame, DataFrame]:
    """The groups (lang, source, place in the language, total, terms and lang_total of the language, p0: the share at count 0) and
    the kept terms of each (lang, source, term, n, lang_n, p: the term's share here, q: in its language), as stored tables."""
    found = stored(counts(docs, lang_col, source_col, text_col))
    of = Window.partitionBy("lang", "term")  # a row for each source of the language
    wide = found.filter("term is not null").select("*", F.sum("docs").over(of).alias("all_docs"), F.sum("n").over(of).alias("lang_n"), (F.min("source").over(of) == F.col("source")).alias("first"))
    kept = stored(wide.filter(F.col("all_docs") >= least).select(F.array("lang", "source").alias("g"), "term", "n", "lang_n", "first"))
    own = kept.groupBy("g").agg(F.sum("n").alias("total"), F.count("*").alias("rows"), F.sum(F.col("first").cast("long")).alias("firsts"))
    groups = found.filter("term is null").select(F.array("lang", "source").alias("g"), "lang", "source").join(own, "g", "left").na.fill(0, ["total", "rows", "firsts"])
    by_lang = Window.partitionBy("lang")  # a row for each source
    groups = groups.select(
        "g", "lang", "source", "total", "rows", (F.row_number().over(by_lang.orderBy("source")) - 1).alias("place"), F.count("*").over(by_lang).alias("sources"),
        F.sum("firsts").over(by_lang).alias("terms"), F.sum("total").over(by_lang).alias("lang_total"), F.sum("rows").over(by_lang).alias("lang_rows"),
    )
    groups = stored(groups.withColumn("p0", F.when(F.col("terms") > 0, F.expr(f"cast(1 + {SCALE} div (total + terms) as bigint)")).otherwise(F.lit(1))))
    sized = hot_join(kept, groups.filter("rows > 0"), "g", "rows")
    return groups, stored(sized.select("lang", "source", "place", "sources", "terms", "lang_rows", "term", "n", "lang_n", _share("n", "total + terms").alias("p"), _share("lang_n", "lang_total + terms").alias("q")))


def _blocks(table):
    """The one-hot products of a task: for each block of terms the columns (source by place, share) of both tiles and how many
    terms have both. First yields the sources, then blocks."""
    import pyarrow.compute as pc

    marks, rows = table.filter(pc.is_null(table.column("term"))), table.filter(pc.is_valid(table.column("term")))
    order = np.argsort(marks.column("place").to_numpy())
    place, p0 = marks.column("place").to_numpy()[order], marks.column("p").to_numpy()[order]
    names = np.array(marks.column("source").to_pylist(), object)[order]
    a, b = table.column("a")[0].as_py(), table.column("b")[0].as_py()
    left, right = np.flatnonzero(place // TILE == a), np.flatnonzero(place // TILE == b)
    terms = rows.column("term").combine_chunks().dictionary_encode().indices.to_numpy() if rows.num_rows else np.zeros(0, np.int64)
    group, p, size = np.searchsorted(place, rows.column("place").to_numpy()), rows.column("p").to_numpy(), rows.column("lang_n").to_numpy()
    total = np.zeros(terms.max(initial=-1) + 1, np.int64)
    total[terms] = size
    rank = np.empty(len(total), np.int64)  # terms of like frequency go together: they share levels
    rank[np.argsort(-total, kind="stable")] = np.arange(len(total))
    row = rank[terms]
    order = np.argsort(row, kind="stable")
    row, group, p = row[order], group[order], p[order]
    first = marks.num_rows and table.column("chunk")[0].as_py() == 0
    yield place, p0, names, left, right, len(total), first, int(marks.column("terms")[0].as_py())

    def block(start: int, stop: int):
        lo, hi = np.searchsorted(row, (start, stop))
        shares = np.repeat(p0[None, :], stop - start, axis=0)
        shares[row[lo:hi] - start, group[lo:hi]] = p[lo:hi]
        columns, at = np.unique((np.arange(len(place)) << 31 | shares).ravel(), return_inverse=True)
        if len(columns) > COLUMNS and stop - start > FEWEST:
            middle = (start + stop) // 2
            yield from block(start, middle)
            yield from block(middle, stop)
            return
        hot = np.zeros((stop - start, len(columns)), np.float32)
        hot[np.arange(stop - start)[:, None], at.reshape(shares.shape)] = 1
        of, share = columns >> 31, columns & ((1 << 31) - 1)
        i, j = np.flatnonzero(np.isin(of, left)), np.flatnonzero(np.isin(of, right))
        # Sums of ones, fewer than 2 ** 24: exact in single precision.
        yield of[i], share[i], of[j], share[j], (hot[:, i].T @ hot[:, j]).astype(np.int64)

    for start in range(0, len(total), TERMS):
        yield from block(start, min(len(total), start + TERMS))


def _price(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // q


def _priced(table):
    """The sums over this task's terms of what each pair of sources comes to, against the value of a term that neither has; the
    first task of a pair also has that value for all terms."""
    import pyarrow as pa

    blocks = _blocks(table)
    place, p0, names, left, right, _, first, terms = next(blocks)
    none = _price(p0[left][:, None], p0[right][None, :]), _price(p0[right][None, :], p0[left][:, None])
    sums = [x * (terms if first else 0) for x in none]
    for g, p, h, q, n in blocks:
        seen = int(n[g == g[0]][:, h == h[0]].sum())
        edges = np.searchsorted(g, left), np.searchsorted(h, right)
        for k, price in enumerate((_price(p[:, None], q[None, :]), _price(q[None, :], p[:, None]))):
            sums[k] = sums[k] + np.add.reduceat(np.add.reduceat(n * price, edges[0], axis=0), edges[1], axis=1) - seen * none[k]
    same = len(left) == len(right) and len(left) and left[0] == right[0]
    one, other = np.repeat(names[left], len(right)), np.tile(names[right], len(left))
    keep = one != other
    lang = table.column("lang")[0].as_py()
    for k in range(1 if same else 2):
        a, b = (one, other) if k == 0 else (other, one)
        yield pa.RecordBatch.from_pydict({"lang": pa.array([lang] * int(keep.sum()), pa.string()), "source": pa.array(a[keep], pa.string()), "item": pa.array(b[keep], pa.string()), "value": pa.array(sums[k].ravel()[keep], pa.int64())})


def _joint(table):
    """The cells of the joint tables of this task's terms; terms that neither source has are counted down from all of them."""
    import pyarrow as pa

    blocks = _blocks(table)
    place, p0, names, left, right, seen, first, terms = next(blocks)
    lang = table.column("lang")[0].as_py()

    def cells(g, p, h, q, n):
        i, j = np.nonzero(n)
        keep = g[i] != h[j]
        i, j = i[keep], j[keep]
        columns = {"lang": pa.array([lang] * len(i), pa.string()), "source": pa.array(names[g[i]], pa.string()), "item": pa.array(names[h[j]], pa.string())}
        return pa.RecordBatch.from_pydict(columns | {"p": pa.array(p[i]), "q": pa.array(q[j]), "terms": pa.array(n[i, j])})

    yield cells(left, p0[left], right, p0[right], np.full((len(left), len(right)), (terms if first else 0) - seen))
    for b in blocks:
        yield cells(*b)


def _products(groups: DataFrame, kept: DataFrame, run, schema: str) -> DataFrame:
    """`run` over the tasks of the product: a task has some terms of a language (by hash) and two tiles of its sources."""

    def placed(rows: DataFrame, chunk: Column) -> DataFrame:
        tile, tiles = F.floor(F.col("place") / TILE).cast("int"), F.ceil(F.col("sources") / TILE).cast("int")
        each = rows.select("lang", "source", "place", "terms", "term", "lang_n", "p", tile.alias("own"), chunk.alias("chunk"), F.explode(F.sequence(F.lit(0), tiles - 1)).alias("other"))
        return each.select(*["lang", "source", "place", "terms", "term", "lang_n", "p", "chunk"], F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"))

    chunks = F.greatest(F.lit(1), F.ceil(F.col("lang_rows") / PER_TASK)).cast("int")
    marks = groups.select("*", F.lit(None).cast("string").alias("term"), F.lit(0).cast("long").alias("lang_n"), F.col("p0").alias("p"), F.explode(F.sequence(F.lit(0), chunks - 1)).alias("c"))
    rows = placed(kept, F.pmod(F.xxhash64("term"), chunks).cast("int")).unionByName(placed(marks, F.col("c")))
    return rows.groupBy("lang", "a", "b", "chunk").applyInArrow(_streamed(run), schema)


def _streamed(run):
    def whole(table):
        import pyarrow as pa

        return pa.Table.from_batches(list(run(table.combine_chunks())))

    return whole


def joint_tables(docs: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """For every two sources of a language: how many kept terms have share p in `source` and q in `item` (lang, source, item, p, q,
    terms). Two sources have one table: from the one that comes first by tile; within a tile both directions are given."""
    groups, kept = levels(docs, lang_col, source_col, text_col)
    cells = _products(groups, kept, _joint, "lang string, source string, item string, p long, q long, terms long")
    return cells.groupBy("lang", "source", "item", "p", "q").agg(F.sum("terms").alias("terms")).filter("terms > 0")


def audit(docs: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text", ranks: int = TERM_RANKS) -> DataFrame:
    """For every language and source: part `pair`, each other source of the language by divergence over all kept terms, and part
    `term`, the terms it uses more than its language does, by their share of the divergence (lang, source, part, item, value, rank).

    A divergence adds (p - q)^2 / q, rounded down, over terms; p and q are shares in parts of SCALE with one added to each count.
    Null text, language and source: ''. Terms are runs of letters and of all that is not ASCII, A-Z lower-cased; kept are those in at
    least LEAST_DOCUMENTS documents of the language. A language without kept terms has pairs of value 0. Repeated rows: each counts.
    Empty input: no rows. No other columns are read.

    A source's share of a term depends on its count there alone. So indicator columns (source, count level) over the terms,
    multiplied by their transpose, give every joint table of two sources, and each cell is priced once. Blocks of terms of like
    frequency and tiles of sources bound a product; a task prices its own cells and returns a sum for each two sources.
    """
    groups, kept = levels(docs, lang_col, source_col, text_col)
    sums = _products(groups, kept, _priced, "lang string, source string, item string, value long")
    pairs = sums.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    terms = kept.filter("p > q").select("lang", "source", F.col("term").alias("item"), F.expr("(p - q) * (p - q) div q").alias("value"))
    by = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = [x.withColumn("rank", F.row_number().over(by)).select("lang", "source", F.lit(part).alias("part"), "item", "value", "rank") for part, x in (("pair", pairs), ("term", terms))]
    return ranked[0].unionByName(ranked[1].filter(F.col("rank") <= ranks))
