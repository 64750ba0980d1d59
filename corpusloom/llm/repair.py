"""Repair of damaged conversations: generalised LR parsing over roles with weighted edits."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import released, stored

#: Turns of a segment, a power of two (1 << TURN_BITS), and bytes of its texts; segments of a sorted range.
TURN_BITS, SEGMENT_BYTES, NTH_BITS = 9, 8 << 20, 24
#: Segments handed on at once; turns up to which the paths of equal segments are remembered, and how many.
SEGMENTS, SHORT, REMEMBERED = 256, 12, 1 << 15
KEEP, REROLE, DELETE, INSERT, CUT_SHORT = 0, 1, 2, 5, 5
SOUND, BLANK, TRUNCATED, REPEATED = range(4)
ROLES = {"u": "user", "a": "assistant"}
LEGAL = ("su", "ua", "au")

# The grammar of role initials, and its LR table. States by what they have read:
#   dialogue: nothing | turns | s turns        turns: u a | turns u a
#   0 nothing, 1 s, 2 u, 3 turns, 4 s turns, 5 u a, 6 turns u, 7 turns u a
SHIFT = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 5, (3, "u"): 6, (4, "u"): 6, (6, "a"): 7}
#: States at whose end `turns` is complete: how many states it takes off the stack; and where it then leads.
REDUCE, GOTO = {5: 2, 7: 3}, {0: 3, 1: 4}
ACCEPT = {0, 3, 4}


class Stacks:
    """A graph-structured stack: a node is a state and the node below it, equal stacks are one node (0: the start). As the
    grammar's lists grow to the left, reductions keep stacks short and nodes few."""

    def __init__(self):
        self.nodes, self.index, self.known = [(0, -1)], {(0, -1): 0}, {}
        todo = [0]
        while todo:
            here = todo.pop()
            for symbol in "sua":
                before = len(self.nodes)
                self.known[here, symbol] = self._shifted(here, symbol)
                todo += range(before, len(self.nodes))
        todo = [k for k in range(len(self.nodes)) if any((k, s) not in self.known for s in "sua")]
        self.accepting = {k for k, (state, _) in enumerate(self.nodes) if state in ACCEPT}
        #: A node's way to an accepting one by insertions alone: the symbols.
        self.ends = {k: self._end(k) for k in range(len(self.nodes))}

    def _pushed(self, state: int, below: int) -> int:
        if (state, below) not in self.index:
            self.index[state, below] = len(self.nodes)
            self.nodes.append((state, below))
        return self.index[state, below]

    def _shifted(self, node: int, symbol: str) -> int | None:
        state = SHIFT.get((self.nodes[node][0], symbol))
        if state is None:
            return None
        below = node
        while state in REDUCE:
            for _ in range(REDUCE[state] - 1):
                below = self.nodes[below][1]
            state = GOTO[self.nodes[below][0]]
        return self._pushed(state, below)

    def after(self, node: int, symbol: str) -> int | None:
        return self.known.get((node, symbol))

    def given(self, node: int) -> str:
        """The one of user and assistant that may follow here (there is one in every state of this grammar)."""
        return "u" if self.after(node, "u") is not None else "a"

    def _end(self, node: int) -> str:
        added = ""
        while node not in self.accepting:
            symbol = self.given(node)
            node, added = self.after(node, symbol), added + symbol
        return added


STACKS = Stacks()
Tops = dict[int, tuple[int, str]]


def _better(tops: Tops, node: int, path: tuple[int, str]) -> bool:
    """Merges a path into the node it leads to: the least (cost, audit) stays."""
    if node not in tops or path < tops[node]:
        tops[node] = path
        return True
    return False


def step(tops: Tops, initial: str, fault: int) -> Tops:
    """All stacks after a turn, each with its cheapest path: insertions before the turn, then its keeping, reroling or deletion."""
    tops, todo = dict(tops), list(tops)
    while todo:
        node = todo.pop()
        cost, audit = tops[node]
        k = STACKS.after(node, STACKS.given(node))
        if _better(tops, k, (cost + INSERT, audit + "I")):
            todo.append(k)
    out: Tops = {}
    extra = CUT_SHORT if fault == TRUNCATED else 0
    for node, (cost, audit) in tops.items():
        _better(out, node, (cost + DELETE, audit + "D"))
        if fault in (SOUND, TRUNCATED):
            k = STACKS.after(node, initial)
            if k is not None:
                _better(out, k, (cost + KEEP + extra, audit + "K"))
            _better(out, STACKS.after(node, STACKS.given(node)), (cost + REROLE + extra, audit + "R"))
    return out


def paths(initials: list[str], faults: list[int], starts) -> list[tuple[int, int, int, int, str]]:
    """The cheapest paths over some turns from each of `starts` to each node: (start, end, cost, rank of the audit, audit).

    A path ends with its last turn's own edit, so no audit of these turns is the beginning of another, and ranks order what
    they are continued by as well."""
    found = []
    for start in starts:
        tops: Tops = {start: (0, "")}
        for initial, fault in zip(initials, faults, strict=True):
            tops = step(tops, initial, fault)
        found += [(start, end, cost, audit) for end, (cost, audit) in tops.items()]
    rank = {audit: k for k, audit in enumerate(sorted({x[3] for x in found}))}
    return [(start, end, cost, rank[audit], audit) for start, end, cost, audit in found]


@lru_cache(maxsize=REMEMBERED)
def _short_paths(initials: tuple[str, ...], faults: tuple[int, ...], starts: tuple[int, ...]) -> list[dict]:
    return _ways(initials, faults, starts)


def _ways(initials, faults, starts) -> list[dict]:
    return [{"start": s, "end": e, "cost": c, "rank": k, "audit": a} for s, e, c, k, a in paths(initials, faults, starts)]


def rendered(roles: list[str], texts: list[str], audit: str, node: int) -> list[str]:
    """The repaired turns `role:text`, from the edits and the node they start from."""
    lines, k = [], 0
    for edit in audit:
        symbol = STACKS.given(node)
        if edit == "I":
            lines.append(f"{ROLES[symbol]}:")
        else:
            if edit != "D":
                lines.append(f"{roles[k] if edit == 'K' else ROLES[symbol]}:{texts[k]}")
            symbol = None if edit == "D" else roles[k][:1] if edit == "K" else symbol
            k += 1
        node = node if symbol is None else STACKS.after(node, symbol)
    return lines


def damaged(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv, turn, role and text (null role or text: one space) with the faults that crc32 of `conv:turn` (null: one space) asks for:
    modulo 20, 0 drops the turn, 1 empties its text, 2 takes `.`, `!` and `?` out, 3 gives it twice, 4 makes it the user's."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    code = F.crc32(F.concat(blank(conv_col), F.lit(":"), blank(turn_col)).cast("binary")) % 20
    rows = conversations.select(F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"), blank(role_col).alias("role"), blank(text_col).alias("t"), code.alias("code")).filter("code != 0")
    text = F.when(F.col("code") == 1, "").when(F.col("code") == 2, F.translate("t", ".!?", "")).otherwise(F.col("t"))
    role = F.when(F.col("code") == 4, "user").otherwise(F.col("role"))
    return rows.select("conv", "turn", role.alias("role"), text.alias("text"), F.explode(F.when(F.col("code") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy")).drop("copy")


SPACES = " \t\n\x0b\x0c\r"


def _last(text: Column) -> Column:
    """The last character that is no white space, if any."""
    return F.substring(F.rtrim(text, F.lit(SPACES)), -1, 1)


def _segments(batches):
    """Sorted turns (conv, turn, role, text, last, digest), cut into segments of a conversation."""
    import pyarrow as pa
    from pyspark import TaskContext

    base = TaskContext.get().partitionId() << NTH_BITS
    kinds = {"seg": pa.int64(), "first": pa.bool_(), "roles": pa.list_(pa.string()), "texts": pa.list_(pa.string()), "digests": pa.list_(pa.binary()), "faults": pa.list_(pa.int32()), **dict.fromkeys(("least", "most", "turns"), pa.int64())}

    def segment(nth, rows, conv, first):
        turns = [r[0] for r in rows if r[0] is not None]
        faults = [BLANK if not r[3] else SOUND if r[3] in ".!?" else TRUNCATED for r in rows]
        lists = {"roles": [r[1] for r in rows], "texts": [r[2] for r in rows], "digests": [r[4] for r in rows], "faults": faults}
        return {"seg": base + nth, "conv": conv, "first": first, **lists, "least": min(turns, default=None), "most": max(turns, default=None), "turns": len(set(turns))}

    def batch_of(done, conv_type):
        return pa.RecordBatch.from_pydict({k: pa.array([r[k] for r in done], conv_type if k == "conv" else kinds[k]) for k in ("seg", "conv", "first", "roles", "texts", "digests", "faults", "least", "most", "turns")})

    rows, size, now, first, nth, done, held, conv_type = [], 0, None, False, 0, [], 0, None
    for batch in batches:
        conv_type = batch.schema.field(0).type
        for conv, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if rows and (conv != now or len(rows) == 1 << TURN_BITS or size > SEGMENT_BYTES):
                done.append(segment(nth, rows, now, first))
                held += size
                rows, size, nth, first = [], 0, nth + 1, conv != now
                if len(done) == SEGMENTS or held > SEGMENT_BYTES:
                    yield batch_of(done, conv_type)
                    done, held = [], 0
            now = conv
            rows.append(row)
            size += len(row[2])
    if rows:
        yield batch_of([*done, segment(nth, rows, now, first)], conv_type)


def segments(turns: DataFrame) -> DataFrame:
    """The turns of damaged() in their order, as a stored table: a row for at most 512 turns of a conversation. seg rises with the order
    over all rows; first is true where a conversation surely begins. Order: conversation, turn (null first), role, the text's
    first 32 characters, its hash; rows that are equal in these in any order."""
    kept = stored(turns.withColumn("head", F.substring("text", 1, 32)).withColumn("h", F.xxhash64("text")).withColumn("row", F.monotonically_increasing_id()))
    by = ["conv", "turn", "role", "head", "h", "row"]
    digest = F.unhex(F.sha2(F.concat_ws(":", F.length("role"), "role", "text"), 256))
    rows = kept.repartitionByRange(*by).sortWithinPartitions(*by).select("conv", F.col("turn").cast("long"), "role", "text", _last(F.col("text")).alias("last"), digest.alias("digest"))
    kind = turns.schema["conv"].dataType.simpleString()
    out = stored(rows.mapInArrow(_segments, f"seg long, conv {kind}, first boolean, roles array<string>, texts array<string>, digests array<binary>, faults array<int>, least long, most long, turns long"))
    released(kept)
    return out


def _walked(batches):
    """The paths and figures of each segment (seg, conv, first, initials, faults, own, least, most, turns); own: the turns of it whose
    role and text are not seen before."""
    import pyarrow as pa

    for batch in batches:
        rows = []
        for r in batch.to_pylist():
            own, initials = set(r["own"] or ()), r["initials"]
            faults = [f if f == BLANK or k in own else REPEATED for k, f in enumerate(r["faults"])]
            starts = (0,) if r["first"] else tuple(range(len(STACKS.nodes)))
            ways = _short_paths(tuple(initials), tuple(faults), starts) if len(faults) <= SHORT else _ways(initials, faults, starts)
            rows.append({
                "seg": r["seg"], "conv": r["conv"], "least": r["least"], "most": r["most"], "turns": r["turns"], "opens": initials[0], "closes": initials[-1],
                "blank": faults.count(BLANK), "duplicate": faults.count(REPEATED), "truncated": faults.count(TRUNCATED), "illegal": sum(a + b not in LEGAL for a, b in zip(initials, initials[1:], strict=False)),
                "ways": ways,
            })
        yield pa.RecordBatch.from_pylist(rows, _schema(batch.schema.field("conv").type))


def _schema(conv):
    import pyarrow as pa

    way = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("cost", pa.int64()), ("rank", pa.int32()), ("audit", pa.string())])
    longs = [(c, pa.int64()) for c in ("blank", "duplicate", "truncated", "illegal")]
    return pa.schema([("seg", pa.int64()), ("conv", conv), ("least", pa.int64()), ("most", pa.int64()), ("turns", pa.int64()), ("opens", pa.string()), ("closes", pa.string()), *longs, ("ways", pa.list_(way))])


class Fold:
    """A conversation's segments in order: figures, and the cheapest path through all of them. Of each segment it keeps where
    its best paths come from: a few numbers."""

    def __init__(self, conv):
        self.conv, self.tops, self.back, self.segs = conv, {0: (0, 0)}, [], []
        self.sums = dict.fromkeys(("blank", "duplicate", "truncated", "illegal"), 0)
        self.least = self.most = self.closes = None
        self.turns, self.latest = 0, None

    def add(self, r: dict) -> None:
        best: dict[int, tuple[int, int, int, int]] = {}
        for w in r["ways"]:
            if w["start"] in self.tops:
                cost, rank = self.tops[w["start"]]
                new = (cost + w["cost"], rank, w["rank"], w["start"])
                if w["end"] not in best or new < best[w["end"]]:
                    best[w["end"]] = new
        order = {x: k for k, x in enumerate(sorted({x[1:3] for x in best.values()}))}
        self.tops = {end: (x[0], order[x[1:3]]) for end, x in best.items()}
        self.back.append({end: x[3] for end, x in best.items()})
        self.segs.append(r["seg"])
        for k in self.sums:
            self.sums[k] += r[k]
        if self.closes is not None and self.closes + r["opens"] not in LEGAL:
            self.sums["illegal"] += 1
        self.closes = r["closes"]
        if r["turns"]:
            self.turns += r["turns"] - (self.latest == r["least"])
            self.least = r["least"] if self.least is None else self.least
            self.most = self.latest = r["most"]

    def rows(self) -> Iterator[dict]:
        """The path a segment takes; the last one with the conversation's figures and what is inserted at its end."""
        end = min(self.tops, key=lambda n: (self.tops[n][0] + INSERT * len(STACKS.ends[n]), self.tops[n][1]))
        cost, tail = self.tops[end][0] + INSERT * len(STACKS.ends[end]), STACKS.ends[end]
        ways, at = [], end
        for back in reversed(self.back):
            ways.append((back[at], at))
            at = back[at]
        figures = {**self.sums, "gaps": 0 if self.least is None else self.most - self.least + 1 - self.turns, "cost": cost, "tail": tail}
        for k, (seg, way) in enumerate(zip(self.segs, reversed(ways), strict=True)):
            yield {"conv": self.conv, "seg": seg, "start": way[0], "end": way[1], **(figures if k == len(self.segs) - 1 else {})}


def _folded(batches):
    import pyarrow as pa

    now, schema = None, None
    longs = ("seg", "gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    for batch in batches:
        schema = schema or pa.schema([("conv", batch.schema.field("conv").type), *((c, pa.int64()) for c in longs), ("start", pa.int32()), ("end", pa.int32()), ("tail", pa.string())])
        done = []
        for r in batch.to_pylist():
            if now is None or now.conv != r["conv"]:
                done += now.rows() if now else ()
                now = Fold(r["conv"])
            now.add(r)
        yield pa.RecordBatch.from_pylist(done, schema)
    if now:
        yield pa.RecordBatch.from_pylist(list(now.rows()), schema)


def _printed(batches):
    """Segments (roles, texts, audit, start, tail, ...) as the lines of their repaired turns, each with its end."""
    import pyarrow as pa

    for batch in batches:
        lines = []
        for r in batch.select(["roles", "texts", "audit", "start", "tail"]).to_pylist():
            found = rendered(r["roles"], r["texts"], r["audit"], r["start"]) + [f"{ROLES[s]}:" for s in r["tail"] or ""]
            lines.append("".join(x + "\n" for x in found))
        kept = batch.drop_columns(["roles", "texts", "start"])
        yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(lines, pa.string())], names=[*kept.schema.names, "lines"])


def _hashed(batches):
    """Of each conversation, whose segments come in order, its figures, its audit and the hash of its turns, taken as they pass."""
    import pyarrow as pa

    now, parts, audit, held = object(), hashlib.sha256(), [], b""
    for batch in batches:
        done, schema = [], None
        for r in batch.to_pylist():
            schema = schema or pa.schema([f for f in batch.schema if f.name not in ("seg", "tail", "lines")] + [pa.field("repaired_sha256", pa.string())])
            if r["conv"] != now:
                now, parts, audit, held = r["conv"], hashlib.sha256(), [], b""
            audit.append(r["audit"] + "I" * len(r["tail"] or ""))
            data = held + r["lines"].encode()
            held = data[-1:]  # the last line's end is not hashed
            parts.update(data[:-1])
            if r["cost"] is not None:
                done.append({c: r[c] for c in schema.names if c in r} | {"audit": "".join(audit), "repaired_sha256": parts.hexdigest()})
                now = object()
        if schema:
            yield pa.RecordBatch.from_pylist(done, schema)


FIGURES = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def repair(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """For every conversation, what is wrong with its damaged() turns and their cheapest repair: conversation, gaps, blank,
    duplicate, truncated, illegal, cost, audit, repaired_sha256.

    Turns are taken by number (null first; ties as segments() says). A turn's first fault counts: blank, duplicate (role and text as of an
    earlier turn), truncated. A repair keeps (0), reroles (1) or deletes (2; blank and duplicate turns always) each turn and inserts
    empty ones (5), so that role initials read `(s?(ua)+)?`; truncated turns that stay cost 5 more. audit: the edits' initials, of equal cost
    the least in ASCII. Null conversation: one conversation. Conversations without turns after the damage: zeros, no edits, the hash of
    nothing. Turn numbers are whole numbers. Empty input: no rows. No other columns are read.

    Generalised LR parsing: a graph-structured stack, equal tops merged by the least (cost, audit). A conversation is cut into segments
    of 512 turns; each is parsed by itself from every stack it may meet, and the segments' ways are then chained by costs and
    ranks. No task holds a conversation; one hashes each, as it streams past.
    """
    segs = segments(damaged(conversations, conv_col, turn_col, role_col, text_col))
    each = segs.select("conv", "seg", F.posexplode("digests").alias("k", "digest"))
    firsts = each.groupBy("conv", "digest").agg(F.min(F.shiftleft("seg", TURN_BITS) + F.col("k")).alias("at"))
    own = firsts.groupBy(F.shiftright("at", TURN_BITS).alias("seg")).agg(F.collect_list((F.col("at") % (1 << TURN_BITS)).cast("int")).alias("own"))  # 512 at the most
    narrow = segs.select("seg", "conv", "first", F.transform("roles", lambda r: F.substring(r, 1, 1)).alias("initials"), "faults", "least", "most", "turns").join(own, "seg", "left")
    conv = segs.schema["conv"].dataType.simpleString()
    longs = "blank long, duplicate long, truncated long, illegal long"
    ways = stored(narrow.mapInArrow(_walked, f"seg long, conv {conv}, least long, most long, turns long, opens string, closes string, {longs}, ways array<struct<start:int,end:int,cost:long,rank:int,audit:string>>"))
    light = ways.withColumn("ways", F.transform("ways", lambda w: w.dropFields("audit")))
    chosen = light.repartition("conv").sortWithinPartitions("conv", "seg").mapInArrow(_folded, f"conv {conv}, seg long, gaps long, {longs}, cost long, start int, end int, tail string")
    of = chosen.drop("conv").join(ways.select("seg", "ways"), "seg")
    of = of.withColumn("audit", F.filter("ways", lambda w: (w["start"] == F.col("start")) & (w["end"] == F.col("end")))[0]["audit"]).drop("ways", "end")
    shown = of.join(segs.select("seg", "conv", "roles", "texts"), "seg").select("seg", "conv", *FIGURES, "audit", "tail", "start", "roles", "texts")
    figures = ", ".join(f"{c} long" for c in FIGURES)
    lines = shown.mapInArrow(_printed, f"seg long, conv {conv}, {figures}, audit string, tail string, lines string")
    found = lines.repartition("conv").sortWithinPartitions("conv", "seg").mapInArrow(_hashed, f"conv {conv}, {figures}, audit string, repaired_sha256 string")
    every = conversations.select(F.col(conv_col).alias("c")).distinct()
    joined = every.join(found, F.col("c").eqNullSafe(F.col("conv")), "left")
    return joined.select(
        F.col("c").alias(conv_col), *[F.coalesce(c, F.lit(0)).alias(c) for c in FIGURES], F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"),
    )
