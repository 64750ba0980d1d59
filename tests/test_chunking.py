"""Chunking against a plain, line-by-line version on made-up Markdown; and the invariants of chunks."""

import random
import re

import pytest

from corpusloom.operators import chunking as C

HEADING = re.compile(r"(#{1,6})\s+(.+?)\s*#*\s*$")


def est(t):
    return (len(t) + 3) // 4


def is_fence(line):
    return line.strip().startswith("```")


class Plain:
    """Chunks by walking lines."""

    def __init__(self, s):
        self.s = s

    def blocks(self, t):
        if not self.s.fence_aware:
            return [p.strip() for p in t.split("\n\n") if p.strip()]
        out, inside = [[]], False
        for line in t.split("\n"):
            if not inside and not line.strip():
                out.append([])
                continue
            out[-1].append(line)
            inside ^= is_fence(line)
        return [x for x in ("\n".join(o).strip() for o in out) if x]

    def units(self, p):
        if not self.s.fence_aware:
            return p.split("\n")
        out, open_ = [], False
        for line in p.split("\n"):
            if open_:
                out[-1] += "\n" + line
                open_ = not is_fence(line)
            else:
                out.append(line)
                open_ = is_fence(line)
        return out

    def runs(self, parts, fits):
        out = []
        for x in parts:
            if out and fits([*out[-1], x]):
                out[-1].append(x)
            else:
                out.append([x])
        return out

    def lines(self, p):
        budget, done, now = self.s.budget, [], []
        summed = lambda xs: sum(map(est, xs)) <= budget

        def flush():
            done.extend(("\n".join(r), C.OVERSIZE) for r in self.runs(now, summed))
            now.clear()

        for u in self.units(p):
            fence = self.s.fence_aware and ("\n" in u or u.lstrip().startswith("```"))
            if est(u) <= budget or not (fence or self.s.sentences):
                now.append(u)
                continue
            flush()
            if fence:
                done.append((u, C.FENCE))
            else:
                parts = [w for x in re.split(r"(?<=[.!?])\s+", u) if x.strip() for w in (x.split() if est(x.strip()) > budget else [x.strip()])]
                done.extend((" ".join(r), C.SENTENCE) for r in self.runs(parts, lambda xs: est(" ".join(xs)) <= budget))
        flush()
        return done

    def pack(self, t):
        budget, blocks = self.s.budget, self.blocks(t)
        if budget <= 0 or not blocks:
            return [(t, C.WHOLE)]
        out, now = [], []

        def flush(reason):
            if now:
                out.append(("\n\n".join(now), reason))
                now.clear()

        for p in blocks:
            if est(p) > budget:
                flush(C.BEFORE_OVERSIZE)
                out.extend(self.lines(p))
            else:
                if sum(map(est, now)) + est(p) > budget:
                    flush(C.BUDGET)
                now.append(p)
        flush(C.END if out else C.WHOLE)
        return out

    def headed(self, text):
        m = HEADING.match(text.split("\n")[0].strip())
        return bool(m) and len(m[1]) <= self.s.level

    def sections(self, t):
        out, inside = [[]], False
        for line in t.split("\n"):
            inside ^= is_fence(line)
            if not inside and out[-1] and self.headed(line):
                out.append([])
            out[-1].append(line)
        return [x for x in ("\n".join(o).strip() for o in out) if x]

    def chunks(self, t):
        t, s = t.strip(), self.s
        if not t:
            return []
        parts = self.sections(t)
        if s.strategy == "headings" and (len(parts) > 1 or self.headed(parts[0])):
            pairs = []
            for x in parts:
                small = s.budget <= 0 or est(x) <= s.budget
                pairs += [(x, C.SECTION if self.headed(x) else C.PREAMBLE)] if small else self.pack(x)
        else:
            pairs = self.pack(t)
        out = []
        for text, reason in pairs:
            both = f"{out[-1][0]}\n\n{text}" if out else ""
            if s.least and out and min(est(text), est(out[-1][0])) < s.least and (s.budget <= 0 or est(both) <= s.budget):
                out[-1] = (both, C.MERGED)
            else:
                out.append((text, reason))
        return out

    @staticmethod
    def titles(t):
        inside = False
        for line in t.split("\n"):
            inside ^= is_fence(line)
            m = None if inside or is_fence(line) else HEADING.match(line.strip())
            if m:
                yield len(m[1]), m[2].strip()

    def paths(self, texts):
        stack, out = {}, []
        for t in texts:
            out.append([stack[k] for k in sorted(stack)])
            for level, title in self.titles(t):
                stack = {k: v for k, v in stack.items() if k < level} | {level: title}
        return out


def document(rng):
    words = lambda n: " ".join(rng.choice(["ab", "cde.", "fghij!", "k", "Lm?", "ñö"]) for _ in range(n))
    out = []
    for _ in range(rng.randint(0, 14)):
        k = rng.random()
        if k < 0.25:
            out.append("#" * rng.randint(1, 7) + " " + words(2) + rng.choice(["", " ##", "#"]))
        elif k < 0.4:
            out.append("```\n" + words(5) + "\n\n# no\n" + words(rng.randint(1, 20)) + rng.choice(["\n```", "\n```", ""]))
        elif k < 0.5:
            out.append("- " + words(3) + "\n* x\n1. y\n| a | b |")
        else:
            out.append("\n".join(words(rng.randint(1, 30)) for _ in range(rng.randint(1, 4))))
        out.append(rng.choice(["\n\n", "\n\n", "\n", " \n \n"]))
    return "".join(out)


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    return [document(rng) for _ in range(300)] + ["", " \n ", "x" * 500, "\n\n", "```", "# ", "a b\x1cc"]


@pytest.mark.parametrize(
    "s",
    [C.Settings(20), C.Settings(20, sentences=True), C.Settings(20, fence_aware=True), C.Settings(12, "headings", 2, 8, True, True), C.Settings(30, "headings", 3), C.Settings(0, "headings"), C.Settings(40, least=15)],
    ids=str,
)
def test_as_plain(spark, texts, s):
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    got = {}
    for r in C.chunk_documents(df, s).collect():
        got.setdefault(r["id"], []).append(r)
    plain = Plain(s)
    for i, t in enumerate(texts):
        rows = sorted(got.get(i, []), key=lambda r: r["idx"])
        want = plain.chunks(t)
        assert [(r["text"], r["reason"]) for r in rows] == want
        assert [list(r["heading_path"]) for r in rows] == plain.paths([x for x, _ in want])
        assert all(list(r["structure"]["headings"]) == [x for _, x in plain.titles(r["text"])] for r in rows)


def test_nothing_lost_and_budget_kept(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text")
    source = dict(docs.collect())
    got = {}
    for r in C.chunk_documents(docs, C.Settings(100), paths=False, structures=False).collect():
        got.setdefault(r["doc_id"], {})[r["idx"]] = r
    for i, t in source.items():
        texts = [got[i][k]["text"] for k in sorted(got.get(i, {}))]
        assert "\n".join(texts).split() == (t or "").split()
        assert all(est(x) <= 100 + 30 or "\n" not in x for x in texts)
    assert C.chunk_documents(docs.limit(0), C.Settings(100)).count() == 0


def test_overlap(spark):
    df = spark.createDataFrame([("aaaa\nbbbb\ncccc\n\ndddd\n\neeee",)], "text string")
    rows = df.select(C.overlap(C.chunk_array(df["text"], C.Settings(3)), 2)).first()[0]
    assert [r["text"] for r in rows] == ["aaaa\nbbbb\ncccc", "bbbb\ncccc\n\ndddd\n\neeee"]
