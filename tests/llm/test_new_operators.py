"""Token files, the divergence audit and conversation repair against plain versions."""

import hashlib
import itertools
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from test_operators import rows
from tokenizers import Tokenizer

from corpusloom.llm import divergence, repair, token_files
from corpusloom.llm.common import scratch
from corpusloom.llm.tokenize import _bytes_of, ending_ranks, spaced

WORDS = public_tokenizers.path("word_bpe_49k.json")
BYTES = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def docs(spark):
    # Further columns that have the names of results.
    return spark.createDataFrame([(*r, 7, "x", 1) for r in rows()], "doc_id long, text string, lang string, source string, start int, term string, value int")


# Token files


@pytest.mark.parametrize("bits", [1, 3, 8, 13, 16, 17, 24, 31])
def test_packing_bits(bits):
    ids = np.random.default_rng(bits).integers(0, 1 << bits, 1003).astype("<u4")
    data = token_files.pack(ids, bits)
    assert len(data) == -(-1003 * bits // 8)
    assert (token_files.unpack(data, bits, 1003) == ids).all() and (token_files.unpack(data, bits, 90, 800) == ids[800:890]).all()
    with pytest.raises(ValueError):
        token_files.pack(np.array([1 << bits], np.int64), bits)


def test_width():
    assert [token_files.width(n) for n in (1, 2, 3, 256, 257, 49_408, 65_536, 65_537)] == [1, 1, 2, 8, 9, 16, 16, 17]


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("aAeEszΣσςİJ \n\t\r.,;:!?'0é̌́  文𝔘<|>-ß")), max_size=40))
def test_words_by_themselves_give_the_same_ids(text):
    assert np.frombuffer(spaced(WORDS).many([text])[0], "<u4").tolist() == _library(WORDS).encode(text, add_special_tokens=False).ids


def test_words_of_texts_by_merges(spark):
    """Every word of real texts, and made ones of all Latin letters, through the merges and through the library."""
    texts = [r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()]
    rng = np.random.default_rng(1)
    letters = [chr(c) for c in (*range(0x21, 0x7F), *range(0xA1, 0x250))]
    texts += ["".join(rng.choice(letters, rng.integers(1, 12))) for _ in range(20_000)] + [w + e for w in ("don't", "it's", "we'll", "1234", "a_b", "x²½", "ŉ", "Ǆ", "ẞ") for e in ("", ".", "'S", "\u200b")]
    spaced.cache_clear()
    assert spaced(WORDS).fast
    assert [np.frombuffer(x, "<u4").tolist() for x in spaced(WORDS).many(texts)] == [x.ids for x in _library(WORDS).encode_batch_fast(texts, add_special_tokens=False)]


def test_merges_are_those_of_the_library():
    """Each merged token's own bytes, merged by the ranks below its own, end as the pair that the file names: so parts that make up a
    token are always that pair, and merging by what results is the same as merging by pairs."""
    import json

    with open(WORDS, encoding="utf-8") as f:
        settings_ = json.load(f)
    ranked, _ = ending_ranks(settings_)
    of, suffix = _bytes_of(), "</w>"
    raw = lambda t: bytes(of[c] for c in t.removesuffix(suffix)) + (b"\x01" if t.endswith(suffix) else b"")
    for m in settings_["model"]["merges"]:
        a, b = (raw(x) for x in (m.split(" ") if isinstance(m, str) else m))
        parts, own = [bytes([x]) for x in a + b], ranked[a + b]
        while True:
            found = [(ranked.get(x + y, own), k) for k, (x, y) in enumerate(itertools.pairwise(parts))]
            best, k = min(found)
            if best >= own:
                break
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
        assert parts == [a, b]


_loaded: dict = {}


def _library(path):
    return _loaded.setdefault(path, Tokenizer.from_file(path))


def test_added_tokens_and_other_tokenizers():
    texts = ["a <|endoftext|> b", "<|startoftext|>", "it's 12 o'clock.", ""]
    for path in (WORDS, BYTES):
        spaced.cache_clear()
        assert [np.frombuffer(x, "<u4").tolist() for x in spaced(path).many(texts)] == [_library(path).encode(t, add_special_tokens=False).ids for t in texts]
    spaced.cache_clear()


def _plain_ids(pairs, end):
    ids = [(i, [*_library(WORDS).encode(t or "", add_special_tokens=False).ids, end]) for i, t in pairs]
    return sorted(ids, key=lambda x: (x[0] is not None, x[0] or 0))


def test_files_of_awkward_rows(spark, docs):
    folder = scratch(spark)
    more = docs.unionByName(docs.limit(1).selectExpr("cast(null as long) as doc_id", "'no id' as text", "lang", "source", "start", "term", "value"))
    files = token_files.write(more, folder, WORDS, 49_408, 2, file_bytes=4000).collect()
    got = sorted(token_files.read(spark, folder).collect(), key=lambda r: r["start"])
    want = _plain_ids([(r["doc_id"], r["text"]) for r in more.select("doc_id", "text").collect()], 2)
    assert [r["doc_id"] for r in got] == [i for i, _ in want] and len(files) > 3
    assert Counter((r["doc_id"], r["n_tokens"], r["ids_crc32"], bytes(r["ids"])) for r in got) == Counter((i, len(x), zlib.crc32(np.array(x, "<u4").tobytes()), np.array(x, "<u4").tobytes()) for i, x in want)
    assert [r["start"] for r in got] == np.concatenate(([0], np.cumsum([r["n_tokens"] for r in got])[:-1])).tolist()
    # Random access: any stretch of a file, and any document of it.
    every = np.concatenate([np.frombuffer(bytes(r["ids"]), "<u4") for r in got])
    for f in files:
        reader = token_files.Reader(f["file"])
        for a, b in ((0, reader.n_ids), (reader.n_ids // 3, reader.n_ids // 2), (5, 5)):
            assert (reader.ids(a, b) == every[f["start"] + a : f["start"] + b]).all()
        assert reader.document(reader.documents.num_rows - 1)[-1] == 2 and reader.bits == 16
        reader.close()


def test_files_of_text_ids_and_of_nothing(spark, docs):
    folder = scratch(spark)
    named = docs.selectExpr("concat('d', doc_id) as doc_id", "text")
    token_files.write(named, folder, WORDS, 49_408, 2)
    assert Counter(r["doc_id"] for r in token_files.read(spark, folder, "string").collect()) == Counter(r["doc_id"] for r in named.collect())
    folder = scratch(spark)
    assert token_files.write(docs.limit(0), folder, WORDS, 49_408, 2).collect() == []
    assert token_files.read(spark, folder).collect() == []


def test_equal_rows_are_spread_over_files(spark):
    same = spark.range(4000).selectExpr("1L as doc_id", "'the same words again and again' as text")
    folder = scratch(spark)
    files = token_files.write(same, folder, WORDS, 49_408, 2, file_bytes=4000).collect()
    assert len(files) > 8 and max(f["docs"] for f in files) < 1000
    got = token_files.read(spark, folder).collect()
    assert sorted(r["start"] for r in got) == [7 * k for k in range(4000)]


def test_a_cut_off_file_is_not_read(tmp_path):
    writer = token_files.Writer(f"file://{tmp_path}/x/ids.bin", 16)
    writer.add(np.arange(20_000, dtype="<u4"))
    import pyarrow as pa

    writer.close(pa.array([1]))
    data = (tmp_path / "x" / "ids.bin").read_bytes()
    (tmp_path / "y.bin").write_bytes(data[:-7])
    with pytest.raises(ValueError):
        token_files.Reader(f"{tmp_path}/y.bin")


# Divergence

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def plain_levels(pairs, least=3):
    found, documents, groups = defaultdict(Counter), defaultdict(Counter), set()
    for lang, source, text in pairs:
        terms = [re.sub("[A-Z]", lambda m: m[0].lower(), t) for t in TERM.findall(text)]
        groups.add((lang, source))
        found[lang, source].update(terms)
        documents[lang].update(set(terms))
    kept = {lang: [t for t, n in c.items() if n >= least] for lang, c in documents.items()}
    kept |= {lang: kept.get(lang, []) for lang, _ in groups}
    return found, groups, kept


def plain_audit(pairs):
    found, groups, kept = plain_levels(pairs)
    share = lambda n, total, v: 1 + 1_000_000_000 * (n + 1) // (total + v)
    p, out = {}, []
    for lang, source in groups:
        total = sum(found[lang, source][t] for t in kept[lang])
        p[lang, source] = {t: share(found[lang, source][t], total, len(kept[lang])) for t in kept[lang]}
    for lang, source in groups:
        mine = p[lang, source]
        pair = [(other, sum((mine[t] - q) ** 2 // q for t, q in p[lang, other].items())) for one, other in groups if one == lang and other != source]
        all_ = {t: sum(found[lang, s][t] for one, s in groups if one == lang) for t in kept[lang]}
        q = {t: share(n, sum(all_.values()), len(kept[lang])) for t, n in all_.items()}
        term = [(t, (mine[t] - q[t]) ** 2 // q[t]) for t in kept[lang] if found[lang, source][t] and mine[t] > q[t]]
        for part, rows_, most in (("pair", pair, None), ("term", term, 200)):
            out += [(lang, source, part, i, v, k + 1) for k, (i, v) in enumerate(sorted(rows_, key=lambda x: (-x[1], x[0].encode()))[:most])]
    return sorted(out)


def _named(df):
    return [(r["lang"] or "", r["source"] or "", r["text"] or "") for r in df.select("lang", "source", "text").collect()]


def test_audit_of_awkward_rows(docs):
    assert sorted(tuple(r) for r in divergence.audit(docs).collect()) == plain_audit(_named(docs))
    assert divergence.audit(docs.limit(0)).collect() == []


def test_audit_of_many_sources(spark):
    """More sources than a tile holds, sources and a language without kept terms, and counts at many levels."""
    rng = np.random.default_rng(3)
    vocabulary = [f"{a}{b}" for a in "abcdefghij" for b in "klmnoÉß"]
    texts = [("en", f"s{k % 70}", " ".join(rng.choice(vocabulary, rng.integers(0, 60), p=None))) for k in range(300)] + [("en", "empty", "1 2 3"), ("xx", "a", "once"), ("xx", "b", "twice"), (None, "lone", "word word word")]
    df = spark.createDataFrame(texts, "lang string, source string, text string").repartition(5)
    assert sorted(tuple(r) for r in divergence.audit(df).collect()) == plain_audit(_named(df))


def test_joint_tables(spark, docs):
    df = docs.unionByName(docs).unionByName(docs)
    found, groups, kept = plain_levels(_named(df))
    got = {(r["lang"], r["source"], r["item"], r["p"], r["q"]): r["terms"] for r in divergence.joint_tables(df).collect()}
    want = Counter()
    for lang, a in groups:
        for other, b in groups:
            if other == lang and a != b:
                v = len(kept[lang])
                total = {s: sum(found[lang, s][t] for t in kept[lang]) for s in (a, b)}
                for t in kept[lang]:
                    want[(lang, a, b, *(1 + 1_000_000_000 * (found[lang, s][t] + 1) // (total[s] + v) for s in (a, b)))] += 1
    assert got == dict(want)


def test_long_texts_are_cut_between_words():
    text = (b"word " * 500_000).translate(divergence._LETTERS)
    assert Counter(w for p in divergence._pieces(text) for w in p) == {b"word": 500_000}


# Repair


def plain_damage(found):
    """Rows (conv, turn, role, text) after the damage, by conversation, in order."""
    of = defaultdict(list)
    blank = lambda x: " " if x is None else str(x)
    for conv, turn, role, text in found:
        role, text = blank(role), blank(text)
        code = zlib.crc32(f"{blank(conv)}:{blank(turn)}".encode()) % 20
        of[conv] += []
        if code:
            role, text = "user" if code == 4 else role, "" if code == 1 else re.sub("[.!?]", "", text) if code == 2 else text
            of[conv] += [(turn, role, text)] * (2 if code == 3 else 1)
    return {c: sorted(x, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2])) for c, x in of.items()}


def plain_faults(turns):
    out = []
    for k, (_, role, text) in enumerate(turns):
        bare = text.rstrip(" \t\n\x0b\x0c\r")
        out.append("blank" if not bare else "duplicate" if any((r, t) == (role, text) for _, r, t in turns[:k]) else "truncated" if bare[-1] not in ".!?" else "sound")
    return out


def plain_repair(turns):
    """Over all turns the cheapest edits to each state of the grammar (0 nothing, 1 s, 2 u open, 3 complete), by full strings."""
    after = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
    best = {0: (0, "", ())}
    name = {"u": "user", "a": "assistant"}

    def filled(best):
        for _ in range(3):
            for s, (cost, audit, lines) in list(best.items()):
                for x in "ua":
                    if (s, x) in after:
                        new = (cost + 5, audit + "I", (*lines, f"{name[x]}:"))
                        best[after[s, x]] = min(best.get(after[s, x], new), new)
        return best

    for (_, role, text), fault in zip(turns, plain_faults(turns), strict=True):
        new = defaultdict(list)
        for s, (cost, audit, lines) in filled(best).items():
            new[s].append((cost + 2, audit + "D", lines))
            if fault in ("sound", "truncated"):
                extra = 5 if fault == "truncated" else 0
                if (s, role[:1]) in after:
                    new[after[s, role[:1]]].append((cost + extra, audit + "K", (*lines, f"{role}:{text}")))
                for x in "ua":
                    if (s, x) in after:
                        new[after[s, x]].append((cost + 1 + extra, audit + "R", (*lines, f"{name[x]}:{text}")))
        best = {s: min(x) for s, x in new.items()}
    cost, audit, lines = min(x for s, x in filled(best).items() if s in (0, 3))
    return cost, audit, "\n".join(lines)


def all_edits(turns):
    """Every way to edit a few turns, with at most two insertions at a place."""
    puts = ["", "u", "a", "ua", "au", "uu", "aa"]
    name = {"u": "user", "a": "assistant"}
    ways = []
    for (_, role, text), fault in zip(turns, plain_faults(turns), strict=True):
        extra = 5 if fault == "truncated" else 0
        ways.append([(2, "D", "", "")] + ([(extra, "K", role[:1], f"{role}:{text}")] + [(1 + extra, "R", x, f"{name[x]}:{text}") for x in "ua"] if fault in ("sound", "truncated") else []))
    found = []
    for ins in itertools.product(puts, repeat=len(turns) + 1):
        for edits in itertools.product(*ways):
            initials = ins[0] + "".join(e[2] + i for e, i in zip(edits, ins[1:], strict=True))
            if re.fullmatch("(s?(ua)+)?", initials):
                audit = "I" * len(ins[0]) + "".join(e[1] + "I" * len(i) for e, i in zip(edits, ins[1:], strict=True))
                found.append((5 * sum(map(len, ins)) + sum(e[0] for e in edits), audit))
    return min(found)


def plain_row(conv, turns):
    kinds = Counter(plain_faults(turns))
    numbers = [t for t, _, _ in turns if t is not None]
    gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(turns))
    cost, audit, text = plain_repair(turns)
    return (conv, gaps, kinds["blank"], kinds["duplicate"], kinds["truncated"], illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest())


def check(df):
    want = {c: plain_row(c, x) for c, x in plain_damage([(r["conv_id"], r["turn"], r["role"], r["text"]) for r in df.select("conv_id", "turn", "role", "text").collect()]).items()}
    got = repair.repair(df).collect()
    assert len(got) == len(want)
    for r in got:
        assert tuple(r) == want[r["conv_id"]]


def _conversations(spark, found):
    # Further columns that have the names of results.
    return spark.createDataFrame([(*r, "x", 3) for r in found], "conv_id long, turn long, role string, text string, audit string, seg int")


def test_repair_of_awkward_rows(spark, data):
    rng = np.random.default_rng(5)
    roles, texts = ["user", "assistant", "system", "tool", "", None, "ubuntu", "a"], ["Yes.", "no", "", " \n", None, "What?! ", "One. Two", "ünï!", "Yes."]
    found = [(c, None if rng.random() < 0.05 else int(t * 2 if c % 3 else t), roles[rng.choice(8, p=[0.35, 0.35, 0.1, 0.04, 0.04, 0.04, 0.04, 0.04])], texts[rng.integers(0, 9)]) for c in range(300) for t in range(rng.integers(1, 9))]
    found += [(None, t, "user", "Alone.") for t in range(3)] + [(-7, None, "assistant", "x") for _ in range(3)] + [(1000 + k, 0, "user", "Hi.") for k in range(60)]
    check(_conversations(spark, found).repartition(3))
    check(spark.read.parquet(f"{data}/conversations.parquet"))
    none = _conversations(spark, found).limit(0)
    assert repair.repair(none).collect() == []


def test_a_long_conversation_is_cut_and_chained(spark):
    rng = np.random.default_rng(6)
    roles = ["user", "assistant", "system"]
    found = [(9, t, roles[rng.choice(3, p=[0.45, 0.45, 0.1])], f"Turn {rng.integers(0, 1500)}{'.' if rng.random() < 0.7 else ''}") for t in range(3000)]
    found += [(8, 1, "user", "Again.")] * 1200
    check(_conversations(spark, found).repartition(4))


def test_edits_against_all_edits():
    rng = np.random.default_rng(7)
    texts = ["Yes.", "No", "", "Well!"]
    for _ in range(60):
        turns = [(k, ["user", "assistant", "system", "tool"][rng.integers(0, 4)], texts[rng.integers(0, 4)]) for k in range(rng.integers(0, 4))]
        assert plain_repair(turns)[:2] == all_edits(turns)


def test_the_stack_has_few_nodes():
    assert len(repair.STACKS.nodes) == 8 and repair.STACKS.accepting == {k for k, (s, _) in enumerate(repair.STACKS.nodes) if s in (0, 3, 4)}
    for word in ("", "ua", "sua", "uaua", "suaua", "s", "u", "su", "uau", "au", "uu", "ss", "uas"):
        node = 0
        for x in word:
            node = None if node is None else repair.STACKS.after(node, x)
        assert (node in repair.STACKS.accepting) == bool(re.fullmatch("(s?(ua)+)?", word))
