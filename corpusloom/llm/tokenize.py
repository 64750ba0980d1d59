"""Token ids of whole texts inside tasks, as the tokenizers library gives them."""

from __future__ import annotations

import json
import os
import re
from functools import lru_cache

import numpy as np

#: Longer texts are encoded in parts of about this many characters.
SPAN = 1 << 20
#: Longer runs of white space are left to the tokenizers library (the other one searches them with a bounded stack).
LONGEST_BLANK = 20_000
#: A place where a byte-level pattern always cuts: a lone space between two characters that are surely not white space.
_CUT = re.compile(r"(?<=[A-Za-z0-9.,;:!?])\x20(?=[A-Za-z0-9])")


@lru_cache(maxsize=1)
def encoder(path: str) -> Encoder:
    """The Python worker's own encoder, kept from task to task."""
    return Encoder(path)


def _bytes_of() -> dict[str, int]:
    """The character that stands for each byte in a byte-level vocabulary: itself if printable, else one from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(others)}


def ranks(settings: dict) -> dict[bytes, int] | None:
    """The vocabulary of a tokenizer file as bytes and ranks, if it is a plain byte-level BPE whose merges make tokens in
    the order of their ids; None otherwise."""
    model, before = settings["model"], settings["pre_tokenizer"] or {}
    plain = before.get("type") == "ByteLevel" and before.get("use_regex") and not before.get("add_prefix_space") and not settings["normalizer"] and not settings["truncation"] and not settings["padding"]
    if not plain or model["type"] != "BPE" or model.get("dropout") or model.get("continuing_subword_prefix") or model.get("end_of_word_suffix") or model.get("byte_fallback"):
        return None
    if any(a["single_word"] or a["lstrip"] or a["rstrip"] for a in settings["added_tokens"]):
        return None
    pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    made = [model["vocab"][a + b] for a, b in pairs]
    added = {a["content"] for a in settings["added_tokens"]}
    if made != sorted(set(made)) or len(made) + 256 != len(model["vocab"].keys() - added):
        return None
    of = _bytes_of()
    return {bytes(of[c] for c in token): i for token, i in model["vocab"].items() if token not in added}


@lru_cache(maxsize=1)
def spaced(path: str) -> SpacedEncoder:
    """The Python worker's own encoder by words, kept from task to task."""
    return SpacedEncoder(path)


def ending_ranks(settings: dict) -> tuple[dict[bytes, int], list[int]] | None:
    """The vocabulary of a BPE whose words end with a suffix, as bytes (END for the suffix) and merge ranks, and the id of each rank;
    None for a vocabulary of another kind. A byte and END merge first, as the model begins with them as one symbol."""
    model, of = settings["model"], _bytes_of()
    suffix = model.get("end_of_word_suffix")
    if model["type"] != "BPE" or not suffix or model.get("dropout") or model.get("continuing_subword_prefix") or model.get("byte_fallback") or model.get("ignore_merges"):
        return None

    def raw(token: str) -> bytes:
        return bytes(of[c] for c in token.removesuffix(suffix)) + (END if token.endswith(suffix) else b"")

    symbols = [*(c + suffix for c in of), *of]
    merged = ["".join(m.split(" ") if isinstance(m, str) else m) for m in model["merges"]]
    tokens = symbols + merged
    ranked = {raw(t): k for k, t in enumerate(tokens)}
    if len(ranked) != len(tokens) or not all(t in model["vocab"] for t in tokens):
        return None
    return ranked, [model["vocab"][t] for t in tokens]


#: Characters that stand for a word's end and for what parts words; texts that hold them are not taken apart.
END, PART = b"\x01", "\x02"


class SpacedEncoder:
    """many(texts): the ids of each, as bytes (little-endian unsigned 32-bit), as encode(text, add_special_tokens=False) of the tokenizers
    library gives them.

    A tokenizer that drops white space and never lets a word reach over it encodes words by themselves, so each distinct word
    is encoded once and what it gives is put together again. New words of Latin letters, digits and signs, in which lower case is the
    only change, are merged by tiktoken with the same merges (tests hold it against the library); other words, texts that hold
    an added token, and all texts under other tokenizers, are given to the library itself.
    """

    #: The steps before and the words of a tokenizer that drops white space.
    STEPS = ["NFC", "Replace", "Lowercase"]
    PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
    #: What no word for tiktoken holds.
    OTHER = re.compile("[^\x21-\x7e\xa1-\u024f]")
    #: Words remembered at most; then all are forgotten.
    MOST = 800_000

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core

        import regex
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            settings = json.load(f)
        before, cuts = (settings["normalizer"] or {}).get("normalizers", []), (settings["pre_tokenizer"] or {}).get("pretokenizers", [{}])
        added = settings["added_tokens"]
        self.cuts = (
            [x["type"] for x in before] == self.STEPS and before[1]["pattern"] == {"Regex": r"\s+"} and before[1]["content"] == " " and len(cuts) == 2
            and cuts[0].get("type") == "Split" and cuts[0]["pattern"] == {"Regex": self.PATTERN} and cuts[0]["behavior"] == "Removed" and cuts[0]["invert"]
            and cuts[1]["type"] == "ByteLevel" and not cuts[1]["use_regex"] and not cuts[1]["add_prefix_space"]
            and not settings["truncation"] and not settings["padding"] and not any(a["single_word"] or a["lstrip"] or a["rstrip"] or " " in a["content"] for a in added)
        )
        self.added = re.compile("|".join(re.escape(a["content"]) for a in added) or r"(?!)")
        ranked = ending_ranks(settings) if self.cuts else None
        self.fast = ranked and tiktoken.Encoding(path, pat_str=r"[^\x01]+\x01", mergeable_ranks=ranked[0], special_tokens={})
        self.ids = ranked and np.array(ranked[1], "<u4")
        self.words = regex.compile(self.PATTERN.replace("[^\\s", f"{PART}|[^{PART}\\s"))
        self.known: dict[str, bytes] = {}

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(x.ids, "<u4").tobytes() for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _merged(self, words: list[str]) -> list[bytes]:
        """The ids of words without any of OTHER, through tiktoken."""
        if not words:
            return []
        end = END.decode()
        found = np.array(self.fast.encode_ordinary(end.join(self.words.findall(PART.join(words).lower())) + end))
        parts = np.flatnonzero(found == self.fast.encode_ordinary(PART + end)[0])
        edges = np.concatenate(([-1], parts, [len(found)])).tolist()
        data = self.ids[found].tobytes()
        return [data[4 * (a + 1) : 4 * b] for a, b in zip(edges, edges[1:], strict=False)]

    def _learn(self, words: list[str]) -> None:
        plain = [w for w in words if w and not self.OTHER.search(w)] if self.fast else []
        others = list(set(words).difference(plain))
        for at in range(0, len(plain), 20_000):
            part = plain[at : at + 20_000]
            self.known.update(zip(part, self._merged(part), strict=True))
        self.known.update(zip(others, self._whole(others), strict=True))

    def many(self, texts: list[str]) -> list[bytes]:
        if not self.cuts:
            return self._whole(texts)
        words = [None if self.added.search(t) else t.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ") for t in texts]
        if len(self.known) > self.MOST:
            self.known = {}
        self._learn(list(set().union(*(w for w in words if w)).difference(self.known)))
        return [self._whole([t])[0] if w is None else b"".join(map(self.known.__getitem__, w)) for t, w in zip(texts, words, strict=True)]


class Encoder:
    """ids(text): what Tokenizer.encode(text, add_special_tokens=False).ids is for the tokenizer file at `path`.

    Plain byte-level BPE vocabularies are given to tiktoken, which merges the same tokens some five times as fast; the two
    libraries' patterns agree on every code point (tests check). Texts that hold an added token or an enormous run of white
    space, and all texts under other kinds of tokenizers, go to the tokenizers library itself. Nothing is remembered between texts.
    """

    #: A fixed value: how a byte-level tokenizer cuts texts into words.
    PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core

        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            settings = json.load(f)
        known = ranks(settings)
        self.fast = known and tiktoken.Encoding(path, pat_str=self.PATTERN, mergeable_ranks=known, special_tokens={})
        added = [re.escape(a["content"]) for a in settings["added_tokens"]]
        self.slow = re.compile("|".join([*added, rf"\s{{{LONGEST_BLANK}}}"]))

    def ids(self, text: str) -> np.ndarray:
        if not text:
            return np.zeros(0, "<u4")
        if not self.fast or self.slow.search(text):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4")
        if len(text) <= SPAN:
            return np.array(self.fast.encode_ordinary(text), "<u4")
        parts, at = [], 0
        while at < len(text):
            cut = _CUT.search(text, at + SPAN) if at + SPAN < len(text) else None
            end = cut.start() if cut else len(text)
            parts.append(np.array(self.fast.encode_ordinary(text[at:end]), "<u4"))
            at = end
        return np.concatenate(parts)
