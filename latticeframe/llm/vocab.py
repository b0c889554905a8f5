"""Loaders of public tokenizer files. A file is named by path; it is read where it is used and never copied."""

from __future__ import annotations

import base64
import functools
import hashlib
import json
import re
from collections.abc import Iterator

import public_tokenizers
import regex

BYTE_RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
BYTE_JSON = public_tokenizers.path("byte_bpe_50k.json")
PATTERN = public_tokenizers.PATTERN


@functools.lru_cache(maxsize=4)
def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to rank, from a rank file of lines `base64 rank`."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


@functools.lru_cache(maxsize=4)
def rank_encoding(path: str, pattern: str = PATTERN):
    import tiktoken

    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=read_ranks(path), special_tokens={})


#: White space in a row from which a text is split outside the rank library, whose own matcher gives up near a million; looked
#: for from the beginning of a run only, so that each run is read once.
LONG_GAP = re.compile(r"(?<!\s)\s{100000}")
#: One character of each class of the split pattern for characters whose class the two matchers see differently.
STAND_INS = {r"\p{L}": "\u4e00", r"\p{N}": "0", r"\s": "\u2003"}
OTHER = "\ue000"


def _all_characters() -> str:
    return "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))


def class_members(cls: str) -> set[str]:
    """All characters that the rank library's matcher takes for a class: only what matches is encoded, here as bytes."""
    import tiktoken

    probe = tiktoken.Encoding("probe", pat_str=cls, mergeable_ranks={bytes([b]): b for b in range(256)}, special_tokens={})
    return set(bytes(probe.encode_ordinary(_all_characters())).decode())


@functools.lru_cache(maxsize=1)
def class_changes() -> tuple[tuple[int, int, str], ...]:
    """(first, last, stand-in) of the runs of characters that the `regex` module puts in another class than the rank
    library does; the two follow different versions of Unicode."""
    text, changed = _all_characters(), {}
    theirs = {cls: class_members(cls) for cls in STAND_INS}
    for cls, members in theirs.items():
        for c in members ^ set(regex.findall(cls, text)):
            changed[ord(c)] = next((STAND_INS[k] for k, v in theirs.items() if c in v), OTHER)
    runs: list[list] = []
    for c in sorted(changed):
        if runs and runs[-1][1] == c - 1 and runs[-1][2] == changed[c]:
            runs[-1][1] = c
        else:
            runs.append([c, c, changed[c]])
    return tuple(map(tuple, runs))


class Splitter:
    """Pieces of a text as the rank library's matcher cuts them, by the `regex` module over a text of the same length in
    which characters of other classes have stand-ins. The pattern's classes are letters, numbers and white space."""

    def __init__(self, pattern: str, changes: tuple[tuple[int, int, str], ...]):
        self.rx = regex.compile(pattern)
        self.odd = re.compile("[" + "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b, _ in changes) + "]") if changes else None
        self.table = {c: s for a, b, s in changes for c in range(a, b + 1)}

    def shadow(self, text: str) -> str:
        return text.translate(self.table) if self.odd and not text.isascii() and self.odd.search(text) else text

    def pieces(self, text: str) -> Iterator[str] | list[str]:
        shadow = self.shadow(text)
        if shadow is text:
            return self.rx.findall(text)
        return [text[m.start() : m.end()] for m in self.rx.finditer(shadow)]


@functools.lru_cache(maxsize=4)
def piece_encoding(path: str):
    """An encoding that takes its whole input for one piece."""
    return rank_encoding(path, r"[\s\S]+")


def byte_of_letter() -> dict[str, int]:
    """Byte-level vocabularies write a byte as a letter: printable Latin-1 as itself, the others from U+0100 on, in order."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


@functools.lru_cache(maxsize=4)
def byte_level_json(path: str):
    """(encoding, special strings) of a plain byte-level BPE .json file as a rank encoding, or None where its
    normaliser, pre-tokenizer, special tokens or model are of another kind."""
    import tiktoken

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    pre, model, added = spec.get("pre_tokenizer") or {}, spec["model"], spec.get("added_tokens", [])
    plain = spec.get("normalizer") is None and pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space") and model.get("type") == "BPE" and not model.get("ignore_merges") and not model.get("dropout")
    simple = all(t["special"] and not (t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"]) for t in added)
    special = {t["content"]: t["id"] for t in added}
    if not (plain and simple):
        return None
    letters = byte_of_letter()
    ranks = {bytes(letters[c] for c in token): i for token, i in model["vocab"].items() if token not in special}
    # merges must be listed in the order of the ids they make, as rank merging takes the lowest id first
    made = ["".join(m) if isinstance(m, list) else m.replace(" ", "") for m in model["merges"]]
    ids = [model["vocab"][m] for m in made]
    if any(a >= b for a, b in zip(ids, ids[1:], strict=False)):
        return None
    return tiktoken.Encoding("json", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special), frozenset(special)


def file_digest(path: str) -> str:
    with open(path, "rb") as f:
        return hashlib.file_digest(f, "sha256").hexdigest()
