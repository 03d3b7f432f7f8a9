"""Byte-level BPE vocabularies in the JSON format of the ``tokenizers`` library.

Only files with a ByteLevel pre-tokeniser, no normaliser and merges in the order of their ids are accepted; anything else
raises, since the counts and ids below are exact for that kind alone.
"""

from __future__ import annotations

import functools
import json
import sys
import unicodedata

import numpy as np
import regex
import tiktoken
from tokenizers import Tokenizer

# The pattern of the ByteLevel pre-tokeniser.
BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
# The bytes that ByteLevel writes as the character of the same number; the others follow from 256 on.
_SHOWN = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]


def byte_characters() -> list[str]:
    """The character that stands for each byte in a ByteLevel vocabulary."""
    hidden = [b for b in range(256) if b not in set(_SHOWN)]
    place = {b: chr(b) for b in _SHOWN} | {b: chr(256 + i) for i, b in enumerate(hidden)}
    return [place[b] for b in range(256)]


class ByteBpe:
    """Vocabulary, special strings and the library's tokenizer of one file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre, model = spec["pre_tokenizer"] or {}, spec["model"]
        if (pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True)
                or spec["normalizer"] or model["type"] != "BPE" or model.get("dropout") or model.get("ignore_merges")):
            raise ValueError(f"{path}: not a plain byte-level BPE file")
        self.vocab: dict[str, int] = model["vocab"]
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        ids = [self.vocab[a + b] for a, b in merges]
        if ids != sorted(ids):
            raise ValueError(f"{path}: merges are not in the order of their ids")
        self.parts = {i: (self.vocab[a], self.vocab[b]) for i, (a, b) in zip(ids, merges, strict=True)}
        self.merged = {a << 32 | b: i for i, (a, b) in self.parts.items()}
        if min(ids, default=0) <= max((i for i in self.vocab.values() if i not in self.parts), default=0):
            raise ValueError(f"{path}: a single byte has an id among the merges")
        self.specials: dict[str, int] = {}
        for t in spec["added_tokens"]:
            if t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"]:
                raise ValueError(f"{path}: special string {t['content']!r} takes its surroundings")
            self.specials[t["content"]] = t["id"]
        self.characters = byte_characters()
        self.library = Tokenizer.from_file(path)
        self.model = self.library.model

    @functools.cached_property
    def reachable(self) -> dict[str, int]:
        """The tokens that their own text is encoded as; merges can leave others unused."""
        return {t: i for t, i in self.vocab.items() if t not in self.specials and len(self.model.tokenize(t)) == 1}

    def stay_apart(self, left: int, right: int) -> bool:
        """Whether two tokens side by side stay as they are when their joint text is encoded.

        A merge across the border joins a token of the left one's right edge with one of the right one's left edge. It happens
        if its rank comes before the merges that take these two into what they are part of. Ranks are ids here; the later
        of the two parts is undone step by step, and of equal merges the left one goes first.
        """
        merged, parts, limit = self.merged, self.parts, sys.maxsize
        while True:
            if merged.get(left << 32 | right, limit) < limit:
                return False
            if left > right:
                limit = left
                if left not in parts:
                    return True
                left = parts[left][1]
            else:
                limit = right + 1
                if right not in parts:
                    return True
                right = parts[right][0]

    @functools.cached_property
    def encoding(self) -> tiktoken.Encoding:
        """The same vocabulary in a second public encoder, several times as fast on whole texts."""
        byte_of = {c: b for b, c in enumerate(self.characters)}
        ranks = {bytes(byte_of[c] for c in token): i for token, i in self.vocab.items() if token not in self.specials}
        found = tiktoken.Encoding("byte-bpe", pat_str=BYTE_LEVEL, mergeable_ranks=ranks, special_tokens=self.specials)
        for probe in PROBES:
            if found.encode(probe, allowed_special="all") != self.library.encode(probe, add_special_tokens=False).ids:
                raise ValueError(f"the encoders differ on {probe!r}")
        return found

    def fast_ids(self, text: str) -> np.ndarray | None:
        """Ids by the second encoder; None where it gives up, which its regex does on white-space runs of about a million."""
        try:
            return self.encoding.encode_to_numpy(text, allowed_special="all").astype("<u4", copy=False)
        except ValueError as error:
            if "Regex error" not in str(error):
                raise
            return None


# Texts on which both encoders must agree before the fast one is used.
PROBES = ("", "Hello  world's\t12 345\n\n x", "naïve Straße élève año", "a b　c  ", "\r\n  \x85\x1c|", "日本語 🙂👍🏽 ع",
          "<|endoftext|> a<|endoftext|>b <|endoftext", "we'll've don'T 'tis ''s", "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa", "½ ² ⅷ ٣ 10e-3")


@functools.lru_cache(maxsize=1)
def settled_characters() -> frozenset[str]:
    """Characters that Unicode 3.2 had assigned already: every later version, and so every library, classes them alike.

    A text with any other character is split by the ``tokenizers`` library itself.
    """
    old = unicodedata.ucd_3_2_0
    return frozenset(c for c in map(chr, range(sys.maxunicode + 1)) if old.category(c) != "Cn")


def is_settled(text: str) -> bool:
    return text.isascii() or settled_characters().issuperset(text)


@functools.lru_cache(maxsize=4)
def load(path: str) -> ByteBpe:
    return ByteBpe(path)


@functools.lru_cache(maxsize=1)
def pattern() -> regex.Pattern:
    return regex.compile(BYTE_LEVEL)
