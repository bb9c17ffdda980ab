"""Text pieces that several operators share: words, byte-level vocabularies and pre-tokens."""

from __future__ import annotations

import json
from functools import lru_cache

import regex

#: Fixed value: the pattern that splits a text before byte-level merges.
PRE_TOKEN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")


def words(text: str | None) -> list[bytes]:
    """Runs of bytes other than space and 0x09-0x0D (what ``bytes.split`` splits at); none for null."""
    return text.encode().split() if text else []


class Vocabulary:
    """A byte-level BPE file: bytes of each id, ids of single bytes, ranks of merges, special strings."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes shown as themselves; others from 256 on
        shown = {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(x for x in range(256) if x not in set(plain))}
        back = {c: b for b, c in shown.items()}
        self.shown = {b: c for b, c in shown.items()}
        vocab = spec["model"]["vocab"]
        self.bytes_of = {i: bytes(back[c] for c in s) for s, i in vocab.items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.bytes_of |= {i: s.encode() for s, i in self.special.items()}
        self.byte_id = [vocab[shown[b]] for b in range(256)]
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, m in enumerate(spec["model"]["merges"]):
            a, b = m.split(" ") if isinstance(m, str) else m
            self.merges[vocab[a], vocab[b]] = (rank, vocab[a + b])
        self._cut = regex.compile("(" + "|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None

    def sections(self, text: str) -> list[str]:
        """Ordinary text at even places, special strings at odd ones."""
        if self._cut is None or not any(s in text for s in self.special):
            return [text]
        return self._cut.split(text)

    def pre_tokens(self, text: str | None) -> list[str]:
        """Pre-tokens in order; a special string in the text is one."""
        out: list[str] = []
        for k, s in enumerate(self.sections(text or "")):
            if k % 2:
                out.append(s)
            else:
                out += PRE_TOKEN.findall(s)
        return out


@lru_cache(maxsize=4)
def vocabulary(path: str) -> Vocabulary:
    """The file's vocabulary, read once in each process."""
    return Vocabulary(path)
