"""Byte-level BPE by a public rank file, for texts of any length."""

from __future__ import annotations

import base64
import re

#: Fixed value: the split pattern of the byte-level vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Fixed value: the characters that the pattern's \s takes.
_SPACE = r"\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_LONG_RUN = re.compile(f"[{_SPACE}]{{10000,}}")


class Encoder:
    """Token ids of texts. special: strings that are one token each, with the ids after the vocabulary's."""

    def __init__(self, ranks: bytes, name: str = "bpe", special: tuple[str, ...] = ()):
        import numpy as np
        import tiktoken

        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
        first = max(table.values()) + 1
        self.special = {s: first + i for i, s in enumerate(special)}
        self.model = tiktoken.Encoding(name, pat_str=PATTERN, mergeable_ranks=table, special_tokens=self.special)
        self.bytes = {i: b for b, i in table.items()} | {i: s.encode() for s, i in self.special.items()}
        self.sizes = np.zeros(first + len(special), np.int64)
        for i, b in self.bytes.items():
            self.sizes[i] = len(b)
        self._marks = re.compile("(" + "|".join(map(re.escape, sorted(special, key=len, reverse=True))) + ")") if special else None

    def encode(self, text: str):
        """Ids as a uint32 array; special strings are their own tokens."""
        import numpy as np

        if _LONG_RUN.search(text):
            parts = self._marks.split(text) if self._marks else [text]
            ids = [[self.special[p]] if i % 2 else self._ordinary(p) for i, p in enumerate(parts)]
            return np.array([x for p in ids for x in p], np.uint32)
        return self.model.encode_to_numpy(text, allowed_special="all", disallowed_special=())

    def _ordinary(self, text: str) -> list[int]:
        """Ids of a text without special strings, cut at long runs of white space, which the pattern's engine can't hold.

        Before other text such a run is one piece without its last character, and that character goes with what
        follows; at the end of a text the run is one piece. Nothing else in the pattern reaches over such a run.
        """
        out, at = [], 0
        for run in _LONG_RUN.finditer(text):
            last = run.end() == len(text)
            out += self.model.encode_ordinary(text[at : run.start()])
            out += self.model._encode_single_piece(text[run.start() : run.end() - (not last)])
            at = run.end() - (not last)
        return out + self.model.encode_ordinary(text[at:])

    def count(self, text: str) -> int:
        return len(self._ordinary(text)) if _LONG_RUN.search(text) else len(self.model.encode_ordinary(text))
