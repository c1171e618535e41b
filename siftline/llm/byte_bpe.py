"""A byte-level BPE from a tokenizers JSON file, for texts of any form.

The encoder's split pattern looks ahead after white space and fails on runs of about a million. Such
runs are cut where the pattern itself would: all but a run's last character are one piece, which
needs no pattern, and the last one belongs to what follows.
"""

from __future__ import annotations

import json
import re
from functools import lru_cache

#: White space as the split pattern sees it (the Unicode property).
_SPACES = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Characters of white space from which a run is cut out.
RUN = 10_000


class ByteBpe:
    def __init__(self, path: str):
        import public_tokenizers
        import tiktoken

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        special = {x["content"]: x["id"] for x in spec.get("added_tokens", [])}
        to_byte = _byte_alphabet()
        vocab = spec["model"]["vocab"]
        ranks = {bytes(to_byte[c] for c in piece): i for piece, i in vocab.items() if piece not in special}
        self.encoding = tiktoken.Encoding("bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)
        self.special = special
        self.size = max([*vocab.values(), *special.values()]) + 1
        self._split = re.compile("(" + "|".join(map(re.escape, sorted(special, key=len, reverse=True))) + ")") if special else None
        self._runs = re.compile(f"[{_SPACES}]{{{RUN},}}")

    def ids(self, text: str) -> list[int]:
        """Special tokens' strings are ordinary text."""
        out: list[int] = []
        at = 0
        for run in self._runs.finditer(text):
            end = run.end() if run.end() == len(text) else run.end() - 1
            if run.start() > at:
                out += self.encoding.encode_ordinary(text[at : run.start()])
            out += self.encoding._encode_single_piece(text[run.start() : end])
            at = end
        if at == 0:
            return self.encoding.encode_ordinary(text)
        return out + self.encoding.encode_ordinary(text[at:])

    def ids_with_special(self, text: str) -> list[int]:
        """Special tokens' strings are those tokens."""
        if self._split is None or not any(s in text for s in self.special):
            return self.ids(text)
        out: list[int] = []
        for part in self._split.split(text):
            out += [self.special[part]] if part in self.special else self.ids(part)
        return out


def _byte_alphabet() -> dict[str, int]:
    """Byte-level BPE writes each byte as a printable character: itself, or the next one from 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}


@lru_cache(maxsize=2)
def byte_bpe(path: str) -> ByteBpe:
    return ByteBpe(path)
