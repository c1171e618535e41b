"""Operator 3: how many tokens a unigram tokenizer makes of each text, without making them.

The vocabulary and its scores come from a SentencePiece model file. An Aho-Corasick automaton
lists the pieces that end at each character; dynamic programming carries the best score up to
there and that path's number of tokens, nothing else. Tie rules are the tokenizer's: of equal
scores the piece that starts first wins, and a character that is no piece by itself may also be an
unknown one, of the least score less 10, which loses ties. Unknown characters count as their
bytes if the vocabulary has byte pieces, else a run of them counts as one.

No piece has a space mark after another character, so a text falls into stretches (space marks,
then other characters) that are scored one by one; scores are whole numbers, so their sums are
exact in any order, and a task may remember the results of stretches it has met.

Edge cases: a null or empty text has no tokens and score 0; a null doc_id stays; repeated rows are
counted each; very long texts and stretches take time in proportion; an empty table gives no
rows; extra columns are left out.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from .common import numbered, own_id, table

MARK = "▁"
UNKNOWN_PENALTY = 10.0
#: Stretches a task remembers at most.
CACHE_STRETCHES = 300_000
_STRETCH = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")


def read_vocabulary(path: str) -> tuple[dict[str, float], bool]:
    """Pieces with their scores, and whether unknown characters fall back to bytes."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = range(model.get_piece_size())
    special = lambda i: model.is_unknown(i) or model.is_control(i) or model.is_unused(i) or model.is_byte(i)
    pieces = {model.id_to_piece(i): model.get_score(i) for i in ids if not special(i)}
    return pieces, sum(map(model.is_byte, ids)) == 256


class Counter(dict):
    """Stretch -> (tokens, score)."""

    def __init__(self, pieces: dict[str, float], bytes_for_unknown: bool):
        super().__init__()
        if any(MARK in p.lstrip(MARK) for p in pieces):
            raise ValueError("a piece has a space mark inside; stretches would not be independent")
        if any(s != int(s) for s in pieces.values()):
            raise ValueError("scores must be whole numbers, else their sums depend on the order")
        self.automaton = ahocorasick.Automaton()
        for piece, score in pieces.items():
            self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.unknown = min(pieces.values()) - UNKNOWN_PENALTY
        self.bytes_for_unknown = bytes_for_unknown

    def __missing__(self, stretch: str) -> tuple[int, float]:
        if len(self) >= CACHE_STRETCHES:
            self.clear()
        self[stretch] = out = self.count(stretch)
        return out

    def count(self, stretch: str) -> tuple[int, float]:
        best: list[float | None] = [0.0] + [None] * len(stretch)
        tokens = [0] * (len(stretch) + 1)
        unknown_end = [False] * (len(stretch) + 1)
        at = 0
        single = False
        for end, (size, score) in self.automaton.iter(stretch):
            while at < end:  # characters before, at which no piece ends (any more)
                self._unknown(stretch, at, single, best, tokens, unknown_end)
                at, single = at + 1, False
            start = end + 1 - size
            total = best[start] + score
            if best[end + 1] is None or total > best[end + 1]:
                best[end + 1], tokens[end + 1], unknown_end[end + 1] = total, tokens[start] + 1, False
            single = single or size == 1
        while at < len(stretch):
            self._unknown(stretch, at, single, best, tokens, unknown_end)
            at, single = at + 1, False
        return tokens[-1], best[-1]

    def _unknown(self, stretch: str, at: int, single: bool, best: list, tokens: list, unknown_end: list) -> None:
        """Let the character at `at` be unknown, if it is no piece and that is better."""
        if single:
            return
        total = best[at] + self.unknown
        if best[at + 1] is None or total > best[at + 1]:
            if self.bytes_for_unknown:
                more = len(stretch[at].encode("utf-8", "surrogatepass"))
            else:
                more = 0 if unknown_end[at] else 1
            best[at + 1], tokens[at + 1], unknown_end[at + 1] = total, tokens[at] + more, True

    def text(self, text: str | None) -> tuple[int, float]:
        if not text:
            return 0, 0.0
        marked = MARK + text.replace(" ", MARK)
        n = score = 0
        for stretch in _STRETCH.findall(marked):
            a, b = self[stretch]
            n += a
            score += b
        return n, float(score)


@lru_cache(maxsize=2)
def counter(path: str) -> Counter:
    return Counter(*read_vocabulary(path))


def _count(path: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = counter(path)
        for batch in batches:
            got = [known.text(t if isinstance(t, str) else None) for t in batch["text"]]
            yield pd.DataFrame({"doc_id": batch["doc_id"], "n_tokens": [x[0] for x in got], "score": [x[1] for x in got]})

    return run


def count_tokens(docs: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id, n_tokens and the best path's score for every row of `docs` (doc_id, text)."""
    counted = numbered(docs, "text").mapInPandas(_count(vocabulary), "doc_id long, n_tokens long, score double")
    return counted.withColumn("doc_id", own_id())


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return count_tokens(table(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path("piece_bpe_32k.model"))
