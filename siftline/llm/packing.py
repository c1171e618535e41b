"""Operator 4: best-fit packing of token sequences by large-item matching.

Pieces are packed by length, not one by one. How many pieces have each length is a table of
at most `capacity` rows, whatever the corpus; the plan is made from it on the driver:

1. a piece of full length is a sequence of its own;
2. pieces above one third of the capacity are matched greedily, at most two in a sequence:
   the longest piece left takes the longest partner that still fits;
3. smaller pieces, longest first, go to the smallest gap that holds them, and open new
   sequences when none does.

All sequences that look alike are planned at once, so the plan has a few thousand runs. A
piece's rank among those of its length (two-level counting, so that a length held by any
share of the rows is split) then says where it goes, by binary search in the runs.

Edge cases: a null or empty text is its end token alone; a text longer than the capacity is
cut so that only its first piece is shorter; runs of white space may have any length; repeated rows are packed like others, null ids
too; an empty table gives no rows; extra columns are not carried.
"""

from __future__ import annotations

import base64
import zlib
from bisect import bisect_left, insort
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .byte_bpe import ByteBpe, byte_bpe
from .common import dense_slots, materialize, numbered, own_id, table

CAPACITY = 2048


def token_pieces(text: str | None, enc: ByteBpe, capacity: int = CAPACITY, end: int = 0) -> list[tuple[int, int, int, int]]:
    """(piece, start, length, crc32 of its little-endian ids) of one document."""
    ids = np.array([*enc.ids_with_special(text or ""), end], dtype="<u4")
    first = (len(ids) - 1) % capacity + 1
    cuts = [0, *range(first, len(ids) + 1, capacity)]
    return [(i, a, b - a, zlib.crc32(ids[a:b].tobytes())) for i, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))]


def _tokenize(path: str, capacity: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = byte_bpe(path)
        for batch in batches:
            ids, rows = [], []
            for doc_id, text in zip(batch["doc_id"], batch["text"], strict=True):
                got = token_pieces(text if isinstance(text, str) else None, enc, capacity)
                rows += got
                ids += [doc_id] * len(got)
            out = pd.DataFrame(rows, columns=["piece", "start", "length", "ids_crc32"])
            out.insert(0, "doc_id", np.array(ids, np.int64))
            yield out

    return run


def plan_runs(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """Runs (length, first rank, pieces, first sequence, offset): ranks in a run go to sequences in order."""
    left = {k: n for k, n in counts.items() if n > 0}
    used: Counter = Counter()
    runs: list[tuple[int, int, int, int, int]] = []
    sequences = 0
    gaps: dict[int, list[tuple[int, int]]] = {}  # room -> (first sequence, number)
    rooms: list[int] = []  # the keys of gaps, sorted

    def put(length: int, n: int, sequence: int, offset: int) -> None:
        runs.append((length, used[length], n, sequence, offset))
        used[length] += n
        left[length] -= n

    def leave(room: int, sequence: int, n: int) -> None:
        if room > 0 and n > 0:
            if room not in gaps:
                gaps[room] = []
                insort(rooms, room)
            gaps[room].append((sequence, n))

    large = sorted((k for k in left if 3 * k > capacity), reverse=True)
    partners = large[::-1]  # ascending
    for a in large:
        while left[a]:
            fit = next((b for b in reversed(partners[: bisect_left(partners, capacity - a + 1)]) if b <= a and left[b] > (b == a)), None)
            n = left[a] if fit is None else left[a] // 2 if fit == a else min(left[a], left[fit])
            put(a, n, sequences, 0)
            if fit is not None:
                put(fit, n, sequences, a)
            leave(capacity - a - (fit or 0), sequences, n)
            sequences += n
    for s in sorted((k for k in left if 3 * k <= capacity), reverse=True):
        while left[s]:
            at = bisect_left(rooms, s)
            if at == len(rooms):
                n = -(-left[s] // (capacity // s))
                leave(capacity, sequences, n)
                sequences += n
                continue
            room = rooms[at]
            first, n = gaps[room].pop()
            if not gaps[room]:
                del gaps[room], rooms[at]
            take = min(n, left[s])
            put(s, take, first, capacity - room)
            leave(room - s, first, take)
            leave(room, first + take, n - take)
    return runs


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    pieces = materialize(
        numbered(docs, "text").mapInPandas(
            _tokenize(tokenizer, capacity), "doc_id long, piece int, start long, length long, ids_crc32 long"
        ),
        "pieces",
    )
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    runs = sorted(plan_runs(counts, capacity))
    shift = 1 << 45
    keys = np.array([r[0] * shift + r[1] for r in runs], dtype=np.int64)
    starts, sequences, offsets = (np.array([r[i] for r in runs], dtype=np.int64) for i in (1, 3, 4))

    @F.pandas_udf("sequence_id long, offset long")
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        at = np.searchsorted(keys, length.to_numpy() * shift + rank.to_numpy(), side="right") - 1
        return pd.DataFrame({"sequence_id": sequences[at] + rank.to_numpy() - starts[at], "offset": offsets[at]})

    ranked = dense_slots(pieces, ["length"], ["doc_id", "piece", "ids_crc32"], sum(counts.values()), "_rank")
    return ranked.withColumn("_at", place("length", "_rank")).select(
        own_id().alias("doc_id"), "piece", "start", "length", "ids_crc32", "_at.sequence_id", "_at.offset"
    )


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pack(docs, public_tokenizers.path("byte_bpe_50k.json"))
