"""Operator 12: tokens of two tokenizers aligned over the same bytes, by diagonal run skipping.

Both token sequences of a text are reduced to the byte offsets where their tokens end. Tokens go
one to one over long stretches, so the end arrays agree at a constant index shift (a
diagonal): stretches are jumped by comparing slices of doubling length at the current shift, and
halving them where they differ. Where the ends part, the smaller one is advanced until both meet; that
irregular group gives the new shift. Groups are the cuts at common ends; two tokens are linked
if their bytes overlap, which a stretch between any two neighbouring ends shows.

How many documents link a pair of ids is counted over the corpus: a task counts its documents'
pairs before they are shuffled. The counts return to the documents in two ways, so that no
table of unknown size is broadcast and no frequent pair meets in one task: the pairs with the
highest counts, HEAD_PAIRS at most, are sent to all tasks; all rarer ones are joined.

Edge cases: a null or empty text, and one that the pieces do not spell, has no tokens: zeros and an empty
digest; a null doc_id stays, repeated rows are documents of their own and counted each; very long texts and
runs of white space take time in proportion; an empty table gives no rows; extra columns are left out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .byte_bpe import byte_bpe
from .common import materialize, table

#: Pairs whose counts are sent to all tasks: 16 bytes each.
HEAD_PAIRS = 1_000_000
#: Text characters that are aligned together.
CHUNK_CHARS = 2_000_000
MARK = "▁"


def group_ends(a: list[int], b: list[int]) -> tuple[list[int], list[int]]:
    """For each group, in order, how many tokens of either side end with it. Both end at the same offset."""
    in_a: list[int] = []
    in_b: list[int] = []
    i = j = 0
    n = len(a)
    while i < n:
        run, step, growing = 0, 1, True
        while step:
            probe = a[i + run : i + run + step]
            if probe and probe == b[j + run : j + run + step]:
                run += len(probe)
                step = step * 2 if growing else step // 2
            else:
                growing = False
                step //= 2
        if run:
            in_a += range(i + 1, i + run + 1)
            in_b += range(j + 1, j + run + 1)
            i += run
            j += run
            if i == n:
                break
        x, y = a[i], b[j]
        while x != y:
            if x < y:
                i += 1
                x = a[i]
            else:
                j += 1
                y = b[j]
        i += 1
        j += 1
        in_a.append(i)
        in_b.append(j)
    return in_a, in_b


class Side(NamedTuple):
    """One tokenizer: its ids of a text, each id's bytes, and their lengths."""

    encode: Callable[[str], list[int]]
    pieces: list[bytes]
    lengths: np.ndarray


def _side(encode: Callable[[str], list[int]], pieces: list[bytes]) -> Side:
    return Side(encode, pieces, np.array([len(p) for p in pieces], np.int64))


@lru_cache(maxsize=2)
def byte_side(path: str) -> Side:
    """Byte-level BPE (a tokenizers JSON file) of a space and the text."""
    bpe = byte_bpe(path)
    special = set(bpe.special.values())
    pieces = [b"" if i in special else bpe.encoding.decode_single_token_bytes(i) for i in range(bpe.size)]
    return _side(lambda text: bpe.ids(" " + text), pieces)


@lru_cache(maxsize=2)
def piece_side(path: str) -> Side:
    """A SentencePiece model, which puts the space in front itself."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)

    def spelt(i: int) -> bytes:
        piece = model.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if model.is_byte(i) else piece.replace(MARK, " ").encode()

    return _side(model.encode, [spelt(i) for i in range(model.get_piece_size())])


class Aligned(NamedTuple):
    a: np.ndarray
    b: np.ndarray
    ends_a: np.ndarray
    ends_b: np.ndarray
    groups_a: np.ndarray
    groups_b: np.ndarray


def align(text: str | None, first: Side, second: Side) -> Aligned | None:
    """None: no tokens, or the pieces of a side do not spell a space and the text."""
    if not text:
        return None
    raw = (" " + text).encode()
    ids = [side.encode(text) for side in (first, second)]
    # a byte-level BPE cuts the very bytes of its text
    if b"".join(map(second.pieces.__getitem__, ids[1])) != raw:
        return None
    a, b = (np.array(own, np.int64) for own in ids)
    ends_a, ends_b = np.cumsum(first.lengths[a]), np.cumsum(second.lengths[b])
    if ends_a[-1] != len(raw):
        return None
    groups_a, groups_b = group_ends(ends_a.tolist(), ends_b.tolist())
    return Aligned(a, b, ends_a, ends_b, np.array(groups_a, np.int64), np.array(groups_b, np.int64))


def links(x: Aligned) -> tuple[np.ndarray, np.ndarray]:
    """Indexes of linked tokens: a token is linked from where the one before it ends up to where it ends itself."""
    last = np.searchsorted(x.ends_b, x.ends_a)
    first = np.zeros_like(last)
    first[1:] = last[:-1] + (x.ends_b[last[:-1]] == x.ends_a[:-1])
    n = last - first + 1
    return np.repeat(np.arange(len(n)), n), np.arange(n.sum()) + np.repeat(first - np.cumsum(n) + n, n)


def spelt_groups(x: Aligned, words: np.ndarray, second: int) -> bytes:
    """`a1,a2|b1;a3|b2,b3`. `words`: ids of the first side with ',' and with '|', then, from `second`, the other's with ',' and ';'."""
    size_a, size_b = np.diff(x.groups_a, prepend=0), np.diff(x.groups_b, prepend=0)
    at_a = np.arange(len(x.a)) + np.repeat(x.groups_b - size_b, size_a)
    at_b = np.arange(len(x.b)) + np.repeat(x.groups_a, size_b)
    said_a, said_b = 2 * x.a, second + 2 * x.b
    said_a[x.groups_a - 1] += 1
    said_b[x.groups_b - 1] += 1
    out = np.empty(len(x.a) + len(x.b), np.int64)
    out[at_a], out[at_b] = said_a, said_b
    return words[out].tobytes().translate(None, b"\0")[:-1]  # words are padded to one width


SCHEMA = "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, times array<int>"


def _align(a_path: str, b_path: str):
    def chunk(rows: list[tuple], first: Side, second: Side, words: np.ndarray) -> pa.RecordBatch:
        width = len(second.pieces)
        columns: list[list] = [[] for _ in range(7)]
        pairs, times, sizes = [], [], [0]
        for row, doc_id, text in rows:
            x = align(text, first, second)
            if x is None:
                figures, own = (0, 0, 0, 0, ""), 0
            else:
                i, j = links(x)
                codes, n = np.unique(x.a[i] * width + x.b[j], return_counts=True)
                pairs.append(codes)
                times.append(n)
                own = len(codes)
                digest = hashlib.sha256(spelt_groups(x, words, 2 * len(first.pieces))).hexdigest()
                figures = (len(x.a), len(x.b), len(x.groups_a), len(i), digest)
            sizes.append(sizes[-1] + own)
            for column, value in zip(columns, (row, doc_id, *figures), strict=True):
                column.append(value)
        types = [pa.int64()] * 6 + [pa.string()]
        arrays = [pa.array(c, t) for c, t in zip(columns, types, strict=True)]
        offsets = pa.array(sizes, pa.int32())
        whole = lambda parts, t: np.concatenate(parts).astype(t) if parts else np.empty(0, t)
        arrays += [pa.ListArray.from_arrays(offsets, pa.array(whole(pairs, np.int64)))]
        arrays += [pa.ListArray.from_arrays(offsets, pa.array(whole(times, np.int32)))]
        return pa.RecordBatch.from_arrays(arrays, [c.split()[0] for c in SCHEMA.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, second = byte_side(a_path), piece_side(b_path)
        words = np.array(
            [f"{i}{s}".encode() for i in range(len(first.pieces)) for s in ",|"] + [f"{i}{s}".encode() for i in range(len(second.pieces)) for s in ",;"]
        )
        for batch in batches:
            held, chars = [], 0
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                held.append(row)
                chars += len(row[2] or "")
                if chars >= CHUNK_CHARS:
                    yield chunk(held, first, second, words)
                    held, chars = [], 0
            if held:
                yield chunk(held, first, second, words)

    return run


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(pair, docs) of a task's documents; each document's pairs are distinct."""
    held: list[np.ndarray] = []
    size = 0

    def summed() -> tuple[np.ndarray, np.ndarray]:
        codes = np.concatenate([h[0] for h in held])
        n = np.concatenate([h[1] for h in held])
        order = np.argsort(codes, kind="stable")
        codes, n = codes[order], n[order]
        start = np.flatnonzero(np.diff(codes, prepend=codes[:1] - 1))
        return codes[start], np.add.reduceat(n, start)

    for batch in batches:
        codes, n = np.unique(batch.column(0).flatten().to_numpy(), return_counts=True)
        held.append((codes, n))
        size += len(codes)
        if size > 4 * HEAD_PAIRS:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in summed()], ["pair", "docs"])
            held, size = [], 0
    if size:
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in summed()], ["pair", "docs"])


def align_tokens(docs: DataFrame, byte_path: str, piece_path: str) -> DataFrame:
    """A written row per document: row (its key), doc_id, n_a, n_b, n_groups, n_links, groups_sha256, and its linked pairs.

    `pairs` are distinct codes (first id * size of the second vocabulary + second id), `times` how
    often each is linked.
    """
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string"))
    return materialize(rows.mapInArrow(_align(byte_path, piece_path), SCHEMA), "aligned")


def pair_counts(aligned: DataFrame) -> DataFrame:
    """(pair, docs): how many documents hold a pair linked."""
    return materialize(
        aligned.select("pairs").mapInArrow(_counted, "pair long, docs long").groupBy("pair").agg(F.sum("docs").alias("docs")), "pairs"
    )


def _head(counts: DataFrame, head_pairs: int) -> tuple[np.ndarray, np.ndarray, bool]:
    """The most frequent pairs, sorted, with their counts; and whether there are others."""
    level = F.floor(F.log2("docs") * 16).cast("int")
    levels = sorted(counts.groupBy(level.alias("level")).agg(F.count(F.lit(1)).alias("n")).collect(), reverse=True)
    kept, least = 0, None
    for r in levels:
        if kept + r["n"] > head_pairs:
            break
        kept, least = kept + r["n"], r["level"]
    head = counts.where(level >= (1 << 30 if least is None else least)).toPandas()
    order = np.argsort(head["pair"].to_numpy())
    return head["pair"].to_numpy()[order], head["docs"].to_numpy()[order], kept < sum(r["n"] for r in levels)


def link_figures(aligned: DataFrame, counts: DataFrame, first_size: int, second_size: int, head_pairs: int = HEAD_PAIRS) -> DataFrame:
    """(row, n_best, count_sum) per document, from the corpus-wide counts of its links."""
    spark = aligned.sparkSession
    best_of = counts.groupBy(F.floor(F.col("pair") / second_size).cast("long").alias("a")).agg(F.max("docs").alias("best")).toPandas()
    best = np.zeros(first_size, np.int64)  # one figure per id of the first vocabulary
    best[best_of["a"].to_numpy(np.int64)] = best_of["best"].to_numpy(np.int64)
    pairs, docs, more = _head(counts, head_pairs)
    known = spark.sparkContext.broadcast((pairs, docs, best))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, docs, best = known.value
        for batch in batches:
            lists, times = batch.column(1), batch.column(2).flatten().to_numpy()
            codes = lists.flatten().to_numpy()
            at = np.searchsorted(pairs, codes)
            hit = at < len(pairs)
            hit[hit] = pairs[at[hit]] == codes[hit]
            n = np.zeros(len(codes), np.int64)
            n[hit] = docs[at[hit]]
            top = hit & (n == best[codes // second_size])
            ends = np.diff(lists.offsets.to_numpy()).cumsum()
            upto = lambda x: np.diff(np.concatenate([[0], np.cumsum(x)])[np.concatenate([[0], ends])])
            rare = upto(~hit)
            offsets = pa.array(np.concatenate([[0], np.cumsum(rare)]), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), pa.array(upto(np.where(top, times, 0))), pa.array(upto(n * times)),
                    pa.ListArray.from_arrays(offsets, pa.array(codes[~hit])), pa.ListArray.from_arrays(offsets, pa.array(times[~hit])),
                ],
                ["row", "n_best", "count_sum", "rare", "rare_times"],
            )

    schema = "row long, n_best long, count_sum long, rare array<long>, rare_times array<int>"
    figures = aligned.select("row", "pairs", "times").mapInArrow(run, schema)
    if not more:
        return figures.select("row", "n_best", "count_sum")
    figures = materialize(figures, "frequent")
    rare = figures.select("row", F.explode(F.arrays_zip("rare", "rare_times")).alias("r")).select(
        "row", F.col("r.rare").alias("pair"), F.col("r.rare_times").cast("long").alias("times")
    )
    tops = spark.createDataFrame(best_of, "a long, best long").select((F.col("a")).alias("a"), "best")  # one row per id of the first vocabulary
    tail = rare.join(counts, "pair").withColumn("a", F.floor(F.col("pair") / second_size).cast("long")).join(F.broadcast(tops), "a")
    sums = tail.groupBy("row").agg(
        F.sum(F.when(F.col("docs") == F.col("best"), F.col("times")).otherwise(0)).alias("b"), F.sum(F.col("docs") * F.col("times")).alias("s")
    )
    return figures.join(sums, "row", "left").select(
        "row", (F.col("n_best") + F.coalesce("b", F.lit(0))).alias("n_best"), (F.col("count_sum") + F.coalesce("s", F.lit(0))).alias("count_sum")
    )


def alignment_report(docs: DataFrame, byte_path: str, piece_path: str, head_pairs: int = HEAD_PAIRS) -> DataFrame:
    aligned = align_tokens(docs, byte_path, piece_path)
    sizes = len(byte_side(byte_path).pieces), len(piece_side(piece_path).pieces)
    figures = link_figures(aligned, pair_counts(aligned), *sizes, head_pairs)
    return aligned.join(figures, "row").select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"
    )


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as public

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return alignment_report(docs, public.path("byte_bpe_50k.json"), public.path("piece_bpe_32k.model"))
