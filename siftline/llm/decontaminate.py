"""Operator 9: benchmark decontamination by rare seeds and local alignment.

1. The n-grams of the test items are counted over the documents (in how many each occurs).
2. Every stretch of an item gives the rarest of its n-grams that occur at all as a seed, so seeds
   are both rare and spread over the whole item; however common a passage is, its item has
   seeds. With stretches of two 3-grams, any five unedited words in a row hold a seed.
3. Seeds join passages of the documents to items, and Smith-Waterman alignment of words (match 1,
   other -1, gap -1) scores the passage around the hits. A passage counts if its score reaches
   `least` of the item's words or LONG, whichever is less, so edited and partial copies are found
   too: an excerpt of LONG words counts however long the item is. As an edit costs one match, a copy with
   three words in ten replaced scores 0.4 of its length, which is enough from 33 words on.

The items are taken in blocks of a bounded number of n-grams, each block broadcast to one pass
over the documents; documents are never shuffled, counts and findings alone are.

Edge cases: null, empty or blank texts have no passage; an item of fewer words than a seed is one
seed; items are told apart by id and text, so those without an id and different texts under one
id are all looked for; repeated items or documents are found for each id; an empty table on either side gives
no rows; very long texts are aligned only around their hits; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import NO_ID, free_names, materialize, numbered, own_id, table
from .minhash import _ODD, WordHashes, mix, word_list

SEED_WORDS, STRETCH, LEAST = 3, 2, 0.5
#: A score that counts in any item.
LONG = 13
#: N-grams of test items in a block: what is broadcast at once.
BLOCK_GRAMS = 1_000_000


def word_hashes(text, known: WordHashes) -> np.ndarray:
    words = word_list(text) if isinstance(text, str) else []
    return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))


def gram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    if len(words) < n:
        return np.empty(0, np.uint64)
    h = np.full(len(words) - n + 1, n, np.uint64)
    for i in range(n):
        h = mix(h * _ODD[0] + words[i : len(words) - n + 1 + i])
    return h


def local_alignment(item: np.ndarray, passage: np.ndarray) -> tuple[int, int, int]:
    """Best Smith-Waterman score, and the ends of its alignment in item and passage (inclusive).

    Of equal scores the first in the item, then in the passage. One numpy row per item word: gaps
    in the passage are a running maximum of score plus place.
    """
    places = np.arange(1, len(passage) + 1)
    before = np.zeros(len(passage) + 1, np.int64)
    best, at = 0, (-1, -1)
    for i, word in enumerate(item):
        row = np.maximum(before[:-1] + np.where(passage == word, 1, -1), before[1:] - 1)
        row = np.maximum(row, 0)
        row = np.maximum.accumulate(row + places) - places
        j = int(row.argmax())
        if row[j] > best:
            best, at = int(row[j]), (i, j)
        before[1:] = row
    return best, *at


def _item_grams(n: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = WordHashes()
        for batch in batches:
            ids, places, grams, words = [], [], [], []
            for item, text in zip(batch["item"], batch["text"], strict=True):
                w = word_hashes(text, known)
                g = gram_hashes(w, min(n, len(w))) if len(w) else w
                if not len(g):
                    continue
                ids += [item] * len(g)
                places += range(len(g))
                grams.append(g.view(np.int64))
                words += [min(n, len(w))] * len(g)
            if ids:
                yield pd.DataFrame({"item": ids, "place": places, "gram": np.concatenate(grams), "n": words})

    return run


def _gram_counts(shared, sizes: list[int]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known, wanted = WordHashes(), shared.value
        for batch in batches:
            count = np.zeros(len(wanted), np.int64)
            for text in batch["text"]:
                w = word_hashes(text, known)
                for n in sizes:
                    g = gram_hashes(w, n)
                    if len(g):
                        at = np.minimum(np.searchsorted(wanted, g), len(wanted) - 1)
                        count[np.unique(at[wanted[at] == g])] += 1
            found = np.flatnonzero(count)
            yield pd.DataFrame({"gram": wanted[found].view(np.int64), "docs": count[found]})

    return run


def _passages(shared, sizes: list[int], least: float):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = WordHashes()
        seeds, owners, places, items = shared.value  # seeds ascending; a seed may belong to several items
        names = ["doc_id", "item_id", "score", "matched", "item_words", "first_word", "last_word", "text_md5"]
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch["doc_id"], batch["text"], strict=True):
                w = word_hashes(text, known)
                hits: dict[int, list[int]] = {}
                for n in sizes:
                    g = gram_hashes(w, n)
                    lo = np.searchsorted(seeds, g, "left")
                    for at in np.flatnonzero((lo < len(seeds)) & (seeds[np.minimum(lo, len(seeds) - 1)] == g)):
                        k = lo[at]
                        while k < len(seeds) and seeds[k] == g[at]:
                            hits.setdefault(owners[k], []).append(int(at) - int(places[k]))
                            k += 1
                for item, starts in hits.items():
                    item_id, item_words = items[item]
                    found = best_passage(item_words, w, starts, least)
                    if found:
                        score, first, last = found
                        m = len(item_words)
                        rows.append((doc_id, item_id, score / m, score, m, first, last, hashlib.md5(text.encode()).hexdigest()))
            yield pd.DataFrame(rows, columns=names)

    return run


def best_passage(item: np.ndarray, words: np.ndarray, starts: list[int], least: float) -> tuple[int, int, int] | None:
    """Score and word range of the best alignment near places where the item seems to start."""
    slack = max(4, len(item))  # an alignment has fewer gaps than item words
    need = min(LONG, least * len(item))
    best: tuple[int, int, int] | None = None
    stretches: list[list[int]] = []
    for s in sorted(set(starts)):
        a, b = max(0, s - slack), min(len(words), s + len(item) + slack)
        if stretches and a <= stretches[-1][1]:
            stretches[-1][1] = max(b, stretches[-1][1])
        else:
            stretches.append([a, b])
    for a, b in stretches:
        passage = words[a:b]
        if np.isin(item, passage).sum() < need:  # a score is at most the words in common
            continue
        score, i, j = local_alignment(item, passage)
        if score >= need and (best is None or score > best[0]):
            back = local_alignment(item[i::-1], passage[j::-1])
            best = (score, a + j - back[2], a + j)
    return best


FOUND = "doc_id long, item_id long, score double, matched long, item_words long, first_word long, last_word long, text_md5 string"


def contaminated_passages(docs: DataFrame, items: DataFrame, **how) -> DataFrame:
    """The best passage of each document (doc_id, text) for each item (item_id, text) it holds a copy of."""
    return passages_of_texts(docs, items, **how).drop("text_md5")


def passages_of_texts(
    docs: DataFrame, items: DataFrame, n: int = SEED_WORDS, stretch: int = STRETCH, least: float = LEAST, block_grams: int = BLOCK_GRAMS
) -> DataFrame:
    """`contaminated_passages` with the MD5 of the text, which tells rows of one doc_id apart."""
    spark = docs.sparkSession
    texts = numbered(docs, "text")
    items = items.select(F.coalesce(F.col("item_id").cast("long"), F.lit(NO_ID)).alias("item_id"), "text").distinct()
    items = items.withColumn("item", F.xxhash64("item_id", "text"))
    grams = materialize(
        items.select("item", "text").mapInPandas(_item_grams(n), "item long, place long, gram long, n int"),
        "item-grams",
    )
    blocks = -(-grams.count() // block_grams)
    out = None
    for k in range(blocks):
        mine = grams.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == k)
        known = mine.select("gram", "n").distinct().toPandas()
        if not len(known):
            continue
        sizes = sorted(set(known["n"]))
        wanted = spark.sparkContext.broadcast(np.sort(known["gram"].to_numpy().view(np.uint64)))
        counts = texts.select("text").mapInPandas(_gram_counts(wanted, sizes), "gram long, docs long").groupBy("gram").agg(F.sum("docs").alias("docs"))
        rarest = Window.partitionBy("item", "stretch").orderBy("docs", "place")
        seeds = (
            mine.join(counts, "gram").withColumn("stretch", F.floor(F.col("place") / stretch))
            .withColumn("nth", F.row_number().over(rarest)).where("nth = 1").select("gram", "item", "place").toPandas()
        )
        order = np.argsort(seeds["gram"].to_numpy().view(np.uint64), kind="stable")
        words = items.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == k).select("item", "item_id", "text").toPandas()
        hashes = WordHashes()
        of_item = {int(k): (int(i), word_hashes(t, hashes)) for k, i, t in zip(words["item"], words["item_id"], words["text"], strict=True)}
        shared = spark.sparkContext.broadcast((
            seeds["gram"].to_numpy().view(np.uint64)[order], seeds["item"].to_numpy()[order], seeds["place"].to_numpy()[order], of_item,
        ))
        found = texts.mapInPandas(_passages(shared, sizes, least), FOUND)
        out = found if out is None else out.unionByName(found)
    return out.withColumn("doc_id", own_id()).withColumn("item_id", own_id("item_id")) if out is not None else spark.createDataFrame([], FOUND)


def drop_contaminated(docs: DataFrame, items: DataFrame, **how) -> DataFrame:
    """The rows of `docs` that hold no copy of an item."""
    gone, text = free_names(docs, "gone", "text")
    bad = passages_of_texts(docs, items, **how).select(F.col("doc_id").alias(gone), F.col("text_md5").alias(text)).distinct()
    bad = materialize(bad, "contaminated")
    same = F.col("doc_id").cast("long").eqNullSafe(F.col(gone)) & (F.md5(F.col("text").cast("binary")) == F.col(text))
    return docs.join(bad, same, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated_passages(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
