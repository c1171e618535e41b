"""Operator 1: removal of repeated byte strings by prefix-free parsing.

A string of `length` bytes is repeated if an equal one starts earlier in corpus order
(doc_id, then start). Every byte that a repeated string covers is removed.

*Parse.* A rolling hash over short grams triggers the phrases: each window of `length` bytes
belongs to the gram in it whose hash is least (the leftmost of equals), and the windows with one
trigger make one phrase, from the first window's start to the last one's end. As with other
prefix-free parses the triggers depend on content alone, and neighbouring phrases overlap by
length - 1 bytes, so every window lies in exactly one phrase; taking the least hash in place of
a fixed residue also bounds a phrase to less than twice `length`, on any text.

*Dictionary and parse.* Phrases are sorted by trigger, phrase and place. All but the first
occurrence of a phrase repeat it whole: all its windows are repeated. A first occurrence whose
trigger has no other phrase has no repeated window.

*Suffixes.* What is left are phrases that share a trigger with different ones. Their windows,
which are the dictionary's suffixes cut at `length` bytes, are sorted within the trigger;
neighbours that are equal are put in corpus order by their phrase's first occurrence, and all
but the first of them are repeated. So only the rims of repeated regions are handled byte by
byte; whole corpus suffixes are never sorted in one place.

Phrases already seen in the same Arrow batch are settled there, before the shuffle, so a text
with very many copies sends at most one occurrence per batch.

Edge cases: a null text is empty; texts shorter than `length` keep everything; of repeated rows
(same doc_id and text) each gets the same result; rows that share a doc_id with another text
are parts of one document, ordered by a hash, and matches never cross them; a null doc_id comes
before all others; an empty table gives no rows; extra columns are kept by `remove_repeats`.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import NO_ID, free_names, materialize, numbered, own_id, table
from .minhash import mix

LENGTH, GRAM = 100, 28
#: Bytes parsed at a time; pieces overlap by length - 1.
PIECE = 1_000_000
#: Phrases a task cuts out before it hands them on.
CHUNK_PHRASES = 20_000
_INDEX_BITS = 24


@lru_cache(maxsize=1)
def _constants() -> tuple[np.ndarray, list[np.uint64]]:
    rnd = np.random.default_rng(20191007)
    letters = rnd.integers(0, 1 << 63, 256, dtype=np.uint64)
    return letters, [np.uint64(int(x) | 1) for x in rnd.integers(0, 1 << 63, 16, dtype=np.uint64)]


def gram_hashes(data: np.ndarray, lengths: tuple[int, ...]) -> list[np.ndarray]:
    """Hashes of all substrings of each of the given lengths, by doubling."""
    letters, odd = _constants()
    levels = [letters[data]]
    while 2 << (len(levels) - 1) <= max(lengths):
        h, step = levels[-1], 1 << (len(levels) - 1)
        levels.append(h[:-step] * odd[len(levels)] + h[step:])
    out = []
    for n in lengths:
        h, at = None, 0
        for j in reversed(range(len(levels))):
            if n >> j & 1:
                part = levels[j][at : at + len(data) - n + 1]
                h = part.copy() if h is None else h * odd[j + 8] + part
                at += 1 << j
        out.append(mix(h))
    return out


def parse(data: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """Phrases of a text: trigger, phrase hash, first window, number of windows."""
    found = [_parse_piece(data[at : at + PIECE + length - 1], at, length, gram) for at in range(0, max(1, len(data) - length + 1), PIECE)]
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _parse_piece(data: np.ndarray, at: int, length: int, gram: int) -> tuple[np.ndarray, ...]:
    if len(data) < length:
        return np.empty(0, np.uint64), np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
    grams, windows = gram_hashes(data, (gram, length))
    index = np.arange(len(grams), dtype=np.uint64)
    low = (grams >> np.uint64(_INDEX_BITS) << np.uint64(_INDEX_BITS)) | index
    span, width = 1, length - gram + 1
    while span * 2 <= width:
        low = np.minimum(low[:-span], low[span:])
        span *= 2
    if width > span:
        low = np.minimum(low[: len(low) - (width - span)], low[width - span :])
    trigger = (low & np.uint64((1 << _INDEX_BITS) - 1)).astype(np.int64)
    first = np.flatnonzero(np.diff(trigger, prepend=-1))
    n = np.diff(first, append=len(trigger))
    anchor = trigger[first]
    shape = (n << 8 | (anchor - first)).astype(np.uint64)
    _, odd = _constants()
    phrase = mix(windows[first] * odd[1] + windows[first + n - 1] * odd[2] + shape)
    return grams[anchor], phrase, first + at, n


# a place is one number: 16 bits of the text's hash, 40 of the first window's start, 7 of the number of windows
def _tag(raw: bytes) -> int:
    return (xxhash.xxh3_64_intdigest(raw) & 0xFFFF) << 47


def text_key(text: str = "text") -> Column:
    """64 bits of another hash of the text than `_tag` takes its 16 from."""
    return F.xxhash64(text)


def _runs(first: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Neighbouring stretches of windows put together: starts and ends (exclusive)."""
    stop = first + n
    new = np.flatnonzero(np.concatenate([[True], first[1:] > stop[:-1]]))
    return first[new], stop[np.append(new[1:] - 1, len(stop) - 1)]


def _raw(text) -> bytes:
    return text.encode("utf-8") if isinstance(text, str) else b""


_PARSED = "doc_id long, key long, trigger long, phrase long, place long, run long"


def _parsed(length: int, gram: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            order = np.lexsort((batch["key"].to_numpy(), batch["doc_id"].to_numpy()))  # the order of the windows below
            ids, keys, texts = (batch[c].to_numpy()[order] for c in ("doc_id", "key", "text"))
            docs, triggers, phrases, firsts, counts, tags = [], [], [], [], [], []
            rows = set()
            for i, text in enumerate(texts):
                raw = _raw(text)
                row = (ids[i], xxhash.xxh3_128_digest(raw))
                if len(raw) < length or row in rows:  # a repeated row is no earlier document
                    continue
                rows.add(row)
                t, p, f, n = parse(np.frombuffer(raw, np.uint8), length, gram)
                docs.append(np.full(len(t), i))
                tags.append(np.full(len(t), _tag(raw)))
                triggers.append(t)
                phrases.append(p)
                firsts.append(f)
                counts.append(n)
            if not docs:
                continue
            doc, tag, trigger, phrase, first, n = map(np.concatenate, (docs, tags, triggers, phrases, firsts, counts))
            _, new = np.unique(mix(trigger ^ mix(phrase)), return_index=True)
            seen = np.ones(len(doc), bool)
            seen[new] = False
            same, key = ids[doc], keys[doc]
            place = tag | first << 7 | n
            keep = ~seen
            yield pd.DataFrame({
                "doc_id": same[keep], "key": key[keep], "trigger": trigger[keep].view(np.int64), "phrase": phrase[keep].view(np.int64),
                "place": place[keep], "run": pd.array([None] * int(keep.sum()), dtype="Int64"),
            })
            if seen.any():
                yield _settled(same[seen], key[seen], tag[seen], first[seen], n[seen], doc[seen])

    return run


def _settled(ids: np.ndarray, keys: np.ndarray, tag: np.ndarray, first: np.ndarray, n: np.ndarray, doc: np.ndarray) -> pd.DataFrame:
    rows = []
    for group in np.split(np.arange(len(doc)), np.flatnonzero(np.diff(doc)) + 1):
        starts, stops = _runs(first[group], n[group])
        rows.append((np.full(len(starts), ids[group[0]]), np.full(len(starts), keys[group[0]]), tag[group[0]] | starts << 7, stops))
    same, key, place, stop = (np.concatenate(x) for x in zip(*rows, strict=True))
    away = mix(place.view(np.uint64) ^ mix(same.view(np.uint64))).view(np.int64)
    return pd.DataFrame({
        "doc_id": same, "key": key, "trigger": away, "phrase": np.zeros(len(same), np.int64), "place": place, "run": pd.array(stop, dtype="Int64")
    })


def _pieces(length: int):
    """The text of every phrase in `rims`, a flat list of places and triggers."""
    names = ["doc_id", "key", "trigger", "place", "piece"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for doc_id, key, text, rims in zip(batch["doc_id"], batch["key"], batch["text"], batch["rims"], strict=True):
                raw = _raw(text)
                tag = _tag(raw)
                for place, trigger in rims.reshape(-1, 2).tolist():
                    if place >> 47 << 47 == tag:
                        first, n = place >> 7 & ((1 << 40) - 1), place & 127
                        rows.append((doc_id, key, trigger, place, raw[first : first + n + length - 1]))
                if len(rows) >= CHUNK_PHRASES:
                    yield pd.DataFrame(rows, columns=names)
                    rows = []
            if rows:
                yield pd.DataFrame(rows, columns=names)

    return run


def _covered(size: int, found: np.ndarray, tag: int, length: int) -> list[tuple[int, int]]:
    """The maximal removed stretches of one text; found: place, stop, low, high and so on."""
    starts, stops = [], []
    for place, stop, low, high in found.reshape(-1, 4).tolist():
        if place >> 47 << 47 != tag:
            continue
        first = place >> 7 & ((1 << 40) - 1)
        if stop:
            starts.append(first)
            stops.append(stop)
        else:
            bits = low | high << 63
            at = [first + i for i in range(place & 127) if bits >> i & 1]
            starts += at
            stops += [i + 1 for i in at]
    out: list[tuple[int, int]] = []
    for a, b in sorted(zip(starts, stops, strict=True)):
        end = min(size, b + length - 1)
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], end))
        else:
            out.append((a, end))
    return out


def repeated_windows(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """Per text, named by doc_id and `key`, the repeated windows of `docs` (doc_id long, text), as a list `found`.

    Texts that share a doc_id, as all without one do, have lists of their own: two of them are taken
    for one another only if the 64 bits of `text_key` and the 16 of a place agree.
    An entry is four numbers of that list: a place (see above), then either `stop`, the end of a
    stretch of windows, or, with stop 0, two sets of bits, one for each window of the phrase.
    """
    flat = lambda *c: F.flatten(F.collect_list(F.array(*c)))  # noqa: E731  numpy arrays in tasks, where structs would be dicts
    docs = docs.select("doc_id", "text", text_key().alias("key"))
    parsed = docs.mapInPandas(_parsed(length, gram), _PARSED).repartition("trigger")
    in_phrase = Window.partitionBy("trigger", "phrase").orderBy("doc_id", "key", "place")
    of_trigger = Window.partitionBy("trigger")
    sorted_phrases = parsed.withColumn("nth", F.rank().over(in_phrase)).withColumn(
        "many", F.min("phrase").over(of_trigger) != F.max("phrase").over(of_trigger)
    )
    stop = F.coalesce("run", F.when(F.col("nth") > 1, F.shiftright("place", 7).bitwiseAND((1 << 40) - 1) + F.col("place").bitwiseAND(127)))
    known = materialize(
        sorted_phrases.where("run is not null or nth > 1 or many").select("doc_id", "key", "trigger", "place", stop.alias("stop")), "phrases"
    )
    rims = known.where("stop is null").groupBy("doc_id", "key").agg(flat("place", "trigger").alias("rims"))
    pieces = docs.join(rims, ["doc_id", "key"]).mapInPandas(_pieces(length), "doc_id long, key long, trigger long, place long, piece binary")
    # a phrase becomes some forty suffixes, hence many partitions
    parts = 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    suffixes = pieces.repartition(parts, "trigger").select(
        "doc_id", "key", "trigger", "place", F.posexplode(F.sequence(F.lit(1), F.col("place").bitwiseAND(127).cast("int"))).alias("nth", "i"), "piece"
    ).select("doc_id", "key", "trigger", "place", "nth", F.substring("piece", F.col("i"), length).alias("suffix"))
    # windows of one trigger are equal only if the trigger stands at one distance
    equal = Window.partitionBy("trigger", "suffix").orderBy(
        "doc_id", "key", F.col("place").bitwiseAND(~((1 << 47) - 1)), F.shiftright("place", 7) + F.col("nth")
    )
    again = suffixes.withColumn("again", F.rank().over(equal)).where("again > 1")
    bit = lambda a, b: F.expr(f"sum(case when nth between {a} and {b} then shiftleft(1L, nth - {a}) else 0L end)")
    rim_found = materialize(
        again.groupBy("trigger", "doc_id", "key", "place").agg(bit(0, 62).alias("low"), bit(63, 125).alias("high")).drop("trigger"), "rims"
    )
    nothing = F.lit(0).cast("long")
    every = known.where("stop is not null").select("doc_id", "key", "place", "stop", nothing.alias("low"), nothing.alias("high")).unionByName(
        rim_found.select("doc_id", "key", "place", nothing.alias("stop"), "low", "high")
    )
    return every.groupBy("doc_id", "key").agg(flat("place", "stop", "low", "high").alias("found"))


def _report(length: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for text, found in zip(batch["text"], batch["found"], strict=True):
                raw = _raw(text)
                cuts = _covered(len(raw), found, _tag(raw), length) if found is not None else []
                kept, at = hashlib.sha256(), 0
                for a, b in cuts:
                    kept.update(raw[at:a])
                    at = b
                kept.update(raw[at:])
                rows.append((len(raw), sum(b - a for a, b in cuts), len(cuts), kept.hexdigest()))
            out = pd.DataFrame(rows, columns=["n_bytes", "n_removed", "n_spans", "kept_sha256"])
            out.insert(0, "doc_id", batch["doc_id"].to_numpy())
            yield out

    return run


def report_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row of `docs` (doc_id, text)."""
    texts = numbered(docs, "text")
    found = repeated_windows(texts, length)
    out = texts.withColumn("key", text_key()).join(found, ["doc_id", "key"], "left").drop("key").mapInPandas(
        _report(length), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    )
    return out.withColumn("doc_id", own_id())


def kept_text(raw: bytes, cuts: list[tuple[int, int]]) -> str:
    """The text without the cut bytes; characters that are cut in part stay whole."""
    out, at = [], 0
    inside = lambda i: i < len(raw) and raw[i] & 0xC0 == 0x80
    for a, b in cuts:
        while inside(a):
            a += 1
        while b > a and inside(b):
            b -= 1
        out.append(raw[at:a])
        at = max(a, b)
    out.append(raw[at:])
    return b"".join(out).decode("utf-8")


def remove_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """`docs` with every repeated string taken out of `text`; all rows and columns stay."""
    number, key, found = free_names(docs, "number", "key", "found")
    spans = repeated_windows(numbered(docs, "text"), length).select(
        F.col("doc_id").alias(number), F.col("key").alias(key), F.col("found").alias(found)
    )

    @F.pandas_udf("string")
    def cut(text: pd.Series, found: pd.Series) -> pd.Series:
        out = []
        for t, x in zip(text, found, strict=True):
            raw = _raw(t)
            out.append(t if x is None else kept_text(raw, _covered(len(raw), x, _tag(raw), length)))
        return pd.Series(out, dtype=object)

    named = docs.withColumn(number, F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID))).withColumn(key, text_key())
    joined = named.join(spans, [number, key], "left")
    new = F.when(F.col(found).isNotNull(), cut("text", found)).otherwise(F.col("text"))
    return joined.withColumn("text", new).select(*[F.col(f"`{c}`") for c in docs.columns])


def op1_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
