"""Operator 2: near-duplicates by one-permutation hashing.

1. A document's word shingles are hashed to 64 bits. One permutation: the hashes' high bits
   choose one of `bands * rows` bins, the least hash of each bin is kept, and an empty bin
   borrows from the first filled one in an order that is fixed per bin (optimal
   densification). Documents with equal shingle sets form one class from here on.
2. A sketch is cut into bands; classes that agree on a whole band meet in its bucket.
3. Candidates are a star per bucket: its member that meets most others over all buckets
   is paired with the rest. Every pair is confirmed on the full sets and confirmed pairs are
   joined into components.
4. Where a bucket's members are not all in its centre's component, the outsiders become
   centres too, four times as many each round, against the members of other components, until
   nobody is left. So no link between two texts that share a bucket is lost, while members
   that are connected already are never paired again. These later pairs must first pass a bound
   that no similar pair fails: each shingle flips one of 1024 bits, and two texts' bits differ in no
   more places than their sets differ in shingles.

At the default 28 bands of 5 rows, a pair of similarity 0.85 meets with probability
1 - 1e-7, one of 0.5 with 0.59 and one of 0.2 with 0.01.

A row takes part under its node: its doc_id, or without one a negative number made of its text's
hash, so that rows without an id link like all others and equal texts among them are one node.
Ids are expected to be 0 or more if there are null ones; a negative one could only meet
such a node by chance of 1 in 2^63.

Edge cases: a null, empty or blank text has no shingles, links with nothing and is its own
component; a text of fewer words than a shingle is one shingle; rows that share a doc_id are
one document with several texts and so end in one component; a row with a null doc_id has the
smallest doc_id that it reaches as its component, null if there is none, and is kept only if there is
none and its node is the component's least; an empty table gives no rows; extra columns are left out of
the result. `drop_near_duplicates` keeps one row of a node that has several, with any one of its texts;
rows without shingles all stay.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import NO_ID, WORD_SPACE, free_names, materialize, table
from .graph import components

BANDS, ROWS = 28, 5
PARITY_LONGS = 16
#: Word hashes a task remembers at most.
CACHE_WORDS = 400_000
_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)]


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64 bits whose every output bit depends on every input bit."""
    x = (x ^ (x >> np.uint64(30))) * _ODD[1]
    x = (x ^ (x >> np.uint64(27))) * _ODD[2]
    return x ^ (x >> np.uint64(31))


def word_list(text: str | None) -> list[bytes]:
    """Words in lower case; bytes.lower and bytes.split know just A-Z and the six white characters."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def shingle_hashes(words: list[bytes], known: WordHashes, size: int) -> np.ndarray:
    """Hashes of the distinct shingles, ascending."""
    if not words:
        return np.empty(0, np.uint64)
    w = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    width = min(size, len(w))
    h = np.full(len(w) - width + 1, width, np.uint64)
    for i in range(width):
        h = mix(h * _ODD[0] + w[i : len(w) - width + 1 + i])
    return np.unique(h)


def donor_order(bins: int) -> np.ndarray:
    """For each bin the order in which it asks the others, the same for every document."""
    rnd = np.random.default_rng(20170703)
    return np.argsort(rnd.random((bins, bins)), axis=1)


def sketch(hashes: np.ndarray, donors: np.ndarray) -> np.ndarray:
    """One-permutation sketch of ascending hashes, densified."""
    bins = len(donors)
    at = ((hashes >> np.uint64(32)) * np.uint64(bins) >> np.uint64(32)).astype(np.int64)
    filled, first = np.unique(at, return_index=True)
    out = np.zeros(bins, np.uint64)
    out[filled] = hashes[first]
    if len(filled) < bins:
        full = np.zeros(bins, bool)
        full[filled] = True
        empty = np.flatnonzero(~full)
        asked = donors[empty]
        out[empty] = out[asked[np.arange(len(empty)), full[asked].argmax(axis=1)]]
    return out


def band_keys(signature: np.ndarray, rows: int) -> np.ndarray:
    parts = signature.reshape(-1, rows)
    key = np.arange(len(parts), dtype=np.uint64)
    for j in range(rows):
        key = mix(key * _ODD[0] + parts[:, j])
    return key.view(np.int64)


def _sketches(size: int, bands: int, rows: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known, donors = WordHashes(), donor_order(bands * rows)
        for batch in batches:
            n, a, b, keys = [], [], [], []
            for text in batch["text"]:
                h = shingle_hashes(word_list(text), known, size)
                n.append(len(h))
                a.append(int(mix(h).sum().view(np.int64)))
                b.append(int(mix(h ^ _ODD[2]).sum().view(np.int64)))
                keys.append(band_keys(sketch(h, donors), rows) if len(h) else np.empty(0, np.int64))
            yield pd.DataFrame({"doc_id": batch["doc_id"], "no_id": batch["no_id"], "n": n, "set_a": a, "set_b": b, "keys": keys})

    return run


def parity(hashes: np.ndarray) -> np.ndarray:
    """Which of the bits an odd number of shingles falls on."""
    odd = np.bincount((hashes & np.uint64(PARITY_LONGS * 64 - 1)).astype(np.int64), minlength=PARITY_LONGS * 64) & 1
    return np.packbits(odd.astype(bool)).view(np.int64)


def _sets(size: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = WordHashes()
        for batch in batches:
            sets = [shingle_hashes(word_list(t), known, size) for t in batch["text"]]
            yield pd.DataFrame({
                "doc_id": batch["doc_id"], "shingles": [x.view(np.int64) for x in sets], "parity": [parity(x) for x in sets],
            })

    return run


def _node() -> Column:
    """What stands for a row: its doc_id, or a negative number from its text's hash."""
    return F.coalesce(F.col("doc_id").cast("long"), F.xxhash64("text").bitwiseOR(F.lit(NO_ID)))


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of `docs` (doc_id, text).

    Two texts are linked if 100 * common shingles >= percent * all shingles of both.
    """
    return _judged(docs, size, percent, bands, rows).drop("node")


def _judged(docs: DataFrame, size: int, percent: int, bands: int, rows: int) -> DataFrame:
    """The rows of `near_duplicates`, each with its node."""
    texts = docs.select(_node().alias("doc_id"), F.col("doc_id").isNull().alias("no_id"), "text")
    sketches = materialize(
        texts.mapInPandas(_sketches(size, bands, rows), "doc_id long, no_id boolean, n long, set_a long, set_b long, keys array<long>"), "sketches"
    )
    same = ["set_a", "set_b", "n"]
    known = sketches.where("n > 0")
    real = F.when(~F.col("no_id"), F.col("doc_id"))
    classes = materialize(known.groupBy(*same).agg(F.min("doc_id").alias("rep"), F.min(real).alias("least")), "classes")

    # buckets where two classes or more meet
    reps = classes.select(F.col("rep").alias("doc_id"), *same)
    entries = known.join(reps, ["doc_id", *same], "left_semi").select(F.col("doc_id").alias("rep"), "n", F.explode("keys").alias("key"))
    met = entries.groupBy("key").agg(F.count(F.lit(1)).alias("m"), F.min("rep").alias("lo"), F.max("rep").alias("hi"))
    met = materialize(met.where("lo <> hi").select("key", "m"), "met")
    members = materialize(entries.join(met, "key"), "members")
    degree = materialize(members.groupBy("rep").agg(F.sum("m").alias("degree")), "degrees")
    members = materialize(members.drop("m").join(degree, "rep"), "members")

    # the whole sets of the classes that met another one
    chosen = degree.select(F.col("rep").alias("doc_id"))
    repeated = materialize(known.groupBy("doc_id").agg(F.count(F.lit(1)).alias("m")).where("m > 1").select("doc_id"), "repeated")
    texts = texts.select("doc_id", "text")
    once = texts.join(chosen.join(repeated, "doc_id", "left_anti"), "doc_id", "left_semi")
    several = texts.join(chosen.join(repeated, "doc_id", "left_semi"), "doc_id", "left_semi").distinct()
    sets = materialize(once.unionByName(several).mapInPandas(_sets(size), "doc_id long, shingles array<long>, parity array<long>"), "sets")

    def confirmed(pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) that are similar enough, judged on their whole sets."""
        first, second = (sets.select(F.col("doc_id").alias(k), F.col("shingles").alias(f"s{k}")) for k in "ab")
        common = F.size(F.array_intersect("sa", "sb"))
        union = F.size("sa") + F.size("sb") - common
        return pairs.join(second, "b").join(first, "a").where(100 * common >= percent * union).select("a", "b")

    fits = 100 * F.least("n", "cn") >= percent * F.greatest("n", "cn")
    best = F.max(F.struct("degree", (-F.col("rep")).alias("r"), "n"))
    centres = materialize(
        members.groupBy("key").agg(best.alias("c")).select("key", (-F.col("c.r")).alias("centre"), F.col("c.n").alias("cn")), "centres"
    )
    star = members.join(centres, "key").where(F.col("rep") != F.col("centre")).where(fits)
    pairs = materialize(star.select(F.col("centre").alias("a"), F.col("rep").alias("b")).distinct(), "pairs")
    labels = components(confirmed(pairs))

    def named(df: DataFrame, column: str, label: str) -> DataFrame:
        known_as = labels.select(F.col("node").alias(column), F.col("label").alias(label))
        return df.join(known_as, column, "left").withColumn(label, F.coalesce(label, column))

    # members outside their bucket's main component, each with a fixed place in its bucket
    main = materialize(named(centres, "centre", "main").select("key", "main", "centre"), "main")
    apart = named(members, "rep", "label").join(main, "key").where("label <> main")
    by_degree = Window.partitionBy("key").orderBy(F.desc("degree"), "rep")
    outsiders = materialize(
        apart.select("key", "rep", F.col("n").alias("cn"), "centre", F.row_number().over(by_degree).alias("place")), "outsiders"
    )
    last = outsiders.agg(F.max("place")).first()[0] or 0
    bits = sets.select(F.col("doc_id").alias("rep"), "parity")
    flipped = sum((F.bit_count(F.get("parity", F.lit(i)).bitwiseXOR(F.get("bits", F.lit(i)))) for i in range(PARITY_LONGS)), F.lit(0))
    # similar sets differ in at most this share of the sum of their sizes
    bounded = (100 + percent) * flipped <= (100 - percent) * (F.col("n") + F.col("cn"))
    done, width = 0, 4
    while done < last:
        turn = outsiders.where((F.col("place") > done) & (F.col("place") <= done + width))
        turn = named(named(turn, "centre", "main"), "rep", "own").where("own <> main")
        turn = turn.join(bits, "rep").select("key", F.col("rep").alias("x"), "cn", "own", F.col("parity").alias("bits"))
        ends = named(members.join(outsiders.select("key").distinct(), "key", "left_semi"), "rep", "label").join(bits, "rep")
        tried = ends.join(turn, "key").where("label <> own").where(fits & bounded)
        pairs = tried.select(F.least("x", "rep").alias("a"), F.greatest("x", "rep").alias("b")).distinct()
        links = materialize(confirmed(materialize(pairs, "pairs")), "links")
        joined = named(named(links, "a", "la"), "b", "lb").select(F.col("la").alias("a"), F.col("lb").alias("b")).where("a <> b")
        if not joined.isEmpty():
            merged = components(joined)
            touched = links.select(F.col("a").alias("node")).union(links.select(F.col("b").alias("node"))).distinct()
            nodes = labels.join(touched, "node", "full").withColumn("label", F.coalesce("label", "node"))
            onto = merged.select(F.col("node").alias("label"), F.col("label").alias("onto"))
            labels = materialize(nodes.join(onto, "label", "left").select("node", F.coalesce("onto", "label").alias("label")), "labels")
        done, width = done + width, width * 4

    # a component goes by the least doc_id in it, null if all its rows are without one
    labelled = materialize(named(classes, "rep", "label").select(*same, "label", "least"), "labelled")
    component = labelled.groupBy("label").agg(F.min("least").alias("component_id"))
    named_classes = materialize(labelled.drop("least").join(component, "label"), "components")
    found = known.select("doc_id", "no_id", *same).join(named_classes, same).select("doc_id", "no_id", "n", "component_id", "label")
    alone = sketches.where("n = 0").select("doc_id", "no_id", "n", real.alias("component_id"), F.col("doc_id").alias("label"))
    first = F.when(F.col("no_id"), F.col("component_id").isNull() & (F.col("doc_id") == F.col("label")))
    return found.unionByName(alone).select(
        F.col("doc_id").alias("node"), real.alias("doc_id"), F.col("n").alias("n_shingles"), "component_id",
        first.otherwise(F.col("doc_id") == F.col("component_id")).alias("kept"),
    )


def drop_near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """The rows of `docs` that are kept: one row of each component, that of its smallest doc_id.

    Only nodes that go or have several rows are joined; texts are shuffled for the latter alone.
    """
    (node,) = free_names(docs, "node")
    nodes = _judged(docs, size, percent, bands, rows).where("n_shingles > 0").groupBy(F.col("node").alias(node))
    odd = materialize(nodes.agg(F.bool_and("kept").alias("kept"), F.count(F.lit(1)).alias("m")).where("not kept or m > 1"), "odd")
    has_words = F.col("text").rlike(f"[^{WORD_SPACE}]")
    keyed = docs.withColumn(node, F.when(has_words, _node()))
    plain = keyed.join(odd.select(node), node, "left_anti")
    again = keyed.join(odd.where("kept").select(node), node, "left_semi").dropDuplicates([node])
    return plain.unionByName(again).select(*[F.col(f"`{c}`") for c in docs.columns])


def op2_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), size=3, percent=85)


OP2_SQL = r"""
with recursive w as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x20\x09-\x0D]+') as ws from documents),
s as (
  select distinct doc_id, unnest(case when len(ws) = 0 then [] when len(ws) < 3 then [array_to_string(ws, ' ')]
    else list_transform(range(1, len(ws) - 1), lambda i: array_to_string(list_slice(ws, i, i + 2), ' ')) end) as sh from w),
n as (select doc_id, count(*) as n from s group by doc_id),
common as (
  select a.doc_id as a, b.doc_id as b, count(*) as c from s a join s b on a.sh = b.sh and a.doc_id < b.doc_id group by 1, 2),
links as (
  select a, b from common join n na on na.doc_id = a join n nb on nb.doc_id = b where 100 * c >= 85 * (na.n + nb.n - c)),
reach(node, other) as (
  select doc_id, doc_id from documents
  union select reach.node, case when links.a = reach.other then links.b else links.a end
  from reach join links on links.a = reach.other or links.b = reach.other)
select d.doc_id, coalesce(any_value(n.n), 0)::bigint as n_shingles, min(r.other) as component_id, d.doc_id = min(r.other) as kept
from documents d join reach r on r.node = d.doc_id left join n on n.doc_id = d.doc_id group by d.doc_id
"""
