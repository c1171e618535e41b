"""Operator 10: shards by a k-d tree over metadata, of nearly equal bytes.

The tree starts with all rows. A node that is to become s shards is split along its widest
dimension (its spread there against the spread of the whole table) at the weighted quantile
that leaves floor(s/2) : ceil(s/2) of its bytes on the two sides, until every leaf is one
shard. Weights are byte sizes. Quantiles are found by counting: a row's place on a dimension
is a 39-bit number (20 bits of the value within the node, then 19 bits of a hash of the row,
so that ties are divided too), and three passes sum bytes by 13 bits each. What reaches the
driver is at most 8192 sums per node and pass, however many rows there are.

Equal texts form a group: its rows share their dimensions (the least of each) and, while the group
weighs no more than 1/SPLIT of a shard, their tie too, so that no cut divides it. A heavier
group's ties begin alike and end in a hash of the row: only the cuts that fall into it divide it.

Rows are only ever a narrow table of numbers, written to the shared folder once per level of
the tree; texts are read once and never shuffled.

Edge cases: a null text has no bytes (size 1); a null dimension counts as its least value;
rows of one id and text, or of null ids with one text, are told apart by a number that the first
table is written with; texts of any length are read once, as a size and three hashes; fewer rows than shards leave shards empty; an empty table gives no rows; extra columns are
left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import dense_slots, materialize, table

VALUE_BITS, TIE_BITS, PASS_BITS = 20, 19, 13
#: Bits of a heavy group's ties that its rows choose, and the share of a shard from which it is heavy.
ROW_BITS, SPLIT = 11, 256


def _place(value: Column, low: Column, high: Column, tie: Column) -> Column:
    """The 39-bit place of a row on one dimension of its node."""
    width = F.greatest(high - low, F.lit(1.0))
    cell = F.least(F.floor((value - low) / width * (1 << VALUE_BITS)), F.lit((1 << VALUE_BITS) - 1))
    return F.shiftleft(cell.cast("long"), TIE_BITS).bitwiseOR(tie)


def _case(node: Column, by_node: dict[int, object], kind: str) -> Column:
    """A value for each node, from a table of at most one entry a shard."""
    pairs = [x for k, v in by_node.items() for x in (F.lit(k), F.lit(v).cast(kind))]
    return F.element_at(F.create_map(*pairs), node)


def assign_shards(rows: DataFrame, dims: list[str], size: str, n_shards: int, tie: str) -> DataFrame:
    """`rows` with `shard`: a narrow, written table with numeric `dims`, a positive `size` and a `tie` of TIE_BITS bits."""
    if n_shards < 1:
        raise ValueError("n_shards must be 1 or more")
    work = rows.withColumns({f"_d{i}": F.coalesce(F.col(d).cast("double"), F.lit(float("-inf"))) for i, d in enumerate(dims)})
    names = [f"_d{i}" for i in range(len(dims))]
    # -inf stands for null until the least value is known
    finite = work.agg(*[F.min(F.when(F.col(n) > float("-inf"), F.col(n))).alias(n) for n in names]).first()
    work = work.withColumns({
        n: F.when(F.col(n) == float("-inf"), F.lit(finite[n] if finite[n] is not None else 0.0)).otherwise(F.col(n)) for n in names
    }).withColumnRenamed(tie, "_tie")
    work = materialize(work.withColumn("_node", F.lit(0)), "shard-level")
    todo = {0: n_shards}  # a node is named by its first shard
    spread: list[float] | None = None
    while any(s > 1 for s in todo.values()):
        wide = {k: s for k, s in todo.items() if s > 1}
        here = work.where(F.col("_node").isin(list(wide)))
        ranges = here.groupBy("_node").agg(
            F.sum(size).alias("w"), *[f(n).alias(f"{k}{n}") for n in names for k, f in (("lo", F.min), ("hi", F.max))]
        ).collect()
        spread = spread or [max((r[f"hi{n}"] - r[f"lo{n}"] for r in ranges), default=0.0) or 1.0 for n in names]
        axis, low, high, want = {}, {}, {}, {}
        for r in ranges:
            widths = [(r[f"hi{n}"] - r[f"lo{n}"]) / spread[i] for i, n in enumerate(names)]
            best = max(range(len(names)), key=lambda i: (widths[i], -i))
            k = r["_node"]
            axis[k], low[k], high[k] = best, r[f"lo{names[best]}"], r[f"hi{names[best]}"]
            want[k] = r["w"] * (wide[k] // 2) / wide[k]
        cuts = _quantiles(here, names, size, axis, low, high, want) if axis else {}
        after, mapped = {k: s for k, s in todo.items() if s == 1}, {}
        for k, s in wide.items():
            after[k] = s // 2
            after[k + s // 2] = s - s // 2
            mapped[k] = k + s // 2
        if cuts:
            n = F.col("_node")
            goes_right = _along(names, axis, low, high) >= _case(n, cuts, "long")
            moved = F.when(n.isin(list(cuts)) & goes_right, _case(n, {k: mapped[k] for k in cuts}, "int")).otherwise(n)
            work = materialize(work.withColumn("_node", moved), "shard-level")
        todo = after
    return work.withColumnRenamed("_node", "shard").drop("_tie", *names)


def _along(names: list[str], axis: dict, low: dict, high: dict) -> Column:
    n = F.col("_node")
    value = F.element_at(F.array(*names), _case(n, {k: a + 1 for k, a in axis.items()}, "int"))
    return _place(value, _case(n, low, "double"), _case(n, high, "double"), F.col("_tie"))


def _quantiles(here: DataFrame, names: list[str], size: str, axis: dict, low: dict, high: dict, want: dict) -> dict[int, int]:
    """Per node the least place with at least `want` bytes before it (nearest of two)."""
    placed = here.select("_node", F.col(size).alias("w"), _along(names, axis, low, high).alias("p"))
    prefix, before = dict.fromkeys(axis, 0), dict.fromkeys(axis, 0)
    bits = VALUE_BITS + TIE_BITS
    for shift in range(bits - PASS_BITS, -1, -PASS_BITS):
        top = F.shiftright("p", shift + PASS_BITS)
        sums = placed.where(top == _case(F.col("_node"), prefix, "long")).groupBy(
            "_node", F.shiftright("p", shift).bitwiseAND((1 << PASS_BITS) - 1).alias("b")
        ).agg(F.sum("w").alias("w")).collect()
        by_node: dict[int, list[tuple[int, int]]] = {}
        for r in sums:
            by_node.setdefault(r["_node"], []).append((r["b"], r["w"]))
        for k, cells in by_node.items():
            digit = 0
            for digit, w in sorted(cells):
                if before[k] + w >= want[k]:
                    break
                before[k] += w
            prefix[k] = (prefix[k] << PASS_BITS) | digit
            if shift == 0:  # the cut goes before or after this last cell, whichever is nearer
                last = dict(cells)[digit]
                prefix[k] += int(before[k] + last - want[k] < want[k] - before[k])
    return prefix


def shard_by_bytes(docs: DataFrame, n_shards: int | None = None, target_bytes: int | None = None) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot of every document, in leaves of about target_bytes."""
    text = F.encode(F.coalesce(F.col("text"), F.lit("")), "UTF-8")
    narrow = materialize(
        docs.select(
            "doc_id", F.monotonically_increasing_id().alias("row"), (F.octet_length(text) + 1).cast("long").alias("size"),
            F.crc32(text).alias("text_crc32"), F.xxhash64(text).alias("text_hash"),
            (F.xxhash64("lang") / F.lit(2.0**64)).alias("lang_place"), (F.xxhash64("source") / F.lit(2.0**64)).alias("source_place"),
        ),
        "shard-rows",
    )
    rows, total = narrow.agg(F.count(F.lit(1)), F.coalesce(F.sum("size"), F.lit(0))).first()
    if n_shards is None:
        if not target_bytes:
            raise ValueError("give n_shards or target_bytes")
        n_shards = max(1, -(-total // target_bytes))
    same, places = ["size", "text_crc32", "text_hash"], ["source_place", "lang_place"]
    groups = narrow.groupBy(*same).agg(
        F.sum("size").alias("weight"), F.count(F.lit(1)).alias("m"), *[F.min(p).alias(f"group_{p}") for p in places]
    )
    groups = materialize(groups.where("m > 1").drop("m"), "shard-groups")
    bits = lambda n, *of: F.shiftrightunsigned(F.xxhash64(F.lit("tie"), *of), 64 - n)
    divided = F.shiftleft(bits(TIE_BITS - ROW_BITS, *same), ROW_BITS).bitwiseOR(bits(ROW_BITS, "row"))
    placed = narrow.join(groups, same, "left").select(
        "doc_id", "row", "size", "text_crc32", F.log2(F.col("size").cast("double")).alias("length"),
        *[F.coalesce(f"group_{p}", p).alias(p) for p in places],
        F.when(F.coalesce("weight", "size") * n_shards * SPLIT > total, divided).otherwise(bits(TIE_BITS, *same)).alias("tie"),
    )
    dealt = assign_shards(placed, ["length", *places], "size", n_shards, "tie")
    identity = ["doc_id", "text_crc32", "size", "row"]
    dealt = materialize(dealt.select(*identity, "shard"), "shards")
    return dense_slots(dealt, ["shard"], identity, rows, "slot").drop("row")


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    return shard_by_bytes(docs, n_shards=16).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
