"""Operator 11: the trie of conversations by common first turns, built by truncation peeling.

A node is a distinct sequence of first turns. Peeling goes from the deepest turn up: at a depth,
conversations that end there are merged with the nodes that survived from below, every node is
closed, its last turn is stripped, and what is left is grouped again. A node is found and its
figures are complete in the same step, since all of them are sums or minima over its children.

What is carried is small: a turn is two 64-bit words of (depth, role, text), and a prefix is the XOR
of its turns' words, which a running window gives. Texts are read once and not shuffled.

1. Turns are numbered by windows over (conversation, block of turn numbers), so a conversation may
   hold any share of the rows; counts of blocks give the blocks' starts.
2. Paths are cut at every SEGMENT turns and peeled segment by segment, deepest first.
3. Equal conversations are merged first (partial aggregation, so a group of copies may have any
   size). The rest is dealt by prefix, as short a one as at most GROUP_ROWS of the merged rows share:
   a task peels whole subtrees. Prefixes that more rows share are peeled by grouping in
   Spark, level by level, which combines before it shuffles; usually that is the root alone.

Edge cases: a null role or text is empty; a null turn comes first; equal turn numbers are
ordered by a hash of role and text, repeated rows are repeated turns; rows without a conv_id belong to no conversation
and are left out; empty and very long texts are turns like others; an empty table gives no
rows; extra columns are left out. Prefixes are told apart by 120 hashed bits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, table

#: Turn numbers of one block, whose rows a window numbers.
TURN_BITS = 8
#: Turns after which a path is cut.
SEGMENT = 1024
#: Merged conversations that one task may hold below a prefix.
GROUP_ROWS = 512
#: Rows that are peeled together, more if one prefix has more.
CHUNK_ROWS = 20_000
#: Conversation ids of one piece of a node's list.
ID_BITS = 12

PATH = ["x1", "x2", "sizes"]
STATS = "depth long, k1 long, k2 long, conv_id long, n_convs long, n_children long, n_leaves long, saved long"


def ordered_turns(conversations: DataFrame, size: Column | None = None) -> DataFrame:
    """(conv_id, depth from 1, g1, g2, size) per turn; `size` is what a shared turn saves (default: its code points)."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    digest = F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text))
    rows = conversations.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        digest.alias("_digest"),
        (F.length(text) if size is None else size).cast("long").alias("size"),
    )
    rows = rows.select(
        "conv_id", "turn", "size",
        F.coalesce(F.shiftright("turn", TURN_BITS), F.lit(-(1 << 63))).alias("block"),
        *[F.conv(F.substring("_digest", 1 + 15 * i, 15), 16, 10).cast("long").alias(f"g{i + 1}") for i in (0, 1)],
    )
    inside = Window.partitionBy("conv_id", "block").orderBy(F.asc_nulls_first("turn"), "g1", "g2")
    placed = materialize(rows.withColumn("at", F.row_number().over(inside).cast("long")), "turns")
    before = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = placed.groupBy("conv_id", "block").agg(F.count(F.lit(1)).alias("n"))
    starts = starts.select("conv_id", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    return placed.join(starts, ["conv_id", "block"]).select("conv_id", (F.col("at") + F.col("start")).alias("depth"), "g1", "g2", "size")


def lengths(turns: DataFrame) -> DataFrame:
    """(conv_id, length) of every conversation with a turn."""
    return turns.groupBy("conv_id").agg(F.max("depth").alias("length"))


def _paths(turns: DataFrame, members: DataFrame, segment: int) -> DataFrame:
    """(conv_id, seg, length, x1, x2, sizes): prefixes of a segment's depths, that of the depth before it first."""
    words = [F.xxhash64(F.lit(i), "depth", "g1", "g2").alias(f"m{i}") for i in (1, 2)]
    seg = F.floor((F.col("depth") - 1) / segment).cast("long")
    running = Window.partitionBy("conv_id", "seg").orderBy("depth")
    rows = turns.select("conv_id", "depth", "size", seg.alias("seg"), *words)
    rows = rows.select("conv_id", "seg", "depth", "size", *[F.bit_xor(f"m{i}").over(running).alias(f"x{i}") for i in (1, 2)])
    steps = F.sort_array(F.collect_list(F.struct("depth", "x1", "x2", "size")))
    paths = materialize(rows.groupBy("conv_id", "seg").agg(steps.alias("steps")), "paths")
    before = Window.partitionBy("conv_id").orderBy("seg").rowsBetween(Window.unboundedPreceding, -1)
    last = paths.select("conv_id", "seg", *[F.element_at("steps", -1)[f"x{i}"].alias(f"x{i}") for i in (1, 2)])
    starts = last.select("conv_id", "seg", *[F.coalesce(F.bit_xor(f"x{i}").over(before), F.lit(0)).alias(f"s{i}") for i in (1, 2)])

    def shifted(i: int) -> Column:
        start = F.col(f"s{i}")
        return F.concat(F.array(start), F.transform(F.col("steps")[f"x{i}"], lambda x: x.bitwiseXOR(start)))

    return paths.join(starts, ["conv_id", "seg"]).join(members, "conv_id").select(
        "conv_id", "seg", "length", shifted(1).alias("x1"), shifted(2).alias("x2"),
        F.concat(F.array(F.lit(0).cast("long")), F.col("steps")["size"]).alias("sizes"),
    )


def _peel(low: int):
    """Peel the subtrees of a task's rows, each down to its own `cut`; rows of one subtree come together."""

    def subtrees(rows: pd.DataFrame) -> pd.DataFrame:
        x1, x2, sizes = (rows[c].tolist() for c in PATH)
        cuts, depths = rows["cut"].tolist(), rows["depth"].tolist()
        figures = list(zip(*(rows[c].tolist() for c in ("n_convs", "conv_id", "n_children", "n_leaves", "saved")), strict=True))
        order = sorted(range(len(rows)), key=depths.__getitem__, reverse=True)
        out: list[list] = []
        alive: dict[tuple[int, int], list] = {}  # at the current depth
        at, depth = 0, (depths[order[0]] if order else 0)
        while alive or at < len(order):
            if not alive:
                depth = depths[order[at]]
            while at < len(order) and depths[order[at]] == depth:
                i = order[at]
                at += 1
                _merge(alive, (int(x1[i][depth - low]), int(x2[i][depth - low])), figures[i], i, ())
            above: dict[tuple[int, int], list] = {}
            for key, (n_convs, conv_id, n_children, n_leaves, saved, i, below) in alive.items():
                n_leaves = n_leaves if n_children else 1
                saved += (n_convs - 1) * int(sizes[i][depth - low])
                top = depth == cuts[i]
                for child in below:
                    out[child][8] = conv_id
                own = len(out)
                out.append([depth, *key, conv_id, n_convs, n_children, n_leaves, saved, 0, top, i])
                if not top:
                    up = (int(x1[i][depth - 1 - low]), int(x2[i][depth - 1 - low]))
                    _merge(above, up, (n_convs, conv_id, 1, n_leaves, saved), i, (own,))
            alive, depth = above, depth - 1
        names = [*(c.split()[0] for c in STATS.split(", ")), "parent_conv_id", "top", "row"]
        nodes = pd.DataFrame(out, columns=names)
        for c, from_ in zip(PATH, (x1, x2, sizes), strict=True):
            nodes[c] = [from_[i][: d - low] if top else np.empty(0, np.int64) for d, top, i in zip(nodes["depth"], nodes["top"], nodes["row"], strict=True)]
        return nodes.drop(columns="row")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for batch in batches:
            held.append(batch)
            if sum(map(len, held)) >= CHUNK_ROWS:
                rows = pd.concat(held, ignore_index=True)
                last = (rows["c1"] != rows["c1"].iloc[-1]) | (rows["c2"] != rows["c2"].iloc[-1])
                whole = int(last[last].index[-1]) + 1 if last.any() else 0
                held = [rows.iloc[whole:].reset_index(drop=True)]
                if whole:
                    yield subtrees(rows.iloc[:whole].reset_index(drop=True))
        if held and sum(map(len, held)):
            yield subtrees(pd.concat(held, ignore_index=True))

    return run


def _merge(nodes: dict, key: tuple[int, int], figures: tuple, row: int, below: tuple) -> None:
    n_convs, conv_id, n_children, n_leaves, saved = figures
    node = nodes.get(key)
    if node is None:
        nodes[key] = [n_convs, conv_id, n_children, n_leaves, saved, row, list(below)]
        return
    node[0] += n_convs
    node[1] = min(node[1], conv_id)
    node[2] += n_children
    node[3] += n_leaves
    node[4] += saved
    node[6].extend(below)


def _sums() -> list[Column]:
    return [
        F.min("conv_id").alias("conv_id"), *[F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved")],
        *[F.first(c).alias(c) for c in PATH],
    ]


def _closed(merged: DataFrame, size: Column) -> DataFrame:
    """Nodes all of whose members and children have been merged."""
    leaves = F.when(F.col("n_children") == 0, F.lit(1).cast("long")).otherwise(F.col("n_leaves"))
    return merged.withColumn("n_leaves", leaves).withColumn("saved", F.col("saved") + (F.col("n_convs") - 1) * size)


def _stripped(nodes: DataFrame) -> DataFrame:
    """What closed nodes give to their parents: the path above is what `top` nodes carry."""
    return nodes.select(
        (F.col("depth") - 1).alias("depth"), F.element_at("x1", -1).alias("k1"), F.element_at("x2", -1).alias("k2"), "conv_id", "n_convs",
        F.lit(1).cast("long").alias("n_children"), "n_leaves", "saved", *PATH,
    )


def _segment(active: DataFrame, low: int, group_rows: int) -> tuple[list[DataFrame], DataFrame]:
    """Peel one segment: (tables of closed nodes, merged but open nodes at depth `low`)."""

    def at(depth: Column | int, c: str) -> Column:
        return F.try_element_at(F.col(c), F.lit(depth - low + 1) if isinstance(depth, int) else (depth - low + 1).cast("int"))

    active = materialize(active.withColumn("cut", F.lit(low + 1).cast("long")), "active")
    depth = low + 1
    while True:  # prefixes that too many share are cut one turn further down
        here = active.where((F.col("cut") == depth) & (F.col("depth") >= depth))
        hot = here.groupBy(at(depth, "x1").alias("h1"), at(depth, "x2").alias("h2")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > group_rows)
        if hot.isEmpty():
            break
        reaches = (F.col("cut") == depth) & (F.col("depth") >= depth)
        same = reaches & (at(depth, "x1") == F.col("h1")) & (at(depth, "x2") == F.col("h2"))
        further = F.when(F.col("n").isNotNull(), F.lit(depth + 1).cast("long")).otherwise(F.col("cut"))
        active = materialize(active.join(materialize(hot, "hot"), same, "left").withColumn("cut", further).drop("h1", "h2", "n"), "active")
        depth += 1
    dealt = active.where("cut <= depth").withColumns({"c1": at(F.col("cut"), "x1"), "c2": at(F.col("cut"), "x2")})
    dealt = dealt.repartition("c1", "c2").sortWithinPartitions("c1", "c2")
    schema = f"{STATS}, parent_conv_id long, top boolean, x1 array<long>, x2 array<long>, sizes array<long>"
    tables = [materialize(dealt.mapInPandas(_peel(low), schema), "nodes")]
    tops = tables[0].where("top")
    for level in range(depth - 1, low - 1, -1):
        above = _stripped(tops.where(F.col("depth") == level + 1))
        if level > low:
            ended = active.where((F.col("cut") > F.col("depth")) & (F.col("depth") == level)).select(*above.columns[:-3], *[
                F.slice(c, 1, level - low + 1).alias(c) for c in PATH
            ])
            above = above.unionByName(ended)
        merged = above.groupBy("depth", "k1", "k2").agg(*_sums())
        if level == low:
            return tables, materialize(merged.drop(*PATH), "open")
        closed = _closed(merged, at(level, "sizes")).withColumn("parent_conv_id", F.lit(0).cast("long")).withColumn("top", F.lit(True))
        shorter = {c: F.slice(c, 1, level - low) for c in PATH}
        tables.append(materialize(closed.withColumns(shorter).select(*tables[0].columns), "nodes"))
        tops = tops.where(F.col("depth") <= level).unionByName(tables[-1])
    raise AssertionError("unreachable")


def build_trie(turns: DataFrame, members: DataFrame, segment: int = SEGMENT, group_rows: int = GROUP_ROWS) -> tuple[DataFrame, DataFrame]:
    """The nodes, and the node that each conversation ends at.

    `turns` as `ordered_turns` gives them, `members` (conv_id, length) with every conversation, one
    without turns too. Nodes: depth, k1, k2 (its key), conv_id (its smallest member),
    parent_conv_id, n_convs, n_children, n_leaves, saved. Ends: conv_id, depth, k1, k2.
    """
    zero = F.lit(0).cast("long")
    paths = materialize(_paths(turns, members, segment), "paths")
    deepest = paths.agg(F.max("seg")).first()[0]
    ends = paths.where(F.col("length") == F.col("seg") * segment + F.size("x1") - 1).select(
        "conv_id", "seg", F.col("length").alias("depth"), F.element_at("x1", -1).alias("k1"), F.element_at("x2", -1).alias("k2"), *PATH
    )
    bare = members.where("length = 0").select("conv_id", zero.alias("depth"), zero.alias("k1"), zero.alias("k2"))
    tables: list[DataFrame] = []
    below: DataFrame | None = None
    for seg in range(-1 if deepest is None else deepest, -1, -1):
        start = ends.where(F.col("seg") == seg).withColumns({"n_convs": F.lit(1).cast("long"), "n_children": zero, "n_leaves": zero, "saved": zero})
        active = start.groupBy("depth", "k1", "k2").agg(*_sums())
        if below is not None:
            active = active.unionByName(below.join(paths.where(F.col("seg") == seg).select("conv_id", *PATH), "conv_id"))
        closed, below = _segment(active, seg * segment, group_rows)
        tables += closed
    empty = bare.withColumns({"n_convs": F.lit(1).cast("long"), "n_children": zero, "n_leaves": zero, "saved": zero})
    roots = empty if below is None else empty.unionByName(below)
    sums = [F.min("conv_id").alias("conv_id"), *[F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved")]]
    root = materialize(_closed(roots.groupBy("depth", "k1", "k2").agg(*sums), zero), "root")
    kept = ["depth", "k1", "k2", "conv_id", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved"]
    ended = ends.select("conv_id", "depth", "k1", "k2").unionByName(bare)
    root_node = root.withColumn("parent_conv_id", F.lit(None).cast("long")).select(*kept)
    if not tables:
        return root_node, ended
    nodes = reduce(DataFrame.unionByName, tables)
    # parents closed elsewhere: the root (one row), nodes closed by level, and the last depth of a segment
    first = nodes.where("top and depth = 1").drop("parent_conv_id").join(F.broadcast(root.select(F.col("conv_id").alias("parent_conv_id"))))
    upper = nodes.where(F.col("top") | (F.col("depth") % segment == 0)).select(
        (F.col("depth") + 1).alias("depth"), F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("conv_id").alias("parent_conv_id")
    )
    later = nodes.where("top and depth > 1").drop("parent_conv_id").withColumns({"p1": F.element_at("x1", -1), "p2": F.element_at("x2", -1)})
    linked = [nodes.where("not top"), first, *([later.join(upper, ["depth", "p1", "p2"])] if len(tables) > 1 else [])]
    return reduce(DataFrame.unionByName, [root_node, *[n.select(*kept) for n in linked]]), ended


def prefix_trie(conversations: DataFrame, size: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """`build_trie` of (conv_id, turn, role, text) rows."""
    turns = materialize(ordered_turns(conversations, size), "turns")
    return build_trie(turns, materialize(lengths(turns), "members"))


def ends_digest(ends: DataFrame) -> DataFrame:
    """(depth, k1, k2, ends_sha256) of nodes where conversations end: their ids, ascending, comma-joined.

    A node's list may have any length: it is put together in pieces of neighbouring ids, and
    the digest is taken piece by piece.
    """
    pieces = ends.groupBy("depth", "k1", "k2", F.shiftright("conv_id", ID_BITS).alias("piece")).agg(
        F.array_join(F.transform(F.sort_array(F.collect_list("conv_id")), lambda x: x.cast("string")), ",").alias("ids")
    )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        node, state = None, None
        for batch in batches:
            done = []
            for depth, k1, k2, ids in zip(batch["depth"], batch["k1"], batch["k2"], batch["ids"], strict=True):
                if (depth, k1, k2) != node:
                    if state is not None:
                        done.append((*node, state.hexdigest()))
                    node, state = (depth, k1, k2), hashlib.sha256(ids.encode())
                else:
                    state.update(b"," + ids.encode())
            yield pd.DataFrame(done, columns=["depth", "k1", "k2", "ends_sha256"])
        if state is not None:
            yield pd.DataFrame([(*node, state.hexdigest())], columns=["depth", "k1", "k2", "ends_sha256"])

    dealt = pieces.repartition("k1", "k2", "depth").sortWithinPartitions("k1", "k2", "depth", "piece")
    return dealt.mapInPandas(run, "depth long, k1 long, k2 long, ends_sha256 string")


#: A conversation takes its first turns from the one that opens its block of ids.
HEAD_BLOCK, HEAD_TURNS = 100, 6


def share_heads(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(turns, members) of the conversations rebuilt as the query wants them: a head from the block's first."""
    own = materialize(lengths(turns), "lengths")
    base = F.col("conv_id") - F.col("conv_id") % HEAD_BLOCK
    wanted = own.select("conv_id", "length", base.alias("base"), (F.crc32(F.col("conv_id").cast("string")) % HEAD_TURNS).alias("h"))
    bases = own.select(F.col("conv_id").alias("base"), F.col("length").alias("base_length"))
    heads = wanted.join(bases, "base", "left").withColumn("k", F.least("h", F.coalesce("base_length", F.lit(0).cast("long"))))
    heads = materialize(heads, "heads")
    rest = turns.join(heads.select("conv_id", "h", "k"), "conv_id").where("depth > h")
    rest = rest.select("conv_id", (F.col("depth") - F.col("h") + F.col("k")).alias("depth"), "g1", "g2", "size")
    first = turns.where((F.col("depth") < HEAD_TURNS) & (F.col("conv_id") % HEAD_BLOCK == 0)).withColumnRenamed("conv_id", "base")
    taken = first.join(heads.select("conv_id", "base", "k"), "base").where("depth <= k").select(*rest.columns)
    members = heads.select("conv_id", (F.col("k") + F.greatest(F.col("length") - F.col("h"), F.lit(0).cast("long"))).alias("length"))
    return rest.unionByName(taken), members


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie_report(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"))


def trie_report(conversations: DataFrame) -> DataFrame:
    turns = materialize(ordered_turns(conversations), "turns")
    nodes, ends = build_trie(*share_heads(turns))
    none = F.lit(hashlib.sha256(b"").hexdigest())
    return nodes.join(ends_digest(ends), ["depth", "k1", "k2"], "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", F.col("saved").alias("saved_tokens"),
        F.coalesce("ends_sha256", none).alias("ends_sha256"),
    )


# crc32 of a decimal number, bit by bit
_CRC = """xor(list_reduce(list_prepend(4294967295::bigint, [ord(x)::bigint for x in string_split(conv_id::varchar, '')]), lambda a, b:
  list_reduce(list_prepend(xor(a, b), [0::bigint, 0, 0, 0, 0, 0, 0, 0]), lambda v, i: xor(v >> 1, (v & 1) * 3988292384))), 4294967295)"""

OP11_SQL = f"""with t as (select conv_id, coalesce(role, '') as role, coalesce(text, '') as txt,
    row_number() over (partition by conv_id order by turn nulls first,
      md5(length(coalesce(role, ''))::varchar || ':' || coalesce(role, '') || coalesce(text, ''))) as p
    from conversations where conv_id is not null),
  own as (select conv_id, count(*) as n from t group by conv_id),
  heads as (select o.conv_id, o.conv_id - o.conv_id % 100 as base, {_CRC.replace('conv_id', 'o.conv_id')} % 6 as h,
    coalesce(b.n, 0) as base_n from own o left join own b on b.conv_id = o.conv_id - o.conv_id % 100),
  rebuilt as (select h.conv_id, t.p as d, t.role, t.txt from heads h join t on t.conv_id = h.base and t.p <= h.h
    union all select h.conv_id, t.p - h.h + least(h.h, h.base_n), t.role, t.txt from heads h join t using (conv_id) where t.p > h.h),
  keyed as (select conv_id, d, length(txt) as size,
    string_agg(md5(length(role)::varchar || ':' || role || txt), '/') over (partition by conv_id order by d) as key from rebuilt),
  steps as (select conv_id, 0 as d, 0 as size, '' as key, null as up from own union all
    select conv_id, d, size, key, coalesce(lag(key) over (partition by conv_id order by d), '') from keyed),
  nodes as (select d, key, any_value(up) as up, any_value(size) as size, min(conv_id) as conv_id, count(*) as n_convs from steps group by d, key),
  kids as (select up as key, d - 1 as d, count(*) as n_children from nodes where d > 0 group by all),
  sized as (select n.*, coalesce(k.n_children, 0) as n_children from nodes n left join kids k using (key, d)),
  pairs as (select distinct a.d as ad, a.key as akey, b.d as bd, b.key as bkey from steps a join steps b on a.conv_id = b.conv_id and b.d >= a.d),
  sums as (select p.ad as d, p.akey as key, count(*) filter (where s.n_children = 0) as n_leaves, sum((s.n_convs - 1) * s.size) as saved
    from pairs p join sized s on s.d = p.bd and s.key = p.bkey group by all),
  lasts as (select conv_id, max(d) as d, arg_max(key, d) as key from steps group by conv_id),
  ends as (select d, key, sha256(string_agg(conv_id::varchar, ',' order by conv_id)) as digest from lasts group by all)
  select s.conv_id::bigint as conv_id, s.d::bigint as depth, p.conv_id::bigint as parent_conv_id, s.n_convs::bigint as n_convs,
    s.n_children::bigint as n_children, u.n_leaves::bigint as n_leaves, u.saved::bigint as saved_tokens,
    coalesce(e.digest, sha256('')) as ends_sha256
  from sized s join sums u using (d, key) left join nodes p on p.d = s.d - 1 and p.key = s.up left join ends e on e.d = s.d and e.key = s.key"""
