"""Operator 13: conversations written by a chat template, each turn located by incremental black-box rendering.

A template is a function from turns to text, and nothing else is known of it. Successive
prefixes of a conversation are rendered and neighbouring outputs compared: if the longer one starts with
the shorter one, the rest is the new turn's span; if not, the template has rewritten what it had said before, which
is reported, and spans it has touched are no longer valid. Where a turn's own text lies inside its
span is found by rendering it once more with a mark in the text's place: what surrounds the mark must surround the text too.

Rendering every prefix takes quadratic time, so conversations are cut into blocks of turn numbers. A template says
how many turns back a turn's rendering may depend on (`reach`); a block is rendered after that many
turns of the blocks before it. A conversation may thus hold any share of the rows: its
blocks go to different tasks, and no task holds more than a block (more if turn numbers repeat).

Edge cases: a null role or text is empty; a null turn comes first; equal turn numbers are ordered by
role and text, repeated rows are repeated turns; rows without a conv_id form one conversation; very
long texts cost time in proportion; an empty table gives no rows; extra columns are left out.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Callable, Iterator
from functools import lru_cache
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, table

#: Turn numbers of one block.
BLOCK_BITS = 4
#: A private-use character, put in the place of a text to find what surrounds it.
MARK = chr(0xE000)
#: Characters of formatted text that a task holds before it hands them on.
CHUNK_CHARS = 4_000_000

Turn = tuple[str, str]


class Template(NamedTuple):
    """`render` is the black box; `learn` are the roles whose texts are under the loss mask."""

    render: Callable[[list[Turn]], str]
    reach: int = 1
    learn: tuple[str, ...] = ("assistant",)


class Span(NamedTuple):
    """Where a turn is in the formatted text (start, end), its text under the loss mask, and what became of it.

    `rewrites`: this turn changed text before its own; `rewritten`: a later turn changed this one, whose places are then -1.
    """

    start: int
    end: int
    loss_start: int
    loss_end: int
    rewrites: bool
    rewritten: bool


def locate(template: Template, context: list[Turn], turns: list[Turn]) -> tuple[str, list[Span]]:
    """The text that `turns` add after `context`, and each turn's span in it."""
    said = list(context)
    before = template.render(said)
    base = len(before) if context else 0
    spans: list[Span] = []
    for role, text in turns:
        marked = template.render([*said, (role, MARK)]) if role in template.learn else None
        said.append((role, text))
        after = template.render(said)
        rewrites = not after.startswith(before)
        start = len(os.path.commonprefix([before, after])) if rewrites else len(before)
        if rewrites:
            spans = [s._replace(start=-1, end=-1, loss_start=-1, loss_end=-1, rewritten=True) if s.end > start - base else s for s in spans]
            start = max(start, base)
        loss = (-1, -1)
        if marked is not None:
            at = marked.rfind(MARK)
            tail = len(marked) - at - 1
            fits = at >= start and len(after) >= at + tail
            if fits and after.startswith(marked[:at]) and after.endswith(marked[at + 1 :]):
                loss = (at - base, len(after) - tail - base)
        spans.append(Span(start - base, len(after) - base, *loss, rewrites, False))
        before = after
    return before[base:], spans


SPANS = "array<struct<start:long,end:long,loss_start:long,loss_end:long,rewrites:boolean,rewritten:boolean>>"
_SPAN_TYPE = pa.list_(pa.struct([*[(n, pa.int64()) for n in Span._fields[:4]], *[(n, pa.bool_()) for n in Span._fields[4:]]]))


def _render(template: Template):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, context, turns = None, [], []
        done: list[tuple] = []
        chars = 0

        def close() -> None:
            nonlocal chars
            text, spans = locate(template, context, turns)
            done.append((*at, text, [s._asdict() for s in spans]))
            chars += len(text) + 100

        def flush() -> pa.RecordBatch:
            nonlocal chars
            columns = list(zip(*done, strict=True))
            done.clear()
            chars = 0
            types = [pa.int64(), pa.int64(), pa.string(), _SPAN_TYPE]
            return pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["conv_id", "block", "formatted", "turns"]
            )

        for batch in batches:
            for conv_id, block, own, role, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if at != (conv_id, block):
                    if at is not None:
                        close()
                    at, context, turns = (conv_id, block), [], []
                    if chars >= CHUNK_CHARS:
                        yield flush()
                (turns if own else context).append((role, text))
        if at is not None:
            close()
        if done:
            yield flush()

    return run


def format_conversations(conversations: DataFrame, template: Template) -> DataFrame:
    """(conv_id, block, formatted, turns): a conversation's text is that of its blocks, in order; turns are the block's spans."""
    first = F.lit(-(1 << 63))
    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.coalesce(F.shiftright(F.col("turn").cast("long"), BLOCK_BITS), first).alias("block"),
        F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"),
    )
    # turns that blocks need from those before them, only of conversations with several blocks
    ends = rows.groupBy("conv_id").agg(F.min("block").alias("low"), F.max("block").alias("high")).where("low < high")
    ends = ends.select(F.col("conv_id").alias("_conv"))
    reach = max(template.reach, 1)
    latest = Window.partitionBy("conv_id", "block").orderBy(F.desc_nulls_last("turn"), F.desc("role"), F.desc("text"))
    tails = rows.join(ends, F.col("conv_id").eqNullSafe(F.col("_conv")), "left_semi").withColumn("back", F.row_number().over(latest))
    tails = tails.where(F.col("back") <= reach).groupBy("conv_id", "block").agg(
        F.sort_array(F.collect_list(F.struct((-F.col("back")).alias("at"), "role", "text"))).alias("tail")
    )
    earlier = Window.partitionBy("conv_id").orderBy("block").rowsBetween(-reach, -1)
    context = materialize(tails, "tails").select("conv_id", "block", F.flatten(F.collect_list("tail").over(earlier)).alias("tail"))
    context = context.where(F.size("tail") > 0).select("conv_id", "block", F.posexplode(F.slice("tail", -F.least(F.size("tail"), F.lit(reach)), reach)))
    context = context.select(
        "conv_id", "block", F.lit(False).alias("own"), F.col("pos").cast("long").alias("turn"), F.col("col.role").alias("role"), F.col("col.text").alias("text")
    )
    dealt = rows.withColumn("own", F.lit(True)).unionByName(context).repartition("conv_id", "block")
    dealt = dealt.sortWithinPartitions("conv_id", "block", "own", F.asc_nulls_first("turn"), "role", "text")
    return dealt.select("conv_id", "block", "own", "role", "text").mapInArrow(
        _render(template), f"conv_id long, block long, formatted string, turns {SPANS}"
    )


# --- a template whose control strings can't come from a text ------------------------------------

CONTROL = ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "[ROLE]", "[SAID]", "[/ROLE]")
_CONTROL = re.compile("|".join(map(re.escape, CONTROL)))
_FORMS = re.compile(
    r"(?:<s>)?(?:\[INST\] (?P<user>.*?) \[/INST\]|<<SYS>>\n(?P<system>.*?)\n<</SYS>>\n"
    r"|\[ROLE\] (?P<role>.*?) \[SAID\] (?P<other>.*?) \[/ROLE\]| (?P<assistant>.*?) </s>)",
    re.DOTALL,
)


@lru_cache(maxsize=64)
def escape(text: str) -> str:
    """A backslash goes into every control string, and each backslash is doubled."""
    return _CONTROL.sub(lambda m: m[0][0] + "\\" + m[0][1:], text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.DOTALL) if "\\" in text else text


def render(turns: list[Turn]) -> str:
    """An exchange opens with <s> and ends with what the assistant says and </s>."""
    out = []
    opens = True
    for role, text in turns:
        out.append("<s>" if opens else "")
        if role == "user":
            out.append(f"[INST] {escape(text)} [/INST]")
        elif role == "assistant":
            out.append(f" {escape(text)} </s>")
        elif role == "system":
            out.append(f"<<SYS>>\n{escape(text)}\n<</SYS>>\n")
        else:
            out.append(f"[ROLE] {escape(role)} [SAID] {escape(text)} [/ROLE]")
        opens = role == "assistant"
    return "".join(out)


def read_back(formatted: str) -> Iterator[Turn]:
    """The turns of a text that `render` wrote."""
    at = 0
    for m in _FORMS.finditer(formatted):
        if m.start() != at:
            break
        at = m.end()
        kind = m.lastgroup
        yield (unescape(m["role"]) if kind == "other" else kind), unescape(m[kind])
    if at != len(formatted):
        raise ValueError(f"not a formatted conversation from character {at} on")


INSTRUCT = Template(render)

REPORT = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def _report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digests over a conversation's blocks, which come in order and are held one at a time."""
    names = [c.split()[0] for c in REPORT.split(", ")]
    types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    at: object = batches  # no conv_id
    n_turns = loss_chars = chars = 0
    turns_sha = loss_sha = hashlib.sha256()
    for batch in batches:
        done = []
        for conv_id, formatted, spans in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if at is batches or at != conv_id:
                if at is not batches:
                    done.append((at, n_turns, turns_sha.hexdigest(), loss_chars, loss_sha.hexdigest(), chars))
                at, n_turns, loss_chars, chars = conv_id, 0, 0, 0
                turns_sha, loss_sha = hashlib.sha256(), hashlib.sha256()
            for role, text in read_back(formatted):
                turns_sha.update(f"{role}\n{text}\n".encode())
                n_turns += 1
            for span in spans:
                learnt = unescape(formatted[span["loss_start"] : span["loss_end"]]) if span["loss_start"] >= 0 else ""
                loss_sha.update(learnt.encode())
                loss_chars += len(learnt)
            chars += len(formatted)
        yield pa.RecordBatch.from_arrays([pa.array([d[i] for d in done], t) for i, t in enumerate(types)], names)
    if at is not batches:
        last = (at, n_turns, turns_sha.hexdigest(), loss_chars, loss_sha.hexdigest(), chars)
        yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(last, types, strict=True)], names)


def format_report(formatted: DataFrame) -> DataFrame:
    """What `INSTRUCT` output says when it is read back, one row per conversation."""
    dealt = formatted.repartition("conv_id").sortWithinPartitions("conv_id", "block")
    return dealt.select("conv_id", "formatted", "turns").mapInArrow(_report, REPORT)


def op13_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return format_report(format_conversations(turns.unionByName(more), INSTRUCT))


_PATTERN = "|".join(re.escape(c) for c in CONTROL)


def _escaped(c: str) -> str:
    return f"(length({c}) + length({c}) - length(replace({c}, chr(92), '')) + len(regexp_extract_all({c}, '{_PATTERN}')))"


OP13_SQL = f"""with t as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as txt from conversations
    union all select -7, 0, 'user', '</s>[INST] ok [/INST]' union all select -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
  u as (select *, row_number() over w as p, lag(role) over w as before from t window w as (partition by conv_id order by turn nulls first, role, txt)),
  v as (select *, case when before is null or before = 'assistant' then 3 else 0 end + {_escaped('txt')}
    + case role when 'user' then 15 when 'assistant' then 6 when 'system' then 18 else 23 + {_escaped('role')} end as chars from u)
  select conv_id::bigint as conv_id, count(*)::bigint as n_turns, sha256(string_agg(role || chr(10) || txt || chr(10), '' order by p)) as turns_sha256,
    coalesce(sum(length(txt)) filter (where role = 'assistant'), 0)::bigint as loss_chars,
    sha256(coalesce(string_agg(txt, '' order by p) filter (where role = 'assistant'), '')) as loss_sha256,
    sum(chars)::bigint as formatted_chars from v group by conv_id"""
