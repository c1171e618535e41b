"""Operator 8: quality rules as a cascade that stops at the first rule a text fails.

Everything is a Column expression. Each rule's cost and share of rejections are measured on
a bounded sample of rows, and the rules are then tried in order of rejections per unit of
cost. The sample is the SAMPLE_ROWS texts of least hash, written once, so that it is the same for the
same table however the table is split; a cost is the least time of several runs over it, in doubling
steps, and rules of equal rate stay in the order given, so that noise seldom changes the order. The order
decides how much work a rejected text causes, never which texts are kept: a text is kept if no rule
rejects it.

Edge cases: a null or empty text has no words and no lines with a word, so it fails the rule
on the number of words; repeated rows are judged alike; an empty table gives an empty
table; other columns pass through untouched, whatever their names.
"""

from __future__ import annotations

import math
import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD_SPACE, free_names, let, materialize, table, words

SYMBOLS = "#*$%&|<>"
WINDOW = 8
MIN_WORDS = 20
#: Rows that cost and selectivity are measured on.
SAMPLE_ROWS = 400
#: Runs of each rule over the sample, and how often a run judges each of its rows.
RUNS, TIMES = 3, 4
#: Costs below this share of the dearest rule's are taken as equal: they drown in the start of a job.
LEAST_COST = 1 / 64


def word_chars(text: Column) -> Column:
    return F.length(F.translate(F.coalesce(text, F.lit("")), WORD_SPACE, "")).cast("long")


def n_symbols(text: Column) -> Column:
    whole = F.coalesce(text, F.lit(""))
    return (F.length(whole) - F.length(F.translate(whole, SYMBOLS, ""))).cast("long")


def worded_lines(text: Column) -> Column:
    lines = F.split(F.coalesce(text, F.lit("")), "\n", -1)
    return F.filter(lines, lambda x: F.length(F.translate(x, WORD_SPACE, "")) > 0)


def n_dup_lines(text: Column) -> Column:
    """Lines with a word that equal an earlier line of the text."""
    return let(worded_lines(text), lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long"))


def n_repeat_words(tokens: Column, k: int = WINDOW) -> Column:
    """Words inside k-word windows that the text has at least twice.

    Most texts repeat no window: comparing the number of distinct 64-bit window hashes with
    the number of windows shows that. Only for the others are the windows themselves sorted,
    so that equal ones become neighbours and their stretches can be added up.
    """
    def count(t: Column) -> Column:
        starts = F.when(F.size(t) >= k, F.sequence(F.lit(1), F.size(t) - (k - 1))).otherwise(F.array().cast("array<int>"))
        hashes = F.transform(starts, lambda i: F.xxhash64(F.slice(t, i, k)))
        windows = F.array_sort(
            F.transform(starts, lambda i: F.struct(F.array_join(F.slice(t, i, k), " ").alias("w"), i.alias("i")))
        )
        plain = let(hashes, lambda h: F.size(F.array_distinct(h)) == F.size(h))
        return F.when(plain, F.lit(0).cast("long")).otherwise(let(let(windows, repeated), covered))

    def repeated(w: Column) -> Column:
        same = lambda j, x: F.coalesce(F.get(w, j)["w"] == x["w"], F.lit(False))
        twice = F.filter(w, lambda x, j: same(j - 1, x) | same(j + 1, x))
        return F.array_sort(F.transform(twice, lambda x: x["i"]))

    def covered(at: Column) -> Column:
        gaps = F.transform(at, lambda p, j: F.least(F.lit(k), F.coalesce(F.get(at, j + 1) - p, F.lit(k))))
        return F.aggregate(gaps, F.lit(0).cast("long"), lambda a, g: a + g)

    return let(tokens, count)


@dataclass(frozen=True)
class Measures:
    """What rules may look at. Expressions are evaluated only by the rules that name them."""

    text: Column
    tokens: Column
    n_words: Column
    word_chars: Column
    n_symbols: Column
    n_dup_lines: Column
    n_repeat_words: Column

    @staticmethod
    def of(text: Column, tokens: Column, n_words: Column) -> "Measures":
        return Measures(
            text, tokens, n_words, word_chars(text), n_symbols(text), n_dup_lines(text), n_repeat_words(tokens)
        )


@dataclass(frozen=True)
class Rule:
    name: str
    rejects: Callable[[Measures], Column]


BASE_RULES = (
    Rule("few_words", lambda m: m.n_words < MIN_WORDS),
    Rule("repetition", lambda m: 100 * m.n_repeat_words > 30 * m.n_words),
)
RULES = (
    *BASE_RULES,
    Rule("symbols", lambda m: 100 * m.n_symbols > 10 * m.n_words),
    Rule("word_length", lambda m: (m.word_chars < 2 * m.n_words) | (m.word_chars > 15 * m.n_words)),
    Rule("repeated_lines", lambda m: 100 * m.n_dup_lines > 50 * F.size(worded_lines(m.text))),
    Rule(
        "capitals",
        lambda m: 2 * F.length(F.regexp_replace(m.text, r"[^\p{Lu}]+", ""))
        > F.length(F.regexp_replace(m.text, r"[^\p{L}]+", "")),
    ),
)


def plan_cascade(df: DataFrame, text: Column, rules: tuple[Rule, ...], sample_rows: int = SAMPLE_ROWS) -> list[Rule]:
    """The rules in order of rejections per unit of cost, both measured on at most `sample_rows` rows."""
    drawn = df.select(text.alias("text")).orderBy(F.xxhash64("text"), "text").limit(sample_rows)
    sample = materialize(drawn, "quality-sample")
    rejected = sample.select(
        F.count(F.lit(1)).alias("rows"), *[F.count_if(judged(F.col("text"), r.rejects)).alias(f"r{i}") for i, r in enumerate(rules)]
    ).first()
    rounds = sample.select(F.explode(F.sequence(F.lit(1), F.lit(TIMES))).alias("i"), "text").coalesce(1)
    fresh = F.concat(F.coalesce("text", F.lit("")), F.lit(" "), F.col("i"))  # a value of its own for each round

    def seconds(rejects: Callable[[Measures], Column]) -> float:
        probe = rounds.select(F.count_if(judged(fresh, rejects)))
        took = []
        for _ in range(RUNS):
            start = time.perf_counter()
            probe.collect()
            took.append(time.perf_counter() - start)
        return min(took)

    floor = seconds(lambda m: m.n_words < 0)  # starting a job and splitting into words belong to no rule
    cost = [max(seconds(r.rejects) - floor, 0.0) for r in rules]
    least = max(LEAST_COST * max(cost, default=0.0), 1e-3)
    rate = {r.name: (rejected[f"r{i}"] + 0.5) / 2 ** round(math.log2(max(cost[i], least) / least)) for i, r in enumerate(rules)}
    return sorted(rules, key=lambda r: -rate[r.name])


def verdict(order: list[Rule], measures: Measures) -> Column:
    """The first rule in this order that rejects the text, null if none does."""
    out = None
    for rule in order:
        hit = F.coalesce(rule.rejects(measures), F.lit(False))
        out = F.when(hit, rule.name) if out is None else out.when(hit, rule.name)
    return out if out is not None else F.lit(None).cast("string")


def judged(text: Column, judge: Callable[[Measures], Column]) -> Column:
    """What `judge` makes of a text whose words are split once.

    The words are bound inside the expression: as a column of their own they would be put in
    again wherever a filter names them, once per window of the text.
    """
    return let(words(text), lambda t: judge(Measures.of(text, t, F.size(t).cast("long"))))


def filter_quality(df: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """The rows whose text passes every rule, with the columns of `df`."""
    order = plan_cascade(df, F.col(text), rules, sample_rows)
    return df.where(judged(F.col(text), lambda m: verdict(order, m)).isNull())


def measure_quality(df: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """`df` with the five measures, `base_failed` and `kept`; columns of `df` with these names are replaced."""
    (tokens,) = free_names(df, "tokens")
    seen = df.withColumn(tokens, words(F.col(text))).withColumn("n_words", F.size(tokens).cast("long"))
    direct = Measures.of(F.col(text), F.col(tokens), F.col("n_words"))
    order = plan_cascade(df, F.col(text), rules, sample_rows)
    names = ("word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    full = seen.withColumns({n: getattr(direct, n) for n in names})
    columns = Measures(F.col(text), F.col(tokens), F.col("n_words"), *[F.col(n) for n in names])
    base = {r.name for r in BASE_RULES}
    failed = verdict(list(BASE_RULES), columns).isNotNull()
    rest = verdict([r for r in order if r.name not in base], columns).isNull()
    return full.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & rest).drop(tokens)


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return measure_quality(docs).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


OP8_SQL = r"""
with w as (
  select doc_id, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as ws
  from documents),
win as (
  select doc_id, i, array_to_string(list_slice(ws, i, i + 7), ' ') as win
  from (select doc_id, ws, unnest(range(1, len(ws) - 6)) as i from w where len(ws) >= 8)),
twice as (select doc_id, win from win group by doc_id, win having count(*) > 1),
rep as (
  select doc_id, count(distinct i + o)::bigint as n
  from win join twice using (doc_id, win), (select unnest(range(0, 8)) as o) group by doc_id),
lines as (
  select doc_id, count(*) as n, (count(*) - count(distinct line))::bigint as dup
  from (select doc_id, unnest(string_split(text, chr(10))) as line from w)
  where regexp_matches(line, '[^\x20\x09-\x0D]') group by doc_id),
m as (
  select w.doc_id, len(ws)::bigint as n_words,
    coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::bigint as word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::bigint as n_symbols,
    coalesce(lines.dup, 0)::bigint as n_dup_lines, coalesce(rep.n, 0)::bigint as n_repeat_words,
    coalesce(lines.n, 0) as n_lines,
    length(regexp_replace(text, '[^\p{Lu}]', '', 'g')) as upper_letters,
    length(regexp_replace(text, '[^\p{L}]', '', 'g')) as letters
  from w left join lines on lines.doc_id = w.doc_id left join rep on rep.doc_id = w.doc_id)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  (n_words < 20 or 100 * n_repeat_words > 30 * n_words) as base_failed,
  not (n_words < 20 or 100 * n_repeat_words > 30 * n_words or 100 * n_symbols > 10 * n_words
    or word_chars < 2 * n_words or word_chars > 15 * n_words or 100 * n_dup_lines > 50 * n_lines
    or 2 * upper_letters > letters) as kept
from m
"""
