"""Operator 7: texts scored by a hierarchical Pitman-Yor language model.

Restaurants: the root serves all words over a uniform base of the V known words and one unknown;
below it, one restaurant for each word that comes before another, all sharing that parent; before a
text stands the end token. Discounts come from counts of counts, n1 / (n1 + 2 n2).

Seating: the customers of a word are reseated given the parent's predictive probability and the
restaurant's number of tables, both of the sweep before; each opens a table or joins one, as the
Chinese restaurant process says. The tables of the children are the root's customers, seated in
the same way. Counts of (word, context) and of words are written tables in buckets of their hashes, so
that the driver holds no restaurant and a word or context with any share of the pairs is split. In a sweep
the buckets of words tell those of pairs what they need of their words and contexts, and these tell back
their tables, summed by word and by context. A single customer has one table for good, so pairs met once
are only counted.
Past GROUP customers they sit down in groups of a sixteenth of those seated, which have one probability; a
group's new tables are their expected number rounded up or down at random, right in the mean and narrower
in spread than single customers would be. Random numbers are hashes of word, context, sweep and customer,
so a sweep that a lost executor repeats comes out the same.

Texts are tokenized once, into written runs of about RUN_TOKENS tokens. The distinct pairs of each run
are dealt into buckets by a 64-bit hash of the pair (of 10^9 pairs, one shares its hash with another
with a chance of 3 %), about one for BUCKET_TOKENS tokens; a bucket sums the pairs' counts and notes for each
run which of its pairs was meant. After the sweeps it answers every run with what the restaurants have of
these pairs, in the order of the run; words are looked up likewise, but for those with one HEAD-th of the tokens,
HEAD at most, which are sent to all tasks. The score of a text is the sum of
log10 of the predictive probabilities, each averaged over the last sweeps, worked out per run from these
answers. Pairs and runs are handled in rounds, whose shuffles are removed before the next, which bounds disk.

Edge cases: a null or empty text is its end token; every row is scored on its own, whatever doc_id it
shares; a null doc_id stays one; words of held-out texts that training lacks get the unknown word's
probability; without training rows the base stands alone; an empty table gives no rows; extra columns
are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import remove
from .common import NO_ID, new_path, numbered, own_id, table
from .minhash import _ODD, WordHashes, mix, word_list

SWEEPS, AVERAGED = 4, 3
GROUP = 64
#: Words with at least one HEAD-th of the tokens, so HEAD at most, are sent to the tasks that score.
HEAD = 1 << 18
#: Tokens of a run of texts, which stay whole; tokens for which there is one bucket of pairs and one of words.
RUN_TOKENS, BUCKET_TOKENS = 1 << 21, 1 << 20
#: Parts in which the pairs are counted, by their words, and the runs scored.
ROUNDS, RUN_ROUNDS = 4, 2
CONCENTRATION = 1.0
#: The end token's hash; a word's hash is never this one but by chance of 1 in 2^64.
END = np.uint64(0x1D8E4E27C47D124F)


def in_training(doc_id: int) -> bool:
    return zlib.crc32(b"" if doc_id == NO_ID else str(doc_id).encode()) % 7 != 2


#: Lists of numbers are binary columns of these kinds, which Spark copies whole.
KINDS = {
    "int32": ("size", "token", "at", "n", "word_at", "context_at", "as_word", "words", "as_context", "contexts"),
    "int64": ("doc_id", "count", "known"), "uint64": ("vocabulary", "word", "context", "id", "key", "want"),
    "float32": ("own", "values"), "float64": ("t", "kept", "sums", "now", "past", "told"),
}
DTYPE = {name: np.dtype(kind) for kind, names in KINDS.items() for name in names}
RUNS = "run long, tokens long, doc_id binary, size binary, token binary, vocabulary binary"
#: What a bucket of pairs holds: places among its runs' pairs; pairs met more than once; shares in the words' counts; words it needs.
COUNTED = (
    "bucket int, run long, at binary, n2 long, id binary, word_at binary, context_at binary, count binary, "
    "to int, key binary, known binary, as_word binary, words binary, as_context binary, contexts binary, want binary"
)
PAIRS = "bucket int, run long, word binary, context binary, n binary"
OWN, ASKED, VALUES = "run long, bucket int, own binary", "to int, run long, want binary", "run long, to int, known binary, values binary"
FREQUENT = "key binary, known binary, values binary"
SEATED = "bucket int, id binary, word_at binary, context_at binary, count binary, t binary, kept binary, to int, sums binary"
#: Of a bucket of words: its words with a, r, t (customers and tables at the root, tables as a context), now and in the
#: kept sweeps before, a third each; for each bucket of pairs the places of words it needs, and what it is told of them.
OF_WORDS = (
    "to int, key binary, known binary, as_word binary, as_context binary, now binary, past binary, "
    "total long, singles long, vocabulary_size long, once long, twice long, customers double, tables double, bucket int, at binary, told binary"
)


class _Places(dict):
    """Words in the order of their first use."""

    def __missing__(self, word: bytes) -> int:
        place = self[word] = len(self)
        return place


def _encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of whole texts: their distinct words, the end token first, and the place of every token's word among them."""
    known = WordHashes()
    number = TaskContext.get().partitionId() << 32

    def run(ids: list[int], tokens: list[np.ndarray], places: _Places) -> pa.RecordBatch:
        words = iter(places)
        next(words)
        vocabulary = np.concatenate([[END], np.fromiter(map(known.__getitem__, words), np.uint64, len(places) - 1)])
        lists = {"doc_id": np.array(ids, np.int64), "size": np.array([len(t) for t in tokens]), "token": np.concatenate(tokens), "vocabulary": vocabulary}
        return _table(RUNS, [{"run": number, "tokens": len(lists["token"]), **lists}]).to_batches()[0]

    ids, tokens, places, held = [], [], _Places({b"": 0}), 0
    for batch in batches:
        for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
            words = word_list(text.as_py())
            words.append(b"")
            ids.append(doc_id)
            tokens.append(np.fromiter(map(places.__getitem__, words), np.int32, len(words)))
            held += len(words)
            if held >= RUN_TOKENS:
                yield run(ids, tokens, places)
                ids, tokens, places, held = [], [], _Places({b"": 0}), 0
                number += 1
    if ids:
        yield run(ids, tokens, places)


def _list(rows: pa.RecordBatch | pa.Table, name: str) -> np.ndarray:
    """The numbers of a column, row after row."""
    column = rows.column(name)
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if not len(column) or not column.buffers()[2]:
        return np.empty(0, DTYPE[name])
    ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2], DTYPE[name], (ends[-1] - ends[0]) // DTYPE[name].itemsize, ends[0])


def _lists(rows: pa.Table, name: str) -> list[np.ndarray]:
    """The same, row by row."""
    return [np.frombuffer(x, DTYPE[name]) for x in rows.column(name).to_pylist()]


def _table(schema: str, rows: list[dict]) -> pa.Table:
    """Rows of numbers and arrays under the columns of a schema."""
    kinds = {"int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "binary": pa.binary()}
    columns = {}
    for name, kind in (c.split() for c in schema.split(", ")):
        found = [r.get(name) for r in rows]
        if kind == "binary":
            found = [None if x is None else x.astype(DTYPE[name], copy=False).tobytes() for x in found]
        columns[name] = pa.array(found, kinds[kind])
    return pa.table(columns)


def _pair_key(word: np.ndarray, context: np.ndarray) -> np.ndarray:
    return mix(word ^ mix(context + _ODD[1]))


def _bucket(key: np.ndarray, buckets: int) -> np.ndarray:
    return ((key >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.uint16 if buckets < 1 << 16 else np.uint32)


def _turn(word: np.ndarray) -> np.ndarray:
    """The round in which pairs of a word are counted."""
    return (word % np.uint64(ROUNDS)).astype(np.uint16)


def _changes(values: np.ndarray) -> np.ndarray:
    """Where a new value begins."""
    return np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]])[: len(values)])


def _dealt(schema: str, bucket: np.ndarray, run: int, **columns: np.ndarray) -> list[pa.RecordBatch]:
    """A row for each bucket with the values of its items; schema: of the bucket, the run and these; bucket: ascending."""
    new = _changes(bucket)
    name = schema.split()[0]
    parts = zip(*[np.split(c, new[1:]) for c in columns.values()], strict=True)
    return _table(schema, [{name: to, "run": run, **dict(zip(columns, part, strict=True))} for to, part in zip(bucket[new].tolist(), parts)]).to_batches()


class _Run:
    """A run's tokens, and its distinct pairs dealt into buckets."""

    def __init__(self, row: pa.RecordBatch | pa.Table):
        self.ids, self.size, token, self.vocabulary = (_list(row, c) for c in ("doc_id", "size", "token", "vocabulary"))
        self.token = token.astype(np.int64)

    def codes(self) -> np.ndarray:
        """Each token's word and the word before it; texts follow each other and end in the end token, word 0."""
        return self.token * len(self.vocabulary) + np.concatenate([[0], self.token[:-1]])

    def words_of(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return codes // len(self.vocabulary), codes % len(self.vocabulary)

    def dealt_pairs(self, word: np.ndarray, context: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
        """The order in which pairs are dealt, and the bucket of each."""
        hashes = self.vocabulary[word]
        part = _bucket(_pair_key(hashes, self.vocabulary[context]), -(-buckets // ROUNDS))
        bucket = part * part.dtype.type(ROUNDS) + _turn(hashes)
        order = np.argsort(bucket, kind="stable")
        return order, bucket[order]

    def dealt_words(self, buckets: int, frequent: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The same for the words that are not frequent."""
        bucket = _bucket(self.vocabulary, buckets)
        order = np.argsort(bucket, kind="stable")
        order = order[~np.isin(self.vocabulary[order], frequent)]
        return order, bucket[order]


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, _Run]]:
    for batch in batches:
        for i, run in enumerate(batch.column("run").to_pylist()):
            yield run, _Run(batch.slice(i, 1))


def _pairs_of_runs(buckets: int, turn: int):
    """The distinct pairs of all texts of a run, and how often its training texts have them, for the buckets of one round."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, run in _runs(batches):
            held = np.repeat([not in_training(i) for i in run.ids.tolist()], run.size)
            mine = (_turn(run.vocabulary) == turn)[run.token]
            codes = np.sort(run.codes()[mine] << 1 | held[mine])
            new = _changes(codes >> 1)
            if len(new):
                n = np.add.reduceat(1 - (codes & 1), new)
                word, context = run.words_of(codes[new] >> 1)
                order, bucket = run.dealt_pairs(word, context, buckets)
                yield from _dealt(PAIRS, bucket, number, word=run.vocabulary[word[order]], context=run.vocabulary[context[order]], n=n[order])

    return deal


def _with(rows: pa.Table, column: str, by: str | None = None) -> pa.Table:
    """The rows that have a column, in the order of another."""
    rows = rows.filter(rows.column(column).is_valid())
    return rows.sort_by(by) if by else rows


def _split(ids: np.ndarray, buckets: int, *columns: np.ndarray) -> tuple[list[int], list[tuple[np.ndarray, ...]]]:
    """The buckets of ascending hashes, and the part of each column that goes there."""
    bucket = _bucket(ids, buckets)
    new = _changes(bucket)
    return bucket[new].tolist(), list(zip(*[np.split(c, new[1:]) for c in columns], strict=True))[: len(new)]


def _counted(buckets: int):
    """A bucket's pairs, counted.

    For each run, what its pairs are: 0 unknown to training, 1 met once, from 2 on the place among those met
    more often, in the order of their hashes.
    """

    def count(rows: pa.Table) -> pa.Table:
        number = rows.column("bucket")[0].as_py()
        word, context = (_list(rows, c) for c in ("word", "context"))
        key = _pair_key(word, context)
        order = np.argsort(key)
        new = _changes(key[order])
        n = np.add.reduceat(_list(rows, "n").astype(np.int64)[order], new)
        often = n > 1
        at = np.empty(len(key), np.int32)
        at[order] = np.repeat(np.where(often, np.cumsum(often) + 1, n), np.diff(new, append=len(key)))
        parts = np.split(at, np.cumsum([len(x) for x in _lists(rows, "n")])[:-1])
        out = [{"run": run, "at": part} for run, part in zip(rows.column("run").to_pylist(), parts, strict=True)]

        first = order[new]
        word, context, met = word[first], context[first], n > 0
        needed, place = np.unique(np.concatenate([word[often], context[often]]), return_inverse=True)
        of_word, of_context = place.reshape(2, -1)
        out.append({"id": needed, "word_at": of_word, "context_at": of_context, "count": n[often], "n2": int((n == 2).sum())})
        for to, want in zip(*_split(needed, buckets, needed), strict=True):
            out.append({"to": to, "want": want[0]})

        ids, place = np.unique(np.concatenate([word[met], context[met]]), return_inverse=True)
        place, n = place.reshape(2, -1), n[met]
        sums = lambda side, weights=None: np.bincount(place[side], weights, len(ids))
        share = {"key": ids, "known": sums(0, n), "as_word": sums(0, n == 1), "words": sums(0), "as_context": sums(1, n == 1), "contexts": sums(1)}
        for to, part in zip(*_split(ids, buckets, *share.values()), strict=True):
            out.append({"to": to, **dict(zip(share, part, strict=True))})
        return _table(COUNTED, [{"bucket": number, **row} for row in out])

    return count


def _told(to: int, state: dict, asked: list[tuple[int, np.ndarray]]) -> pa.Table:
    """A bucket of words, and for each bucket of pairs what it needs of its words."""
    now = state["now"].reshape(3, -1)
    state |= {"customers": float(now[0].sum()), "tables": float(now[1].sum())}
    rows = [{"bucket": bucket, "at": at, "told": now[:, at].ravel()} for bucket, at in asked]
    return _table(OF_WORDS, [{"to": to, **row} for row in (state, *rows)])


def _first_of_words(rows: pa.Table) -> pa.Table:
    shares, wants = _with(rows, "key"), _with(rows, "want", "bucket")
    key, place = np.unique(_list(shares, "key"), return_inverse=True)
    known, as_word, words, as_context, contexts = (
        np.bincount(place, _list(shares, c), len(key)) for c in ("known", "as_word", "words", "as_context", "contexts")
    )
    state = {
        "key": key, "known": known, "as_word": as_word, "as_context": as_context, "now": np.concatenate([words, np.ones(len(key)), contexts]), "past": np.empty(0),
        "total": int(known.sum()), "singles": int(as_word.sum()), "vocabulary_size": len(key), "once": int((known == 1).sum()), "twice": int((known == 2).sum()),
    }
    asked = [np.searchsorted(key, want) for want in _lists(wants, "want")]
    return _told(rows.column("to")[0].as_py(), state, list(zip(wants.column("bucket").to_pylist(), asked, strict=True)))


def _next_of_words(model: Model, k: int, keep: bool):
    """Words after sweep k + 1, given the tables that buckets of pairs have summed."""

    def run(rows: pa.Table) -> pa.Table:
        old, asked, sums = _with(rows, "key"), _with(rows, "at", "bucket"), _with(rows, "sums", "bucket")
        key, at = _list(old, "key"), _lists(asked, "at")
        of_word, of_context = np.zeros((2, len(key)))
        for places, more in zip(at, _lists(sums, "sums"), strict=True):  # a bucket of pairs has each word once
            more = more.reshape(2, -1)
            of_word[places] += more[0]
            of_context[places] += more[1]
        a = _list(old, "as_word") + of_word
        now, past = _list(old, "now"), _list(old, "past")
        state = {c: _list(old, c) for c in ("key", "known", "as_word", "as_context")} | {
            "now": np.concatenate([a, model.reseat_root(k, key, a), _list(old, "as_context") + of_context]),
            "past": np.concatenate([past, now]) if keep else past,
        }
        return _told(rows.column("to")[0].as_py(), state, list(zip(asked.column("bucket").to_pylist(), at, strict=True)))

    return run


def _reseated(model: Model, k: int, before: float, share: float):
    """A bucket's pairs with their tables after sweep k + 1, summed by word and by context for the buckets of these.

    `share` of what the sweep leaves of n is added to `kept`, and `before` of what there is before the first sweep.
    """

    def run(rows: pa.Table) -> pa.Table:
        old, told = _with(rows, "id"), _with(rows, "told", "to")
        ids, word, context, n = (_list(old, c) for c in ("id", "word_at", "context_at", "count"))
        each = [x.reshape(3, -1) for x in _lists(told, "told")]
        at_root, root_tables, as_context = np.concatenate([np.empty((3, 0)), *each], 1)
        tables = _list(old, "t") if k else np.ones(len(n))
        kept = _list(old, "kept") if k else before * (n - model.discount)
        t = model.reseat(k, ids[word], ids[context], n, tables, as_context[context], at_root[word], root_tables[word])
        sums = np.stack([np.bincount(side, t, len(ids)) for side in (word, context)])
        parts = np.split(sums, np.cumsum([x.shape[1] for x in each])[:-1], 1) if each else []
        out = [{"id": ids, "word_at": word, "context_at": context, "count": n, "t": t, "kept": kept + share * np.maximum(n - model.discount * t, 0)}]
        out += [{"to": to, "sums": part.ravel()} for to, part in zip(told.column("to").to_pylist(), parts, strict=True)]
        return _table(SEATED, [{"bucket": rows.column("bucket")[0].as_py(), **row} for row in out])

    return run


def _own_of_pairs(single: float):
    def answer(rows: pa.Table) -> pa.Table:
        own = np.concatenate([[0, single], _list(_with(rows, "kept"), "kept")]).astype(np.float32)
        asked = _with(rows, "run")
        to = zip(asked.column("run").to_pylist(), asked.column("bucket").to_pylist(), _lists(asked, "at"), strict=True)
        return _table(OWN, [{"run": run, "bucket": bucket, "own": own[at]} for run, bucket, at in to])

    return answer


def _words_of_runs(buckets: int, frequent: np.ndarray):
    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, run in _runs(batches):
            order, bucket = run.dealt_words(buckets, frequent)
            if len(order):
                yield from _dealt(ASKED, bucket, number, want=run.vocabulary[order])

    return deal


def _values(model: Model, kept: list[int], known: np.ndarray, history: np.ndarray) -> np.ndarray:
    """Of each word: its probability at the root after each kept sweep; then what its restaurant leaves to the root.

    history: a, r and t of the words after each kept sweep.
    """
    a, r, t = history.reshape(len(kept), 3, -1).transpose(1, 0, 2)
    at_root = [model.root(k, *x) for k, *x in zip(kept, a, r, strict=True)]
    left = [(CONCENTRATION + model.discount * x) / (len(kept) * (CONCENTRATION + known)) for x in t]
    return np.stack([*at_root, *left], 1).astype(np.float32)


def _held(model: Model, kept: list[int], state: pa.Table | pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes, counts and values of the words of a bucket."""
    known = _list(state, "known")
    return _list(state, "key"), known, _values(model, kept, known, np.concatenate([_list(state, "past"), _list(state, "now")]))


def _frequent(model: Model, kept: list[int], total: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                key, known, values = _held(model, kept, batch.slice(i, 1))
                at = np.flatnonzero(known >= total / HEAD)
                yield from _table(FREQUENT, [{"key": key[at], "known": known[at], "values": values[at]}]).to_batches()

    return run


def _values_of_words(model: Model, kept: list[int]):
    unknown = _values(model, kept, np.zeros(1), np.zeros(3 * len(kept)))

    def answer(rows: pa.Table) -> pa.Table:
        state, asked = _with(rows, "key"), _with(rows, "run")
        key, known, values = _held(model, kept, state) if state.num_rows else (np.empty(0, np.uint64), np.empty(0, np.int64), unknown[:0])
        known, values, out = np.append(known, 0), np.concatenate([values, unknown]), []
        for run, to, want in zip(asked.column("run").to_pylist(), asked.column("to").to_pylist(), _lists(asked, "want"), strict=True):
            at = np.searchsorted(key, want)
            at[np.append(key, np.uint64(0))[at] != want] = len(key)
            out.append({"run": run, "to": to, "known": known[at], "values": values[at]})
        return _table(VALUES, out)

    return answer


def _scored(buckets: int, total: int, vocabulary: int, frequent: tuple[np.ndarray, np.ndarray, np.ndarray]):
    """The texts of a run, from the answers to its words and pairs."""

    def score(rows: pa.Table) -> pa.Table:
        run = _Run(_with(rows, "token"))
        order, _ = run.dealt_words(buckets, frequent[0])
        known, values = np.empty(len(run.vocabulary), np.int64), np.empty((len(run.vocabulary), frequent[2].shape[1]))
        answers = _with(rows, "known", "to")
        known[order], values[order] = _list(answers, "known"), _list(answers, "values").reshape(-1, values.shape[1])
        sent = np.ones(len(known), bool)
        sent[order] = False
        at = np.searchsorted(frequent[0], run.vocabulary[sent])
        known[sent], values[sent] = frequent[1][at], frequent[2][at]
        averaged = values.shape[1] // 2
        pairs, place = np.unique(run.codes(), return_inverse=True)
        word, context = run.words_of(pairs)
        order, _ = run.dealt_pairs(word, context, buckets)
        own = np.empty(len(order))
        own[order] = _list(_with(rows, "own", "bucket"), "own")
        p = own / (CONCENTRATION + known[context])
        for k in range(averaged):
            p += values[word, k] * values[context, averaged + k]
        starts = np.cumsum(run.size, dtype=np.int64) - run.size
        by_text = lambda of_token: pa.array(np.add.reduceat(of_token, starts))
        base = np.log10((known + 1.0) / (total + vocabulary + 1.0))
        return pa.table({
            "doc_id": pa.array(run.ids), "n_tokens": pa.array(run.size.astype(np.int64)), "n_known": by_text((known > 0).astype(np.int64)[run.token]),
            "base_score": by_text(base[run.token]), "score": by_text(np.log10(p)[place]),
        })

    return score


def _salt(step: int, kind: int) -> np.uint64:
    return np.uint64(step * int(_ODD[kind]) & (1 << 64) - 1)


def seat(customers: np.ndarray, new_weight: np.ndarray, discount: float, salt: np.ndarray) -> np.ndarray:
    """Tables that `customers` of a word take if a new one has weight `new_weight`; salt: one number each."""
    tables = np.minimum(customers, 1).astype(np.float64)
    seated = tables.copy()
    step = 0
    live = np.flatnonzero(customers > 1)
    while len(live):
        step += 1
        i, t, w = seated[live], tables[live], new_weight[live]
        group = np.where(i < GROUP, 1.0, np.minimum(np.floor(i / 16), customers[live] - i))
        chance = w / (w + np.maximum(i - discount * t, 1e-12))
        u = (mix(salt[live] + _salt(step, 0)) >> np.uint64(11)) * 2.0**-53
        tables[live] = t + np.floor(group * chance + u)
        seated[live] = i + group
        live = live[seated[live] < customers[live]]
    return tables


class Model:
    """What all tasks share: constants, and the number of tables of each restaurant after each sweep."""

    def __init__(self, vocabulary: int, customers: np.ndarray, discount: float, root_discount: float):
        self.vocabulary, self.customers = vocabulary, customers.astype(np.float64)
        self.discount, self.root_discount = discount, root_discount
        # before the first sweep every word has one table in each restaurant
        self.tables: list[np.ndarray] = []
        self.root_customers: list[float] = []
        self.root_tables: list[float] = []

    def base(self) -> float:
        return 1.0 / (self.vocabulary + 1)

    def root(self, k: int, n: np.ndarray | float, t: np.ndarray | float) -> np.ndarray | float:
        """The root's predictive probability after k sweeps for a word with n customers at t tables."""
        free = CONCENTRATION + self.root_discount * self.root_tables[k]
        return (np.maximum(n - self.root_discount * t, 0) + free * self.base()) / (CONCENTRATION + self.root_customers[k])

    def below(self, k: int, context: np.ndarray, n: np.ndarray, t: np.ndarray, parent: np.ndarray) -> np.ndarray:
        free = CONCENTRATION + self.discount * self.tables[k][context]
        return (np.maximum(n - self.discount * t, 0) + free * parent) / (CONCENTRATION + self.customers[context])

    def reseat(self, k: int, word, context, n, tables, of_context, at_root, root_tables) -> np.ndarray:
        """Tables of (word, context) entries after sweep k + 1, given what the entries, their contexts and words had before it."""
        others = at_root - tables
        parent = self.root(k, others, root_tables * others / np.maximum(at_root, 1))
        weight = (CONCENTRATION + self.discount * of_context) * parent
        return seat(n.astype(np.float64), weight, self.discount, mix(word ^ mix(context + _ODD[1])) + _salt(k + 1, 1))

    def reseat_root(self, k: int, word: np.ndarray, at_root: np.ndarray) -> np.ndarray:
        free = CONCENTRATION + self.root_discount * self.root_tables[k]
        return seat(at_root, np.full(len(word), free * self.base()), self.root_discount, mix(word ^ _ODD[2]) + _salt(k + 1, 1))

    def sweeps(self, word: np.ndarray, row: np.ndarray, context: np.ndarray, n: np.ndarray, upto: int, names: np.ndarray | None = None):
        """After each sweep: tables of every (word, context) entry, and of every word's root customers.

        Over arrays, for what fits in memory; row: an entry's place in `word`; names: the contexts' hashes.
        """
        sums = lambda x: np.bincount(row, x, len(word))
        tables, root_tables = np.minimum(n, 1).astype(np.float64), np.ones(len(word))
        yield tables, sums(tables), root_tables
        named = context.astype(np.uint64) if names is None else names[context]
        for k in range(upto):
            tables = self.reseat(k, word[row], named, n, tables, self.tables[k][context], sums(tables)[row], root_tables[row])
            at_root = sums(tables)
            root_tables = self.reseat_root(k, word, at_root)
            yield tables, at_root, root_tables


@contextmanager
def _settings(spark: SparkSession, **values: str):
    """Sets settings below `spark.sql` for one write."""
    names = {f"spark.sql.{k.replace('__', '.')}": v for k, v in values.items()}
    before = {k: spark.conf.get(k, None) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


class Written:
    """A table in the shared folder that the next version takes the place of."""

    def __init__(self, spark: SparkSession, tag: str):
        self.spark, self.tag, self.path = spark, tag, None

    def put(self, *parts: DataFrame) -> DataFrame:
        """Writes the parts one after another."""
        path = new_path(self.spark, self.tag)
        # the shuffles of a written table are needed no more
        with _settings(self.spark, classic__shuffleDependency__fileCleanup__enabled="true"):
            for df in parts:
                # rows can be of megabytes, so a file's size is looked at after each
                checked = {f"parquet.{x}.size.row.check.min": "1" for x in ("page", "block")}
                df.write.mode("append").options(compression="zstd", **checked).parquet(path)
        self.drop()
        self.path = path
        return self.spark.read.schema(parts[0].schema).parquet(path)

    def drop(self) -> None:
        if self.path:
            remove(self.spark, self.path)
        self.path = None


def score_texts(docs: DataFrame, sweeps: int = SWEEPS, averaged: int = AVERAGED) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity of `docs` (doc_id, text)."""
    spark = docs.sparkSession
    of_runs, counted, of_pairs, seated, of_words = (Written(spark, tag) for tag in ("runs", "counted", "pairs", "seated", "words"))
    runs = of_runs.put(numbered(docs, "text").mapInArrow(_encoded, RUNS))
    buckets = max(1, -(-(runs.agg(F.sum("tokens")).first()[0] or 0) // BUCKET_TOKENS))
    texts = runs.select("run", "doc_id", "size", "token", "vocabulary")
    pairs = counted.put(*[texts.mapInArrow(_pairs_of_runs(buckets, i), PAIRS).groupBy("bucket").applyInArrow(_counted(buckets), COUNTED) for i in range(ROUNDS)])
    asked = of_pairs.put(pairs.where("run is not null").select("bucket", "run", "at"))
    entries = seated.put(pairs.where("id is not null").select("bucket", "id", "word_at", "context_at", "count", "n2"))
    words = pairs.where("to is not null").select("to", "bucket", "key", "known", "as_word", "words", "as_context", "contexts", "want")
    words = of_words.put(words.groupBy("to").applyInArrow(_first_of_words, OF_WORDS))
    counted.drop()

    # after sweep k a word has a<k> customers at r<k> tables of the root, and t<k> tables as a context
    total, n1, vocabulary, once, twice = words.agg(*[F.coalesce(F.sum(c), F.lit(0)) for c in ("total", "singles", "vocabulary_size", "once", "twice")]).first()
    n2 = entries.agg(F.coalesce(F.sum("n2"), F.lit(0))).first()[0]
    discount = lambda n1, n2: min(0.95, max(0.05, n1 / (n1 + 2 * n2))) if n1 else 0.5
    model = Model(vocabulary, np.empty(0), discount(n1, n2), discount(once, twice))
    kept = list(range(sweeps - averaged + 1, sweeps + 1))
    share = lambda k: 1 / averaged if k in kept else 0.0
    for k in range(sweeps + 1):
        customers, root_tables = words.agg(F.sum("customers"), F.sum("tables")).first()
        model.root_customers.append(customers or 0.0)
        model.root_tables.append(root_tables or 0.0)
        if k == sweeps:
            break
        entries = entries.where("id is not null").unionByName(words.where("told is not null").select("bucket", "to", "told"), True)
        entries = seated.put(entries.groupBy("bucket").applyInArrow(_reseated(model, k, share(0), share(k + 1)), SEATED))
        words = words.select("to", "key", "known", "as_word", "as_context", "now", "past", "bucket", "at").unionByName(entries.where("sums is not null").select("to", "bucket", "sums"), True)
        words = of_words.put(words.groupBy("to").applyInArrow(_next_of_words(model, k, k in kept), OF_WORDS))

    own = asked.unionByName(entries.where("kept is not null").select("bucket", "kept"), True)
    own = Written(spark, "own").put(own.groupBy("bucket").applyInArrow(_own_of_pairs(1 - model.discount), OWN))
    for done in (of_pairs, seated):
        done.drop()
    words = words.where("key is not null").select("to", "key", "known", "past", "now")
    frequent = words.drop("to").mapInArrow(_frequent(model, kept, total), FREQUENT).toArrow()
    frequent = [_list(frequent, "key"), _list(frequent, "known"), _list(frequent, "values").reshape(-1, 2 * averaged)]
    frequent = tuple(x[np.argsort(frequent[0])] for x in frequent)
    known = texts.mapInArrow(_words_of_runs(buckets, frequent[0]), ASKED).unionByName(words, True)
    known = known.groupBy("to").applyInArrow(_values_of_words(model, kept), VALUES)
    known = Written(spark, "known").put(known)
    of_words.drop()
    answered = texts.unionByName(own, True).unionByName(known, True)
    result = "doc_id long, n_tokens long, n_known long, base_score double, score double"
    scored = Written(spark, "scored").put(*[
        answered.where(F.pmod(F.xxhash64("run"), F.lit(RUN_ROUNDS)) == i).groupBy("run").applyInArrow(_scored(buckets, total, vocabulary, frequent), result)
        for i in range(RUN_ROUNDS)
    ])
    own = own_id()
    return scored.select(
        own.alias("doc_id"), (F.crc32(F.coalesce(own.cast("string"), F.lit(""))) % 7 == 2).alias("held_out"),
        "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score", "score",
        F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")).alias("perplexity"),
    )


def op7_pitman_yor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(table(spark, sf_dir, "documents").select("doc_id", "text"))
