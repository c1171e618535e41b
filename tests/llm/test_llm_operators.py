"""Every operator against a brute-force version, on odd and copied texts."""

import base64
import contextlib
import hashlib
import math
import os
import random
import re
import threading
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from siftline.llm import decontaminate, licences, minhash, packing, pitman_yor, quality_rules, repeats, sharding, token_counts, warc
from siftline.llm.common import dense_slots, new_path, numbered

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


# --- 1 ---------------------------------------------------------------------------------------


def removed_by_hand(docs, length):
    """(doc_id, text) -> covered bytes, from every window's first start."""
    first, texts = {}, {}
    for doc_id, text in sorted({(i, t) for i, t in docs}, key=lambda x: (x[0] is not None, x[0] or 0)):
        raw = (text or "").encode()
        cover = bytearray(len(raw))
        for p in range(len(raw) - length + 1):
            w = raw[p : p + length]
            if w in first:
                cover[p : p + length] = b"\x01" * length
            else:
                first[w] = (doc_id, p)
        texts[doc_id, text] = (raw, cover)
    return texts


@pytest.mark.parametrize("parts", [1, 5])
def test_repeats_equal_brute_force(make, corpus, parts):
    want = removed_by_hand(corpus, repeats.LENGTH)
    got = repeats.report_repeats(make(corpus).repartition(parts)).collect()
    assert len(got) == len(corpus)
    by_id = {i: t for i, t in corpus}
    for r in got:
        raw, cover = want[r.doc_id, by_id[r.doc_id]]
        runs = re.findall(b"\x01+", bytes(cover))
        kept = bytes(b for b, c in zip(raw, cover) if not c)
        assert (r.n_bytes, r.n_removed, r.n_spans) == (len(raw), sum(cover), len(runs)), r.doc_id
        assert r.kept_sha256 == hashlib.sha256(kept).hexdigest()
    assert sum(r.n_removed for r in got) > 10_000


def test_repeats_of_few_letters(make, monkeypatch):
    """Texts that repeat at every scale, with other lengths, and cut into pieces."""
    rnd = random.Random(3)
    pool = ["".join(rnd.choice("ab") for _ in range(rnd.randrange(20, 200))) for _ in range(12)]
    docs = [(i, "".join(rnd.choice(pool) for _ in range(rnd.randrange(1, 9)))) for i in range(60)]
    want = removed_by_hand(docs, 40)
    texts = numbered(make(docs).repartition(3), "text")
    got = {r.doc_id: r.found for r in repeats.repeated_windows(texts, length=40, gram=12).collect()}
    for i, text in docs:
        raw, cover = want[i, text]
        cuts = repeats._covered(len(raw), np.array(got.get(i, []), np.int64), repeats._tag(raw), 40)
        assert [(m.start(), m.end()) for m in re.finditer(b"\x01+", bytes(cover))] == cuts
    monkeypatch.setattr(repeats, "PIECE", 64)
    for i, text in docs[:20]:
        _, _, first, n = repeats.parse(np.frombuffer(text.encode(), np.uint8), 40, 12)
        assert sorted(p for a, k in zip(first, n) for p in range(a, a + k)) == list(range(max(0, len(text) - 39)))


def test_repeats_edge_rows(make, spark):
    empty = make([])
    assert repeats.report_repeats(empty).count() == 0
    assert repeats.remove_repeats(empty).columns == empty.columns
    long = "0123456789" * 3 + "".join(chr(97 + i % 26) + str(i) for i in range(80))
    rows = [(None, long), (1, long), (1, long), (2, long + "é")]
    got = sorted((r.doc_id or 0, r.n_removed) for r in repeats.report_repeats(make(rows, found=1, key=2)).collect())
    assert got == [(0, 0), (1, len(long)), (1, len(long)), (2, len(long))]
    cut = {r.doc_id: (r.text, r.found, r._key) for r in repeats.remove_repeats(make(rows, found=1, _key=2)).collect()}
    assert cut == {None: (long, 1, 2), 1: ("", 1, 2), 2: ("é", 1, 2)}


def test_texts_that_share_an_id_keep_their_own_repeats(make, monkeypatch):
    """Also where the 16 bits of a place are the same for all of them, as for some pairs of many rows they are."""
    monkeypatch.setattr(repeats, "_tag", lambda raw: 0)
    common = "".join(chr(97 + i % 26) + str(i) for i in range(60))
    own = lambda i: "".join(f"{i}-{k}/" for k in range(60))
    twice = "".join(chr(97 + i % 25) + str(i) for i in range(61, 120))
    rows = [(None, own(1)), (None, own(2) + common), (None, own(3)), (None, twice + own(5)), (None, twice + own(6)), (7, common), (7, own(4)), (8, own(3) + common)]
    got = {t: n for t, n in repeats.remove_repeats(make(rows, number=1).repartition(2).withColumn("was", F.col("text"))).select("was", F.length("text")).collect()}
    want = {t: len(t) for _, t in rows}
    want[common], want[own(3) + common] = 0, 0
    either = [got.pop(twice + own(i)) - want.pop(twice + own(i)) for i in (5, 6)]  # the first by hash stays whole
    assert got == want and sorted(either) == [-len(twice), 0]


# --- 2 ---------------------------------------------------------------------------------------


def components_by_hand(docs, size, percent):
    sets = {}
    for i, t in docs:
        w = WORD.findall(lower(t))
        k = min(size, len(w))
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if w else set()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b]:
                c = len(sets[a] & sets[b])
                if 100 * c >= percent * (len(sets[a]) + len(sets[b]) - c):
                    x, y = sorted((find(a), find(b)))
                    root[y] = x
    return {i: (len(sets[i]), find(i), find(i) == i) for i in sets}


@pytest.mark.parametrize("size, percent", [(3, 85), (5, 80)])
def test_near_duplicates_equal_brute_force(make, corpus, size, percent):
    got = minhash.near_duplicates(make(corpus, key=1, rep=2).repartition(3), size=size, percent=percent).collect()
    assert len(got) == len(corpus)
    want = components_by_hand(corpus, size, percent)
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got} == want
    assert len({v[1] for v in want.values()}) < len(want) - 8


def test_star_leaves_no_link_behind(make):
    """A chain: each text is near the next one only, so the outsiders of every star must be paired too."""
    words, docs = [f"t{i}" for i in range(120)], []
    for i in range(25):
        docs.append((i, " ".join(words)))
        at = (i * 4) % 120
        words = words[:at] + [f"n{i}.{j}" for j in range(4)] + words[at + 4 :]
    docs = docs[::2] + docs[1::2]
    want = components_by_hand(docs, 3, 85)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(make(docs), size=3, percent=85).collect()}
    assert got == want


def test_near_duplicates_edge_rows(make):
    assert minhash.near_duplicates(make([])).count() == 0
    rows = [(None, "a b c"), (4, "a b c"), (4, "a b c"), (9, "A B c"), (11, None), (12, "")]
    got = sorted((str(r.doc_id), r.component_id, r.kept) for r in minhash.near_duplicates(make(rows), size=3, percent=85).collect())
    assert got == [("11", 11, True), ("12", 12, True), ("4", 4, True), ("4", 4, True), ("9", 4, False), ("None", 4, False)]
    assert sorted(str(r.doc_id) for r in minhash.drop_near_duplicates(make(rows)).collect()) == ["11", "12", "4"]


def prose(seed, n):
    rnd = random.Random(seed)
    return [f"w{rnd.randrange(10**6):x}" for _ in range(n)]


def test_near_duplicates_without_ids(make):
    """Links through rows without an id hold, and a group of such rows alone keeps one of them."""
    words = [f"t{i}" for i in range(120)]
    chain = []
    for i in range(3):  # each text is near the next one only
        chain.append(" ".join(words))
        words = words[: 6 * i] + [f"n{i}.{j}" for j in range(6)] + words[6 * i + 6 :]
    assert components_by_hand([(0, chain[0]), (1, chain[2])], 3, 85)[1][1] == 1
    lone = " ".join(f"u{i}" for i in range(90))
    rows = [(3, chain[0]), (None, chain[1]), (1, chain[2]), (None, lone), (None, lone), (None, lone + " more"), (None, "other words here"), (None, None), (None, "")]
    numbered = [(1000 + k if i is None else i, t) for k, (i, t) in enumerate(rows)]
    want = components_by_hand(numbered, 3, 85)
    got = minhash.near_duplicates(make(rows, node=1), size=3, percent=85).collect()
    assert len(got) == len(rows)
    assert Counter((r.n_shingles, r.component_id) for r in got) == Counter((n, c if c < 1000 else None) for n, c, _ in (want[i] for i, _ in numbered))
    kept = minhash.drop_near_duplicates(make(rows, node=1), size=3, percent=85)
    assert kept.columns == make(rows, node=1).columns
    texts = sorted(str(r.text) for r in kept.collect())
    assert [t for t in texts if t not in (lone, lone + " more")] == sorted([chain[2], "other words here", "None", ""])
    assert len(texts) == 5


def test_near_duplicates_keep_one_row_of_an_id(make):
    """Rows of one id, with one text or several, are one document; a hot one is fetched once."""
    a, b = (" ".join(prose(k, 80)) for k in (31, 32))
    rows = [*[(5, a)] * 300, (5, b), (8, b), (9, a + " end"), *[(None, a)] * 200, (2, "alone here now")]
    got = minhash.near_duplicates(make(rows).repartition(3), size=3, percent=85).collect()
    assert Counter((r.doc_id, r.component_id, r.kept) for r in got) == Counter(
        {(5, 5, True): 301, (8, 5, False): 1, (9, 5, False): 1, (None, 5, False): 200, (2, 2, True): 1}
    )
    assert sorted(r.doc_id for r in minhash.drop_near_duplicates(make(rows).repartition(3), size=3, percent=85).collect()) == [2, 5]


def test_parity_bits_differ_no_more_than_sets():
    rnd = np.random.default_rng(8)
    for n in (3, 200, 3000):
        a = np.unique(rnd.integers(0, 1 << 63, n, dtype=np.uint64))
        b = np.unique(np.concatenate([a[: n * 4 // 5], rnd.integers(0, 1 << 63, n // 5 + 1, dtype=np.uint64)]))
        apart = len(np.setxor1d(a, b))
        flipped = sum(int(x).bit_count() for x in (minhash.parity(a) ^ minhash.parity(b)).view(np.uint64))
        assert flipped <= apart and (n > 200 or flipped > 0.9 * apart - 4)


def test_densified_sketches_agree_as_sets_do():
    donors, rnd = minhash.donor_order(140), np.random.default_rng(5)
    for n in (4, 20, 400):
        same = []
        for _ in range(200):
            a = rnd.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2)
            b = np.concatenate([a[: n * 3 // 4], rnd.integers(0, 1 << 63, n - n * 3 // 4, dtype=np.uint64) * np.uint64(2)])
            same.append((minhash.sketch(np.unique(a), donors) == minhash.sketch(np.unique(b), donors)).mean())
        assert abs(np.mean(same) - 0.6) < 0.06


# --- 3 ---------------------------------------------------------------------------------------


def test_token_counts_equal_the_library(make, corpus):
    import public_tokenizers
    from tokenizers import Tokenizer, models

    path = public_tokenizers.path("piece_bpe_32k.model")
    pieces, by_bytes = token_counts.read_vocabulary(path)
    assert by_bytes
    vocab = [("<unk>", 0.0), *pieces.items()]
    low = min(pieces.values())
    vocab += [(f"<0x{i:02X}>", low) for i in range(256)]
    exact = Tokenizer(models.Unigram(vocab, unk_id=0, byte_fallback=True))
    texts = [*corpus, (None, "no id"), ((1 << 60) + 1, "a large id"), (200, "日本語 \U0001f600\U0001f600 a  b   c\n\nd"), (201, "   "), (202, " lead"), (203, "ééßß x")]
    got = token_counts.count_tokens(make(texts), path).collect()
    want = Counter()
    for i, t in texts:
        n = 0
        if t:
            for token in exact.encode(token_counts.MARK + t.replace(" ", token_counts.MARK), add_special_tokens=False).tokens:
                n += 1
        want[i, n] += 1
    assert Counter((r.doc_id, r.n_tokens) for r in got) == want
    assert token_counts.count_tokens(make([]), path).count() == 0


def test_token_count_ties_and_unknowns():
    c = token_counts.Counter({"a": -1.0, "b": -1.0, "c": -1.0, "ab": -2.0, "bc": -2.0, "▁": 0.0}, False)
    assert c.count("abc") == (2, -3.0)  # the piece that starts first wins: "ab" then "c"... or "a" "bc": fewest by the rule
    assert c.count("xyz") == (1, 3 * (-2.0 - 10))
    assert c.count("axb") == (3, -14.0)
    with pytest.raises(ValueError):
        token_counts.Counter({"a▁b": -1.0}, False)


# --- 4 ---------------------------------------------------------------------------------------


def check_packing(rows, capacity):
    by_sequence = defaultdict(list)
    for r in rows:
        by_sequence[r.sequence_id].append((r.offset, r.length))
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by_sequence)


@pytest.mark.parametrize("blank", [" ", "\n", " \n\t", "x"])
def test_packing_of_two_million_blanks(make, blank):
    import public_tokenizers

    text = "a" + blank * (2_000_000 // len(blank)) + "b"
    rows = packing.pack(make([(1, text), (2, "c")]), public_tokenizers.path("byte_bpe_50k.json")).collect()
    assert sum(r.length for r in rows) == len({(r.sequence_id, r.offset + i) for r in rows for i in range(r.length)})
    assert sorted(r.piece for r in rows if r.doc_id == 1) == list(range(sum(r.doc_id == 1 for r in rows)))


def test_packing_round_trip(make, corpus):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    texts = [*corpus, (300, "<|endoftext|> it's\n\n  x"), (301, "日本語 \U0001f600"), (None, "no id")]
    rows = packing.pack(make(texts, offset=1).repartition(3), path, capacity=256).collect()
    check_packing(rows, 256)
    want = Counter()
    for i, t in texts:
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 0]
        first = len(ids) % 256 or 256
        cuts = [0, *range(first, len(ids) + 1, 256)]
        for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
            want[i, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    assert packing.pack(make([]), path).count() == 0


def test_plan_is_as_good_as_best_fit_decreasing():
    rnd = random.Random(11)
    for _ in range(30):
        counts = Counter(rnd.randrange(1, 101) for _ in range(rnd.randrange(1, 400)))
        runs = packing.plan_runs(dict(counts), 100)
        used, room = Counter(), Counter()
        for length, rank, n, first, offset in runs:
            assert rank == used[length]
            used[length] += n
            for s in range(first, first + n):
                assert room[s] == offset
                room[s] += length
        assert used == counts and max(room.values()) <= 100
        bins = []
        for x in sorted(counts.elements(), reverse=True):
            fit = max((b for b in bins if sum(b) + x <= 100), key=sum, default=None)
            bins.append([x]) if fit is None else fit.append(x)
        assert len(room) <= len(bins) + 1


# --- 5 ---------------------------------------------------------------------------------------


def test_warc_round_trip(make, spark, tmp_path):
    html = ["<p>a</p>", "<p>a</p>", None, "", "<p>b\r\n\r\nWARC/1.1\r\nContent-Length: 5\r\n\r\n</p>", "é" * 5000, "<p>a</p>", "x\n\r\n\r\n"]
    rows = [(i * 3, f"http://h/{i}\nx" if i else None, h) for i, h in enumerate(html)]
    pages = spark.createDataFrame([*rows, (30, "u", "<p>a</p>"), (30, "u", "<p>a</p>")], "page_id long, url string, html string")
    for compression in ("gzip", "none"):
        raw, slim = (str(tmp_path / f"{compression}{k}") for k in "ab")
        warc.write_archives(warc.as_captures(pages.repartition(3)), raw, compression)
        assert sorted((r.page_id, r.payload) for r in warc.read_archives(spark, raw).collect()) == sorted((r.page_id, r.html or "") for r in pages.collect())
        warc.deduplicate_archives(spark, raw, slim)
        got = sorted(tuple(r) for r in warc.report(warc.read_archives(spark, slim)).collect())
        first = {}
        for r in sorted(pages.collect(), key=lambda r: r.page_id):
            first.setdefault(r.html or "", r.page_id)
        want = []
        for r in pages.collect():
            body = (r.html or "").encode()
            digest = base64.b32encode(hashlib.sha1(body).digest()).decode()
            again = first[r.html or ""] != r.page_id
            want.append((r.page_id, len(body), digest, "revisit" if again else "response", first[r.html or ""] if again else None))
        assert got == sorted(want)
    empty = str(tmp_path / "empty")
    warc.write_archives(warc.as_captures(pages.limit(0)), empty)
    assert warc.report(warc.read_archives(spark, empty)).count() == 0


def test_revisits_of_a_repeated_first_page_come_out_once(spark, make, tmp_path):
    pages = spark.createDataFrame([(1, "u", "<p>a</p>"), (1, "u", "<p>a</p>"), (2, "v", "<p>a</p>")], "page_id long, url string, html string")
    raw, slim = str(tmp_path / "raw"), str(tmp_path / "slim")
    warc.write_archives(warc.as_captures(pages), raw)
    warc.deduplicate_archives(spark, raw, slim)
    got = sorted((r.page_id, r.record_type, r.refers_to) for r in warc.report(warc.read_archives(spark, slim)).collect())
    assert got == [(1, "response", None), (1, "response", None), (2, "revisit", 1)]


def test_small_payloads_stay_responses(make, spark):
    pages = spark.createDataFrame([(1, "u", "aa"), (2, "u", "aa"), (3, "u", "aaaa"), (4, "u", "aaaa")], "page_id long, url string, html string")
    got = warc.resolve_revisits(warc.as_captures(pages), min_payload=3).collect()
    assert sorted(r.page_id for r in got if r.refers_to_id is None) == [1, 2, 3]


# --- 6 ---------------------------------------------------------------------------------------


def test_licences(spark, make):
    files = [
        (1, "a/LICENSE", "Released under the MIT License."),
        (2, "a/b/x.py", "code\n" * 50),
        (3, "a/b/c/COPYING", "Licensed under the Apache License, Version 2.0.\n" + "words " * 500),
        (4, "a/b/c/d/y.py", "more code"),
        (5, "a/b/c/z.py", "# Licensed under CC BY-NC 4.0.\n" + "code " * 400),
        (6, "top.py", ""),
        (7, None, None),
        (8, "/e/LICENSE.txt", "released under the mit license"),
        (9, "e/f.py", "The weather is fine under the sun."),
    ]
    df = spark.createDataFrame(files, "doc_id long, path string, text string").withColumn("licence", F.lit("x"))
    got = {r.doc_id: (r.own_licence, r.licence, r.inherited_from) for r in licences.scan_licences(df).collect()}
    assert got == {
        1: ("MIT", "MIT", None), 2: (None, "MIT", "a/LICENSE"), 3: ("Apache-2.0", "Apache-2.0", None),
        4: (None, "Apache-2.0", "a/b/c/COPYING"), 5: ("CC-BY-NC-4.0", "CC-BY-NC-4.0", None), 6: (None, None, None),
        7: (None, None, None), 8: ("MIT", "MIT", None), 9: (None, "MIT", "/e/LICENSE.txt"),
    }
    assert licences.scan_licences(df.limit(0)).count() == 0


# --- 7 ---------------------------------------------------------------------------------------


def test_language_model(make, corpus):
    rnd = random.Random(1)
    pairs = [f"k{i}" for i in range(12)]
    docs = []
    for i in range(300):  # after each word come two others only: what a bigram model can learn
        w, out = rnd.randrange(12), []
        for _ in range(60):
            out.append(pairs[w].upper() if rnd.random() < 0.2 else pairs[w])
            w = (2 * w + rnd.randrange(2)) % 12
        docs.append((i, " ".join(out)))
    docs += [(1000, None), (1001, "never seen words here")]
    got = {r.doc_id: r for r in pitman_yor.score_texts(make(docs, context=1).repartition(4)).collect()}
    tokens = {i: [*WORD.findall(lower(t)), None] for i, t in docs}
    train = Counter(t for i, ts in tokens.items() if zlib.crc32(str(i).encode()) % 7 != 2 for t in ts)
    n, v = sum(train.values()), len(train)
    for i, ts in tokens.items():
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (zlib.crc32(str(i).encode()) % 7 == 2, len(ts), sum(train[t] > 0 for t in ts), n)
        assert math.isclose(r.base_score, sum(math.log10((train[t] + 1) / (n + v + 1)) for t in ts), rel_tol=1e-9)
    held = [r for r in got.values() if r.held_out]
    per_token = lambda k: sum(getattr(r, k) for r in held) / sum(r.n_tokens for r in held)
    assert per_token("score") > per_token("base_score") + 0.5  # 12 words fall to 2: log10(6) is 0.78
    assert pitman_yor.score_texts(make([])).count() == 0


def test_predictive_probabilities_sum_to_one():
    """Over all words and the unknown one, in every restaurant and after every sweep."""
    rnd = np.random.default_rng(2)
    v, contexts = 50, 4
    n = rnd.integers(0, 30, (v, contexts)) * (rnd.random((v, contexts)) < 0.5)
    n[:, 0] += 1
    n[0, 1] = 5000
    row, context = np.nonzero(n)
    n = n[row, context]
    word = minhash.mix(np.arange(v, dtype=np.uint64))
    model = pitman_yor.Model(v, np.bincount(context, n, contexts), 0.7, 0.4)
    for k in range(4):
        for tables, at_root, root_tables in model.sweeps(word, row, context, n, k):
            pass
        assert (tables >= 1).all() and (tables <= n).all() and (root_tables <= at_root).all()
        model.tables.append(np.bincount(context, tables, contexts))
        model.root_customers.append(at_root.sum())
        model.root_tables.append(root_tables.sum())
        root = model.root(k, at_root, root_tables)
        assert math.isclose(root.sum() + model.root(k, 0.0, 0.0), 1, rel_tol=1e-9)
        for c in range(contexts):
            have = np.zeros(v)
            at = np.zeros(v)
            have[row[context == c]], at[row[context == c]] = n[context == c], tables[context == c]
            p = model.below(k, np.full(v, c), have, at, root).sum() + model.below(k, np.array([c]), np.zeros(1), np.zeros(1), model.root(k, 0.0, 0.0))[0]
            assert math.isclose(p, 1, rel_tol=1e-9)


def test_rare_contexts_have_restaurants_of_their_own(make):
    """After each of 1500 rare words comes one other: joined tables score as arrays over all contexts do."""
    rnd = random.Random(5)
    docs = [(i, " ".join(f"a{k} b{k}" for k in (rnd.randrange(1500) for _ in range(60)))) for i in range(250)] + [(None, "a1 new b1"), (900, None)]
    got = {r.doc_id: r for r in pitman_yor.score_texts(make(docs).repartition(4)).collect()}
    held = [r for r in got.values() if r.held_out]
    assert sum(r.score - r.base_score for r in held) / sum(r.n_tokens for r in held) > 0.8  # half the words follow from the one before

    tokens = {i: [*(t or "").split(), None] for i, t in docs}
    hashed = lambda w: np.uint64(minhash.WordHashes()[w.encode()]) if w else pitman_yor.END
    pairs = Counter(p for i, ts in tokens.items() if zlib.crc32(str("" if i is None else i).encode()) % 7 != 2 for p in zip(ts, [None, *ts]))
    words = sorted({w for w, _ in pairs}, key=str)
    at = {w: k for k, w in enumerate(words)}
    row, context, n = np.array([(at[w], at[c], m) for (w, c), m in pairs.items()]).T
    names = np.array([hashed(w) for w in words], np.uint64)
    share = lambda x: min(0.95, max(0.05, (x == 1).sum() / ((x == 1).sum() + 2 * (x == 2).sum())))
    model = pitman_yor.Model(len(words), np.bincount(context, n, len(words)), share(n), share(np.bincount(row, n)))
    p = {}
    for k in range(5):
        for tables, at_root, root_tables in model.sweeps(names, row, context, n, k, names):
            pass
        model.tables.append(np.bincount(context, tables, len(words)))
        model.root_customers.append(at_root.sum())
        model.root_tables.append(root_tables.sum())
        if k >= 2:
            for r, c, x in zip(row, context, model.below(k, context, n, tables, model.root(k, at_root, root_tables)[row])):
                p[words[r], words[c]] = p.get((words[r], words[c]), 0) + x / 3
    checked = 0
    for i, ts in tokens.items():
        if all(x in p for x in zip(ts, [None, *ts])):
            checked += 1
            assert math.isclose(got[i].score, sum(math.log10(p[x]) for x in zip(ts, [None, *ts])), rel_tol=1e-6)
    assert checked > 150


def test_rows_that_share_an_id_are_scored_on_their_own(make):
    docs = [(i, f"red fish {i % 3} blue fish") for i in range(40)] + [
        (None, "red fish"), (None, "blue fish 1 red"), (None, "red fish"), (7, "blue blue"), (7, "red sky"), (7, None), (7, ""),
    ]
    got = [r for r in pitman_yor.score_texts(make(docs).repartition(3)).collect()]
    assert len(got) == len(docs)
    assert sorted(r.n_tokens for r in got if r.doc_id is None) == [3, 3, 5]
    assert sorted(r.n_tokens for r in got if r.doc_id == 7) == [1, 1, 3, 3, 6]
    assert {r.train_tokens for r in got} == {sum(len((t or "").split()) + 1 for i, t in docs if pitman_yor.in_training(pitman_yor.NO_ID if i is None else i))}
    twins = [r for r in got if r.doc_id is None and r.n_tokens == 3]
    assert math.isclose(twins[0].score, twins[1].score) and math.isclose(twins[0].base_score, twins[1].base_score)


def test_frequent_words_sent_and_rare_words_joined_score_alike(make, monkeypatch):
    rnd = random.Random(9)
    docs = [(i, " ".join(f"w{int(rnd.paretovariate(0.7))}" for _ in range(40))) for i in range(120)]
    runs = []
    for head in (8, 1 << 16):
        monkeypatch.setattr(pitman_yor, "HEAD", head)
        runs.append({r.doc_id: r.score for r in pitman_yor.score_texts(make(docs).repartition(3)).collect()})
    for i, _ in docs:
        assert math.isclose(runs[0][i], runs[1][i], rel_tol=1e-9)


def test_disk_of_the_language_model_is_bounded(spark, make):
    """Files of all kinds at their most, per token: one written form of the texts, and pairs dealt in rounds."""
    rnd = random.Random(4)
    docs = [(i, " ".join(f"w{int(rnd.paretovariate(0.5)) % 50_000}" for _ in range(300))) for i in range(2500)]
    manager = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    folders = {os.path.dirname(d.getPath()) for d in manager.localDirs()} | {new_path(spark, "x").rsplit("/siftline/", 1)[0].removeprefix("file://")}
    most, over = [0], threading.Event()

    def used():
        total = 0
        for folder in folders:
            for at, _, names in os.walk(folder):
                for name in names:
                    with contextlib.suppress(OSError):  # removed meanwhile
                        total += os.lstat(os.path.join(at, name)).st_size if "blockmgr" in at or "siftline" in at else 0
        return total

    def watch():
        while not over.wait(0.05):
            most.append(used())

    df = make(docs).repartition(4).persist()
    assert df.count() == 2500
    before = used()
    watcher = threading.Thread(target=watch)
    watcher.start()
    try:
        tokens = pitman_yor.score_texts(df).agg(F.sum("n_tokens")).first()[0]
    finally:
        over.set()
        watcher.join()
        df.unpersist()
    assert tokens == 2500 * 301
    assert max(most) - before < 9 * tokens, (max(most) - before) / tokens


def test_seating_follows_the_restaurant():
    """Mean number of tables against the exact recursion for one word."""
    d, theta, customers = 0.6, 2.0, 40
    p = np.zeros(customers + 1)
    p[1] = 1
    for i in range(1, customers):
        q = np.zeros_like(p)
        for t in range(1, i + 1):
            new = theta / (theta + i - d * t)
            q[t + 1] += p[t] * new
            q[t] += p[t] * (1 - new)
        p = q
    salt = minhash.mix(np.arange(20000, dtype=np.uint64))
    got = pitman_yor.seat(np.full(20000, float(customers)), np.full(20000, theta), d, salt)
    assert abs(got.mean() - (p * np.arange(customers + 1)).sum()) < 0.05


# --- 8 ---------------------------------------------------------------------------------------


def quality_by_hand(text):
    text = text or ""
    w = WORD.findall(text)
    seen = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    cover = {i + k for i in range(len(w) - 7) if seen[tuple(w[i : i + 8])] > 1 for k in range(8)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    n, chars, symbols = len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text)
    base = n < 20 or 100 * len(cover) > 30 * n
    upper, letters = sum(c.isupper() for c in text), sum(c.isalpha() for c in text)
    rest = 100 * symbols > 10 * n or not 2 * n <= chars <= 15 * n or 100 * (len(lines) - len(set(lines))) > 50 * len(lines) or 2 * upper > letters
    return n, chars, symbols, len(lines) - len(set(lines)), len(cover), base, not base and not rest


def test_quality_rules(make, corpus):
    texts = [*corpus, (400, "Line one is here.\n" * 30), (401, "LOUD WORDS " + " ".join(f"W{i}" for i in range(40))),
             (402, " ".join(f"a{i} ***" for i in range(60))), (403, "x" * 50 + " " + " ".join(f"{i}" * 20 for i in range(40))),
             (404, "\n".join(["alpha beta gamma"] * 2 + [f"row {i} of many" for i in range(30)]))]
    df = make(texts, words=1, symbols=2)
    got = quality_rules.measure_quality(df).collect()
    want = Counter((i, *quality_by_hand(t)) for i, t in texts)
    names = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    assert Counter(tuple(r[c] for c in names) for r in got) == want
    kept = quality_rules.filter_quality(df)
    assert kept.columns == df.columns
    assert Counter(r.doc_id for r in kept.collect()) == Counter(i for i, *v in want.elements() if v[-1])
    assert quality_rules.filter_quality(make([])).count() == 0


def test_cascade_order_changes_no_verdict(make, corpus):
    df = make(corpus)
    kept = lambda rules: Counter(r.doc_id for r in quality_rules.filter_quality(df, rules=rules).collect())
    assert kept(quality_rules.RULES) == kept(quality_rules.RULES[::-1])


# --- 9 ---------------------------------------------------------------------------------------


def alignment_by_hand(a, b):
    h = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            h[i][j] = max(0, h[i - 1][j - 1] + (1 if a[i - 1] == b[j - 1] else -1), h[i - 1][j] - 1, h[i][j - 1] - 1)
    return max(map(max, h))


def test_alignment_equals_the_textbook():
    rnd = random.Random(4)
    for _ in range(60):
        a, b = ([rnd.randrange(5) for _ in range(rnd.randrange(1, 25))] for _ in "ab")
        score, i, j = decontaminate.local_alignment(np.array(a), np.array(b))
        assert score == alignment_by_hand(a, b)
        if score:
            assert a[i] == b[j]


def test_contamination_is_found_and_clean_texts_are_not(make, spark):
    rnd = random.Random(9)
    vocabulary = [f"v{i}" for i in range(300)]
    items = [(i, [rnd.choice(vocabulary) for _ in range(rnd.randrange(16, 60))]) for i in range(20)] + [(90, ["two", "words"]), (91, [])]
    docs = []
    for d in range(80):
        w = [rnd.choice(vocabulary) for _ in range(rnd.randrange(30, 300))]
        if d % 2:
            passage = list(items[d % 20][1])
            if d % 4 == 1:  # edited: a word in eight changed, one dropped
                for k in range(0, len(passage), 8):
                    passage[k] = "edited"
                del passage[len(passage) // 2]
            at = rnd.randrange(len(w))
            w = w[:at] + passage + w[at:]
        docs.append((d, " ".join(w)))
    docs += [(200, None), (201, ""), (202, "Two Words."), (203, "so TWO\nwords it is"), (None, "x " + " ".join(items[0][1])), ((1 << 60) + 1, " ".join(items[1][1]))]
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in items] + [(None, "x y z"), (95, None)], "item_id long, text string")
    frame = make(docs, item_id=7).repartition(3)
    got = decontaminate.contaminated_passages(frame, bench).collect()
    want = set()
    for d, t in docs:
        for i, w in items:
            if w and alignment_by_hand(w, WORD.findall(lower(t))) >= 0.5 * len(w):
                want.add((d, i))
    found = {(r.doc_id, r.item_id) for r in got}
    assert want - {(202, 90)} <= found | {(202, 90)} and found <= want
    assert {(d, d % 20) for d in range(1, 80, 2)} <= found and (203, 90) in found
    in_blocks = decontaminate.contaminated_passages(frame, bench, block_grams=200)
    assert {(r.doc_id, r.item_id) for r in in_blocks.collect()} == found
    for r in got:
        words = WORD.findall(lower(dict(docs)[r.doc_id]))[r.first_word : r.last_word + 1]
        assert alignment_by_hand(dict(items)[r.item_id], words) == r.matched
    left = decontaminate.drop_contaminated(frame, bench)
    assert left.columns == frame.columns and {r.doc_id for r in left.collect()} == {d for d, _ in docs} - {d for d, _ in found}
    assert decontaminate.contaminated_passages(make([]), bench).count() == 0
    assert decontaminate.contaminated_passages(frame, bench.limit(0)).count() == 0


def test_clean_rows_stay_beside_contaminated_ones_of_their_id(make, spark):
    item = " ".join(f"q{i}" for i in range(20))
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    rows = [(None, "so " + item), (None, "a clean text"), (None, None), (5, item + " é"), (5, "another clean text"), (6, "clean")]
    left = decontaminate.drop_contaminated(make(rows, _text=1, _gone=2).repartition(3), bench).collect()
    want = [(None, "a clean text"), (None, None), (5, "another clean text"), (6, "clean")]
    assert sorted(((r.doc_id, r.text) for r in left), key=str) == sorted(want, key=str)


def test_excerpts_and_every_text_of_an_item_are_found(make, spark):
    words = lambda c, n: [f"{c}{i}" for i in range(n)]
    long, first, second, unnamed = words("l", 59), words("f", 20), words("s", 20), words("u", 20)
    rows = [(1, long), (2, first), (2, second), (None, unnamed)]
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in rows], "item_id long, text string")
    paraphrase = [w if k % 10 not in (2, 6, 9) else "other" for k, w in enumerate(long)]  # 70 % kept
    parts = {10: long[10:38], 11: paraphrase, 12: first, 13: second, 14: unnamed, 15: long[20:32], 16: words("c", 80)}
    docs = make([(i, " ".join(["so", *w, "on"])) for i, w in parts.items()])
    got = {(r.doc_id, r.item_id) for r in decontaminate.contaminated_passages(docs, bench).collect()}
    assert got == {(10, 1), (11, 1), (12, 2), (13, 2), (14, None)}


# --- 10 --------------------------------------------------------------------------------------


def test_shards(make, corpus):
    rnd = random.Random(6)
    docs = [*corpus, (None, "no id"), *[(1000 + i, "copy of one text") for i in range(400)], *[(2000 + i, "x" * rnd.randrange(400)) for i in range(600)]]
    for n in (1, 5, 16):
        got = sharding.shard_by_bytes(make(docs, shard=1, slot=2), n_shards=n).collect()
        assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == Counter(
            (i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in docs
        )
        weight, slots = Counter(), defaultdict(list)
        for r in got:
            weight[r.shard] += r.size
            slots[r.shard].append(r.slot)
        assert set(weight) <= set(range(n))
        assert all(sorted(s) == list(range(len(s))) for s in slots.values())
        largest = max(r.size for r in got)
        assert max(weight.values()) <= sum(weight.values()) / n + 4 * largest
    assert sharding.shard_by_bytes(make([]), n_shards=4).count() == 0


def test_equal_texts_stay_in_one_shard(make):
    """Light groups are whole; a third of all bytes in one group is divided, by the cuts alone; nulls and repeated rows too."""
    rnd = random.Random(9)
    texts = [" ".join(prose(200 + k, rnd.randrange(5, 12 if k < 40 else 60))) for k in range(900)]
    docs = [(k, t) for k, t in enumerate(texts)]
    light = [(5000 + k, texts[k % 40]) for k in range(80)]
    heavy = [(k % 7 or None, "one text that very many rows have, " * 4) for k in range(900)]
    df = make([*docs, *light, *heavy]).withColumn("lang", F.when(F.rand(3) < 0.8, F.lit("en")))
    df = df.withColumn("source", F.when(F.rand(4) < 0.7, F.concat(F.lit("s"), (F.rand(5) * 9).cast("int"))))
    got = sharding.shard_by_bytes(df, n_shards=4).collect()
    assert len(got) == len(docs) + len(light) + len(heavy)
    weight, at, slots = Counter(), defaultdict(set), defaultdict(list)
    for r in got:
        weight[r.shard] += r.size
        at[r.size, r.text_crc32].add(r.shard)
        slots[r.shard].append(r.slot)
    split = {k for k, v in at.items() if len(v) > 1}
    big = ("one text that very many rows have, " * 4).encode()
    assert split == {(len(big) + 1, zlib.crc32(big))}
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(weight.values()) <= 1.05 * min(weight.values())


def test_shards_by_target_bytes(make, corpus):
    rnd = random.Random(6)
    docs = [*corpus, (None, "no id"), *[(1000 + i, "copy of one text") for i in range(400)], *[(2000 + i, "x" * rnd.randrange(400)) for i in range(600)]]
    by_size = sharding.shard_by_bytes(make(docs), target_bytes=50_000).groupBy("shard").count().count()
    assert by_size == -(-sum(len((t or "").encode()) + 1 for _, t in docs) // 50_000)


def test_dense_slots_split_a_hot_group(spark):
    df = spark.range(5000).selectExpr("id", "id % 7 = 0 as g")
    got = dense_slots(df, ["g"], ["id"], 5000, "slot", cell_rows=50).collect()
    for g in (True, False):
        mine = sorted(r.slot for r in got if r.g == g)
        assert mine == list(range(len(mine)))


def test_intermediate_tables_go_to_the_shared_folder(make, spark):
    assert new_path(spark, "x").startswith(spark.conf.get("spark.checkpoint.dir"))
