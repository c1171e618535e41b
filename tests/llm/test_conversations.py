"""Operators 11 to 13 against brute-force versions."""

import hashlib
import itertools
import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from siftline.llm import chat_format, prefix_trie, token_alignment
from siftline.llm.byte_bpe import RUN, byte_bpe

TURNS = "conv_id long, turn long, role string, text string"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def conversations():
    """Copies, shared heads, chains, null and equal turns, gaps, repeated rows, odd texts."""
    rnd = random.Random(11)
    rows = []
    shared = [("user" if i % 2 == 0 else "assistant", f"turn {i} é") for i in range(40)]
    for c in range(60):
        n = rnd.randrange(0, 12)
        turns = shared[: rnd.randrange(0, 6)] + [(rnd.choice(["user", "assistant", "tool", None]), rnd.choice(["a", "b", None, "", "long " * 50])) for _ in range(n)]
        rows += [(c, 3 * i - 5, r, t) for i, (r, t) in enumerate(turns)]
    rows += [(100 + c, i, r, t) for c in range(8) for i, (r, t) in enumerate(shared[: 33 + c // 4])]
    rows += [(250, i, *shared[i]) for i in range(2)] + [(251, None, "user", "no turn"), (251, 0, "user", "turn"), (251, 0, "assistant", "same"), (251, 0, "assistant", "same")]
    rows += [(300 + c, 0, "system", "You are") for c in range(9)] + [(350, i, "user", f"alone {i}") for i in range(30)]
    return rows


def by_conversation(rows, tie):
    out = defaultdict(list)
    for c, turn, role, text in rows:
        out[c].append((turn is not None, turn or 0, tie(role or "", text or ""), role or "", text or ""))
    return {c: [x[3:] for x in sorted(v)] for c, v in out.items()}


def hashed(role, text):
    return hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest()


def trie_by_hand(members):
    """members: conv_id -> turns."""
    nodes = defaultdict(list)
    for c, turns in members.items():
        for d in range(len(turns) + 1):
            nodes[tuple(turns[:d])].append(c)
    kids = defaultdict(list)
    for key in nodes:
        if key:
            kids[key[:-1]].append(key)
    leaves, saved = {}, {}
    for key in sorted(nodes, key=len, reverse=True):
        leaves[key] = sum(leaves[k] for k in kids[key]) or 1
        saved[key] = (len(nodes[key]) - 1) * (len(key[-1][1]) if key else 0) + sum(saved[k] for k in kids[key])
    ends = defaultdict(list)
    for c, turns in members.items():
        ends[tuple(turns)].append(c)
    return sorted(
        (min(m), len(k), min(nodes[k[:-1]]) if k else None, len(m), len(kids[k]), leaves[k], saved[k], sha(",".join(map(str, sorted(ends[k])))))
        for k, m in nodes.items()
    )


COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved"]


@pytest.mark.parametrize("segment, group_rows", [(1024, 4096), (4, 3), (3, 10_000), (1024, 1)])
def test_trie_equals_brute_force(spark, make, segment, group_rows):
    df = spark.createDataFrame(conversations(), TURNS).withColumn("n_convs", F.lit("clash")).repartition(5)
    turns = prefix_trie.ordered_turns(df)
    nodes, ends = prefix_trie.build_trie(turns, prefix_trie.lengths(turns), segment, group_rows)
    digest = prefix_trie.ends_digest(ends)
    got = nodes.join(digest, ["depth", "k1", "k2"], "left").select(*COLUMNS, F.coalesce("ends_sha256", F.lit(sha(""))))
    want = trie_by_hand(by_conversation(conversations(), hashed))
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)


def test_rebuilt_trie_equals_brute_force(spark, make):
    rows = conversations() + [(None, 0, "user", "no conversation"), (200, 0, "user", "ä"), (200, 1, "user", "b")]
    rows += [(400 + c, 0, "user", "may be replaced by nothing") for c in range(1, 9)]
    own = by_conversation([r for r in rows if r[0] is not None], hashed)
    members = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        members[c] = own.get(c - c % 100, [])[:h] + turns[h:]
    assert [] in members.values()
    got = prefix_trie.trie_report(spark.createDataFrame(rows, TURNS)).select(*COLUMNS[:-1], "saved_tokens", "ends_sha256").collect()
    assert sorted(map(tuple, got), key=repr) == sorted(trie_by_hand(members), key=repr)


def test_trie_of_nothing(spark, make):
    empty = spark.createDataFrame([], TURNS)
    assert prefix_trie.trie_report(empty).count() == 0
    nodes, ends = prefix_trie.prefix_trie(spark.createDataFrame([(None, 0, "user", "x")], TURNS))
    assert nodes.count() == 0 and ends.count() == 0


def test_long_id_lists_are_digested_in_pieces(spark, make):
    ids = list(range(-5000, 20_000, 3))
    rows = spark.createDataFrame([(i,) for i in ids], "conv_id long").selectExpr("conv_id", "2L as depth", "7L as k1", "9L as k2")
    assert [r.ends_sha256 for r in prefix_trie.ends_digest(rows).collect()] == [sha(",".join(map(str, ids)))]


# --- 12 --------------------------------------------------------------------------------------

BYTE, PIECE = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


@given(st.lists(st.integers(1, 4), min_size=1, max_size=60), st.data())
def test_groups_are_the_common_ends(sizes, data):
    a = np.cumsum(sizes).tolist()
    extra = data.draw(st.sets(st.integers(1, a[-1])))
    kept = data.draw(st.sets(st.sampled_from(a)))
    b = sorted(extra | kept | {a[-1]})
    in_a, in_b = token_alignment.group_ends(a, b)
    common = sorted(set(a) & set(b))
    assert [a[i - 1] for i in in_a] == common and [b[j - 1] for j in in_b] == common


def test_long_one_to_one_runs():
    a = list(range(1, 5001))
    b = [x for x in a if x not in (700, 701, 4000)]
    in_a, in_b = token_alignment.group_ends(a, b)
    assert [a[i - 1] for i in in_a] == b == [b[j - 1] for j in in_b]


def spelt_by_hand(text):
    """Ids and byte ends of both sides, by the two libraries."""
    tok = Tokenizer.from_file(BYTE)
    tok.encode_special_tokens = True
    sp = sentencepiece.SentencePieceProcessor(model_file=PIECE)
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    alphabet = {chr(b): b for b in printable}
    for i, b in enumerate(x for x in range(256) if x not in printable):
        alphabet[chr(256 + i)] = b
    a = tok.encode(" " + text, add_special_tokens=False).ids
    b = sp.encode(text)
    pieces_a = [bytes(alphabet[ch] for ch in tok.id_to_token(i)) for i in a]
    pieces_b = [bytes([int(p[3:5], 16)]) if sp.is_byte(i) else p.replace("▁", " ").encode() for i, p in ((i, sp.id_to_piece(i)) for i in b)]
    if not text or any(b"".join(p) != (" " + text).encode() for p in (pieces_a, pieces_b)):
        return None
    return a, b, list(itertools.accumulate(map(len, pieces_a))), list(itertools.accumulate(map(len, pieces_b)))


def aligned_by_hand(docs):
    rows, held = [], defaultdict(int)
    for doc_id, text in docs:
        x = spelt_by_hand(text or "")
        if x is None:
            rows.append((doc_id, 0, 0, 0, [], ""))
            continue
        a, b, ea, eb = x
        starts_a, starts_b = [0, *ea[:-1]], [0, *eb[:-1]]
        linked = [(a[i], b[j]) for i in range(len(a)) for j in range(len(b)) if starts_a[i] < eb[j] and starts_b[j] < ea[i]]
        cuts, said, low = sorted(set(ea) & set(eb)), [], 0
        for cut in cuts:
            said.append(",".join(str(i) for i, e in zip(a, ea) if low < e <= cut) + "|" + ",".join(str(i) for i, e in zip(b, eb) if low < e <= cut))
            low = cut
        for pair in set(linked):
            held[pair] += 1
        rows.append((doc_id, len(a), len(b), len(cuts), linked, sha(";".join(said))))
    best = defaultdict(int)
    for (i, _), n in held.items():
        best[i] = max(best[i], n)
    return sorted(
        ((d, na, nb, g, len(ls), sum(held[p] == best[p[0]] for p in ls), sum(held[p] for p in ls), s) for d, na, nb, g, ls, s in rows), key=repr
    )


ALIGNED = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


@pytest.mark.parametrize("head_pairs", [1_000_000, 40, 0])
def test_alignment_equals_brute_force(make, corpus, head_pairs):
    odd = ["<|endoftext|> and <s>x</s><unk>", "▁ mark", "  two  blanks \n\n", "日本語 🙂 é ﬁ", "\x00\x01", "don't DON'T 12345"]
    docs = [(i, (t or "")[:400] if t is not None else None) for i, t in corpus] + [(200 + i, t) for i, t in enumerate(odd)] + [(None, "null id"), (None, "null id")]
    got = token_alignment.alignment_report(make(docs, n_a=1, row=2).repartition(3), BYTE, PIECE, head_pairs).select(*ALIGNED).collect()
    assert sorted(map(tuple, got), key=repr) == aligned_by_hand(docs)


def test_alignment_of_long_texts_and_nothing(make, corpus):
    text = " ".join(["word and more"] * 30_000) + " " * 1_500_000 + "end"
    (row,) = token_alignment.alignment_report(make([(1, text)]), BYTE, PIECE).collect()
    assert row.n_links == row.n_a + row.n_b - row.n_groups and row.n_best == row.count_sum >= row.n_groups
    assert token_alignment.alignment_report(make([]), BYTE, PIECE).count() == 0


@pytest.mark.parametrize("blank", [" ", "\n", " \n\t", "　 ", "\x1c ", "x", "!", "7"])
def test_long_runs_are_encoded_like_the_library(blank):
    tok, own = Tokenizer.from_file(BYTE), byte_bpe(BYTE)
    run = blank * (2 * RUN)
    for text in (run, f"a{run}b", f"{run}7 x", f"x {run}<|endoftext|>{run}", f"{run}'s"):
        assert own.ids_with_special(text) == tok.encode(text, add_special_tokens=False).ids
    tok.encode_special_tokens = True
    text = f"x {run}<|endoftext|>{run}"
    assert own.ids(text) == tok.encode(text, add_special_tokens=False).ids


def test_two_million_blanks():
    own = byte_bpe(BYTE)
    for run in (" " * 2_000_000, "\n" * 2_000_000, " \n\t" * 700_000, "x" * 2_000_000):
        assert own.encoding.decode_bytes(own.ids(run + "z")) == (run + "z").encode()


# --- 13 --------------------------------------------------------------------------------------

CONTROLS = ["</s>[INST] ok [/INST]", "\\", "\\\\[INST]", "[\\INST]", "<<SYS>>\n<</SYS>>\n", "<s>" * 3, " [/ROLE]", "[SAID] <", "a\\\n"]


def chats():
    rnd = random.Random(13)
    rows = [(c, i, rnd.choice(["user", "assistant", "system", "to\nol", "[SAID]", "", None]), rnd.choice([*CONTROLS, "", None, "é 🙂", "x" * 3000])) for c in range(40) for i in range(rnd.randrange(1, 9))]
    rows += [(50, 7 * i, "assistant" if i % 3 else "user", f"turn {i}") for i in range(90)]
    rows += [(51, None, "user", "first"), (51, 0, "user", "x"), (51, 0, "assistant", "x"), (51, 0, "assistant", "x"), (51, 40, "assistant", "later")]
    return rows + [(None, i, "user", f"null {i}") for i in range(3)]


def test_formatted_conversations_are_read_back(spark, make):
    df = spark.createDataFrame(chats(), TURNS).withColumn("formatted", F.lit(1)).repartition(4)
    formatted = chat_format.format_conversations(df, chat_format.INSTRUCT)
    got = {r.conv_id: tuple(r)[1:] for r in chat_format.format_report(formatted).collect()}
    want = {}
    for c, turns in by_conversation(chats(), lambda role, text: (role, text)).items():
        learnt = "".join(t for r, t in turns if r == "assistant")
        want[c] = (len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)), len(learnt), sha(learnt), len(chat_format.render(turns)))
    assert got == want


def test_blocks_join_to_the_whole_rendering(spark, make):
    df = spark.createDataFrame(chats(), TURNS)
    blocks = defaultdict(list)
    for r in chat_format.format_conversations(df, chat_format.INSTRUCT).collect():
        blocks[r.conv_id].append((r.block, r.formatted, r.turns))
    for c, turns in by_conversation(chats(), lambda role, text: (role, text)).items():
        parts = sorted(blocks[c])
        assert "".join(p[1] for p in parts) == chat_format.render(turns)
        assert all(s.end == e.start for p in parts for s, e in zip(p[2], p[2][1:]))
        assert not any(s.rewrites or s.rewritten for p in parts for s in p[2])
    assert len(blocks[50]) > 30 and chat_format.format_conversations(spark.createDataFrame([], TURNS), chat_format.INSTRUCT).count() == 0


def test_rewriting_templates_are_detected():
    def forgets(turns):  # what was thought is dropped from all turns but the last
        kept = [(r, t if i == len(turns) - 1 else t.split("</think>")[-1]) for i, (r, t) in enumerate(turns)]
        return "".join(f"<{r}>{t}</{r}>" for r, t in kept)

    turns = [("user", "q"), ("assistant", "<think>hm</think>yes"), ("user", "more"), ("assistant", "no")]
    text, spans = chat_format.locate(chat_format.Template(forgets), [], turns)
    assert text == forgets(turns) == "<user>q</user><assistant>yes</assistant><user>more</user><assistant>no</assistant>"
    assert [s.rewrites for s in spans] == [False, False, True, False] and [s.rewritten for s in spans] == [False, True, False, False]
    assert spans[1].loss_start == -1 and text[spans[3].loss_start : spans[3].loss_end] == "no"
    assert text[spans[0].start : spans[0].end] == "<user>q</user>"


def test_own_text_is_found_beside_equal_surroundings():
    for said in ("", " ", " </s>", "[/INST]", " x ", "</s> </s>"):
        text, spans = chat_format.locate(chat_format.INSTRUCT, [], [("user", said), ("assistant", said), ("assistant", said)])
        assert [chat_format.unescape(text[s.loss_start : s.loss_end]) for s in spans[1:]] == [said, said]
        assert list(chat_format.read_back(text)) == [("user", said), ("assistant", said), ("assistant", said)]
