"""The pipeline's stages, each against a brute-force version on its own input."""

import importlib.util
import random
import sys
from pathlib import Path

import corpus_pipeline
from siftline.llm import repeats

spec = importlib.util.spec_from_file_location("llm_brute_force", Path(__file__).with_name("test_llm_operators.py"))
brute = importlib.util.module_from_spec(spec)
sys.modules["llm_brute_force"] = brute
spec.loader.exec_module(brute)


def test_every_stage(make, spark, corpus, tmp_path):
    rnd = random.Random(12)
    vocabulary = [f"{rnd.choice('bcdfgk')}{rnd.choice('aeiou')}{i}" for i in range(500)]
    text = lambda n: " ".join(rnd.choice(vocabulary) for _ in range(n))
    items = [(i, text(30)) for i in range(5)]
    docs = [*corpus[:-1], *[(500 + i, text(80)) for i in range(20)], *[(600 + i, text(40) + "\n" + items[i % 5][1] + " " + text(30)) for i in range(10)]]
    sf = str(tmp_path)
    make(docs, extra="kept").write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    table = spark.read.parquet(f"{sf}/documents.parquet")
    rows = sorted(docs)
    quality, near, cut, clean, pack = [f for _, f in corpus_pipeline.STAGES]

    passed = quality(spark, table, sf)
    assert passed.columns == table.columns
    want = {i: t for i, t in rows if brute.quality_by_hand(t)[-1]}
    assert {r.doc_id: r.text for r in passed.collect()} == want

    table = make(sorted(want.items()), extra="kept")
    kept = near(spark, table, sf)
    assert kept.columns == table.columns
    groups = brute.components_by_hand(sorted(want.items()), 5, 80)
    want = {i: t for i, t in want.items() if groups[i][2]}
    assert {r.doc_id: r.text for r in kept.collect()} == want

    table = make(sorted(want.items()), extra="kept")
    slim = cut(spark, table, sf)
    assert slim.columns == table.columns
    covered = brute.removed_by_hand(want.items(), repeats.LENGTH)
    want = {i: bytes(b for b, c in zip(*covered[i, t]) if not c).decode() for i, t in want.items()}
    assert {r.doc_id: (r.text, r.n_chars, r.extra) for r in slim.collect()} == {i: (t, len(t), "kept") for i, t in want.items()}

    table = make(sorted(want.items()), extra="kept")
    rest = clean(spark, table, sf)
    assert rest.columns == table.columns
    words = {i: brute.WORD.findall(t) for i, t in items}
    dirty = lambda t: any(brute.alignment_by_hand(w, brute.WORD.findall(brute.lower(t))) >= 0.5 * len(w) for w in words.values())
    want = {i: t for i, t in want.items() if not dirty(t)}
    assert {r.doc_id: r.text for r in rest.collect()} == want

    packed = pack(spark, make(sorted(want.items())), sf).collect()
    brute.check_packing(packed, 2048)
    assert {r.doc_id for r in packed} == set(want)
    whole = corpus_pipeline.run(spark, sf).collect()
    assert {(r.doc_id, r.piece, r.length, r.ids_crc32) for r in whole} == {(r.doc_id, r.piece, r.length, r.ids_crc32) for r in packed}


def test_registered():
    import __spark_entry__ as entry

    names = entry.queries()
    assert [n for n in range(1, 11) if not any(k.startswith(f"op{n}_") for k in names)] == []
    assert "pipeline" in names and set(entry.oracle_sql()) <= set(names)
