import collections
import hashlib

import corpus_pipeline
import numpy as np
from test_operators import exact_groups, near_copies

from gyre.llm import mixing, near_dedup, quality, suffix_dedup
from gyre.llm.common import written


def test_stages_act_on_what_is_left(spark, sf):
    path = sf.replace("sf0.001", "sf0.01")
    docs = spark.read.parquet(f"{path}/documents.parquet")
    columns, seen = docs.columns, []
    for name, stage in corpus_pipeline.STAGES:
        out = written(stage(spark, docs, path), "test-stage")
        seen.append((name, docs, out))
        docs = out
    assert all(out.columns == columns for _, _, out in seen[:-1])
    (_, d0, q), (_, d1, n), (_, d2, s), (_, d3, m), (_, d4, p) = seen
    labels = spark.read.parquet(f"{path}/labels.parquet")
    assert q.join(labels.where("quality = 0"), "doc_id").count() <= 0.15 * labels.where("quality = 0").count()
    assert q.join(labels.where("quality = 1"), "doc_id").count() >= 0.97 * labels.where("quality = 1").count()
    classes = near_dedup.classes(d1)
    assert {r.doc_id for r in n.collect()} == {r.class_id for r in classes.collect()}
    want = {d: len((t or "").encode()) for d, t in ((r.doc_id, r.text) for r in d2.collect())}
    brute = {r[0]: r for r in suffix_dedup.brute([(r.doc_id, r.text) for r in d2.collect()])}
    assert set(brute) == set(want) and sum(len(r.text.encode()) for r in s.collect()) <= sum(b[1] - b[2] for b in brute.values())
    cut = {r.doc_id: r.text for r in s.collect()}
    for r in d2.collect():  # document by document; characters cut in two go as well
        if (r.text or "").isascii():
            assert hashlib.sha256((cut[r.doc_id] or "").encode()).hexdigest() == brute[r.doc_id][4]
    taken = {r.doc_id: r._mix_copies for r in mixing.mix(d3).select("doc_id", "_mix_copies").collect()}
    texts = {r.doc_id: r.text for r in d3.collect()}
    mixed = collections.Counter((r.doc_id, r.text) for r in m.collect())
    assert mixed == {(d, texts[d]): n for d, n in taken.items() if n}
    assert m.count() == mixing.mix(d3).agg({"_mix_copies": "sum"}).first()[0]
    assert p.agg({"length": "sum"}).first()[0] > 0 and d4.count() == p.where("start = 0").count()
    assert quality.THRESHOLD == 0.7


def test_near_dedup_stage_keeps_one_of_each_class_of_a_large_group_from_few_pairs(spark, monkeypatch):
    rows, found = [(k, t, "a") for k, t in enumerate(near_copies("words", 400, np.random.default_rng(9)))], []
    possible = near_dedup.possible
    monkeypatch.setattr(near_dedup, "possible", lambda *a: found.append(written(possible(*a), "pairs")) or found[-1])
    stage = dict(corpus_pipeline.STAGES)["MinHash near-dedup"]
    out = stage(spark, spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3), "").collect()
    assert sorted(r.doc_id for r in out) == sorted(min(g) for g in exact_groups([r[:2] for r in rows]))
    assert 0 < found[0].count() < 10 * len(rows)
