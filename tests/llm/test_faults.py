"""Ids at the ends of their range, and columns whose names clash."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from gyre.llm import mixing, near_dedup, suffix_dedup, topk

TOP = (1 << 63) - 1


def by_suffix(df):
    return sorted(map(tuple, suffix_dedup.removed(df).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256)).collect()), key=repr)


@pytest.mark.parametrize("ids", [(TOP, None), (TOP, TOP - 1, None), (TOP, TOP - 1, TOP - 3, None, None), (-TOP - 1, None, TOP), (None, 5)])
def test_suffix_dedup_tells_null_from_the_largest_id(spark, ids):
    rows = [(i, "b" * 60 + str(n % 2) * 55) for n, i in enumerate(ids)] + [(3, "c" * 70)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    want = sorted([(None if r[0] == TOP + 1 else r[0], *r[1:]) for r in suffix_dedup.brute(rows)], key=repr)
    assert by_suffix(df) == want
    assert sorted((r.doc_id, r.text) for r in suffix_dedup.deduplicated(df).where("doc_id is not null").collect())[0][0] == min(i for i, _ in rows if i is not None)
    kept = {r.doc_id: hashlib.sha256((r.text or "").encode()).hexdigest() for r in suffix_dedup.deduplicated(df).collect() if r.doc_id is not None}
    assert kept == {r[0]: r[4] for r in want if r[0] is not None}


def test_near_dedup_passes_columns_of_any_name_on(spark):
    words = "one two three four five six seven eight nine ten eleven twelve"
    rows = [(1, words, "a", "b", "c", "d"), (2, words, "e", "f", "g", "h"), (3, "other " + words[::-1], "i", "j", "k", "l")]
    df = spark.createDataFrame(rows, "doc_id long, text string, _near_h string, _near_id string, _near_text string, c0 string")
    out = near_dedup.deduplicated(df)
    assert out.columns == df.columns and sorted(map(tuple, out.collect())) == [rows[0], rows[2]]


def test_near_dedup_numbers_texts_apart(spark, odd):
    """As many nodes as texts, in the order of their hashes, and the same classes by shuffled joins."""
    sig, named = near_dedup.labelled(odd)
    assert named.count() == named.select("h").distinct().count() == odd.select(F.coalesce("text", F.lit(""))).distinct().count()


def test_near_dedup_and_its_shuffle_joins_agree(spark, odd, monkeypatch):
    want = sorted(map(repr, near_dedup.classes(odd).collect()))
    monkeypatch.setattr(near_dedup, "BROADCAST_ROWS", 0)
    monkeypatch.setattr("gyre.llm.common.FEW_ROWS", 0)
    assert sorted(map(repr, near_dedup.classes(odd).collect())) == want


def test_topk_over_many_slices_holds_one_scan_s_slices_at_a_time(spark, monkeypatch):
    rng = np.random.default_rng(3)
    rows = [(i, [float(c) for c in rng.normal(size=8)]) for i in range(300)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    want = topk.top_k(df, F.col("vec_id") % 3 == 0).collect()
    monkeypatch.setattr(topk, "SLICES", 2)
    live, most, send = set(), [], type(spark.sparkContext).broadcast

    def counted(context, value):
        b = send(context, value)
        live.add(id(b))
        most.append(len(live))
        gone = b.destroy
        b.destroy = lambda *a, **k: (live.discard(id(b)), gone(*a, **k))
        return b

    monkeypatch.setattr(type(spark.sparkContext), "broadcast", counted)
    got = topk.top_k(df, F.col("vec_id") % 3 == 0, most=100)  # some eight slices
    assert not live and max(most) <= 3 and len(most) >= 14
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want))


def test_mixed_passes_columns_of_any_name_on(spark, monkeypatch):
    rows = [(i, "word " * (i % 9 + 1), f"s{i % 3}", "a", "b", "c") for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, _mix_size string, _mix_copies string, c0 string")
    plain = df.select("doc_id", "text", "source")
    want = sorted(r for r in mixing.mixed(plain).collect())
    out = mixing.mixed(df)
    assert out.columns == df.columns and sorted(r[:3] for r in out.collect()) == [tuple(r) for r in want] and {r[3:] for r in out.collect()} == {("a", "b", "c")}
    monkeypatch.setattr(mixing, "BROADCAST_ROWS", 0)  # joins by shuffle
    assert sorted(mixing.mixed(plain).collect()) == want
