import collections
import hashlib
import io
import math
import re
import zlib

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gyre.llm import common, hashing, licenses, lm, media, mixing, near_dedup, packing, quality, rans, registry, suffix_dedup, token_files, tokens, topk

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def docs_of(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def by_duckdb(sql, **paths):
    con = duckdb.connect()
    for name, path in paths.items():
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    got = con.execute(sql)
    names = [d[0] for d in got.description]
    return sorted(map(repr, (tuple(r[names.index(n)] for n in sorted(names)) for r in got.fetchall())))


def rows_of(df):
    return sorted(map(repr, (tuple(r[c] for c in sorted(df.columns)) for r in df.collect())))


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_empty_tables_give_no_rows(spark, none_dir, name):
    assert registry.QUERIES[name](spark, none_dir).count() == 0


# 1
def test_suffix_dedup_equals_brute_force(spark, odd, odd_dir, monkeypatch):
    want = sorted(suffix_dedup.brute(docs_of(odd)), key=repr)
    got = registry.QUERIES["op1_suffix_dedup"](spark, odd_dir)
    assert sorted(map(tuple, got.collect()), key=repr) == want
    monkeypatch.setattr(suffix_dedup, "BROADCAST_ROWS", 0)  # the way without a broadcast
    assert sorted(map(tuple, suffix_dedup.removed(odd).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256)).collect()), key=repr) == want


def test_suffix_dedup_of_hot_ranks_equals_brute_force(spark):
    """One passage in all documents, between bytes that differ: more rows of a rank than a chunk or a task keeps together."""
    rng = np.random.default_rng(1)
    passage = "the one passage that every document of this table has, again and again, word for word and byte for byte"
    rows = [(i, "".join(map(chr, rng.integers(97, 123, 80))) + passage[i % 3 :] + "".join(map(chr, rng.integers(97, 123, 80)))) for i in range(300)]
    want = sorted(suffix_dedup.brute(rows))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    for chunk, hot, group in ((1000, 20, 30), (10**6, 10**6, 10**6)):
        sender = suffix_dedup.anchor_rows(50, 16, 4)
        got = _with(suffix_dedup, {"CHUNK": chunk, "HOT": hot, "GROUP": group}, df)
        assert got == want
    assert callable(sender)


def _with(module, values, df):
    """Workers import the module anew, so the limits are set within the tasks."""
    names = ("anchor_rows", "context_rows", "window_ranks")
    old = {n: getattr(module, n) for n in names}

    def limited(make):
        def outer(*args):
            inner = make(*args)

            def run(batches):
                import gyre.llm.suffix_dedup as m

                for k, v in values.items():
                    setattr(m, k, v)
                yield from inner(batches)

            return run

        return outer

    try:
        for n in names:
            setattr(module, n, limited(old[n]))
        return sorted(map(tuple, module.removed(df).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256)).collect()))
    finally:
        for n in names:
            setattr(module, n, old[n])


def test_suffix_dedup_judges_each_text_of_a_shared_id_for_itself(spark):
    """So many texts without an id, or under one, that any 16 bits of a hash agree for some of them."""
    rng = np.random.default_rng(2)
    passage = "a passage of more than fifty bytes that stands in the first document and again in many others"
    own = ["".join(map(chr, rng.integers(97, 123, 60 + i % 90))) for i in range(2400)]
    rows = [(0, passage)] + [((None, 5)[i % 4 < 2], t + passage if i % 2 else t) for i, t in enumerate(own)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = suffix_dedup.removed(df).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256)).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(suffix_dedup.brute(rows), key=repr)
    kept = [hashlib.sha256(r.text.encode()).hexdigest() for r in suffix_dedup.deduplicated(df).collect()]
    assert sorted(kept) == sorted(b[-1] for b in suffix_dedup.brute(rows))


def test_prefix_doubling_over_all_positions_gives_the_same(spark, odd):
    rng = np.random.default_rng(5)
    passage = "".join(map(chr, rng.integers(97, 123, 75)))
    rows = [(i % 40, "".join(map(chr, rng.integers(97, 123, i % 60))) + passage[i % 5 :] + "ab" * (i % 50)) for i in range(90)]
    for df, held, length in ((odd, docs_of(odd), 50), (spark.createDataFrame(rows, "doc_id long, text string").repartition(3), rows, 50), (spark.createDataFrame(rows[:20], "doc_id long, text string"), rows[:20], 5)):
        got = suffix_dedup.removed(df, length, suffix_dedup.doubled).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256)).collect()
        want = [(None if b[0] == suffix_dedup.LAST else b[0], *b[1:]) for b in suffix_dedup.brute(held, length)]
        assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)


def test_suffix_dedup_keeps_columns(odd):
    out = suffix_dedup.deduplicated(odd)
    assert out.columns == odd.columns and out.count() == odd.count()


# 2
def test_quality_on_odd_tables(spark, odd, odd_dir):
    out = registry.QUERIES["op2_quality"](spark, odd_dir).collect()
    assert len(out) == odd.count() and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in out)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in out if r.doc_id is not None)


@pytest.mark.parametrize("quality_of", [None, 0, 1])
def test_quality_without_both_classes_refuses_nothing(spark, odd, quality_of):
    labels = spark.createDataFrame([] if quality_of is None else [(i, quality_of) for i in range(40)], "doc_id long, quality int")
    out = quality.accepted(odd, labels)
    assert out.columns == odd.columns and rows_of(out) == rows_of(odd)


def test_quality_on_held_out_labels(spark, sf):
    out = registry.QUERIES["op2_quality"](spark, sf.replace("sf0.001", "sf0.01"))
    labels = spark.read.parquet(sf.replace("sf0.001", "sf0.01") + "/labels.parquet")
    rows = out.where("held_out").join(labels, "doc_id").collect()
    assert np.mean([r.predicted == r.quality for r in rows]) > 0.93


def test_quality_scores_follow_the_plain_discriminant(spark, sf):
    """Log-odds of all scores against log-density differences by inverses and determinants, from labelled rows of the training fold."""
    path = sf.replace("sf0.001", "sf0.01")
    texts = dict(docs_of(spark.read.parquet(f"{path}/documents.parquet")))
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{path}/labels.parquet").collect() if zlib.crc32(str(r.doc_id).encode()) % 4 != 2 and r.doc_id in texts}
    x = {d: np.array(quality.statistics(t)) for d, t in texts.items()}
    own = [np.stack([x[d] for d, q in labels.items() if q == k]) for k in (0, 1)]
    mean = [m.mean(axis=0) for m in own]
    each = [(m - c).T @ (m - c) for m, c in zip(own, mean)]
    pooled, d = sum(each) / sum(map(len, own)), len(quality.NAMES)
    density = []
    for m, c, e in zip(own, mean, each):
        w = min(1.0, 0.3 + d / len(m))
        cov = 0.95 * ((1 - w) * e / len(m) + w * pooled) + 0.05 * np.diag(np.maximum(np.diag(pooled), 1e-6)) + 1e-9 * np.eye(d)
        density.append((np.linalg.inv(cov), np.linalg.slogdet(cov)[1], c))
    out = registry.QUERIES["op2_quality"](spark, path).where("score between 0.001 and 0.999").collect()
    diff = np.array([[-0.5 * ((x[r.doc_id] - c) @ inv @ (x[r.doc_id] - c) + det) for inv, det, c in density] for r in out])
    z = quality.squashed(diff[:, 1] - diff[:, 0])
    odds = np.array([math.log(r.score / (1 - r.score)) for r in out])
    slope, offset = np.polyfit(z, odds, 1)
    assert slope > 0 and np.abs(slope * z + offset - odds).max() < 1e-4 and len(out) > 20


# 3
def test_lm_base_scores_equal_brute_force_and_the_model_beats_them(spark, sf):
    path = sf.replace("sf0.001", "sf0.01")
    rows = docs_of(spark.read.parquet(f"{path}/documents.parquet"))
    lower = {ord(c): c.lower() for c in licenses.UPPER}
    held = {d: WORDS.findall((t or "").translate(lower)) + [None] for d, t in rows}
    counts = collections.Counter(w for d in held if zlib.crc32(str(d).encode()) % 5 != 1 for w in held[d])
    n, v = sum(counts.values()), len(counts)
    sums = collections.Counter()
    for r in registry.QUERIES["op3_lm_score"](spark, path).collect():
        base = sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in held[r.doc_id])
        assert r.base_score == pytest.approx(base, rel=1e-9) and r.n_known == sum(counts[w] > 0 for w in held[r.doc_id])
        assert r.train_tokens == n and r.n_tokens == len(held[r.doc_id]) and r.score < 0
        sums[r.held_out] += r.score - r.base_score
    assert sums[True] > 0 and sums[False] > 0


def test_lm_on_odd_rows(odd):
    out = lm.score(odd, F.col("doc_id") % 5 == 1).collect()
    assert len(out) == odd.count() and all(np.isfinite(r.score) and r.n_tokens >= 1 for r in out)


def test_lm_scores_equal_a_plain_sum_over_words(spark, monkeypatch):
    """score against loops over words with the trained model's tables: feature hashes, class and leaf softmax, shares of leaves."""
    rng = np.random.default_rng(9)
    names, often = [f"w{x}" for x in range(300)], 1.0 / np.arange(1, 301)
    rows = [(i, " ".join(rng.choice(names, int(rng.integers(0, 40)), p=often / often.sum()))) for i in range(80)] + [(80, None), (81, "unseen words here")]
    held, train = [], lm.train

    def kept(*args):
        held.append((args, train(*args)))
        return held[-1][1]

    monkeypatch.setattr(lm, "train", kept)
    out = {r.doc_id: r for r in lm.score(spark.createDataFrame(rows, "doc_id long, text string").repartition(2), F.col("doc_id") % 5 == 1).collect()}
    (_, leaf_counts, top, *_), model = held[0]
    assert np.abs(model.w1).max() > 0 and len(model.w1) < 1 << lm.BITS1
    counts = collections.Counter(w for d, t in rows if d % 5 != 1 for w in [*(t or "").split(), None])

    def facts(word):
        if word is None:
            h, leaf = int(lm.END), lm.TOP
        else:
            h, leaf, _ = (int(x[0]) for x in lm.tokens_of(np.frombuffer(word.encode(), np.uint8), np.array([0, len(word)])))
        rank = np.flatnonzero(top == np.uint64(h))
        return h, int(rank[0]) if len(rank) else leaf, len(rank) > 0

    sharing = collections.Counter(facts(w)[1] for w in counts)
    for d, t in rows:
        total, past = 0.0, [(int(lm.START), int(lm.START))] * 2
        for w in [*(t or "").split(), None]:
            h, leaf, alone = facts(w)
            cls, own = divmod(leaf, lm.K2)
            (one, first), (_, second) = past[-1], past[-2]
            keys = (first, (first * hashing.P + second) % 2**64, second, one)
            f = [int(hashing.mix(np.array([k], np.uint64), seed)[0]) for seed, k in enumerate(keys, 21)]
            n1, n2 = len(model.w1).bit_length() - 1, len(model.w2).bit_length() - 1
            z1 = sum(model.w1[x >> (64 - n1)].astype(float) for x in f) + model.b1
            z2 = sum(model.w2[((x ^ (cls * hashing.P % 2**64)) * 0xBF58476D1CE4E5B9 % 2**64) >> (64 - n2)].astype(float) for x in f) + model.b2[cls]
            for z, y in ((z1, cls), (z2, own)):
                total += math.log10(math.exp(z[y]) / np.exp(z).sum())
            if not alone:
                total += math.log10((counts[w] + 0.5) / (leaf_counts[leaf] + 0.5 * (sharing[leaf] + 1)))
            past.append((h, leaf))
        assert out[d].score == pytest.approx(total, rel=1e-4, abs=1e-4)


def test_lm_softmax_sums_to_one():
    model = lm.Model.start(np.arange(lm.LEAVES))
    rng = np.random.default_rng(0)
    model.w1, model.w2 = rng.standard_normal(model.w1.shape).astype(np.float32), rng.standard_normal(model.w2.shape).astype(np.float32)
    f = np.repeat(lm.contexts(np.array([3, 200, 7]), np.zeros(3, int))[2:], lm.LEAVES, axis=0)
    assert (10 ** model.log10(np.arange(lm.LEAVES), f)).sum() == pytest.approx(1, abs=1e-4)


# 4
def exact_groups(rows, least=0.8):
    """Classes of row numbers, by all pairs' weighted similarity."""
    sets = {}
    for k, (_, t) in enumerate(rows):
        w = [x.lower() for x in WORDS.findall(t or "")]
        sets[k] = collections.Counter([tuple(w[i : i + 5]) for i in range(len(w) - 4)] if len(w) >= 5 else [tuple(w)] if w else [])
    parent = {k: k for k in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in range(a):
            same = (rows[a][1] or "") == (rows[b][1] or "")
            if same or sets[a] and sets[b] and (sets[a] & sets[b]).total() >= least * (sets[a] | sets[b]).total():
                parent[find(a)] = find(b)
    groups = collections.defaultdict(list)
    for k in sets:
        groups[find(k)].append(rows[k][0])
    return list(groups.values())


def exact_classes(rows, least=0.8):
    return sorted(repr((d, min((x for x in g if x is not None), default=None))) for g in exact_groups(rows, least) for d in g)


def test_near_dedup_equals_brute_force(odd):
    rows = docs_of(odd)
    assert sorted(repr((r.doc_id, r.class_id)) for r in near_dedup.classes(odd).collect()) == exact_classes(rows)
    out = near_dedup.deduplicated(odd)
    assert out.columns == odd.columns and out.count() == len(exact_groups(rows))  # class ids may be null or equal


def test_near_dedup_keeps_a_row_of_each_class_where_ids_are_null_or_repeat(spark):
    rng = np.random.default_rng(8)
    texts = [" ".join(f"w{x}" for x in rng.integers(0, 10**6, 60)) for _ in range(9)]
    near = texts[4].replace(texts[4].split()[0], "changed")
    ids = [6, 6, None, None, None, None, 1, 2, 2]
    rows = [*zip(ids, texts), (7, texts[1]), (None, texts[2]), (None, near), (None, texts[6]), (6, texts[0]), (2, texts[8])]
    out = docs_of(near_dedup.deduplicated(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)))
    got = sorted((t.replace(near, texts[4]), repr(d)) for d, t in out)
    assert got == sorted((t, repr(d)) for d, t in zip(ids, texts))


def test_near_dedup_weighs_repeats_and_takes_other_thresholds(spark):
    """Repeated lines count as often as they stand; under a low threshold pairs of unlike sizes are links too."""
    rng = np.random.default_rng(11)
    rows = []
    for g in range(12):
        body = [f"w{x}" for x in rng.integers(0, 10**6, 60)]
        line = [f"r{x}" for x in rng.integers(0, 10**6, 9)]
        rows += [(len(rows) + i, " ".join(body + line * times)) for i, times in enumerate((1, 2, 9, 10))]
        rows += [(len(rows), " ".join(body[: 20 + g]))]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for least, bands, per in ((0.8, 26, 5), (0.3, 60, 1)):
        got = near_dedup.classes(df, least=least, bands=bands, rows=per).collect()
        assert sorted(repr((r.doc_id, r.class_id)) for r in got) == exact_classes(rows, least)
    assert len(exact_groups(rows, 0.8)) > len(exact_groups(rows, 0.3))


def test_near_dedup_second_round_loses_no_link(spark):
    """Chains of copies of copies: ends are unlike the first, but linked through others."""
    rng = np.random.default_rng(3)
    rows = []
    for g in range(6):
        text = [f"w{x}" for x in rng.integers(0, 10**6, 150)]
        for _ in range(25):
            text = list(text)
            text[int(rng.integers(0, 150))] = f"n{rng.integers(0, 10**6)}"
            rows.append((len(rows), " ".join(text)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(repr((r.doc_id, r.class_id)) for r in near_dedup.classes(df).collect()) == exact_classes(rows)


def near_copies(kind, n, rng):
    """Copies of one text: with few words changed anywhere, cut short, with one of two long insertions, or changed in ten fixed places."""
    base = [f"w{x}" for x in rng.integers(0, 3000, 150)]
    for k in range(n):
        text = list(base)
        if kind == "cut":
            text = text[: rng.integers(60, 150)] + [f"e{rng.integers(0, 10**6)}"]
        elif kind == "places":
            for p in range(5, 150, 14):
                text[p] = f"n{p}_{rng.integers(0, 2)}" if rng.random() < 0.5 else text[p]
        else:
            if kind == "versions" and k % 3:
                text = text[:60] + [f"v{k % 3}_{i}" for i in range(30)] + text[30 + 30 * (k % 3) :]
            for p in rng.integers(0, 150, rng.integers(1, 7)):
                text[p] = f"n{rng.integers(0, 20)}"
        yield " ".join(text)


def test_near_dedup_second_round_makes_few_pairs_of_a_large_group(spark, monkeypatch):
    """Near copies changed in places of their own meet in the shingles they have in common, not all with all; no link is lost."""
    rows, found = list(enumerate(near_copies("words", 400, np.random.default_rng(5)))), []
    possible = near_dedup.possible
    monkeypatch.setattr(near_dedup, "possible", lambda *a: found.append(common.written(possible(*a), "pairs")) or found[-1])
    got = near_dedup.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(repr((r.doc_id, r.class_id)) for r in got) == exact_classes(rows)
    assert 0 < found[0].count() < 10 * len(rows)


def test_near_dedup_second_round_equals_brute_force_on_kinds_of_copies(spark):
    rng = np.random.default_rng(6)
    rows = list(enumerate(t for kind in ("words", "cut", "versions", "places") for t in near_copies(kind, 90, rng)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for least, bands, per in ((0.8, 26, 5), (0.5, 80, 2)):
        got = near_dedup.classes(df, least=least, bands=bands, rows=per).collect()
        assert sorted(repr((r.doc_id, r.class_id)) for r in got) == exact_classes(rows, least)


def test_dart_signatures_agree_as_often_as_sets_are_alike():
    k, rng = 4096, np.random.default_rng(0)
    a = rng.integers(0, 2**63, 300).astype(np.uint64)
    h, row = np.concatenate([a[:240], a[60:]]), np.repeat([0, 1], 240)
    sig = near_dedup.darts(h, row, np.ones(480), 2, k)
    assert (sig[0] == sig[1]).mean() == pytest.approx(180 / 300, abs=0.03) and (sig != 0).all()
    w = np.concatenate([np.full(240, 1.0), np.full(240, 2.5)])
    sig = near_dedup.darts(np.concatenate([a[:240], a[:240]]), row, w, 2, k)
    assert (sig[0] == sig[1]).mean() == pytest.approx(1 / 2.5, abs=0.03)


# 5
def test_mixing_equals_sql(spark, odd_dir):
    assert rows_of(registry.QUERIES["op5_mixing"](spark, odd_dir)) == by_duckdb(mixing.OP5_SQL, documents=odd_dir + "/documents.parquet/*.parquet")


def test_mixing_comes_near_its_targets(spark, sf):
    path = sf.replace("sf0.001", "sf0.01")
    out = registry.QUERIES["op5_mixing"](spark, path).join(spark.read.parquet(f"{path}/documents.parquet").select("doc_id", "source"), "doc_id")
    for r in out.groupBy("source").agg(F.sum("taken").alias("t"), F.first("target").alias("g"), F.max("size").alias("m")).collect():
        assert abs(r.t - r.g) <= r.m
    assert out.where("taken > 3 * size").count() == 0


def test_mixed_repeats_rows(odd):
    out = mixing.mixed(odd)
    assert out.columns == odd.columns
    assert out.count() == mixing.mix(odd).agg(F.sum("_mix_copies")).first()[0]


# 6
def test_token_files_round_trip(spark, odd, odd_dir, tmp_path):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(tokens.default_path())
    rows = sorted(docs_of(odd), key=lambda r: (r[0] is None, r[0] or 0))
    got = token_files.read(spark, token_files.write(odd, str(tmp_path / "t"))).orderBy("start").collect()
    assert [r.doc_id for r in got] == [r[0] for r in rows]
    at = 0
    for r in got:
        assert r.start == at
        at += r.n_tokens
    want = collections.Counter((d, (np.array(tok.encode(t or "", add_special_tokens=False).ids + [2], "<u4").tobytes())) for d, t in rows)
    assert collections.Counter((r.doc_id, bytes(r.ids)) for r in got) == want
    assert registry.QUERIES["op6_token_files"](spark, odd_dir).count() == len(rows)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet=st.characters(codec="utf-8"), max_size=40), max_size=5))
def test_word_ids_equal_the_library(texts):
    ids_of = tokens.word_ids(tokens.default_path())
    ids, lens = ids_of.encode(texts, 2)
    want = [ids_of.tok.encode(t, add_special_tokens=False).ids + [2] for t in texts]
    assert lens.tolist() == list(map(len, want)) and ids.tolist() == [x for w in want for x in w]


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_other_tokenizer_files_give_the_library_s_ids(spark, odd, tmp_path, name):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path(name)
    tok = Tokenizer.from_file(path)
    want = collections.Counter(np.array(tok.encode(t or "", add_special_tokens=False).ids + [2], "<u4").tobytes() for _, t in docs_of(odd))
    got = token_files.read(spark, token_files.write(odd, str(tmp_path / "t"), path))
    assert collections.Counter(bytes(r.ids) for r in got.collect()) == want
    assert packing.pack(odd, path).agg(F.sum("length")).first()[0] == sum(len(raw) // 4 * n for raw, n in want.items())
    assert tokens.is_plain(path) == (name == "word_bpe_49k.json")


def test_full_word_table_still_encodes():
    small = tokens.WordIds(tokens.default_path(), limit=8)
    texts = ["one two three four five six", "seven eight nine ten one two", "alpha beta gamma delta epsilon zeta eta theta"]
    for _ in range(3):
        ids, _ = small.encode(texts)
        assert ids.tolist() == [x for t in texts for x in small.tok.encode(t, add_special_tokens=False).ids]


@pytest.mark.parametrize("n", [1, 7, 300, 5000])
def test_rans_blocks_and_checkpoints(n):
    ids = np.minimum(np.random.default_rng(n).zipf(1.2, n), 40_000).astype(np.uint32)
    table = rans.Table.of(ids)
    blocks = rans.encode(ids, table, block=1024)
    again = rans.Table.load(table.dump())
    assert (rans.decode(blocks, again) == ids).all()
    per = blocks[0]["steps"] * rans.LANES
    for k, mark in enumerate(blocks[-1]["marks"]):
        own = ids[(len(blocks) - 1) * per + mark[0] * rans.LANES :]
        assert (rans.decode(blocks[-1:], again, mark=k).reshape(-1)[: len(own)] == own).all()
    with pytest.raises(ValueError):
        rans.decode([{**blocks[0], "crc": blocks[0]["crc"] ^ 1}, *blocks[1:]], again)


# 7
def test_licenses_equal_sql(spark, sf, odd_dir):
    rng = np.random.default_rng(2)
    words = ["lorem", "ipsum", "dolor", "sit", "amet"]
    fill = lambda k: " ".join(rng.choice(words, k))
    mit = licenses.TEMPLATES["MIT notice"].split()
    rows = [(1, fill(40) + " " + " ".join(mit) + " " + fill(9)), (2, " ".join(mit[:20])), (3, "RELEASED under the MIT, License!"), (4, None), (5, "a b"), (5, "released under the mit license"), (6, " ".join(w for i, w in enumerate(mit) if i != 30))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    path = odd_dir + "-licenses"
    df.write.mode("overwrite").parquet(path + "/documents.parquet")
    assert rows_of(registry.QUERIES["op7_license_scan"](spark, path)) == by_duckdb(licenses.OP7_SQL, documents=path + "/documents.parquet/*.parquet")
    assert {r.doc_id for r in licenses.scan(df).collect()} == {1, 3, 5, 6}
    assert licenses.scan(df, templates={}).count() == 0
    none = spark.createDataFrame([(None, "x " + licenses.TEMPLATES["MIT line"]), (None, licenses.TEMPLATES["MIT line"]), (None, licenses.TEMPLATES["MIT line"]), (None, licenses.TEMPLATES["GPL-3.0 line"])], "doc_id long, text string")
    assert licenses.scan(none).count() == 3  # texts of no id are kept apart, repeated rows are one
    table = spark.createDataFrame([("a", licenses.TEMPLATES["MIT notice"]), ("a", None), ("b", ""), (None, "x")], "license string, text string")
    assert {r.doc_id for r in licenses.scan(df, table).collect()} == {1, 6}
    plan = licenses.scan(df)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan


def test_licenses_whole_texts_are_found_and_others_left_alone(spark, odd_dir, monkeypatch):
    names = sorted(licenses.TEMPLATES)
    rows = [(k, f"Copyright (c) 20{k:02d} somebody\n\n" + licenses.TEMPLATES[n].upper().replace(" ", "\n  ")) for k, n in enumerate(names)]
    rows += [(100 + k, " ".join(licenses.TEMPLATES[n].split()[::2])) for k, n in enumerate(names)]  # every second word: no shingle
    path = odd_dir + "-license-texts"
    spark.createDataFrame(rows, "doc_id long, text string").write.mode("overwrite").parquet(path + "/documents.parquet")
    got = rows_of(registry.QUERIES["op7_license_scan"](spark, path))
    assert got == by_duckdb(licenses.OP7_SQL, documents=path + "/documents.parquet/*.parquet")
    found = {(r.doc_id, r.license): r.containment for r in registry.QUERIES["op7_license_scan"](spark, path).collect()}
    assert all(found[k, n] == 1.0 for k, n in enumerate(names)) and max(k for k, _ in found) < 100
    monkeypatch.setattr(common, "FEW_ROWS", 20)  # the windows are more, and joined by a shuffle
    monkeypatch.setattr(licenses, "BROADCAST_SHINGLES", 0)
    assert rows_of(registry.QUERIES["op7_license_scan"](spark, path)) == got


@pytest.mark.parametrize("name", ["Apache-2.0 notice", "MIT notice"])
def test_licenses_with_a_passage_inside_are_found_at_every_offset(spark, name):
    text = licenses.TEMPLATES[name].split()
    rows = [(k, " ".join(f"w{x}" for x in range(k)) + " " + " ".join(text[: len(text) // 2] + [f"v{x}" for x in range(30)] + text[len(text) // 2 :])) for k in range(70)]
    found = licenses.scan(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r.doc_id for r in found.where(F.col("license") == name).collect()} == set(range(70))


# 8
def exact_top(rows, every, k):
    held = []
    for i, v in rows:
        if i is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        held.append((i, [math.floor(256 * float(np.float32(x))) for x in v]))
    out = []
    for a, (i, v) in enumerate(held):
        if i % every == 0:
            scores = sorted((-sum(x * y for x, y in zip(v, w)), j) for j, w in held if j != i)[:k]
            out += [(i, n + 1, j, -s) for n, (s, j) in enumerate(scores)]
    return sorted(out)


@pytest.mark.parametrize("spread", [0.0, 1.5])
def test_topk_equals_brute_force(spark, spread):
    rng = np.random.default_rng(4)
    rows = [(i, (rng.standard_normal(12) * np.exp(spread * rng.standard_normal())).astype(np.float32).tolist()) for i in range(600)]
    rows += [(700, [float("nan")] * 12), (701, None), (702, [None] + [1.0] * 11), (None, [1.0] * 12), (750, []), (703, rows[3][1]), (704, rows[3][1]), (705, [float("inf")] * 12), (800, [0.0] * 12)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = sorted(tuple(r) for r in topk.top_k(df, F.col("vec_id") % 50 == 0).collect())
    assert got == exact_top(rows, 50, 5)
    assert sorted(tuple(r) for r in topk.top_k(df, F.col("vec_id") % 50 == 0, most=60).collect()) == exact_top(rows, 50, 5)  # in slices
    few = spark.createDataFrame(rows[:3], "vec_id long, embedding array<float>")
    assert sorted(tuple(r) for r in topk.top_k(few, F.col("vec_id") % 50 == 0).collect()) == exact_top(rows[:3], 50, 5)


@pytest.mark.parametrize("floors", [-1e9, 0.35, 0.9])
def test_topk_prunes_without_loss(floors):
    rng = np.random.default_rng(6)
    c = rng.integers(-200, 200, (300, 20))
    q = c[:10] + rng.integers(-20, 20, (10, 20))
    norm = lambda m: np.sqrt((m.astype(float) ** 2).sum(axis=1))
    floor = np.floor(floors * norm(q) * norm(c).max()).astype(np.int64) if floors > 0 else np.full(10, topk.LEAST)
    search = topk.Search(np.arange(10) + 1000, q, floor, 5)
    order = np.argsort(-norm(c))
    for own in (order[:90], order[90:200], order[200:]):  # floors rise from bucket to bucket
        search.meet(own, c[own], norm(c)[own])
    got = {(1000 + int(i), int(j), int(s)) for i, j, s in zip(*search.best)}
    want = set()
    for i in range(10):
        s = q[i] @ c.T
        want |= {(1000 + i, j, s[j]) for j in sorted(range(300), key=lambda j: (-s[j], j))[:5] if s[j] >= floor[i]}
    assert got == want


# 9
def test_packing_is_exact_and_without_padding(spark, odd):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(tokens.default_path())
    pieces = packing.pack(odd).collect()
    want = collections.Counter((d, np.array(tok.encode(t or "", add_special_tokens=False).ids + [2], "<u4").tobytes()) for d, t in docs_of(odd))
    assert sum(r.length for r in pieces) == sum(len(raw) // 4 * n for (_, raw), n in want.items())
    by_seq = collections.defaultdict(list)
    for r in pieces:
        by_seq[r.sequence_id].append(r)
        assert r.length > 0 and len(r.ids) == 4 * r.length
    for own in by_seq.values():
        own.sort(key=lambda r: r.offset)
        assert own[0].offset == 0 and all(b.offset == a.offset + a.length for a, b in zip(own, own[1:]))
        total = sum(r.length for r in own)
        assert total == 4096 or total < 4096 and total & (total - 1) == 0
    ids = {d for d, _ in want if d is not None and sum(n for (x, _), n in want.items() if x == d) == 1}
    for d in ids:
        own = sorted((r for r in pieces if r.doc_id == d), key=lambda r: r.start)
        assert b"".join(bytes(r.ids) for r in own) == next(raw for x, raw in want if x == d)


def test_nnls_is_nonnegative_and_fits():
    rng = np.random.default_rng(0)
    a, x = rng.random((30, 50)), np.maximum(rng.standard_normal(50), 0)
    got = packing.nnls(a, a @ x)
    assert (got >= 0).all() and np.abs(a @ got - a @ x).max() < 1e-4


# 10
def test_media_round_trip(spark, odd, odd_dir):
    want = collections.Counter((d, *media.brute(t).values()) for d, t in docs_of(odd))
    out = registry.QUERIES["op10_media_columns"](spark, odd_dir).collect()
    assert collections.Counter((r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in out) == want
    assert [r.payload_sha256 for r in media.features(media.images(odd, "bmp")).select(F.sha2("payload", 256).alias("payload_sha256")).orderBy("payload_sha256").collect()] == sorted(r.payload_sha256 for r in out)


def test_image_codecs():
    rng = np.random.default_rng(0)
    rgb = rng.integers(0, 256, (5, 7, 3), dtype=np.uint8)
    grey = rng.integers(0, 256, (4, 9), dtype=np.uint8)
    assert (media.decode(media.to_ppm(rgb)) == rgb).all() and (media.decode(media.to_ppm(grey)) == grey).all() and (media.decode(media.to_bmp(rgb)) == rgb).all()
    text = b"P3\n# a remark\n7 5\n255\n" + b" ".join(str(x).encode() for x in rgb.ravel())
    assert (media.decode(text) == rgb).all()
    assert (media.decode(b"P1\n3 2\n1 0 1\n010") == [[0, 255, 0], [255, 0, 255]]).all()
    assert (media.decode(b"P4\n3 2\n" + bytes([0b10100000, 0b01000000])) == [[0, 255, 0], [255, 0, 255]]).all()
    with pytest.raises(ValueError):
        media.decode(b"GIF89a")


def test_bad_images_give_null_and_the_reason(spark):
    rgb = np.arange(60, dtype=np.uint8).reshape(4, 5, 3)
    bad = [None, b"", b"BM", media.to_bmp(rgb)[:60], media.to_ppm(rgb)[:-1], b"P6\n0 0\n255\n", b"P6\n3 3\n0\n", b"P5\n2 2\n255", b"P4\n9 2\n\x00", b"P1\n2 2\n1 0", b"BM" + bytes(60), b"GIF89a"]
    rows = [(i, 0, raw) for i, raw in enumerate([*bad, media.to_bmp(rgb), media.to_ppm(rgb)])]
    out = {r.doc_id: r for r in media.features(spark.createDataFrame(rows, "doc_id long, n_bytes long, media binary")).collect()}
    for i in range(len(bad)):
        assert out[i].error and out[i].payload is None and out[i].tile is None and out[i].dhash is None
    good = [out[len(bad)], out[len(bad) + 1]]
    assert all(r.error is None and bytes(r.payload) == rgb.tobytes() and np.load(io.BytesIO(r.tile)).shape == (16, 16) for r in good) and good[0].dhash == good[1].dhash


def test_area_resize_is_the_mean_of_areas():
    grey = np.arange(24, dtype=float).reshape(4, 6)
    assert np.allclose(media.resized(grey, 2, 3), grey.reshape(2, 2, 3, 2).mean(axis=(1, 3)))
    assert np.allclose(media.resized(grey, 7, 5).mean(), grey.mean())


# shared
@settings(max_examples=80, deadline=None)
@given(st.lists(st.text(alphabet="ab \t\n\x1c é", max_size=12), min_size=1, max_size=6))
def test_word_spans_equal_the_pattern(texts):
    import pyarrow as pa

    got = []
    for _, data, offsets in hashing.texts_of(pa.array(texts, pa.string())):
        begin, end, edges = hashing.word_spans(data, offsets)
        got += [[bytes(data[b:e]).decode() for b, e in zip(begin[edges[i] : edges[i + 1]], end[edges[i] : edges[i + 1]])] for i in range(len(offsets) - 1)]
    assert got == [WORDS.findall(t) for t in texts]


def test_digest_helpers():
    assert media.brute(None)["payload_sha256"] == hashlib.sha256(b" " * 192).hexdigest()
    assert quality.statistics(None) == quality.statistics("")
