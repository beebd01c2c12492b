"""The graph index, whitening and spelling variants against brute force."""

import collections
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from gyre.llm import ann, registry, spelling, whitening

VECTORS = "vec_id long, embedding array<double>, v string, ids string, x string, word string, label int"


def table(spark, rows):
    return spark.createDataFrame([(i, v, "a", "b", "c", "d", 1) for i, v in rows], VECTORS).repartition(3)


def odd_vectors():
    rng = np.random.default_rng(4)
    rows = [(i, [float(c) for c in rng.normal(size=6)]) for i in range(120)]
    same = rows[3][1]
    rows += [(i, same) for i in range(120, 190)]  # a third of all are one vector
    rows += [(40, rows[41][1]), (40, rows[40][1]), (41, rows[41][1]), (None, rows[1][1]), (200, None), (201, [0.0] * 6), (202, [1.0, None, 0.0]), (203, [float("nan")] * 6), (204, [float("inf")] * 6), (205, []), (206, [2.0, -1.0]), (220, [0.5])]
    return rows


def nearest(rows, k, every):
    dim = max(len(v) for _, v in rows if v)
    live = [(i, np.array(v + [0.0] * (dim - len(v)))) for i, v in rows if i is not None and v and all(c is not None and np.isfinite(c) for c in v) and any(v)]
    queries = {}
    for i, v in live:
        if i % every == 0 and (i not in queries or tuple(v) > tuple(queries[i])):
            queries[i] = v
    out = []
    for q, v in queries.items():
        best = sorted((-float((c * v).sum()), i) for i, c in live if i != q)[:k]
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(best)]
    return sorted(out)


# 11
def test_search_that_reaches_all_nodes_equals_brute_force(spark):
    rows = odd_vectors()
    for shard in (1000, 40):
        got = sorted(map(tuple, ann.neighbours(table(spark, rows), F.col("vec_id") % 20 == 0, 7, shard=shard, beam=200).collect()))
        want = nearest(rows, 7, 20)
        assert [g[:3] for g in got] == [w[:3] for w in want]
        assert np.allclose([g[3] for g in got], [w[3] for w in want], rtol=1e-12)


def test_recall_at_the_query_s_parameters(spark):
    sf = "/root/testdata/sf0.1"
    rows = spark.read.parquet(f"{sf}/embeddings.parquet")
    v = {r.vec_id: np.array(r.embedding, np.float64) for r in rows.collect()}
    ids, all_ = np.array(sorted(v)), np.stack([v[i] for i in sorted(v)])
    got = collections.defaultdict(list)
    for r in registry.QUERIES["op11_ann"](spark, sf).collect():
        got[r.query_id].append((r.rank, r.vec_id))
        assert abs(r.score - float(v[r.query_id] @ v[r.vec_id])) < 1e-12
    hits = 0
    for q in ids[ids % 20 == 0]:
        s = all_ @ v[q]
        order = [i for i in ids[np.lexsort((ids, -s))] if i != q][:20]
        assert [n for n, _ in sorted(got[q])] == list(range(1, 21))
        hits += len(set(order) & {i for _, i in got[q]})
    assert hits / (20 * (ids % 20 == 0).sum()) >= 0.98


def test_one_graph_reaches_nodes_of_unlike_lengths_and_near_copies():
    rng = np.random.default_rng(1)
    v = rng.normal(size=(3000, 12)) * rng.uniform(0.1, 5, size=(3000, 1))
    v[:1000] = v[0] + rng.normal(size=(1000, 12)) * 1e-3
    g = ann.Graph(v[rng.permutation(3000)])
    v = g.x[:, :-1].astype(np.float64)
    g.build()
    q = rng.normal(size=(200, 12))
    q /= np.linalg.norm(q, axis=1)[:, None]
    found = g.beam(np.hstack([q, np.zeros((200, 1))]).astype(np.float32), 96, 3000)[0]
    want = np.argsort(-(q @ v.T), axis=1)[:, :20]
    assert np.mean([len(set(a[:20]) & set(b)) for a, b in zip(found.tolist(), want.tolist())]) >= 18
    assert (g.near[:, ann.EDGES :] == -1).all()


# 12
def whitened(rows, k=8):
    live = [(i, v) for i, v in rows if v is not None and all(c is not None and np.isfinite(c) for c in v)]
    dim = max(len(v) for _, v in live)
    x = np.array([[int(np.floor(1024 * c)) + 100000 for c in v + [0.0] * (dim - len(v))] for _, v in live], dtype=object)
    n, s = len(x), x.sum(axis=0)
    d = (n * x - s).astype(np.float64) / n
    e, u = np.linalg.eigh(d.T @ d / n)
    return live, x, n, s, d, e[::-1][:k], u[:, ::-1][:, :k], e.sum()


@pytest.mark.parametrize("odd", [True, False])
def test_whitening_equals_brute_force(spark, sf, odd):
    if odd:
        rows = odd_vectors()
        got = whitening.whiten(table(spark, rows)).collect()
    else:
        rows = [(r.vec_id, list(map(float, r.embedding))) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
        got = registry.QUERIES["op12_whitening"](spark, sf).collect()
    live, x, n, s, d, e, u, trace = whitened(rows)
    k = len(e)
    assert len(got) == n * k and {r.n for r in got} == {n} and {r.component for r in got} == set(range(1, k + 1))
    want = collections.Counter((i, int(((n * row - s) ** 2).sum())) for (i, _), row in zip(live, x))
    assert collections.Counter((r.vec_id, r.deviation) for r in got if r.component == 1) == want
    error = {r.identity_error for r in got}
    assert len(error) == 1 and error.pop() <= 1e-9
    for j in range(k):
        mine = sorted(abs(r.whitened) for r in got if r.component == j + 1)
        assert np.allclose(mine, sorted(np.abs(d @ u[:, j]) / np.sqrt(e[j])), atol=1e-7)
        assert {round(r.explained / (e[j] / trace), 9) for r in got if r.component == j + 1} == {1.0}


def test_whitening_of_flat_and_huge_dimensions(spark):
    rows = [(1, [1.0, 3.0, 1e300]), (2, [2.0, 3.0, -1e300]), (3, [4.0, 3.0, 0.0])]
    got = whitening.whiten(table(spark, rows)).collect()
    assert len(got) == 9 and {r.deviation for r in got} == {None, *[r.deviation for r in got if r.vec_id == 3]}
    assert all(r.whitened is None for r in got if r.component == 3) and all(r.identity_error < 1e-6 for r in got)
    one = whitening.whiten(table(spark, [(1, [1.0, 2.0])])).collect()
    assert [(r.deviation, r.whitened, r.explained, r.identity_error) for r in one] == [(0, None, None, None)] * 2


# 13
def spelled(docs):
    count = collections.Counter()
    for i, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if h % 97 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            count[w] += 1
    words = {w: n for w, n in count.items() if len(w) >= 5 and n >= 3}
    near = collections.defaultdict(set)
    holes = collections.defaultdict(set)
    for w in words:
        for p in range(len(w)):
            holes[p, w[:p], w[p + 1 :]].add(w)
            if (v := w[:p] + w[p + 1 :]) in words:
                near[w].add(v)
                near[v].add(w)
    for group in holes.values():
        for w in group:
            near[w] |= group - {w}
    form = {}
    for w, n in words.items():
        if near[w] and words[best := min(near[w], key=lambda v: (-words[v], v))] >= 2 * n:
            form[w] = best
    out = []
    for w, n in words.items():
        root = w
        while root in form:
            root = form[root]
        out.append((w, form.get(w), root, n, len(near[w]), words[form[w]] if w in form else None))
    return sorted(out, key=repr)


def spelling_docs():
    rng = np.random.default_rng(2)
    letters = list("abcdeéÿ×")
    words = ["".join(rng.choice(letters, rng.integers(5, 9))) for _ in range(150)]
    for w in list(words):
        p = int(rng.integers(len(w)))
        words += [w[:p] + w[p + 1 :], w[:p] + str(rng.choice(letters)) + w[p:], w[:p] + str(rng.choice(letters)) + w[p + 1 :]]
    words += ["abcabcabcabc" + "".join(rng.choice(list("abc"), 6)) for _ in range(60)]  # many words under a choice
    words += ["q" * n for n in (5, 6, 7, 300, 301, 5000)] + ["Überßen", "überßen", "x" * 3000 + "y" + "x" * 3000, "x" * 6000]
    docs = [(i, " ".join(str(w).upper() if i % 7 == 0 else str(w) for w in rng.choice(words, 600))) for i in range(12)]
    docs += [(i, " ".join(sorted(set(words)))) for i in (20, 20, None)] + [(30, None), (31, ""), (None, "one-two don't 12 abcde_fghij"), (32, "abcde " * 500)]
    return docs


@pytest.mark.parametrize("most", [1000, 12, 2])
def test_spelling_equals_brute_force(spark, most):
    docs = spelling_docs()
    df = spark.createDataFrame([(i, t, "w", "k", 1) for i, t in docs], "doc_id long, text string, word string, key string, n int").repartition(3)
    want = spelled(docs)
    assert sum(r[1] is not None for r in want) > 50 and any(r[1] != r[2] for r in want if r[1])
    assert sorted(map(tuple, spelling.variants(df, most).collect()), key=repr) == want


def test_spelling_of_a_given_table(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert sorted(map(tuple, registry.QUERIES["op13_spelling"](spark, sf).collect()), key=repr) == spelled(docs)
