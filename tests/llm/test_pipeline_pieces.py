"""The pipeline's last stage: pieces of all documents, whole and without gaps."""

import collections

import corpus_pipeline


def test_packed_pieces_hold_every_document_once_for_each_time_it_was_taken(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    again = docs.union(docs.where("doc_id % 3 = 0"))  # as the mix repeats documents
    rows = corpus_pipeline.STAGES[-1][1](spark, again, sf).collect()
    sequences, held = collections.defaultdict(list), collections.Counter()
    tokens = {}
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length))
        held[r.doc_id] += r.length
        assert tokens.setdefault(r.doc_id, r.doc_tokens) == r.doc_tokens and 0 < r.length <= 4096
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 4096
    times = collections.Counter(r.doc_id for r in again.select("doc_id").collect())
    assert held == {d: n * tokens[d] for d, n in times.items()}
    used = sum(held.values())
    assert used >= 0.98 * sum(4096 if sum(p[1] for p in s) > 2048 else sum(p[1] for p in s) for s in sequences.values())
