"""Token-ID files: range-coded ids of all documents in ascending doc_id order.

Texts are range-partitioned by (doc_id, hash of the text) and sorted; each task
tokenizes its shard once and codes it in groups of about two million ids.  A
group is one row of the file: a static frequency table of its ids that its
independent interleaved blocks share (``rans``), and the lengths of its
documents.  So memory is bounded by a group, nothing waits for a pass over the
corpus, and the only shuffle is the ordering of the texts.  ``manifest`` has the
ids of each shard; a shard's start is the sum of those before it.

Defined cases: a null text is an empty one (its ids are the end id alone); a
null doc_id sorts last; equal doc_ids sort by the text's hash, then by the text;
an empty table gives a file without rows; columns other than doc_id and text are
never read.
"""

from __future__ import annotations

import json
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import hashing, rans, tokens
from .common import documents, new_path

GROUP = 8 * rans.BLOCK
BLOCK_T = "struct<n:int,steps:int,words:binary,marks:array<struct<step:int,at:int,states:binary>>,crc:long>"
GROUP_T = f"shard int, group int, start long, n_ids long, doc_ids array<long>, doc_lens array<int>, table binary, blocks array<{BLOCK_T}>"
ARROW_BLOCK = pa.struct([("n", pa.int32()), ("steps", pa.int32()), ("words", pa.binary()), ("marks", pa.list_(pa.struct([("step", pa.int32()), ("at", pa.int32()), ("states", pa.binary())]))), ("crc", pa.int64())])
ARROW_GROUP = pa.schema([("shard", pa.int32()), ("group", pa.int32()), ("start", pa.int64()), ("n_ids", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("doc_lens", pa.list_(pa.int32())), ("table", pa.binary()), ("blocks", pa.list_(ARROW_BLOCK))])
READ = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])


def coded(path: str, end_id: int, group: int = GROUP):
    """The task: sorted (doc_id, text) batches to groups of coded ids.  A group closes after the first document that fills it."""

    def run(batches):
        ids_of, shard, k, start = tokens.word_ids(path), TaskContext.get().partitionId(), 0, 0
        held: list[tuple[list, np.ndarray, np.ndarray]] = []  # ids of documents, their token ids, their lengths
        size = 0

        def close():
            ids = np.concatenate([h[1] for h in held])
            table = rans.Table.of(ids)
            blocks = [{**b, "marks": [dict(zip(("step", "at", "states"), m)) for m in b["marks"]]} for b in rans.encode(ids, table)]
            row = {"shard": shard, "group": k, "start": start, "n_ids": len(ids), "doc_ids": [d for h in held for d in h[0]], "doc_lens": np.concatenate([h[2] for h in held]).tolist(), "table": table.dump(), "blocks": blocks}
            return pa.RecordBatch.from_pylist([row], ARROW_GROUP), len(ids)

        for batch in batches:
            doc_ids = batch.column(0).to_pylist()
            for first, data, offsets in hashing.texts_of(batch.column(1)):
                ids, lens = ids_of.encode_bytes(data, offsets, end_id)
                held.append((doc_ids[first : first + len(lens)], ids, lens))
                size += len(ids)
                if size >= group:
                    out, n = close()
                    yield out
                    k, start, held, size = k + 1, start + n, [], 0
        if held:
            yield close()[0]

    return run


def write(docs: DataFrame, path: str, tokenizer: str | None = None, end_id: int = 2) -> str:
    """Codes ``docs`` (doc_id, text) into ``path`` and returns it."""
    text = F.coalesce(F.col("text"), F.lit(""))
    at = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")).withColumn("h", F.xxhash64("text"))
    by = [F.col("doc_id").asc_nulls_last(), F.col("h")]
    ordered = at.repartitionByRange(*by).sortWithinPartitions(*by, "text").select("doc_id", "text")
    ordered.mapInArrow(coded(tokenizer or tokens.default_path(), end_id), GROUP_T).write.option("compression", "none").parquet(path)
    return path


def manifest(groups: DataFrame) -> dict[int, int]:
    """First id of each shard.  One number for each shard (partition of the write): bounded by the partitions, not the documents."""
    total, starts = 0, {}
    for shard, n in sorted(tuple(r) for r in groups.groupBy("shard").agg(F.sum("n_ids")).collect()):
        starts[shard], total = total, total + n
    return starts


def read(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids) from the files; ids: little-endian unsigned 32-bit integers."""
    groups = spark.read.schema(GROUP_T).parquet(path)
    bases = json.dumps({str(k): v for k, v in manifest(groups).items()})

    def run(batches):
        base = {int(k): v for k, v in json.loads(bases).items()}
        for batch in batches:
            for i in range(batch.num_rows):
                g = batch.slice(i, 1).to_pylist()[0]
                blocks = [{**b, "marks": [(m["step"], m["at"], m["states"]) for m in b["marks"]]} for b in g["blocks"]]
                ids = rans.decode(blocks, rans.Table.load(g["table"])).astype("<u4")
                ends = np.concatenate([[0], np.cumsum(np.array(g["doc_lens"], np.int64))])
                raw = pa.Array.from_buffers(pa.large_binary(), len(ends) - 1, [None, pa.py_buffer(ends * 4), pa.py_buffer(ids)])
                for a in range(0, len(ends) - 1, 2000):
                    own = slice(a, min(a + 2000, len(ends) - 1))
                    yield pa.record_batch([pa.array(g["doc_ids"][own], pa.int64()), pa.array(ends[own] + g["start"] + base[g["shard"]]), pa.array(np.array(g["doc_lens"][own], np.int64)), raw[own].cast(pa.binary())], schema=READ)

    return groups.mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary")


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes the ids of all documents and returns doc_id, start, n_tokens, ids_crc32 from the files."""
    path = write(documents(spark, sf_dir), new_path(spark, "token-files"))
    return read(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def crc_of_ids(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())
