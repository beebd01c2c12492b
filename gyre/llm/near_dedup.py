"""Near-duplicate classes by DartMinHash signatures, banded joining and exact verification.

A text's shingles (five words, ASCII letters lower-cased) are elements; an element's
weight is its number of times in the text (``weighting="unit"``: 1).  Every element owns a plane of
weight and rank on which hashed darts fall as a Poisson process of density one; an
element of weight w keeps the darts under w.  A set of total weight W looks at ranks
up to (k log k + 2 k) / W, where about k log k + 2 k darts lie, whatever its size;
each dart belongs to one of k coordinates, and the earliest of a coordinate is its
value (sets that leave a coordinate open look at twice the rank again).  Two sets
agree in a coordinate with the probability of their weighted Jaccard similarity.
26 bands of 5 coordinates let a pair of similarity 0.8 pass with 0.99997.

Equal texts are one text.  In a band's bucket every text is held against the
bucket's first one, its most central, not against all; the links that hold make
classes (a centre's shingles are sent once to each task that has members of its
bucket), and only pairs of a bucket that are in different classes after that are
verified in a second round, if they meet in a shingle that the first has not and
counts don't rule them out (see ``possible``).  So a bucket of n copies costs about n verifications, and no link
between different classes is lost.  Verification is the exact weighted Jaccard similarity
(least over greatest counts) on 64-bit shingle hashes.  Classes come from
label propagation with pointer jumping over written tables.

Defined cases: a null text is an empty one; texts without a word are alike only if
equal; fewer than five words make one shingle; null doc_ids are rows of their own,
and a class of them alone has a null id; repeated rows are copies; an empty table
gives no rows; other columns are not read by ``classes``, and ``deduplicated`` passes
them on whatever their names.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import hashing
from .common import documents, dropped, few, written

BANDS, ROWS, SHINGLE, LEAST = 26, 5, 5, 0.8
#: Texts that take part in a pair are broadcast as (hash, id) up to so many rows (some 100 MB); beyond, their join shuffles.
BROADCAST_ROWS = 1_000_000


def weighted(h: np.ndarray, row: np.ndarray, weighting: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (row, element) and their weights."""
    order = np.lexsort((h, row))
    h, row = h[order], row[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    at = np.flatnonzero(new)
    w = np.diff(np.append(at, len(h))) if weighting == "count" else np.ones(len(at), np.int64)
    return h[at], row[at], w.astype(np.float64)


def uniform(x: np.ndarray) -> np.ndarray:
    return ((x >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


def darts(h: np.ndarray, row: np.ndarray, weight: np.ndarray, rows: int, k: int) -> np.ndarray:
    """Signatures (rows x k, uint64) of weighted sets; rows without an element are zero."""
    total = np.bincount(row, weights=weight, minlength=rows)
    reach = (k * np.log(k) + 2 * k) / np.maximum(total, 1e-300)
    out = np.zeros((rows, k), np.uint64)
    open_rows = total > 0
    while open_rows.any():
        own = np.flatnonzero(open_rows[row])
        # One strip of the plane for each whole unit of weight; a dart's weight lies within its strip.
        strips = np.maximum(1, np.ceil(weight[own])).astype(np.int64)
        e = np.repeat(own, strips)
        level = np.arange(len(e)) - np.repeat(np.cumsum(strips) - strips, strips)
        state = hashing.mix(h[e] + level.astype(np.uint64) * np.uint64(hashing.P), 1)
        rank = -np.log1p(-uniform(state))
        found = []
        while len(e):
            near = rank <= reach[row[e]]
            e, level, state, rank = e[near], level[near], state[near], rank[near]
            if not len(e):
                break
            mark = hashing.mix(state, 2)
            hit = level + uniform(hashing.mix(mark, 3)) <= weight[e]
            found.append((row[e[hit]], (mark[hit] % np.uint64(k)).astype(np.int64), rank[hit], mark[hit]))
            state = hashing.mix(state, 4)
            rank = rank - np.log1p(-uniform(state))
        r, j, rank, mark = (np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64),) * 4
        cell = r * k + j
        order = np.lexsort((rank, cell))
        cell, mark = cell[order], mark[order]
        first = np.ones(len(cell), bool)
        first[1:] = cell[1:] != cell[:-1]
        flat = out.reshape(-1)
        flat[cell[first]] = mark[first]
        full = np.bincount(cell[first] // k, minlength=rows) == k
        open_rows &= ~full
        reach = np.where(open_rows, reach * 2, reach)
    return out


def bands_of(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """(texts x bands) keys, int64."""
    parts = signature.reshape(len(signature), bands, rows)
    key = np.zeros(parts.shape[:2], np.uint64) + np.arange(bands, dtype=np.uint64)
    for i in range(rows):
        key = hashing.mix(key * np.uint64(hashing.P) + parts[:, :, i], 5)
    return key.view(np.int64)


def shingled(data: np.ndarray, offsets: np.ndarray, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    begin, end, edges = hashing.word_spans(data, offsets)
    return hashing.shingle_hashes(hashing.span_hashes(hashing.FOLD[data], begin, end), edges, size)


def lists(values: np.ndarray, lens: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lens)]).astype(np.int32)), pa.array(values))


def signatures(docs: DataFrame, bands: int, rows: int, weighting: str) -> DataFrame:
    """(doc_id, h, bands): h names the text; bands is empty for texts without a word."""

    def run(batches):
        for batch in batches:
            for first, data, offsets in hashing.texts_of(batch.column(2)):
                n = len(offsets) - 1
                h, row, w = weighted(*shingled(data, offsets), weighting)
                keys = bands_of(darts(h, row, w, n, bands * rows), bands, rows)
                some = np.bincount(row, minlength=n) > 0
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, n), batch.column(1).slice(first, n), lists(keys[some].ravel(), some * bands)], names=["doc_id", "h", "bands"])

    return keyed(docs).mapInArrow(run, "doc_id long, h string, bands array<long>")


def keyed(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.sha2(text, 256).alias("h"), text.alias("text"))


def sets(docs: DataFrame, wanted: DataFrame, weighting: str) -> DataFrame:
    """(h, s): the sorted shingle hashes of the wanted texts (h, doc_id); of equal rows each gives one.  Counts are hashed in for weights."""
    n = wanted.count()
    small = F.broadcast if n <= BROADCAST_ROWS else lambda df: df
    own = keyed(docs).join(small(wanted.select(F.col("h").alias("wh"), F.col("doc_id").alias("wd"))), (F.col("h") == F.col("wh")) & F.col("doc_id").eqNullSafe(F.col("wd")), "left_semi")

    def run(batches):
        for batch in batches:
            for first, data, offsets in hashing.texts_of(batch.column(1)):
                h, row, w = weighted(*shingled(data, offsets), weighting)
                if weighting == "count":  # m times an element: m elements
                    times = w.astype(np.int64)
                    level = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
                    h, row, _ = weighted(hashing.mix(np.repeat(h, times) + level.astype(np.uint64) * np.uint64(hashing.P), 6), np.repeat(row, times), "unit")
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(offsets) - 1), lists(h.view(np.int64), np.bincount(row, minlength=len(offsets) - 1))], names=["h", "s"])

    return own.select("h", "text").mapInArrow(run, "h string, s array<long>")


def jaccard(pairs: DataFrame, held: DataFrame, cut: float) -> DataFrame:
    """(a, b, sim) of pairs of node numbers; held: (node, s), written.  Where sizes alone show that sim is under ``cut``, it is 0."""

    def run(batches):
        for batch in batches:
            a_s, b_s = batch.column(2), batch.column(3)
            ao, bo = a_s.offsets.to_numpy(), b_s.offsets.to_numpy()
            av, bv = a_s.values.to_numpy().view(np.uint64), b_s.values.to_numpy().view(np.uint64)
            sims = np.zeros(batch.num_rows)
            for i in range(batch.num_rows):
                x, y = av[ao[i] : ao[i + 1]], bv[bo[i] : bo[i + 1]]
                if min(len(x), len(y)) < cut * max(len(x), len(y)):
                    continue
                at = np.searchsorted(x, y)
                both = int(np.count_nonzero(x[np.minimum(at, len(x) - 1)] == y))
                sims[i] = both / (len(x) + len(y) - both)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sims)], names=["a", "b", "sim"])

    return beside(pairs, held).select("a", "b", "sa", "sb").mapInArrow(run, "a long, b long, sim double")


def beside(pairs: DataFrame, held: DataFrame) -> DataFrame:
    """Pairs (a, b, ...) with the shingles sa and sb of both."""
    # A centre of many pairs is dealt over all tasks by the other side's hash, and its shingles go once to each of them.
    tasks = F.lit(int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = pairs.withColumn("deal", F.pmod(F.xxhash64("b"), tasks))
    centres = dealt.select("a", "deal").distinct().join(held.select(F.col("node").alias("a"), F.col("s").alias("sa")), "a")
    members = dealt.join(held.select(F.col("node").alias("b"), F.col("s").alias("sb")), "b")
    return members.join(centres, ["a", "deal"])


def cut_of(least: float) -> float:
    """Under this similarity pairs need no exact value."""
    return least * 0.625


def components(links: DataFrame) -> DataFrame:
    """(node, label): label is the least node of the component, for the nodes of links (a, b)."""
    both = written(links.select("a", "b").union(links.select("b", "a")).distinct(), "near-links")
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.min("a")).alias("label")), "near-labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), F.col("label").alias("l")), "b").groupBy(F.col("a").alias("node")).agg(F.min("l").alias("l"))
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("j"))
        step = labels.join(near, "node").join(jump, "label", "left").select("node", F.least("label", "l", "j").alias("new"), "label")
        step = written(step, "near-labels")
        dropped(labels)
        changed = step.where("new < label").limit(1).count()
        labels = step.select("node", F.col("new").alias("label"))
        if not changed:
            return labels


def labelled(docs: DataFrame, least: float = LEAST, bands: int = BANDS, rows: int = ROWS, weighting: str = "count") -> tuple[DataFrame, DataFrame]:
    """((doc_id, h) of every row, (h, doc_id, label, links) of every text): texts of one class have one label; doc_id is the least of the text."""
    sig = written(signatures(docs, bands, rows, weighting), "near-signatures")
    texts = sig.groupBy("h").agg(F.min("doc_id").alias("doc_id"), F.first("bands").alias("bands"))
    # Texts are numbered in the order of their hashes, so two texts never share a number, and choices by number don't depend on partitions.
    nodes = written(texts.repartitionByRange("h").sortWithinPartitions("h").withColumn("node", F.monotonically_increasing_id()), "near-nodes")
    keys = written(nodes.select("node", F.explode("bands").alias("key")), "near-bands")
    sizes = written(keys.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "near-sizes")
    shared = written(keys.join(few(sizes), "key"), "near-shared")
    # A bucket's first text is the one that shares buckets with most others: copies of one text have that text for it.
    central = written(shared.groupBy("node").agg(F.sum("n").alias("c")), "near-central")
    firsts = shared.join(few(central), "node").groupBy("key").agg(F.min(F.struct((-F.col("c")).alias("c"), "node"))["node"].alias("first"))
    firsts = written(firsts, "near-firsts")
    buckets = written(shared.select("key", "node").join(few(firsts), "key"), "near-buckets")
    pairs = written(buckets.where("node <> first").select(F.col("first").alias("a"), F.col("node").alias("b")).distinct(), "near-pairs")
    wanted = nodes.join(buckets.select("node").distinct(), "node", "left_semi").select("node", "h", "doc_id")
    wanted = written(wanted, "near-wanted")
    held = written(wanted.select("node", "h").join(sets(docs, wanted, weighting).dropDuplicates(["h"]), "h").select("node", "s"), "near-sets")
    tested = written(jaccard(pairs, held, cut_of(least)), "near-tested")
    links = tested.where(F.col("sim") >= least)
    labels = components(links)
    # Second round: pairs of one bucket, but of different classes, that counts don't rule out.
    known = tested.select(F.col("a").alias("first"), F.col("b").alias("node"), "sim")
    at = buckets.join(known, ["first", "node"], "left").withColumn("sim", F.when(F.col("node") == F.col("first"), 1.0).otherwise(F.col("sim")))
    at = written(at.join(few(labels), "node", "left").withColumn("label", F.coalesce("label", "node")), "near-labelled")
    split = written(at.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low < high").select("key"), "near-split")
    at = written(at.join(few(split), "key"), "near-mixed")
    more = possible(at, held, least)
    more = more.select(F.least("xn", "yn").alias("a"), F.greatest("xn", "yn").alias("b")).distinct().join(pairs, ["a", "b"], "left_anti")
    more = written(more, "near-more")
    if more.limit(1).count():
        again = written(jaccard(more, held, cut_of(least)), "near-tested").where(F.col("sim") >= least)
        links = links.union(again)
        labels = components(links)
    degree = links.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count("*").alias("links"))
    named = nodes.select("h", "node", "doc_id").join(labels, "node", "left").join(degree, "node", "left")
    return sig.select("doc_id", "h"), named.select("h", "doc_id", F.coalesce("label", "node").alias("label"), F.coalesce("links", F.lit(0)).alias("links"))


def classes(docs: DataFrame, **how) -> DataFrame:
    """(doc_id, class_id, links): class_id is the least doc_id of the class; links, the verified links of the row's text."""
    sig, named = labelled(docs, **how)
    least_id = named.groupBy("label").agg(F.min("doc_id").alias("class_id"))
    named = written(named.join(least_id, "label").select("h", "class_id", "links"), "near-classes")
    return sig.join(named, "h").select("doc_id", "class_id", "links")


def possible(at: DataFrame, held: DataFrame, least: float) -> DataFrame:
    """Pairs (xn, yn) of texts with one first that may reach ``least``, one of them outside its first's class.

    at: (key, node, first, sim to the first, label); held: (node, s) of these nodes.
    Of A's shingles, i are the first's too and the others are its own.  A and B are
    similar only if they share t / (1 + t) (|A| + |B|), of which the first has
    min(i_A, i_B) at most, so they share the rest, m, of what is their own.  With each
    text's own shingles in one order, the rarest first, pairs are texts that meet in one
    and have enough left from there on; the last m - 1 of a text are not looked at.
    Texts that were changed in places of their own share none, however many they are.
    Where m may be 0, both lie in the first but for a fifth; they meet by size.
    """
    share = least / (1 + least)
    own = at.where("node <> first").select(F.col("first").alias("a"), F.col("node").alias("b"), "label", (F.col("sim") < least).alias("outer")).distinct()
    own = beside(own, held).select(F.col("a").alias("first"), F.col("b").alias("node"), "label", "outer", F.size("sb").alias("size"), F.array_except("sb", "sa").alias("own"))
    own = written(own.withColumn("i", F.col("size") - F.size("own")), "near-own")
    small = written(own.groupBy("first").agg(F.min("size").alias("small")), "near-small")
    # The least that a similar text has in common with this one.
    common = share * (F.col("size") + F.greatest(F.col("small"), least * F.col("size"))) - 1e-6
    facts = own.join(few(small), "first").withColumn("m", F.greatest(F.lit(1), F.ceil(common - F.col("i"))))
    facts = written(facts.select("first", "node", "label", "outer", "size", "i", "m", (F.col("i") >= common).alias("inside")), "near-facts")

    each = own.select("first", "node", "label", "outer", F.explode("own").alias("e"))
    # Shingles that an outer text shares with a text of another class; the others come first in everyone's order.
    met = each.groupBy("first", "e").agg(F.count("*").alias("n"), F.max("outer").alias("any"), F.min("label").alias("low"), F.max("label").alias("high"))
    met = written(each.select("first", "node", "e").join(met.where("any and low < high").select("first", "e", "n"), ["first", "e"]), "near-met")
    order = Window.partitionBy("first", "node").orderBy("n", "e")
    met = met.withColumn("left", F.count("*").over(Window.partitionBy("first", "node")) - F.row_number().over(order) + 1).withColumn("prev", F.lag("e").over(order))
    posted = written(met.drop("n").join(facts, ["first", "node"]).where("left >= m"), "near-posted")
    # Texts of similar sizes lie in one band or in neighbours.
    inside = written(facts.where("inside").select("*", F.lit(0).alias("left"), F.lit(None).cast("long").alias("prev"), F.floor(F.log("size") / (1e-9 - math.log(least))).alias("band")), "near-inside")

    def side(df: DataFrame, p: str, *by: str) -> DataFrame:
        return df.select(*by, *[F.col(c).alias(p + c) for c in ("node", "label", "size", "i", "left", "prev", "outer")])

    fits = (F.col("xlabel") != F.col("ylabel")) & (~F.col("youter") | (F.col("xnode") < F.col("ynode")))
    fits = fits & (F.least("xi", "yi") + F.least("xleft", "yleft") >= share * (F.col("xsize") + F.col("ysize")) - 1e-6)
    # Those that have the shingle before in common as well have met there.
    fits = fits & ~F.coalesce(F.col("xprev") == F.col("yprev"), F.lit(False))
    by = ["first", "e"]
    pairs = side(posted.where("outer"), "x", *by).join(side(posted, "y", *by), by).where(fits).select(F.col("xnode").alias("xn"), F.col("ynode").alias("yn"))
    by = ["first", "band"]
    near = inside.withColumn("band", F.explode(F.array(*[F.col("band") + k for k in (-1, 0, 1)])))
    return pairs.union(side(inside.where("outer"), "x", *by).join(side(near, "y", *by), by).where(fits).select("xnode", "ynode"))


def deduplicated(docs: DataFrame, **how) -> DataFrame:
    """One document of each class, with the columns of docs: the one of the least doc_id (nulls last), of several texts under it the one of the least hash; of rows that repeat it, one."""
    _, named = labelled(docs, **how)
    first = named.groupBy("label").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "h")).alias("k"))
    keep = written(first.select(F.col("k.doc_id").alias("_near_id"), F.col("k.h").alias("_near_h")), "near-kept")
    # Rows are chosen by id and text: an id may stand on texts of several classes, or be null.  Columns go by place, so that no name clashes.
    names = [f"c{i}" for i in range(len(docs.columns))]
    text, doc_id = (F.col(names[docs.columns.index(c)]) for c in ("text", "doc_id"))
    out = docs.toDF(*names).withColumn("_near_text", F.sha2(F.coalesce(text, F.lit("")), 256))
    out = out.join(keep, (F.col("_near_text") == F.col("_near_h")) & doc_id.cast("long").eqNullSafe(F.col("_near_id")), "left_semi")
    return out.dropDuplicates(["_near_text"]).select(*names).toDF(*docs.columns)


def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(documents(spark, sf_dir))
