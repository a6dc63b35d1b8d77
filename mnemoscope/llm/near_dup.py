"""Near-duplicate classes by consistent weighted sampling over TF-IDF shingles.

Texts are sets of ``SHINGLE``-word runs (letters and digits, ASCII case folded),
weighted (1 + ln tf) * idf with idf = 1 + ln((1+N)/(1+df)) / ln(1+N), between 1
(in every document) and 2.  Document frequencies cover all documents; they come
from a count-min sketch of fixed size (``DF_ROWS`` rows of 2**``DF_BITS`` cells),
merged over all partitions, so what is broadcast is 8 MB whatever the input.

Improved consistent weighted sampling (Ioffe 2010) draws ``BANDS * ROWS`` samples
from each text; two texts draw the same sample with a probability equal to their
weighted Jaccard similarity.  ``PLAIN_BANDS * ROWS`` MinHash samples of the same
shingles, all of weight 1, do so for the plain one, which a repeated line or a
common template leaves high where the weighted one falls.  ``ROWS`` samples make a
band.  With 16 bands of 5 of either kind, a pair of which either similarity is 0.8
shares a band with probability 0.998 at least, one of 0.9 always.

Texts in one bucket of a band are candidates.  Copies are first reduced to one
numbered row for each distinct text, and the texts of one document are linked.  In each
bucket every text is compared with the least and the largest number, not with every other; verified links (below) are closed to
components.  Where texts that met the same least number are still in several
components, for instance those that share a common passage, the rest is done by
prefix filtering, which loses no pair: a text's shingles are ordered from the
rarest among these texts to the most frequent, and two texts of similarity
``SIMILARITY`` share a shingle in their first fifth (by weight, or by number for the
plain measure).  A passage that many texts share is frequent, so it is in no prefix.
Texts of different components that share a prefix shingle held by at most ``FEW``
texts are compared pair by pair.  Those that hold a more frequent one, whose texts
are nearly all template, are compared in full with those of the same kind
that met the same least number: blocks of about ``BLOCK`` texts are indexed by shingle, and
each text outside the leader's component is looked up in every block.  So each two
texts that share a bucket end in one component, or have been compared, or can't
be similar.

A pair is linked if its exact weighted Jaccard similarity, or the plain Jaccard
similarity of its shingle sets, is ``SIMILARITY`` or more.  Members are compared with
a leader in runs of at most ``SALT`` rows; a leader of thousands is many tasks.

Edge cases: null texts read as empty; texts without words are copies of equal
texts only.  Rows of one doc_id are one document; if their texts differ, they are
one class.  A text of fewer than ``SHINGLE`` words is one
shingle.  Rows of equal text are one class, whatever their number.  A null
doc_id takes a negative number made from its text, which also serves as class id
if it is the least.  Ties don't matter: a similarity of exactly ``SIMILARITY`` links, and what is linked does not depend on the order of rows.  Very long texts are
compared whole.  An empty table gives an empty table.  Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.graph import components
from . import text as tx
from .session import prepare, shuffles_freed, unused_names

SHINGLE = 5
SIMILARITY = 0.8
BANDS, PLAIN_BANDS, ROWS = 16, 16, 5
DF_BITS, DF_ROWS = 20, 2
DF_BLOCK_BITS = 12
SALT, BLOCK, FEW = 64, 512, 32
_POOL_BITS = 14
_SEEDS = tx.mix(np.arange(1, BANDS * ROWS + DF_ROWS + 2, dtype=tx.U64) * tx.U64(0xA0761D6478BD642F))
_PLAIN_SEEDS = tx.mix(np.arange(1, PLAIN_BANDS * ROWS // 2 + 1, dtype=tx.U64) * tx.U64(0x8EBC6AF09C88C6E3))


def _pool() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """r and ln c with r, c ~ Gamma(2, 1) and beta uniform; a hash picks an entry."""
    u = (tx.mix(np.arange(1, (5 << _POOL_BITS) + 1, dtype=tx.U64) * tx.U64(0xE7037ED1A0B428DB)) >> tx.U64(11)).astype(np.float64) / 2**53
    u = np.maximum(u, 1e-12).reshape(5, -1)
    r, c = -np.log(u[0] * u[1]), -np.log(u[2] * u[3])
    return r.astype(np.float32), np.log(c).astype(np.float32), u[4].astype(np.float32)


_R, _LN_C, _BETA = _pool()
_INV_R = (1 / _R).astype(np.float32)


def _df_cells(value: np.ndarray, row: int) -> np.ndarray:
    return (tx.mix(value ^ _SEEDS[-1 - row]) >> tx.U64(64 - DF_BITS)).astype(np.int64)


def _count_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The partition's sketch of document frequencies, in blocks of cells that have a count (all, if no place is named); block -1 counts documents."""
    counts, docs = np.zeros((DF_ROWS, 1 << DF_BITS), np.uint32), 0
    for batch in batches:
        for _, piece in tx.slices(batch):
            row, value, _ = tx.distinct_in_row(*tx.Words(piece, tx.FOLDED).shingles(SHINGLE))
            docs += int(np.count_nonzero(np.bincount(row, minlength=1)))
            for r in range(DF_ROWS):
                counts[r] += np.bincount(_df_cells(value, r), minlength=1 << DF_BITS).astype(np.uint32)
    if docs:
        yield _cells([-1], [np.zeros(0, np.uint16)], [np.array([docs], np.uint32)])
        flat = counts.reshape(-1, 1 << DF_BLOCK_BITS)
        held = [np.flatnonzero(x) for x in flat]
        full = [3 * len(x) > 2 * flat.shape[1] for x in held]  # then places would take more than the zeros
        at = [k for k, x in enumerate(held) if len(x)]
        yield _cells(at, [held[k][: 0 if full[k] else None].astype(np.uint16) for k in at], [flat[k] if full[k] else flat[k][held[k]] for k in at])


def _cells(block: list[int], place: list[np.ndarray], counts: list[np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(block, pa.int64()), *(pa.array([x.tobytes() for x in y], pa.binary()) for y in (place, counts))], names=["block", "place", "counts"])


def _merge_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    totals: dict[int, np.ndarray] = {}
    for batch in batches:
        for block, place, counts in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
            more = np.frombuffer(counts.as_buffer(), np.uint32)
            if block not in totals:
                totals[block] = np.zeros(1 if block < 0 else 1 << DF_BLOCK_BITS, np.int64)
            where = np.frombuffer(place.as_buffer(), np.uint16)
            totals[block][where if len(where) else slice(None)] += more
    if totals:
        yield pa.RecordBatch.from_arrays([pa.array(list(totals), pa.int64()), pa.array([x.tobytes() for x in totals.values()], pa.binary())], names=["block", "counts"])


class Idf:
    """idf of a shingle by its cells; the least count of its cells is the estimate, so the largest idf."""

    def __init__(self, counts: np.ndarray, docs: int):
        self.table = (1 + np.log((1 + docs) / (1 + np.minimum(counts, docs))) / np.log(1 + max(docs, 1))).astype(np.float32)

    def __call__(self, value: np.ndarray) -> np.ndarray:
        out = self.table[0, _df_cells(value, 0)]
        for row in range(1, DF_ROWS):
            out = np.maximum(out, self.table[row, _df_cells(value, row)])
        return out


def document_frequencies(docs: DataFrame) -> Idf:
    """A count-min sketch of shingle document frequencies over all of ``docs`` (text)."""
    merged = docs.select("text").mapInArrow(_count_parts, "block long, place binary, counts binary").repartition("block").mapInArrow(_merge_counts, "block long, counts binary")
    counts, n = np.zeros(DF_ROWS << DF_BITS, np.int64), 0
    for block, part in merged.collect():  # 16 MB at any size
        if block < 0:
            n = int(np.frombuffer(part, np.int64)[0])
        else:
            counts[block << DF_BLOCK_BITS : (block + 1) << DF_BLOCK_BITS] = np.frombuffer(part, np.int64)
    return Idf(counts.reshape(DF_ROWS, -1), n)


def weighted(piece: tx.Slice, idf: Idf) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, shingle, weight), sorted by row and shingle."""
    row, value, times = tx.distinct_in_row(*tx.Words(piece, tx.FOLDED).shingles(SHINGLE))
    return row, value, ((1 + np.log(times.astype(np.float32))) * idf(value)).astype(np.float32)


def band_keys(row: np.ndarray, value: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rows that have shingles, their keys [rows, BANDS + PLAIN_BANDS]): weighted samples, then plain ones."""
    have, start = np.unique(row, return_index=True)
    if not len(have):
        return have, np.zeros((0, BANDS + PLAIN_BANDS), tx.U64)
    sizes = np.diff(np.append(start, len(row)))
    owner = np.repeat(np.arange(len(have)), sizes)
    log_w = np.log(weight)
    keys = np.zeros((len(have), BANDS + PLAIN_BANDS), tx.U64)
    with np.errstate(over="ignore"):
        for band in range(BANDS):
            key = np.full(len(have), band + 1, tx.U64)
            for k in range(band * ROWS, (band + 1) * ROWS):
                pick = ((value * (_SEEDS[k] | tx.U64(1))) >> tx.U64(64 - _POOL_BITS)).astype(np.int32)
                r, beta = _R[pick], _BETA[pick]
                t = np.floor(log_w * _INV_R[pick] + beta)
                a = _LN_C[pick] - r * (t - beta + 1)
                least = np.minimum.reduceat(a, start)
                at = np.flatnonzero(a == least[owner])
                first = at[np.searchsorted(owner[at], np.arange(len(have)))]
                sample = value[first] ^ (t[first].astype(np.int64).astype(tx.U64) * tx.U64(0x9E3779B97F4A7C15))
                key = tx.mix(key * tx.U64(0x100000001B3) ^ tx.mix(sample ^ _SEEDS[k]))
            keys[:, band] = key
        # Each half of a mixed hash is a sample.
        halves = [np.minimum.reduceat(half, start) for seed in _PLAIN_SEEDS for h in (tx.mix(value ^ seed),) for half in (h >> tx.U64(32), h & tx.U64(0xFFFFFFFF))]
        for band in range(PLAIN_BANDS):
            key = np.full(len(have), BANDS + band + 1, tx.U64)
            for least in halves[band * ROWS : (band + 1) * ROWS]:
                key = tx.mix(key * tx.U64(0x100000001B3) ^ least)
            keys[:, BANDS + band] = key
    return have, keys


def _sign(shared):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        idf = shared.value
        for batch in batches:
            for part, piece in tx.slices(batch):
                have, keys = band_keys(*weighted(piece, idf))
                offsets = np.zeros(len(piece) + 1, np.int32)
                offsets[have + 1] = keys.shape[1]
                bands = pa.ListArray.from_arrays(pa.array(np.cumsum(offsets, dtype=np.int32)), pa.array(tx.signed(keys.reshape(-1))))
                yield pa.RecordBatch.from_arrays([part.column("doc"), part.column("c1"), part.column("c2"), bands], names=["doc", "c1", "c2", "bands"])

    return rows


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """The larger of weighted and plain Jaccard of two (sorted shingles, weights)."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    if not len(i):
        return 0.0
    low = float(np.minimum(a[1][i], b[1][j]).sum(dtype=np.float64))
    total = float(a[1].sum(dtype=np.float64) + b[1].sum(dtype=np.float64))
    return max(low / (total - low), len(i) / (len(a[0]) + len(b[0]) - len(i)))


def _verify(shared, threshold: float):
    """Rows come sorted by (lead, salt, is_member): each leader stands before its members."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        idf, lead, own = shared.value, None, None
        for batch in batches:
            for part, piece in tx.slices(batch):
                row, value, weight = weighted(piece, idf)
                cuts = np.searchsorted(row, np.arange(len(piece) + 1))
                leads, nodes = part.column("lead").to_pylist(), part.column("node").to_pylist()
                found = []
                for i, (k, node) in enumerate(zip(leads, nodes, strict=True)):
                    have = value[cuts[i] : cuts[i + 1]], weight[cuts[i] : cuts[i + 1]]
                    if k == node:
                        lead, own = k, have
                    elif lead == k and similarity(own, have) >= threshold:
                        found.append((k, node))
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.int64())], names=["a", "b"])

    return rows


class _Block:
    """Shingles of the texts of one block, to look other texts up in."""

    def __init__(self):
        self.nodes, self.labels, self.values, self.weights = [], [], [], []
        self.sorted = False

    def add(self, node: int, label: int, value: np.ndarray, weight: np.ndarray) -> None:
        self.nodes.append(node)
        self.labels.append(label)
        self.values.append(value)
        self.weights.append(weight)

    def close(self) -> None:
        sizes = [len(x) for x in self.values]
        self.size = np.array(sizes)
        self.total = np.array([x.sum(dtype=np.float64) for x in self.weights])
        self.node, self.label = np.array(self.nodes), np.array(self.labels)
        value = np.concatenate(self.values)
        order = np.argsort(value, kind="stable")
        self.value, self.weight, self.owner = value[order], np.concatenate(self.weights)[order], np.repeat(np.arange(len(sizes)), sizes)[order]
        self.sorted = True

    def similar(self, label: int, value: np.ndarray, weight: np.ndarray, threshold: float) -> list[int]:
        if not self.nodes or not len(value):
            return []
        if not self.sorted:
            self.close()
        low, high = np.searchsorted(self.value, value, "left"), np.searchsorted(self.value, value, "right")
        times = high - low
        at = np.repeat(low - np.append(0, np.cumsum(times)[:-1]), times) + np.arange(times.sum())
        owner = self.owner[at]
        common = np.bincount(owner, minlength=len(self.node))
        least = np.bincount(owner, np.minimum(self.weight[at], np.repeat(weight, times)), minlength=len(self.node))
        plain = common / (self.size + len(value) - common)
        heavy = least / (self.total + weight.sum(dtype=np.float64) - least)
        return self.node[(np.maximum(plain, heavy) >= threshold) & (self.label != label)].tolist()


def _look_up(shared, threshold: float):
    """Rows come sorted by (lead, block, is_query): the block's texts stand before those looked up in it."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        idf, key, block = shared.value, None, _Block()
        for batch in batches:
            for part, piece in tx.slices(batch):
                row, value, weight = weighted(piece, idf)
                cuts = np.searchsorted(row, np.arange(len(piece) + 1))
                found = []
                fields = (part.column(x).to_pylist() for x in ("lead", "block", "query", "node", "label"))
                for i, (lead, number, query, node, label) in enumerate(zip(*fields, strict=True)):
                    if key != (lead, number):
                        key, block = (lead, number), _Block()
                    have = value[cuts[i] : cuts[i + 1]], weight[cuts[i] : cuts[i + 1]]
                    if query:
                        found += [(node, other) for other in block.similar(label, *have, threshold)]
                    else:
                        block.add(node, label, *have)
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.int64())], names=["a", "b"])

    return rows


def _prefixes(frequency, shared, threshold: float):
    """A row for each shingle in a text's prefix, for the weighted and the plain measure together."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rarity, idf = frequency.value, shared.value
        for batch in batches:
            for part, piece in tx.slices(batch):
                row, value, weight = weighted(piece, idf)
                if not len(row):
                    continue
                order = np.lexsort((value, -rarity(value), row))
                row, value, weight = row[order], value[order], weight[order].astype(np.float64)
                first = np.searchsorted(row, np.arange(len(piece) + 1))
                size, upto = np.diff(first), np.append(0.0, np.cumsum(weight))
                total = np.diff(upto[first])
                # What begins here and later still weighs enough for a link; a little slack for rounding.
                rest = total[row] - (upto[:-1] - upto[first[row]])
                after = size[row] - (np.arange(len(row)) - first[row])
                keep = (rest >= threshold * total[row] * (1 - 1e-5)) | (after >= threshold * size[row] * (1 - 1e-9))
                take = pa.array(row[keep])
                yield pa.RecordBatch.from_arrays([pa.array(tx.signed(value[keep])), part.column("node").take(take), part.column("label").take(take)], names=["shingle", "node", "label"])

    return rows


def links_between_components(texts: DataFrame, met: DataFrame, labels: DataFrame, shared, threshold: float) -> DataFrame:
    """Links between texts in different components among those that ``met`` (lead, node) the same leader."""
    spark = texts.sparkSession
    label = labels.select(F.col("node").alias("n"), "label")
    at = met.union(met.select("lead", F.col("lead").alias("node")).distinct()).join(label, F.col("node") == F.col("n"), "left").select("lead", "node", F.coalesce("label", "node").alias("label"))
    # Counted on the map side, before the leader's row meets those of its texts.
    own = F.max(F.when(F.col("node") == F.col("lead"), F.col("label"))).alias("own")
    groups = at.groupBy("lead").agg(F.min("label").alias("l0"), F.max("label").alias("l1"), own).where("l0 < l1").select("lead", "own").checkpoint()
    # Written, so that the joins below have a shuffle of their own on either side and a hot leader's rows can be split.
    at = at.join(groups, "lead").checkpoint()
    strays = texts.join(at.select("node", "label").distinct(), "node").select("node", "label", "text").checkpoint()
    if strays.isEmpty():
        return spark.createDataFrame([], "a long, b long")
    frequency = spark.sparkContext.broadcast(document_frequencies(strays))  # 8 MB, as the other
    prefixes = strays.mapInArrow(_prefixes(frequency, shared, threshold), "shingle long, node long, label long").checkpoint()
    common = prefixes.groupBy("shingle").agg(F.count(F.lit(1)).alias("n"), F.min("label").alias("l0"), F.max("label").alias("l1")).where("l0 < l1").select("shingle", "n").checkpoint()
    in_few = prefixes.join(common.where(F.col("n") <= FEW), "shingle")
    other = in_few.select("shingle", F.col("node").alias("lead"), F.col("label").alias("lead_label"))
    pairs = in_few.join(other, "shingle").where("lead < node and lead_label <> label").select("lead", "node").distinct().checkpoint()
    links = verified(texts, pairs, shared, threshold)
    # Texts with a prefix shingle that many others have.
    hot = prefixes.join(common.where(F.col("n") > FEW).select("shingle"), "shingle", "left_semi").select("node").distinct()
    hot = at.join(hot, "node", "left_semi").checkpoint()
    if hot.isEmpty():
        return links
    blocks = hot.groupBy("lead").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"), F.min("label").alias("l0"), F.max("label").alias("l1")).where("l0 < l1").select("lead", "blocks").checkpoint()
    hot = hot.join(blocks, "lead")
    held = hot.select("lead", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int").alias("block"), F.lit(0).alias("query"), "node", "label")
    asked = hot.where("label <> own").select("lead", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(1).alias("query"), "node", "label")
    looked_up = (
        texts.join(held.union(asked), "node")
        .select("lead", "block", "query", "node", "label", "text")
        .repartition("lead", "block")
        .sortWithinPartitions("lead", "block", "query")
        .mapInArrow(_look_up(shared, threshold), "a long, b long")
    )
    return links.union(looked_up)


def verified(texts: DataFrame, pairs: DataFrame, shared, threshold: float) -> DataFrame:
    """The linked ones of ``pairs`` (lead, node); ``texts`` has (node, text) once for each node."""
    # Written, for the same reason as the groups above.
    counts = pairs.groupBy("lead").agg(F.ceil(F.count(F.lit(1)) / SALT).cast("int").alias("salts")).checkpoint()
    members = pairs.join(counts, "lead").select("lead", F.pmod(F.xxhash64("node"), F.col("salts")).cast("int").alias("salt"), "node")
    leaders = counts.select("lead", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.col("lead").alias("node"))
    return (
        texts.join(members.unionByName(leaders), "node")
        .select("lead", "salt", "node", "text")
        .repartition("lead", "salt")
        .sortWithinPartitions("lead", "salt", (F.col("lead") != F.col("node")).cast("int"))
        .mapInArrow(_verify(shared, threshold), "a long, b long")
    )


def near_duplicate_classes(docs: DataFrame, *, threshold: float = SIMILARITY) -> DataFrame:
    """(doc_id, node, class_id, content hash c1 and c2) for each row of ``docs`` (doc_id, text).

    ``node`` is doc_id, or a negative stand-in for a null; ``class_id`` is the least node of the class.
    """
    prepare(docs.sparkSession)
    with shuffles_freed(docs.sparkSession):
        return _classes(docs, threshold)


def _classes(docs: DataFrame, threshold: float) -> DataFrame:
    spark = docs.sparkSession
    body = F.coalesce("text", F.lit(""))
    docs = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), body.alias("text"), F.xxhash64(body).alias("c1"), F.xxhash64(F.lit(1), body).alias("c2"),
        F.coalesce(F.col("doc_id").cast("long"), -1 - F.shiftrightunsigned(F.xxhash64(F.lit(2), body), 2)).alias("node"),
    )
    shared = spark.sparkContext.broadcast(document_frequencies(docs))
    signed = docs.select(F.col("node").alias("doc"), "c1", "c2", "text").mapInArrow(_sign(shared), "doc long, c1 long, c2 long, bands array<long>").checkpoint()
    # One row for each distinct text, numbered; all copies and all documents with this text stand behind it.
    texts = (
        signed.groupBy("c1", "c2").agg(F.min(F.struct("doc", "bands")).alias("x"), F.count(F.lit(1)).alias("copies"))
        .select(F.monotonically_increasing_id().alias("node"), "c1", "c2", "x.doc", "copies", "x.bands").checkpoint()
    )
    buckets = texts.select("node", F.explode("bands").alias("key"))
    # Only buckets of two texts or more, with the two leaders of each.
    shared_keys = buckets.groupBy("key").agg(F.min("node").alias("low"), F.max("node").alias("high")).where("low < high")
    members = buckets.join(shared_keys, "key").checkpoint()
    pairs = (
        members.select(F.col("low").alias("lead"), "node").where("lead <> node")
        .union(members.select(F.col("high").alias("lead"), "node").where("lead <> node and node <> low"))
        .distinct().checkpoint()
    )
    # Texts that share a bucket, once; both verification steps read them.
    wanted = texts.join(members.select("node").distinct(), "node").select("node", "c1", "c2", F.col("doc").alias("d"), "copies")
    rows = docs.select("node", "c1", "c2", "text").withColumnRenamed("node", "d").join(wanted, ["c1", "c2", "d"]).select("node", "copies", "text")
    # A row can only be repeated if its text is.
    own_text = rows.where("copies = 1").select("node", "text").union(rows.where("copies > 1").select("node", "text").dropDuplicates(["node"])).checkpoint()
    links = verified(own_text, pairs, shared, threshold).union(_texts_of_one_document(signed, texts))
    labels = components(links)
    met = members.select(F.col("low").alias("lead"), "node").where("lead <> node").distinct()
    extra = links_between_components(own_text, met, labels, shared, threshold).checkpoint()
    if not extra.isEmpty():
        labels = components(labels.select(F.col("node").alias("a"), F.col("label").alias("b")).union(extra))
    classed = texts.select("c1", "c2", "node", "doc").join(labels, "node", "left").select("c1", "c2", "doc", F.coalesce("label", "node").alias("label"))
    least = classed.groupBy("label").agg(F.min("doc").alias("class_id"))
    classes = classed.join(least, "label").select("c1", "c2", "class_id")
    return docs.select("doc_id", "node", "c1", "c2").join(classes, ["c1", "c2"]).select("doc_id", "node", "class_id", "c1", "c2")


def _texts_of_one_document(signed: DataFrame, texts: DataFrame) -> DataFrame:
    """Links (a, b) between the texts of a document that has several."""
    each = signed.groupBy("doc").agg(F.min(F.struct("c1", "c2")).alias("low"), F.max(F.struct("c1", "c2")).alias("high")).where("low <> high")
    held = signed.join(each, "doc").select("low.c1", "low.c2", F.col("c1").alias("m1"), F.col("c2").alias("m2")).where("c1 <> m1 or c2 <> m2").distinct()
    name = texts.select("c1", "c2", F.col("node").alias("a"))
    return held.join(name, ["c1", "c2"]).join(texts.select(F.col("c1").alias("m1"), F.col("c2").alias("m2"), F.col("node").alias("b")), ["m1", "m2"]).select("a", "b")


def keep_one(docs: DataFrame, *, threshold: float = SIMILARITY) -> DataFrame:
    """``docs`` with one row of each class, that of the least id; all columns stay.

    Of repeated rows (equal id) one stays, that with the least content hash.
    """
    # One content for each kept document, so that rows which repeat its id with other texts fall away.
    classes = near_duplicate_classes(docs, threshold=threshold).where("node = class_id").groupBy("node").agg(F.min(F.struct("c1", "c2")).alias("c"), F.count(F.lit(1)).alias("n"))
    with shuffles_freed(docs.sparkSession):
        classes = classes.checkpoint()
    key, keeper, again, c1, c2, b1, b2 = unused_names(docs, "key", "keeper", "again", "c1", "c2", "b1", "b2")
    keepers = classes.select(F.col("node").alias(keeper), (F.col("n") > 1).alias(again), F.col("c.c1").alias(c1), F.col("c.c2").alias(c2))
    body = F.coalesce("text", F.lit(""))
    node = F.coalesce(F.col("doc_id").cast("long"), -1 - F.shiftrightunsigned(F.xxhash64(F.lit(2), body), 2))
    named = docs.withColumns({key: node, b1: F.xxhash64(body), b2: F.xxhash64(F.lit(1), body)})
    kept = named.join(keepers, (F.col(key) == F.col(keeper)) & (F.col(b1) == F.col(c1)) & (F.col(b2) == F.col(c2)))
    if classes.where("n > 1").isEmpty():
        return kept.select(*docs.columns)
    # Equal rows of a kept document: one of them, found with a row for each task before any meet.
    return kept.where(~F.col(again)).select(*docs.columns).unionByName(kept.where(again).dropDuplicates([key]).select(*docs.columns))
