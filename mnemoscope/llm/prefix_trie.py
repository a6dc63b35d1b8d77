"""The prefix trie of conversations: what they share from the first turn on.

A node is a distinct sequence of first turns (role and text).  A turn is 16 bytes of
SHA-256, a conversation the string of its turns, its *path*; byte order of paths is
depth-first order of the trie.

1. Conversations of equal path become one row: their number, least id and the digest
   of their ids.  A path that very many have is cut to runs of ids first, in
   order, so that the one task which must digest them in order reads blocks of ids and not rows.
2. Paths are range-partitioned and sorted, so a task sees a stretch of the trie, which it
   cuts to shards of about ``SHARD`` nodes.  A shard is a string of balanced parentheses,
   one pair for each node.  Blocks of the string hold the least and largest excess (open minus
   closed), a tree over the blocks the same of its halves.  ``find_close`` skips blocks that
   can't hold the excess it looks for, and so finds where a node's subtree ends.  From there on a subtree is an interval:
   the rank of pairs "()" counts its leaves, differences of cumulative arrays its
   conversations and savings, a range minimum its least id.
3. Only prefixes of a shard's first or last path, its *spines*, can have nodes in other
   shards.  All other nodes are complete.  Spines go on as paths with, for each node, the sums of what hangs
   from it in its shard; step 2 runs on them again, and adds up equal nodes.  A shard of
   many thousand nodes leaves two paths, so a round or two are enough, and
   the last has one shard of at most ``SHARD`` nodes (or the nodes of ``LEAST_PATHS`` paths).
4. A complete node under a spine gets its parent's id by a join on (shard, parent), of which no key has more rows
   than a shard has nodes.

A conversation's turns are one row, of a digest and a number each, and no text; this is
the one thing that must fit in memory.

Edge cases: a null role or text reads as empty.  Rows without conv_id belong to no
conversation and are left out.  Turns of equal number are ordered by their digest, and repeated
rows are turns of their own.  A conversation may end up without turns; it is a member of the
root only.  Very long texts count whole.  Other columns are not read.  An empty table has no node.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .session import prepare

TURN = 16
SHARD, LEAST_PATHS = 1 << 16, 8
#: Characters of ids in a block that is digested at once.
ID_BLOCK = 1 << 16
BLOCK = 64
NONE = np.iinfo(np.int64).max
#: Conversations of a hundred are rebuilt on the first turns of its first one.
FAMILY, SHARED_TURNS = 100, 6

_NODE = "conv_id long, depth int, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string, key binary, parent_key binary"
_SPINE = "path binary, sizes array<int>, keys array<binary>, n array<long>, low array<long>, children array<long>, leaves array<long>, saved array<long>, ends array<string>"


def paths(conversations: DataFrame) -> DataFrame:
    """(conv_id, path, sizes) of ``conversations`` (conv_id, turn, role, text) as they are; sizes are code points of the turns' texts."""
    return _joined_turns(_turns(conversations).select("conv_id", F.col("own").alias("turns")))


def rebuilt_paths(conversations: DataFrame) -> DataFrame:
    """(conv_id, path, sizes), each conversation on the first turns of the first one of its hundred, as its number says."""
    own = _turns(conversations).checkpoint()
    first = own.select(F.col("conv_id").alias("first"), F.slice("own", 1, SHARED_TURNS - 1).alias("head"))
    taken = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % SHARED_TURNS).cast("int")
    both = own.join(first, F.col("conv_id") - F.col("conv_id") % FAMILY == F.col("first"), "left").withColumn("taken", taken)
    head = F.slice(F.coalesce("head", F.slice("own", 1, 0)), F.lit(1), F.col("taken"))
    return _joined_turns(both.select("conv_id", F.concat(head, F.slice("own", F.col("taken") + 1, F.size("own"))).alias("turns")))


def _turns(conversations: DataFrame) -> DataFrame:
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.substring(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256), 1, 2 * TURN)
    narrow = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), F.struct("turn", digest.alias("digest"), F.length(text).alias("size")).alias("turn"))
    return narrow.groupBy("conv_id").agg(F.sort_array(F.collect_list("turn")).alias("own"))


def _joined_turns(df: DataFrame) -> DataFrame:
    return df.select("conv_id", F.unhex(F.array_join(F.transform("turns", lambda x: x["digest"]), "")).alias("path"), F.transform("turns", lambda x: x["size"]).alias("sizes"))


def _id_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by path and id: a row for each run of ids of a path."""
    held, ids, size = None, [], 0
    out: list[tuple] = []

    def close() -> None:
        out.append((*held, ids[0], len(ids), ",".join(map(str, ids))))

    def send() -> pa.RecordBatch:
        sent = pa.RecordBatch.from_arrays(
            [pa.array(x, t) for x, t in zip(zip(*out, strict=True), (pa.int64(), pa.binary(), pa.list_(pa.int32()), pa.int64(), pa.int64(), pa.string()), strict=True)], names=["h", "path", "sizes", "low", "n", "ids"]
        )
        out.clear()
        return sent

    for batch in batches:
        for h, path, sizes, conv in zip(*(batch.column(c).to_pylist() for c in ("h", "path", "sizes", "conv_id")), strict=True):
            if held is None or held[1] != path or size > ID_BLOCK:
                if held is not None:
                    close()
                held, ids, size = (h, path, sizes), [], 0
            ids.append(conv)
            size += len(str(conv)) + 1
        if out:
            yield send()
    if held is not None:
        close()
        yield send()


def _digest_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by path and least id: one row for each path, with the digest of all its ids."""
    held, digest = None, None
    out: list[tuple] = []

    def send() -> pa.RecordBatch:
        sent = pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), (pa.binary(), pa.list_(pa.int32()), pa.int64(), pa.int64(), pa.string()), strict=True)], names=["path", "sizes", "n", "low", "ends"])
        out.clear()
        return sent

    for batch in batches:
        for path, sizes, low, n, ids in zip(*(batch.column(c).to_pylist() for c in ("path", "sizes", "low", "n", "ids")), strict=True):
            if held is not None and held[0] == path:
                held[2] += n
                digest.update(b"," + ids.encode())
                continue
            if held is not None:
                out.append((*held, digest.hexdigest()))
            held, digest = [path, sizes, n, low], hashlib.sha256(ids.encode())
        if out:
            yield send()
    if held is not None:
        out.append((*held, digest.hexdigest()))
        yield send()


def distinct_paths(rows: DataFrame) -> DataFrame:
    """(path, sizes, n, low, ends) of ``rows`` (conv_id, path, sizes): how many have a path, their least id and the digest of all."""
    hashed = rows.select(F.xxhash64("path").alias("h"), "path", "sizes", "conv_id").checkpoint()
    blocks = (
        hashed.repartitionByRange("h", "conv_id").sortWithinPartitions("h", "path", "conv_id")
        .mapInArrow(_id_blocks, "h long, path binary, sizes array<int>, low long, n long, ids string")
    )
    return blocks.repartition("h").sortWithinPartitions("h", "path", "low").drop("h").mapInArrow(_digest_ids, "path binary, sizes array<int>, n long, low long, ends string")


class Parentheses:
    """Balanced parentheses with the least and largest excess of blocks, and of the halves of a tree over them."""

    def __init__(self, bits: np.ndarray):
        self.bits, self.excess = bits, np.cumsum(2 * bits.astype(np.int32) - 1, dtype=np.int32)
        padded = np.full(-(-len(bits) // BLOCK) * BLOCK, self.excess[-1], np.int32)
        padded[: len(bits)] = self.excess
        self.blocks = padded.reshape(-1, BLOCK)
        self.levels = [(self.blocks.min(1), self.blocks.max(1))]
        while len(self.levels[-1][0]) > 1:
            low, high = self.levels[-1]
            if len(low) % 2:
                low, high = np.append(low, low[-1]), np.append(high, high[-1])
            self.levels.append((np.minimum(low[::2], low[1::2]), np.maximum(high[::2], high[1::2])))
        #: How many pairs "()" begin before each place.
        self.leaf = np.append(bits[:-1] & ~bits[1:], False) if len(bits) else bits

    def _holds(self, level: int, node: np.ndarray, wanted: np.ndarray) -> np.ndarray:
        """Whether the excess ``wanted`` is in the range of a node; excess moves by one, so a range holds all between its ends."""
        low, high = self.levels[level]
        inside = node < len(low)
        node = np.where(inside, node, 0)
        return inside & (low[node] <= wanted) & (wanted <= high[node])

    def find_close(self, opens: np.ndarray) -> np.ndarray:
        """The place that closes each open place: the next with an excess of one less than there."""
        wanted, out = self.excess[opens] - 1, np.full(len(opens), -1)
        # In the block of the open place.
        left = np.arange(len(opens))
        for step in range(1, BLOCK):
            at = opens[left] + step
            inside = at // BLOCK == opens[left] // BLOCK
            left, at = left[inside & (at < len(self.bits))], at[inside & (at < len(self.bits))]
            hit = self.excess[at] == wanted[left]
            out[left[hit]] = at[hit]
            left = left[~hit]
        # Up the tree to the first half on the right whose range holds it, then down to its first block.
        left = np.flatnonzero(out < 0)
        node, level_of = opens[left] // BLOCK, np.full(len(left), -1)
        for level in range(len(self.levels)):
            free = level_of < 0
            here = free & (node % 2 == 0) & self._holds(level, node + 1, wanted[left])
            node, level_of = np.where(here, node + 1, np.where(free, node // 2, node)), np.where(here, level, level_of)
        for level in range(len(self.levels) - 1, 0, -1):
            below = level_of == level
            first = self._holds(level - 1, 2 * node, wanted[left])
            node, level_of = np.where(below, np.where(first, 2 * node, 2 * node + 1), node), np.where(below, level - 1, level_of)
        for i in range(0, len(left), 1 << 14):
            part = slice(i, i + (1 << 14))
            out[left[part]] = node[part] * BLOCK + (self.blocks[node[part]] == wanted[left[part], None]).argmax(1)
        return out


def _range_min(values: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """The least of values[start:stop], none of them empty."""
    out, level, width = np.empty(len(start), np.int64), values, 1
    power = np.frexp((stop - start).astype(np.float64))[1] - 1
    for p in range(int(power.max(initial=0)) + 1):
        at = np.flatnonzero(power == p)
        out[at] = np.minimum(level[start[at]], level[stop[at] - width])
        level, width = np.minimum(level[: max(0, len(level) - width)], level[width:]), 2 * width
    return out


def _common(a: bytes, b: bytes) -> int:
    """How many turns two paths share from the start."""
    size = min(len(a), len(b))
    different = np.flatnonzero(np.frombuffer(a, np.uint8, size) != np.frombuffer(b, np.uint8, size))
    return (int(different[0]) if len(different) else size) // TURN


@dataclass
class _Path:
    """A path with what its nodes hold: from ``first`` on, for each depth."""

    path: bytes
    sizes: list[int]
    first: int
    n: list[int]
    low: list[int]
    children: list[int]
    leaves: list[int]
    saved: list[int]
    ends: list[str | None]


class _Shard:
    """Sorted paths, and the trie of them."""

    def __init__(self):
        self.rows: list[_Path] = []
        self.common: list[int] = []
        self.nodes = 1

    def add(self, row: _Path) -> None:
        common = _common(self.rows[-1].path, row.path) if self.rows else 0
        self.rows.append(row)
        self.common.append(common)
        self.nodes += len(row.path) // TURN - common

    def build(self) -> None:
        count = self.nodes
        depth, size, parent = np.zeros(count, np.int32), np.zeros(count, np.int64), np.full(count, -1)
        self.n, self.low = np.zeros(count, np.int64), np.full(count, NONE)
        children, leaves, saved = (np.zeros(count, np.int64) for _ in range(3))
        self.end: dict[int, str] = {}
        stack, new = [0], 1
        runs = [0, 1]  # closed, opened: the root opens first
        for row, common in zip(self.rows, self.common, strict=True):
            deep = len(row.path) // TURN
            runs += [len(stack) - 1 - common, deep - common]
            stop = new + deep - common
            if stop > new:
                depth[new:stop], size[new:stop], parent[new:stop] = np.arange(common + 1, deep + 1), row.sizes[common:], np.arange(new - 1, stop - 1)
                parent[new] = stack[common]
            stack[common + 1 :] = range(new, stop)
            new = stop
            at = np.array(stack[row.first :])
            self.n[at] += row.n
            self.low[at] = np.minimum(self.low[at], row.low)
            children[at] += row.children
            leaves[at] += row.leaves
            saved[at] += row.saved
            self.end.update((k, e) for k, e in zip(stack[row.first :], row.ends, strict=True) if e is not None)
        runs += [len(stack), 0]
        self.first_spine, self.last_spine = np.arange(len(self.rows[0].path) // TURN + 1), np.array(stack)
        string = Parentheses(np.repeat(np.tile([False, True], len(runs) // 2), runs))
        opens = np.flatnonzero(string.bits)
        node, stop = np.arange(count), np.arange(count) + (string.find_close(opens) - opens + 1) // 2
        within = lambda values: (total := np.append(0, np.cumsum(values)))[stop] - total[node]
        self.depth, self.parent = depth, parent
        self.own = {"n": self.n, "low": self.low, "children": children, "leaves": leaves, "saved": saved}
        self.n_all, self.low_all = within(self.n), _range_min(self.low, node, stop)
        # A pair "()" is a leaf unless children hang from it in other shards.
        self.leaves_all = within((string.leaf[opens] & (children == 0)) + leaves)
        self.saved_all = within((self.n_all - 1) * size + saved)
        self.children_all = children + np.bincount(parent[1:], minlength=count)

    def keys(self, row: _Path) -> list[bytes]:
        """A name for each prefix of a path."""
        out = [b""]
        for i in range(0, len(row.path), TURN):
            out.append(hashlib.blake2b(out[-1] + row.path[i : i + TURN], digest_size=TURN).digest())
        return out

    def complete(self, nodes: np.ndarray, keys: dict[int, bytes], open_nodes: np.ndarray, shard: int, named: bool) -> pa.RecordBatch:
        """Rows of ``nodes``; parents among ``open_nodes`` are given by name."""
        parent = self.parent[nodes]
        waits = (parent >= 0) & open_nodes[parent]
        known = pa.array(self.low_all[parent], pa.int64(), mask=waits | (parent < 0))
        own = [keys[k] if named else None for k in nodes.tolist()]
        above = [keys[p] if w else None for p, w in zip(parent.tolist(), waits.tolist(), strict=True)]
        columns = [
            pa.array(self.low_all[nodes]), pa.array(self.depth[nodes]), known, *(pa.array(x[nodes].astype(np.int64)) for x in (self.n_all, self.children_all, self.leaves_all, self.saved_all)),
            pa.array([self.end.get(k) for k in nodes.tolist()], pa.string()), pa.array(own, pa.binary()), pa.array(above, pa.binary()), pa.array(np.full(len(nodes), shard), pa.int64()),
        ]
        nothing = [pa.nulls(len(nodes), t) for t in _SPINE_TYPES]
        return pa.RecordBatch.from_arrays(columns + nothing, names=_NAMES)

    def spines(self, keys: dict[int, bytes], shard: int) -> pa.RecordBatch:
        """The first and the last path, with what hangs from their nodes in this shard alone."""
        count = len(self.depth)
        on = np.zeros(count, bool)
        on[self.first_spine] = on[self.last_spine] = True
        hangs = np.flatnonzero(~on & on[self.parent])  # the root has no parent, and is on both
        at = self.parent[hangs]
        held = {k: v.copy() for k, v in self.own.items()}
        for name, value in (("n", self.n_all), ("children", np.ones(count, np.int64)), ("leaves", self.leaves_all), ("saved", self.saved_all)):
            np.add.at(held[name], at, value[hangs])
        np.minimum.at(held["low"], at, self.low_all[hangs])
        rows = []
        for row, spine, given in ((self.rows[0], self.first_spine, 0), (self.rows[-1], self.last_spine, len(self.first_spine))):
            if spine[-1] < given:  # the last path is the first
                continue
            mine = spine >= given  # nodes on both are given once
            values = [np.where(mine, held[k][spine], NONE if k == "low" else 0).tolist() for k in ("n", "low", "children", "leaves", "saved")]
            rows.append((row.path, row.sizes, [keys[k] for k in spine.tolist()], *values, [self.end.get(k) if m else None for k, m in zip(spine.tolist(), mine.tolist(), strict=True)]))
        nothing = [pa.nulls(len(rows), t) for t in _NODE_TYPES]
        return pa.RecordBatch.from_arrays([*nothing, pa.array([shard] * len(rows), pa.int64()), *(pa.array(x, t) for x, t in zip(zip(*rows, strict=True), _SPINE_TYPES, strict=True))], names=_NAMES)

    def results(self, shard: int, *, last: bool, named: bool) -> Iterator[pa.RecordBatch]:
        self.build()
        on = np.zeros(len(self.depth), bool)
        keys: dict[int, bytes] = {}
        if named:
            stack: list[int] = [0]
            new = 1
            for row, common in zip(self.rows, self.common, strict=True):
                stop = new + len(row.path) // TURN - common
                stack[common + 1 :] = range(new, stop)
                new = stop
                keys.update(zip(stack, self.keys(row), strict=True))
        else:
            for row, spine in ((self.rows[0], self.first_spine), (self.rows[-1], self.last_spine)):
                keys.update(zip(spine.tolist(), self.keys(row), strict=True))
        if not last:
            on[self.first_spine] = on[self.last_spine] = True
            yield self.spines(keys, shard)
        nodes = np.flatnonzero(~on)
        for i in range(0, len(nodes), 10_000):
            yield self.complete(nodes[i : i + 10_000], keys, on, shard, named)


_NODE_TYPES = [pa.int64(), pa.int32(), *[pa.int64()] * 5, pa.string(), pa.binary(), pa.binary()]
_SPINE_TYPES = [pa.binary(), pa.list_(pa.int32()), pa.list_(pa.binary()), *[pa.list_(pa.int64())] * 5, pa.list_(pa.string())]
_NAMES = [x.split()[0] for x in f"{_NODE}, shard long, {_SPINE}".split(", ")]


def _tries(round_number: int, limit: int, *, last: bool = False):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, number = _Shard(), 0
        name = lambda: (round_number << 56) | (TaskContext.get().partitionId() << 24) | number
        for batch in batches:
            fields = {c: batch.column(c).to_pylist() for c in batch.schema.names}
            for i in range(batch.num_rows):
                row = {c: v[i] for c, v in fields.items()}
                if round_number:
                    shard.add(_Path(row["path"], row["sizes"], 0, *(row[c] for c in ("n", "low", "children", "leaves", "saved", "ends"))))
                else:
                    shard.add(_Path(row["path"], row["sizes"], len(row["sizes"]), [row["n"]], [row["low"]], [0], [0], [0], [row["ends"]]))
                if not last and shard.nodes >= limit and len(shard.rows) >= LEAST_PATHS:
                    yield from shard.results(name(), last=False, named=round_number > 0)
                    shard, number = _Shard(), number + 1
        if shard.rows:
            yield from shard.results(name(), last=last, named=round_number > 0)

    return rows


def trie(rows: DataFrame, *, shard: int = SHARD) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256) of every node of ``rows`` (conv_id, path, sizes; each conversation once)."""
    prepare(rows.sparkSession)
    schema = f"{_NODE}, shard long, {_SPINE}"
    found = distinct_paths(rows).checkpoint().repartitionByRange("path").sortWithinPartitions("path").mapInArrow(_tries(0, shard), schema).checkpoint()
    rounds, before = [found], None
    while True:
        spines = rounds[-1].where("path is not null").select([c.split()[0] for c in _SPINE.split(", ")])
        total, count = spines.agg(F.coalesce(F.sum(F.size("n")), F.lit(0)), F.count(F.lit(1))).first()
        if not count:
            break
        # Rounds halve the number of paths at least; one that doesn't has few, long ones, and is the last.
        last = total <= shard or (before is not None and 2 * count > before)
        dealt = spines.repartition(1) if last else spines.repartitionByRange(max(1, total // shard), "path")
        rounds.append(dealt.sortWithinPartitions("path").mapInArrow(_tries(len(rounds), shard, last=last), schema).checkpoint())
        if last:
            break
        before = count
    every = rounds[0]
    for x in rounds[1:]:
        every = every.unionByName(x)
    nodes = every.where("path is null")
    names = every.where("path is not null").select("shard", F.explode("keys").alias("k")).distinct()
    named = names.join(nodes.where("key is not null").select(F.col("key").alias("k"), F.col("conv_id").alias("above")), "k").select(F.col("shard").alias("s"), "k", "above")
    waiting = nodes.where("parent_key is not null").join(named, (F.col("shard") == F.col("s")) & (F.col("parent_key") == F.col("k")))
    columns = ["n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256")]
    depth = F.col("depth").cast("long").alias("depth")
    return nodes.where("parent_key is null").select("conv_id", depth, "parent_conv_id", *columns).union(waiting.select("conv_id", depth, F.col("above").alias("parent_conv_id"), *columns))
