"""Shards by a consistent-hash ring with virtual nodes and bounded loads."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tallyforge.llm.common import gapless_rank, materialize, pick, with_copy

#: A row's place in the order of arrival: 6 bits of size class (see ``_arrival``), then 57 bits of its hash.
CLASS_SHIFT = 57
#: Parts of one slice of arrivals that a pass over the keys counts, as a power of two.
STEP = 6
#: Keys of a slice that are played one by one.
EXACT = 10_000


class _Clockwise:
    """``[a]``: all shards, as they come clockwise from arc a. Made for one arc when it is asked for."""

    def __init__(self, owner: np.ndarray):
        self.owner = owner

    def __getitem__(self, arc: int) -> list[int]:
        return list(dict.fromkeys(np.roll(self.owner, -arc).tolist()))


class Ring:
    """Virtual nodes on a circle of ``cells`` places. ``owner[a]``: the shard of the node that ends arc a; ``owners[a]``: the shards clockwise from there."""

    def __init__(self, shards: int, vnodes: int = 128, seed: int = 42):
        self.shards, self.vnodes, self.seed = shards, vnodes, seed
        self.bits = max(8, (8 * shards * vnodes - 1).bit_length())  # the upper ones of a hash: a finer circle keeps the order of places
        self.cells = 1 << self.bits
        places: dict[int, int] = {}
        for s in range(shards):
            for v in range(vnodes):
                at = xxhash.xxh64_intdigest(f"{s}#{v}", seed=seed) >> (64 - self.bits)
                while at in places:
                    at = (at + 1) % self.cells
                places[at] = s
        nodes = np.array(sorted(places), np.int64)
        self.owner = np.array([places[n] for n in nodes.tolist()], np.int32)
        self.arc_of_cell = (np.searchsorted(nodes, np.arange(self.cells)) % len(nodes)).astype(np.int32)
        self.owners = _Clockwise(self.owner)

    def route(self, open_: np.ndarray) -> np.ndarray:
        """The first open shard clockwise from each arc: that of the next node whose shard is open."""
        nodes = np.flatnonzero(open_[self.owner])
        return self.owner[nodes[np.searchsorted(nodes, np.arange(len(self.owner))) % len(nodes)]]


def _arrival(size: Column, h: Column, small: int) -> Column:
    """Size classes are powers of two. Sizes over ``small`` bits come first, the largest before all; then the others, the smallest first.

    The last to come are those that leave their home, so what moves is few rows, and none of them too large to fit into the slack.
    """
    bits = F.length(F.bin(size))
    return F.shiftleft(F.when(bits > small, F.lit(63) - bits).otherwise(F.lit(62 - small) + bits).cast("long"), CLASS_SHIFT).bitwiseOR(F.shiftrightunsigned(h, 64 - CLASS_SHIFT))


class _Loads:
    """Plays the arrivals against the shards' capacities, slice by slice; notes from which arrival on each arc goes to which shard."""

    def __init__(self, keys: DataFrame, ring: Ring, total: int, slack: float, small: int):
        self.keys, self.ring, self.large = keys, ring, 63 - small
        self.mean = total / ring.shards
        self.even, self.tolerance = (1 + slack) * self.mean, slack / 2 * self.mean
        self.cap, self.last = self.even, -1
        self.load = np.zeros(ring.shards)
        self.open = np.ones(ring.shards, bool)
        self.now = ring.route(self.open)
        self.noted = self.now
        self.routes: list[list[tuple[int, int]]] = [[(0, s)] for s in self.now.tolist()]

    def _note(self, start: int) -> None:
        """Note, of the arcs that lead to another shard than before, that they do from this arrival on."""
        for arc in np.flatnonzero(self.now != self.noted).tolist():
            if self.routes[arc][-1][0] == start:
                self.routes[arc].pop()
            self.routes[arc].append((start, int(self.now[arc])))
        self.noted = self.now

    def _count(self, low: int, shift: int, within: int) -> list[tuple[int, np.ndarray, int]]:
        """(part, bytes by arc, keys) of the parts of 2**shift arrivals among the 2**within from low on."""
        at = self.keys if within == 63 else self.keys.where((F.col("t") >= low) & (F.col("t") < low + (1 << within)))
        rows = at.groupBy(F.shiftrightunsigned("t", shift).alias("part"), "arc").agg(F.sum("size").alias("size"), F.count("*").alias("n")).toArrow().to_pydict()
        parts: dict[int, tuple[np.ndarray, int]] = {}
        for part, arc, size, n in zip(rows["part"], rows["arc"], rows["size"], rows["n"], strict=True):
            sums, k = parts.get(part) or (np.zeros(len(self.ring.owner)), 0)
            sums[arc] += size
            parts[part] = sums, k + n
        return [(p, *parts[p]) for p in sorted(parts)]

    def play(self, low: int = 0, shift: int = CLASS_SHIFT, within: int = 63) -> list[list[tuple[int, int]]]:
        for part, sums, n in self._count(low, shift, within):
            if within == 63:
                if self.last < self.large:  # smaller rows may fit where larger ones didn't, and room made for those ends here
                    self.open[:], self.cap = True, self.even
                self.last = part
                self.now = self.ring.route(self.open)
                self._note(part << shift)
            self._take(part << shift, shift, sums, n)
        return self.routes

    def _take(self, start: int, shift: int, sums: np.ndarray, n: int) -> None:
        while True:
            more = np.bincount(self.now, weights=sums, minlength=self.ring.shards)
            full = (more > 0) & (self.load + more > self.cap)
            if not full.any():
                self.load += more
                return
            if n > 1 and shift > 0 and more[full].max() > self.tolerance:
                self.play(start, 0 if n <= EXACT else max(0, shift - STEP), shift)
                return
            self.open[full] = False
            if not self.open.any():  # no shard has room for keys of this size: as little more room as they need
                self.open[:] = True
                self.cap += more.max()
            self.now = self.ring.route(self.open)
            self._note(start)


def _table(spark: SparkSession, **columns: list | np.ndarray) -> DataFrame:
    """A table by arc or cell, written, so that its size is known where it is joined."""
    return materialize(spark.createDataFrame(pa.table(columns)), "shard-ring", small=True)


def shard(docs: DataFrame, shards: int = 8, vnodes: int = 128, slack: float = 0.002, seed: int = 42, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Deal rows to shards: key, size, text_crc32, law, shard, slot, grown_shard, home_shard.

    A key's place on the ring is its hash; the first virtual node clockwise names its home shard. Rows arrive by size class
    (``_arrival``) and then by a hash of key, text and number among equal rows; a row whose shard can't take its
    slice of arrivals continues clockwise to the next shard with room. A slice is as fine as needed to hold at most half the slack,
    down to single rows, also where many rows share a key. Capacity is (1 + slack) x the mean bytes of a shard, more only
    while a size class lasts whose rows, larger than the slack, fit nowhere. So the law is ``bytes``. The whole
    placement is a few numbers (from which arrival on an arc leads to which shard), found from counts by slice and arc,
    first of whole size classes and then of parts of those that don't fit as a whole: at most 64 parts x arcs rows, or
    10,000 keys, at a time come to the driver, however many keys there are.

    size: UTF-8 bytes plus 1 (null text: 1); text_crc32: of the UTF-8 bytes (null: of none, 0); slot: from 0 without gaps in
    each shard; grown_shard: null. A null key's home is that of its text and number among equal rows. Rows of one key have one home,
    and leave it like others once it is full. Groups of equal texts aren't kept together: each row is placed by its own key, since a
    group may hold more than a shard's bytes. Repeated rows have slots of their own. An empty table gives no rows. Reads texts
    once; then works on a written table of fixed-size rows.
    """
    ring = Ring(shards, vnodes, seed)
    rows = pick(docs, key, text)
    size = (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long")
    facts = rows.select(F.col(key), size.alias("size"), F.crc32(F.coalesce(F.col(text), F.lit("")).cast("binary")).alias("text_crc32"), F.monotonically_increasing_id().alias("place"))
    facts = materialize(facts.withColumn("alike", F.xxhash64(F.col(key), F.col(key).isNull(), "size", "text_crc32")), "shard-sizes")
    total = facts.agg(F.sum("size")).first()[0] or 0
    small = max(0, int(slack / 2 * total / shards).bit_length() - 1)
    own = F.xxhash64("alike", "copy")
    cell = F.shiftrightunsigned(F.xxhash64(F.when(F.col(key).isNull(), own).otherwise(F.xxhash64(F.col(key))), F.lit(seed)), 64 - ring.bits).cast("int")
    cells = _table(docs.sparkSession, _c=np.arange(ring.cells, dtype=np.int32), arc=ring.arc_of_cell)
    keyed = with_copy(facts).select(F.col(key), "size", "text_crc32", own.alias("h"), cell.alias("cell"))
    keys = materialize(keyed.join(cells, keyed["cell"] == cells["_c"]).select(key, "size", "text_crc32", _arrival(F.col("size"), F.col("h"), small).alias("t"), "arc"), "shard-keys")
    routes = _Loads(keys, ring, total, slack, small).play()
    arcs = _table(docs.sparkSession, _a=np.arange(len(routes), dtype=np.int32), home_shard=ring.owner, _starts=[[t for t, _ in r] for r in routes], _to=[[s for _, s in r] for r in routes])
    passed = F.size(F.filter("_starts", lambda t: t <= F.col("t")))  # starts ascend
    placed = keys.join(arcs, keys["arc"] == arcs["_a"]).withColumn("shard", F.element_at("_to", passed).cast("int")).drop("_a", "_starts", "_to").withColumn("r", F.col("t").bitwiseAND(F.lit((1 << CLASS_SHIFT) - 1)))
    ranked = gapless_rank(placed, "shard", "r", CLASS_SHIFT, "slot", (key, "text_crc32", "size"))
    return ranked.select(key, "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "home_shard")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(spark.read.parquet(f"{sf_dir}/documents.parquet"))
