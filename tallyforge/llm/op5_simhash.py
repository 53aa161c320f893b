"""SimHash near-duplicates: 64-bit fingerprints, linked by searches in BK-trees of shards."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from tallyforge.llm.common import Carried, connected_components, contents, materialize, pick, small_batches, word_runs

SEED = 42
#: Nodes of one tree at most. A larger shard is divided over further bits, see ``links``.
TREE_ROWS = 32_768
#: Nodes that a tree should have about: shards are dealt by as many bits as that takes.
SHARD_ROWS = 2048


def fingerprint(text: bytes | None, width: int = 3) -> int:
    """The majority of each bit over the XXH64 values (seed 42) of all word shingles; unsigned. No words: 0.

    A text is read in runs of words, each begun with the last words of the one before, so memory doesn't grow with the text.
    """
    ones, n, last, digest = np.zeros(64, np.int64), 0, [], xxhash.xxh64_digest
    for run in word_runs(text or b""):
        words = last + [w.lower() for w in run] if last else b" ".join(run).lower().split(b" ") if run else []
        if len(words) >= width:
            joined, next_ = b" ".join(words), np.cumsum([len(w) + 1 for w in words])
            raw = b"".join([digest(joined[s:e], SEED) for s, e in zip([0, *next_.tolist()], (next_[width - 1 :] - 1).tolist(), strict=False)])
            ones += np.unpackbits(np.frombuffer(raw, np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
            n += len(words) - width + 1
        last = words[-(width - 1) :] if width > 1 else []
    if not n and last:  # fewer words than a shingle has
        return xxhash.xxh64_intdigest(b" ".join(last), SEED)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


@F.pandas_udf(T.LongType())
def _fingerprints(text: pd.Series) -> pd.Series:
    raw = np.array([fingerprint(t) for t in text], np.uint64)
    return pd.Series(raw.view(np.int64))


class BKTree:
    """A tree of numbers under Hamming distance: a node's children are keyed by their distance to it."""

    def __init__(self) -> None:
        self.values: list[int] = []
        self.children: list[dict[int, int]] = []
        self.visited = 0

    def add(self, value: int) -> None:
        at = 0
        if self.values:
            while d := (value ^ self.values[at]).bit_count():
                nearer = self.children[at].get(d)
                if nearer is None:
                    self.children[at][d] = len(self.values)
                    break
                at = nearer
            else:
                return
        self.values.append(value)
        self.children.append({})

    def within(self, value: int, radius: int) -> list[int]:
        """Values at most ``radius`` away. Only edges keyed d - radius to d + radius can lead to one, by the triangle inequality.

        ``visited`` counts the nodes that were compared.
        """
        found, todo = [], [0] if self.values else []
        while todo:
            at = todo.pop()
            self.visited += 1
            d = (value ^ self.values[at]).bit_count()
            if d <= radius:
                found.append(self.values[at])
            if edges := self.children[at]:
                if len(edges) <= 2 * radius + 1:
                    todo += [c for k, c in edges.items() if d - radius <= k <= d + radius]
                else:
                    todo += [edges[k] for k in range(d - radius, d + radius + 1) if k in edges]
        return found


class _Sets:
    """Disjoint sets, to hand on only links that join two of them."""

    def __init__(self) -> None:
        self.parent: dict[int, int] = {}

    def join(self, a: int, b: int) -> bool:
        a, b = self._root(a), self._root(b)
        self.parent[max(a, b)] = min(a, b)
        return a != b

    def _root(self, a: int) -> int:
        parent = self.parent
        while (up := parent.setdefault(a, a)) != a:
            parent[a] = a = parent[up]
        return a


def _search(radius: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tree, sets, out, last = BKTree(), _Sets(), [], None
        for rows in batches:
            if not len(rows):
                continue
            keys, prints = rows["shard"].to_numpy(np.int64), rows["fp"].to_numpy(np.int64).view(np.uint64)
            starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
            ends = np.append(starts[1:], len(rows))
            # a shard of one member has nothing to find, unless the batch before or after has more of it
            some = ends - starts > 1
            some[[0, -1]] = True
            for s, e in zip(starts[some].tolist(), ends[some].tolist(), strict=True):
                if (key := int(keys[s])) != last:
                    tree, sets, last = BKTree(), _Sets(), key
                for value in prints[s:e].tolist():
                    out += [(value, near) for near in tree.within(value, radius) if sets.join(value, near)]
                    tree.add(value)
                if len(out) > 50_000:
                    yield _pairs(out)
                    out = []
        yield _pairs(out)

    return run


def _pairs(out: list[tuple[int, int]]) -> pd.DataFrame:
    return pd.DataFrame(np.array(out, np.uint64).reshape(-1, 2).view(np.int64), columns=["a", "b"])


def masks(radius: int, n: int) -> list[int]:
    """Sets of bits of which two numbers within the radius agree in one at least: the leading bits of each of ``radius`` + 1 blocks.

    As many leading bits as deal n numbers to shards of about ``SHARD_ROWS``, so nearly all of the search is left to the trees. Where a block
    alone has too few, sets of 2 or 3 of more blocks have more.
    """
    want = max(0, (max(1, n) // SHARD_ROWS).bit_length() - 1)
    if not want:
        return [0]  # one shard
    for equal in (1, 2, 3):
        blocks = radius + equal
        cuts = [64 * i // blocks for i in range(blocks + 1)]
        sets = [[b for lo, hi in part for b in range(hi - 1, lo - 1, -1)] for part in combinations(list(zip(cuts, cuts[1:], strict=False)), equal)]
        if min(map(len, sets)) >= want:
            break
    return [sum(1 << b for b in bits[:want]) for bits in sets]


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def _dealt(rows: DataFrame, parts: dict[int, list[int]]) -> DataFrame:
    """(fp, shard, known) once for each mask that ``parts`` has for the row's ``known``: members of a shard that agree in the mask's bits stay
    together. ``known`` has the bits in which all members of a shard agree."""
    listed = F.create_map(*[x for known, masks_ in parts.items() for x in (F.lit(_signed(known)), F.array(*[F.lit(_signed(m)) for m in masks_]))])
    each = rows.select("fp", "shard", "known", F.explode(F.element_at(listed, F.col("known"))).alias("mask"))
    return each.select("fp", F.xxhash64("shard", "mask", F.col("fp").bitwiseAND(F.col("mask"))).alias("shard"), F.col("known").bitwiseOR(F.col("mask")).alias("known"))


def _blocks(bits: list[int], radius: int) -> list[int]:
    """``bits`` in radius + 1 blocks: two numbers within the radius agree in one of them."""
    cuts = [len(bits) * i // (radius + 1) for i in range(radius + 2)]
    return [sum(1 << b for b in bits[lo:hi]) for lo, hi in zip(cuts, cuts[1:], strict=False)]


def shards(prints: DataFrame, radius: int, tree_rows: int = TREE_ROWS) -> list[DataFrame]:
    """Tables of (fp, shard) without a shard of more than ``tree_rows`` members: any two fingerprints within the radius meet in one shard at least.

    Fingerprints within the radius agree in one of a few sets of leading bits (``masks``), so each goes to a shard a set. A larger shard is
    divided over bits in which its members may still differ: two of them within the radius also agree in one of radius + 1
    blocks of these. Each division leaves a third fewer free bits (at radius 2), and b free bits tell 2^b fingerprints apart at most, so after a
    few divisions no shard can be larger, whatever the data; no shard is compared whole with its parts. The driver sees the sets
    of known bits of such shards: tens, however many shards there are.
    """
    state = _dealt(prints.select("fp", F.lit(0).cast("long").alias("shard"), F.lit(0).cast("long").alias("known")), {0: masks(radius, prints.count())})
    most, done = max(tree_rows, 1 << radius), []
    while True:
        large = materialize(state.groupBy("shard", "known").agg(F.count("*").alias("n")).where(F.col("n") > most).select(F.col("shard").alias("ls"), F.col("known").alias("lk")), "simhash-large", small=True)
        kinds = [r["lk"] & ((1 << 64) - 1) for r in large.select("lk").distinct().collect()]
        if not kinds:
            return [*done, state.select("fp", "shard")]
        here = large.select("ls")
        done.append(state.join(here, state["shard"] == here["ls"], "left_anti").select("fp", "shard"))
        members = state.join(here, state["shard"] == here["ls"], "left_semi")
        state = materialize(_dealt(members, {k: _blocks([b for b in range(64) if not k >> b & 1], radius) for k in kinds}), "simhash-divided")


def links(prints: DataFrame, radius: int = 2) -> DataFrame:
    """(a, b) of distinct fingerprints (column ``fp``): enough links at most ``radius`` bits apart to join all that the whole set joins.

    Fingerprints are dealt to ``shards``; a shard's tree, of at most ``TREE_ROWS`` nodes, is built and searched in one task, and a
    search follows only edges within the radius. Of a shard's links those are given that join two sets.
    """
    n = int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = [s.repartition(n, "shard").sortWithinPartitions("shard", "fp").mapInPandas(_search(radius), "a long, b long") for s in shards(prints, radius, TREE_ROWS)]
    return reduce(DataFrame.union, found)


def tree_work(prints: DataFrame, radius: int = 2) -> DataFrame:
    """(shard, nodes, compared): how large the trees of ``links`` are, and how many nodes all their searches compare; all pairs would be nodes x (nodes - 1) / 2."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tree, last = None, None
        for rows in batches:
            for key, fp in zip(rows["shard"].tolist(), rows["fp"].to_numpy(np.int64).view(np.uint64).tolist(), strict=True):
                if key != last:
                    if tree is not None:
                        yield pd.DataFrame({"shard": [last], "nodes": [len(tree.values)], "compared": [tree.visited]})
                    tree, last = BKTree(), key
                tree.within(fp, radius)
                tree.add(fp)
        if tree is not None:
            yield pd.DataFrame({"shard": [last], "nodes": [len(tree.values)], "compared": [tree.visited]})

    n = int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return reduce(DataFrame.union, [s.repartition(n, "shard").sortWithinPartitions("shard", "fp").mapInPandas(run, "shard long, nodes long, compared long") for s in shards(prints, radius, TREE_ROWS)])


def simhash(docs: DataFrame, radius: int = 2, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: key, fingerprint (16 hex digits), component_id (smallest key reachable by links, itself included).

    Null, empty and wordless texts have fingerprint zero, which links like any other. Rows of equal fingerprints are one class
    from the start, so a group of copies of any size is one node; only fingerprints are dealt to shards. A row with a null
    key gets its fingerprint and component null and links nothing. Repeated rows give repeated results. An empty
    table gives no rows. Texts are read once; fingerprints go to a written table.
    """
    with small_batches(docs.sparkSession):
        prints = materialize(pick(docs, key, text).select(F.col(key).cast("long").alias("k"), _fingerprints(F.col(text).cast("binary")).alias("fp")), "simhash")
    return _components(prints, radius).select(F.col("k").alias(key), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _components(prints: DataFrame, radius: int) -> DataFrame:
    """k, fp, component_id of a table of k, fp."""
    classes = materialize(prints.where("k is not null").groupBy("fp").agg(F.min("k").alias("least")), "simhash-classes")
    found = _least(classes, radius)
    out = prints.join(found, prints["fp"] == found["cfp"], "left")
    return out.select("k", "fp", F.when(F.col("k").isNotNull(), F.col("least")).alias("component_id"))


def _least(classes: DataFrame, radius: int) -> DataFrame:
    """cfp, least: the smallest ``least`` of each fingerprint's component, of a written table of fp (distinct), least."""
    nodes = connected_components(links(classes, radius))
    joined = classes.join(nodes, classes["fp"] == nodes["node"])
    least = joined.groupBy("component").agg(F.min("least").alias("component_least"))
    linked = joined.select("node", F.col("component").alias("c")).join(least, F.col("c") == least["component"]).select(F.col("node").alias("fp"), F.col("component_least").alias("least"))
    alone = classes.join(nodes, classes["fp"] == nodes["node"], "left_anti").select("fp", "least")
    return materialize(linked.union(alone), "simhash-components").select(F.col("fp").alias("cfp"), "least")


def dedup_documents(docs: DataFrame, radius: int = 2) -> DataFrame:
    """One row of each component, with all its columns: one with the smallest key, or of a component without keys any one.

    Rows are decided one by one, not by key: a row with a null key is a document like others, links like others and comes after those
    with a key; a key's rows may lie in several components. Among a component's rows with the smallest key the least hash of
    the content wins, and of rows that are equal in all columns one stays. Hashes are of 128 bits.
    """
    carried = Carried(docs)
    content = contents(carried.rows)
    rows = carried.rows.select("*", carried.col("doc_id").cast("long").alias("k"), F.xxhash64(F.lit(1), *content).alias("h1"), F.xxhash64(F.lit(2), *content).alias("h2"))
    with small_batches(docs.sparkSession):
        prints = materialize(rows.select("k", "h1", "h2", _fingerprints(carried.col("text").cast("binary")).alias("fp")), "simhash")
    least = F.struct(F.col("k").isNull().alias("no_key"), "k", "h1", "h2")
    found = _least(materialize(prints.groupBy("fp").agg(F.min(least).alias("least")), "simhash-classes"), radius)
    kept = F.col("k").eqNullSafe(F.col("least.k")) & (F.col("h1") == F.col("least.h1")) & (F.col("h2") == F.col("least.h2"))
    decided = materialize(prints.join(found, prints["fp"] == found["cfp"]).select("k", "h1", "h2", kept.alias("kept")), "simhash-decided")

    # most keys have one row, so most rows that go are told by key alone
    by_key = decided.where("k is not null").groupBy("k").agg(F.max("kept").alias("some"), F.min("kept").alias("all"))
    gone = materialize(by_key.where("not some").select(F.col("k").alias("gk")), "simhash-gone")
    mixed = by_key.where("some and not all").select(F.col("k").alias("mk"))
    lost = decided.where("not kept").select("k", "h1", "h2")
    gone_rows = materialize(lost.where("k is null").union(lost.join(mixed, lost["k"] == mixed["mk"], "left_semi")).distinct(), "simhash-gone-rows")
    copies = materialize(decided.where("kept").groupBy("k", "h1", "h2").agg(F.count("*").alias("n")).where("n > 1").drop("n"), "simhash-copies")

    rows = rows.join(gone, rows["k"] == gone["gk"], "left_anti")
    if not gone_rows.isEmpty():
        rows = rows.join(gone_rows.toDF("gk", "g1", "g2"), F.expr("k <=> gk and h1 = g1 and h2 = g2"), "left_anti")
    if not copies.isEmpty():
        again = copies.toDF("gk", "g1", "g2")
        same = F.expr("k <=> gk and h1 = g1 and h2 = g2")
        first = rows.join(again, same, "left_semi").groupBy("k", "h1", "h2").agg(F.first(F.struct(*carried.rows.columns)).alias("row"))
        rows = rows.join(again, same, "left_anti").select(*carried.rows.columns).union(first.select("row.*"))
    return carried.back(rows)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash(spark.read.parquet(f"{sf_dir}/documents.parquet"))
