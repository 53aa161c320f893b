"""Merkle manifest: trees of digests by source, grown from partial parents, with a proof for every row."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.window import Window

from tallyforge.llm.common import empty, materialize, pick, streamed_groups
from tallyforge.operators.ordinals import dense

#: What a leaf states about a document, in this order.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Children of a node.
ARITY = 3
#: Levels that one round resolves: a group has at most ARITY**HEIGHT nodes (2,187).
HEIGHT = 7


def leaf(*values: Column) -> Column:
    """SHA-256 of the values: ``-`` for a null, else its UTF-8 byte count, ``:`` and the value."""
    told = [v.cast("string") for v in values]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v), F.lit("-")) for v in told]), 256)


def fold(digest: Column, proof: Column) -> Column:
    """The root that a leaf and its proof lead to. A step of a proof is ``<digests before>|<digests after>``."""
    return F.aggregate(proof, digest, lambda d, s: F.sha2(F.concat(F.substring_index(s, "|", 1), d, F.substring_index(s, "|", -1)), 256))


def proof_digest(proof: Column) -> Column:
    """SHA-256 of all siblings of a proof, from the leaf's run up."""
    return F.sha2(F.translate(F.array_join(proof, ""), "|", ""), 256)


def _joined(children: list[str]) -> str:
    return hashlib.sha256("".join(children).encode()).hexdigest()


class Tree:
    """Part of a tree of ``n`` leaves: partial parents that gather their children's digests by place.

    A parent's arity follows from the tree's size. A child's digest arriving is an event: the parent that it completes is closed at
    once and its own digest is the next event, one level up. ``open`` has the parents that still miss a child; with ``keep``,
    ``closed`` has the children of the others. Parents above level ``stop`` stay open: their children are gathered elsewhere.
    """

    def __init__(self, n: int, arity: int = ARITY, keep: bool = False, stop: int | None = None):
        self.arity, self.keep, self.stop, self.sizes = arity, keep, stop, [n]
        while self.sizes[-1] > 1:
            self.sizes.append(-(-self.sizes[-1] // arity))
        self.top = len(self.sizes) - 1
        self.root: str | None = None
        self.open: dict[tuple[int, int], dict[int, str]] = {}
        self.closed: dict[tuple[int, int], list[str]] = {}

    def add(self, level: int, index: int, digest: str) -> None:
        while level < self.top:
            at, place = divmod(index, self.arity)
            parent = self.open.setdefault((level + 1, at), {})
            parent[place] = digest
            wants = min(self.arity, self.sizes[level] - self.arity * at)
            if len(parent) < wants or level == self.stop:
                return
            del self.open[level + 1, at]
            children = [parent[i] for i in range(wants)]
            if self.keep:
                self.closed[level + 1, at] = children
            level, index, digest = level + 1, at, _joined(children)
        self.root = digest

    def frontier(self) -> list[tuple[int, int, str]]:
        """(level, index, digest) of the root, if it was reached, or of the nodes whose parents wait for others."""
        if self.root is not None:
            return [(self.top, 0, self.root)]
        return [(level - 1, at * self.arity + place, d) for (level, at), parent in self.open.items() for place, d in parent.items()]

    def step(self, level: int, index: int) -> str | None:
        """The siblings of a node before and after it, if its parent is closed here."""
        at, place = divmod(index, self.arity)
        children = self.closed.get((level + 1, at))
        return None if children is None else "".join(children[:place]) + "|" + "".join(children[place + 1 :])


def _up(arity: int, stop: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tree, name, n, out = None, None, 0, []

        def ended() -> None:
            if tree is not None:
                out.extend((name, n, level, at, d, level == tree.top) for level, at, d in tree.frontier())

        for (new, _), rows, begins in streamed_groups(batches, ("tree", "block")):
            if begins:
                ended()
                name, n = new, int(rows["n"].iat[0])
                tree = Tree(n, arity, stop=stop)
            for level, at, d in zip(rows["level"].tolist(), rows["idx"].tolist(), rows["digest"].tolist(), strict=True):
                tree.add(level, at, d)
            if len(out) > 20_000:
                yield pd.DataFrame(out, columns=["tree", "n", "level", "idx", "digest", "done"])
                out.clear()
        ended()
        yield pd.DataFrame(out, columns=["tree", "n", "level", "idx", "digest", "done"])

    return run


def _down(arity: int, stop: int):
    """Groups that begin with the proofs of their frontier; gives each node its own."""

    def proofs(rows: list[pd.DataFrame]) -> pd.DataFrame:
        all_ = pd.concat(rows, ignore_index=True)
        known, below = all_[~all_["below"]], all_[all_["below"]]
        tree = Tree(int(below["n"].iat[0]), arity, True, stop)
        for level, at, d in zip(below["level"].tolist(), below["idx"].tolist(), below["digest"].tolist(), strict=True):
            tree.add(level, at, d)
        found = {(level, at): list(p) for level, at, p in zip(known["level"].tolist(), known["idx"].tolist(), known["proof"], strict=True)}

        def proof(level: int, at: int) -> list[str]:
            here = found.get((level, at))
            if here is None:
                here = found[level, at] = [tree.step(level, at), *proof(level + 1, at // arity)]
            return here

        made = [proof(level, at) for level, at in zip(below["level"].tolist(), below["idx"].tolist(), strict=True)]
        return below.assign(proof=pd.Series(made, index=below.index, dtype=object), subroot=known["subroot"].iat[0])[["tree", "level", "idx", "digest", "proof", "subroot", "k", "claimed"]]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows: list[pd.DataFrame] = []
        for _, some, begins in streamed_groups(batches, ("tree", "block")):
            if begins and rows:
                yield proofs(rows)
                rows = []
            rows.append(some)
        if rows:
            yield proofs(rows)

    return run


def _blocked(nodes: DataFrame, arity: int, height: int, round_: int) -> DataFrame:
    """Nodes with the block of round ``round_`` (from 1) that they lie in: what one node at level height x round_ covers."""
    wide = F.element_at(F.array(*[F.lit(arity**i) for i in range(height + 1)]), F.lit(height * round_) - F.greatest("level", F.lit(height * (round_ - 1))) + 1)
    return nodes.withColumn("block", F.call_function("div", F.col("idx"), wide))


class Forest:
    """Trees over nodes (tree, n, level, idx, digest), a written table with idx from 0 without gaps below n in each tree."""

    def __init__(self, leaves: DataFrame, arity: int = ARITY, height: int = HEIGHT):
        """Grows all trees at once. A round gives each block of nodes, of ``arity ** height`` at most, to one task in order, so few parents are
        open at a time; what a round leaves open is dealt to the next round's blocks. Rounds: the logarithm of the largest tree's size,
        divided by ``height``."""
        self.arity, self.height = arity, height
        self.rounds: list[tuple[DataFrame, DataFrame]] = []
        now = leaves
        while not now.isEmpty():
            grown = self._grouped(now, len(self.rounds) + 1, "tree", "block", "level", "idx").mapInPandas(_up(arity, height * (len(self.rounds) + 1)), "tree string, n long, level int, idx long, digest string, done boolean")
            grown = materialize(grown, "merkle-nodes")
            self.rounds.append((now, grown))
            now = grown.where("not done").drop("done")

    def _grouped(self, nodes: DataFrame, round_: int, *order: str) -> DataFrame:
        n = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        return _blocked(nodes, self.arity, self.height, round_).repartition(n, "tree", "block").sortWithinPartitions(*order)

    def roots(self) -> DataFrame:
        """(tree, digest), one row a tree."""
        out = self.rounds[0][1]
        for _, grown in self.rounds[1:]:
            out = out.union(grown)
        return out.where("done").select("tree", "digest")

    def proofs(self, of_roots: DataFrame) -> DataFrame:
        """tree, level, idx, digest, proof, subroot, k, claimed of each leaf. ``of_roots`` has (tree, proof) of the roots themselves.

        From the last round back to the first, each block is grown again with its children kept, and links from parents back to children carry
        the proofs down: a node's is its own step and its parent's proof.
        """
        above = of_roots.withColumnRenamed("tree", "rt").withColumnRenamed("proof", "rp")
        known = None
        for round_ in range(len(self.rounds), 0, -1):
            below, grown = self.rounds[round_ - 1]
            done = grown.where("done")
            tops = done.join(above, done["tree"] == above["rt"]).select("tree", "level", "idx", F.col("rp").alias("proof"), F.col("digest").alias("subroot"))
            known = tops if known is None else tops.union(known.select("tree", "level", "idx", "proof", "subroot"))
            text = lambda c: F.col(c) if c in below.columns else F.lit(None).cast("string").alias(c)  # noqa: B023, E731
            both = below.select("tree", "n", "level", "idx", "digest", text("k"), text("claimed"), F.lit(True).alias("below"), F.lit(None).cast("array<string>").alias("proof"), F.lit(None).cast("string").alias("subroot"))
            known = both.union(known.select("tree", F.lit(0).cast("long"), "level", "idx", F.lit(None).cast("string"), F.lit(None).cast("string"), F.lit(None).cast("string"), F.lit(False), "proof", "subroot"))
            known = self._grouped(known, round_, "tree", "block", "below", "level", "idx").mapInPandas(_down(self.arity, self.height * round_), "tree string, level int, idx long, digest string, proof array<string>, subroot string, k string, claimed string")
            if round_ > 1:
                known = materialize(known, "merkle-proofs")
        return known


def _placed(leaves: DataFrame) -> DataFrame:
    """tree, n, level, idx, digest, k, claimed of a written table (tree, id, digest, k, claimed, place), as a written table.

    Rows are dealt to ranges of (tree, id, digest, place), so a tree may fill many tasks; counts by tree and range give each range's first number.
    """
    ranged = materialize(leaves.repartitionByRange(F.col("tree"), F.col("id"), F.col("digest"), F.col("place")).withColumn("part", F.spark_partition_id()), "merkle-ranges")
    count = ranged.groupBy(F.col("tree").alias("t"), F.col("part").alias("p")).agg(F.count("*").alias("_n"))
    whole = Window.partitionBy("t")
    first = materialize(count.select("t", "p", F.sum("_n").over(whole).alias("n"), (F.sum("_n").over(whole.orderBy("p").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n")).alias("_first")), "merkle-firsts", small=True)
    ranked = ranged.withColumn("_r", F.row_number().over(Window.partitionBy("tree", "part").orderBy("id", "digest", "place")))
    joined = ranked.join(first, (ranked["tree"] == first["t"]) & (ranked["part"] == first["p"]))
    return materialize(joined.select("tree", "n", F.lit(0).alias("level"), (F.col("_first") + F.col("_r") - 1).cast("long").alias("idx"), "digest", "k", "claimed"), "merkle-leaves")


def manifest(docs: DataFrame, key: str = "doc_id", source: str = "source", fields: tuple[str, ...] = FIELDS, claimed=None, arity: int = ARITY, height: int = HEIGHT) -> DataFrame:
    """One row per input row: key, source, idx, leaf, claimed, subroot, root, proof.

    A leaf is the digest of the row's ``fields``. Leaves of a source ascend by key, null first, rows of one key by their digest (equal rows are
    interchangeable); ``idx`` is the place. While several nodes remain, ``arity`` consecutive ones become one, the last run as many as
    there are; what remains is the source's subroot. Subroots by source, null first and then in byte order, give the root in the same way.
    proof: a step a level up to the root, ``<siblings before>|<siblings after>``, for ``fold``. A null source is a source. ``claimed`` makes
    of a row's columns by name the digest of another copy of that row (a string), given back beside its proof; null if there is none.
    An empty table gives no rows.

    Texts are read once; then digests are moved, of a fixed size a row. Groups are blocks of ``arity ** height`` nodes however large a
    source is, and there may be many sources: subroots are numbered by ranges and grow in rounds too. One digest comes to the driver, the root.
    """
    names = list(dict.fromkeys([key, source, *fields]))
    rows = pick(docs, *names).toDF(*[f"_{i}" for i in range(len(names))])
    col = {n: F.col(f"_{i}") for i, n in enumerate(names)}
    kinds = dict(zip(names, [t for _, t in rows.dtypes], strict=True))
    src = F.when(col[source].isNull(), F.lit("0")).otherwise(F.concat(F.lit("1"), col[source].cast("string")))
    other = F.lit(None).cast("string") if claimed is None else claimed(col)
    leaves = materialize(rows.select(src.alias("tree"), col[key].alias("id"), leaf(*[col[f] for f in fields]).alias("digest"), col[key].cast("string").alias("k"), other.alias("claimed"), F.monotonically_increasing_id().alias("place")), "merkle-digests")
    out = [F.col("k").cast(kinds[key]).alias(key), F.when(F.col("tree") != "0", F.expr("substring(tree, 2)")).cast(kinds[source]).alias(source), "idx", F.col("digest").alias("leaf"), "claimed", "subroot", "root", "proof"]
    if leaves.isEmpty():
        return empty(docs.sparkSession, "k string, tree string, idx long, digest string, claimed string, subroot string, root string, proof array<string>").select(*out)
    forest = Forest(_placed(leaves), arity, height)
    subroots = materialize(forest.roots(), "merkle-subroots")
    numbered = materialize(dense(subroots.withColumnRenamed("tree", "k"), "k", "idx").select(F.lit("").alias("tree"), F.lit(subroots.count()).cast("long").alias("n"), F.lit(0).alias("level"), "idx", "digest", "k", F.lit(None).cast("string").alias("claimed")), "merkle-sources")
    above = Forest(numbered, arity, height)
    root = above.roots().first()["digest"]
    of_sources = materialize(above.proofs(docs.sparkSession.createDataFrame([("", [])], "tree string, proof array<string>")).select(F.col("k").alias("tree"), "proof"), "merkle-source-proofs")
    return forest.proofs(of_sources).withColumn("root", F.lit(root)).select(*out)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where 2 divides the unsigned crc32 of a key, the other copy lost the line breaks of its text."""

    def tampered(col: dict[str, Column]) -> Column:
        even = F.crc32(col["doc_id"].cast("string").cast("binary")) % 2 == 0
        return F.when(even, leaf(*[F.translate(col[f], "\n", "") if f == "text" else col[f] for f in FIELDS]))

    rows = manifest(spark.read.parquet(f"{sf_dir}/documents.parquet"), claimed=tampered)
    folded = rows.withColumn("folded_root", fold(F.coalesce("claimed", "leaf"), F.col("proof")))
    return folded.select("doc_id", "leaf", "subroot", "root", proof_digest(F.col("proof")).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def sql() -> str:
    told = lambda x: f"coalesce(strlen({x})::varchar || ':' || {x}, '-')"
    of = lambda text: "sha256(" + " || ".join(told(x) for x in ("doc_id::varchar", "source", "lang", "n_chars::varchar", text)) + ")"
    return f"""
with recursive t as (select list(list_reduce(list_prepend(i, range(8)), lambda x, y: case when x & 1 = 1 then xor(x >> 1, 3988292384) else x >> 1 end) order by i) as t from range(256) r(i)),
d as (select *, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(doc_id::varchar, ''), lambda c: ascii(c)::bigint)), lambda c, b: xor(c >> 8, t.t[(xor(c, b) & 255) + 1])), 4294967295) as crc from documents, t),
l as (select doc_id, case when source is null then '0' else '1' || source end as src, {of("text")} as leaf, case when crc % 2 = 0 then {of("replace(text, chr(10), '')")} end as other from d),
p as (select *, row_number() over (partition by src order by doc_id nulls first, leaf) - 1 as idx, count(*) over (partition by src) as n, row_number() over () as id from l),
up as (select src, 0 as level, idx, leaf as digest, n from p union all select src, level + 1, idx // 3, sha256(string_agg(digest, '' order by idx)), (n + 2) // 3 from up where n > 1 group by src, level, idx // 3, n),
sub as (select src, digest as subroot, row_number() over (order by src) - 1 as idx, count(*) over () as n from up where n = 1),
top as (select 0 as level, idx, subroot as digest, n from sub union all select level + 1, idx // 3, sha256(string_agg(digest, '' order by idx)), (n + 2) // 3 from top where n > 1 group by level, idx // 3, n),
runs as (select src, level, idx // 3 as run, list(digest order by idx) as ds from up where n > 1 group by all union all select null, level, idx // 3, list(digest order by idx) from top where n > 1 group by all),
step as (select src, level, run, u.i as place, array_to_string(ds[1:u.i], '') as b, array_to_string(ds[u.i + 2:], '') as a from runs, unnest(range(len(ds))) u(i)),
w as (select id, src, 0 as level, idx, coalesce(other, leaf) as f, '' as sib from p
  union all select w.id, w.src, w.level + 1, w.idx // 3, sha256(s.b || w.f || s.a), w.sib || s.b || s.a from w join step s on s.src = w.src and s.level = w.level and s.run = w.idx // 3 and s.place = w.idx % 3),
w1 as (select id, src, max_by(f, level) as f, max_by(sib, level) as sib from w group by id, src),
v as (select w1.id, 0 as level, sub.idx, f, sib from w1 join sub using (src)
  union all select v.id, v.level + 1, v.idx // 3, sha256(s.b || v.f || s.a), v.sib || s.b || s.a from v join step s on s.src is null and s.level = v.level and s.run = v.idx // 3 and s.place = v.idx % 3),
v1 as (select id, max_by(f, level) as f, max_by(sib, level) as sib from v group by id)
select doc_id, leaf, subroot, (select digest from top where n = 1) as root, sha256(sib) as proof_sha256, f as folded_root, f = (select digest from top where n = 1) as verified
from p join sub using (src) join v1 using (id)
"""
