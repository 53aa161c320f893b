"""Embedding near-duplicates: an exact metric range join over pivot cells."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tallyforge.llm.common import connected_components, materialize, pick, streamed_groups

#: Vectors of a cell (or of a slice of a large cell) that one task holds at a time, while others stream past them: from the
#: first number, which keeps cores busy on small tables, to as many as fit in the second, since each slice sees all
#: members of its cell and fewer slices move less.
HOME_ROWS, HOME_BYTES = 4096, 48 << 20
#: Cosines computed at a time.
BLOCK = 4 << 20
#: Pivots are chosen from this many vectors at most, and are this many at most.
SAMPLE_ROWS, MOST_PIVOTS = 2048, 512
#: Room for rounding in comparisons of distances; a pair is decided by its cosine in double precision.
SLACK = 1e-6


def home_rows(size: int, dims: int, cores: int) -> int:
    """Rows of a slice: a quarter of a core's share, within the bounds. A row takes 8 + 4 bytes a component."""
    return max(HOME_ROWS, min(size // (4 * cores), HOME_BYTES // (12 * dims)))


def single_slack(dims: int) -> float:
    """How far a product of two unit vectors in single precision may be off: both are rounded, and so are ``dims`` products and sums."""
    return (2 * dims + 8) * 2.0**-24


def _valid(v: Column) -> Column:
    """Not null or empty, all components finite, not all zero."""
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return v.isNotNull() & (F.size(v) > 0) & fine & F.exists(v, lambda x: x != 0)


def _matrix(vectors: pd.Series) -> np.ndarray:
    """Unit rows in double precision."""
    x = np.array(vectors.tolist(), float)
    x /= np.abs(x).max(axis=1, keepdims=True)  # else the squares of very large or small components over- or underflow
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def choose_pivots(unit: np.ndarray, count: int) -> np.ndarray:
    """``count`` rows, each the farthest from those before it; the first row is the first."""
    at, near = [0], np.full(len(unit), np.inf)
    while len(at) < min(count, len(unit)):
        near = np.minimum(near, 2 - 2 * (unit @ unit[at[-1]]))
        nxt = int(near.argmax())
        if near[nxt] <= SLACK:
            break
        at.append(nxt)
    return unit[at]


def _distances(unit: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(2 - 2 * (unit @ pivots.T), 0))


def _homes(pivots: np.ndarray):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            if len(rows):
                d = _distances(_matrix(rows["v"]), pivots)
                home = d.argmin(axis=1)
                yield pd.DataFrame({"id": rows["id"], "home": home.astype(np.int32), "reach": d[np.arange(len(d)), home]})

    return run


def _dealt(pivots: np.ndarray, reach: np.ndarray, slices: np.ndarray, radius: float):
    """Rows (cell, slice, member, id, n, v): each vector at home in its nearest pivot's cell, and a member of every slice that may
    hold a vector within the radius.

    By the triangle inequality a vector y of cell j within ``radius`` of x has d(x, p_j) <= d(x, y) + d(y, p_j) <= radius + reach_j.
    And y is no farther from p_j than from x's pivot p_i, so x is at most ``radius`` beyond the plane between the two
    pivots: (d(x, p_j)^2 - d(x, p_i)^2) / (2 d(p_i, p_j)) <= radius.
    """
    between = np.maximum(_distances(pivots, pivots), 1e-9)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            if not len(rows):
                continue
            d = _distances(_matrix(rows["v"]), pivots)
            home = d.argmin(axis=1)
            near = d[np.arange(len(d)), home]
            may = (d <= radius + reach[None, :] + SLACK) & ((d**2 - near[:, None] ** 2) / (2 * between[home]) <= radius + SLACK)
            may[np.arange(len(d)), home] = True
            own = rows["h"].to_numpy() % slices[home]
            for cell in np.flatnonzero(may.any(axis=0)):
                at = np.flatnonzero(may[:, cell])
                for part in range(slices[cell]):
                    some = rows.iloc[at]
                    yield pd.DataFrame({"cell": np.int32(cell), "slice": np.int32(part), "member": ~((home[at] == cell) & (own[at] == part)), "id": some["id"], "n": some["n"], "v": some["v"]})

    return run


class _Cell:
    """The vectors at home in a slice, what they link to so far, and the sets that they form."""

    def __init__(self, cosine: float):
        self.cosine, self.ids, self.counts, self.parts = cosine, [], [], []

    def add(self, rows: pd.DataFrame) -> None:
        self.ids.append(rows["id"].to_numpy())
        self.counts.append(rows["n"].to_numpy())
        self.parts.append(_matrix(rows["v"]))

    def close(self) -> None:
        """All home vectors are here; link them with each other."""
        self.id, self.n, self.unit = np.concatenate(self.ids), np.concatenate(self.counts), np.concatenate(self.parts)
        self.small = self.unit.astype(np.float32)
        self.links = self.n - 1  # copies link to each other
        self.set = np.arange(len(self.id))
        self.edges: list[tuple[int, int]] = []
        self.meet(self.id, self.n, self.unit, own=True)

    def meet(self, ids: np.ndarray, n: np.ndarray, unit: np.ndarray, own: bool = False) -> None:
        step = max(32, BLOCK // len(self.id))
        for at in range(0, len(ids), step):
            block = unit[at : at + step]
            near = self.small @ block.astype(np.float32).T
            h, m = np.nonzero(near >= self.cosine - single_slack(unit.shape[1]))
            if own:
                h, m = h[h != m + at], m[h != m + at]
            if not len(h):
                continue
            sure = np.empty(len(h))
            for k in range(0, len(h), 1 << 16):
                sure[k : k + (1 << 16)] = np.einsum("ij,ij->i", self.unit[h[k : k + (1 << 16)]], block[m[k : k + (1 << 16)]])
            h, m = h[sure >= self.cosine], m[sure >= self.cosine]
            self.links += np.bincount(h, weights=n[at + m], minlength=len(self.id)).astype(np.int64)
            self._join(h, m, ids[at : at + step])

    def _join(self, h: np.ndarray, m: np.ndarray, ids: np.ndarray) -> None:
        """Edges from each member to its first home vector, and from further ones only where they join two sets."""
        order = np.lexsort((h, m))
        h, m = h[order], m[order]
        first = np.concatenate([[True], m[1:] != m[:-1]]) if len(m) else np.zeros(0, bool)
        self.edges += zip(self.id[h[first]].tolist(), ids[m[first]].tolist(), strict=True)
        lead = h[first][np.cumsum(first) - 1] if len(m) else h
        while (apart := np.flatnonzero(self.set[h] != self.set[lead])).size:
            a, b = self.set[h[apart[0]]], self.set[lead[apart[0]]]
            self.edges.append((int(self.id[h[apart[0]]]), int(ids[m[apart[0]]])))
            self.set[self.set == max(a, b)] = min(a, b)

    def rows(self) -> pd.DataFrame:
        e = np.array(self.edges, np.int64).reshape(-1, 2)
        return pd.DataFrame({"a": np.concatenate([self.id, e[:, 0]]), "b": pd.array(np.concatenate([np.zeros(len(self.id), np.int64), e[:, 1]]), "Int64"), "links": np.concatenate([self.links, np.full(len(e), -1)])})


def _joined(cosine: float):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cell, open_ = None, False
        for _, rows, begins in streamed_groups(batches, ("cell", "slice")):
            if begins:
                if cell is not None and cell.ids:
                    if open_:
                        cell.close()
                    yield cell.rows()
                cell, open_ = _Cell(cosine), True
            member = rows["member"].to_numpy()
            if not member.all():
                cell.add(rows[~member])
            if member.any() and cell.ids:
                if open_:
                    cell.close()
                    open_ = False
                more = rows[member]
                cell.meet(more["id"].to_numpy(), more["n"].to_numpy(), _matrix(more["v"]))
        if cell is not None and cell.ids:
            if open_:
                cell.close()
            yield cell.rows()

    return run


def _one_dimension(classes: DataFrame, size: int, dims: int, cosine: float) -> DataFrame:
    """(a, b, links) of vectors of one length: links of each vector (b = 0), and enough edges (links = -1) to join what is joined."""
    radius = math.sqrt(max(0.0, 2 - 2 * cosine))
    rows = classes.where(F.col("dims") == dims)
    most = home_rows(size, dims, classes.sparkSession.sparkContext.defaultParallelism)
    part = min(1.0, 1.5 * SAMPLE_ROWS / size)
    sample = rows.where(F.pmod(F.xxhash64("id", F.lit(11)), F.lit(1 << 30)) <= F.lit(int(part * (1 << 30)))).orderBy("id").limit(SAMPLE_ROWS).select("id", "v").collect() or rows.orderBy("id").limit(SAMPLE_ROWS).select("id", "v").collect()
    pivots = choose_pivots(_matrix(pd.Series([r["v"] for r in sample])), max(1, min(MOST_PIVOTS, -(-size // most))))
    per = {r["home"]: r for r in rows.mapInPandas(_homes(pivots), "id long, home int, reach double").groupBy("home").agg(F.max("reach").alias("reach"), F.count("*").alias("n")).collect()}
    reach = np.array([per[j]["reach"] if j in per else -np.inf for j in range(len(pivots))])
    slices = np.array([max(1, -(-per[j]["n"] // most)) if j in per else 1 for j in range(len(pivots))])
    kind = dict(rows.dtypes)["v"]
    dealt = rows.withColumn("h", F.pmod(F.xxhash64("id", F.lit(12)), F.lit(1 << 30))).mapInPandas(_dealt(pivots, reach, slices, radius), f"cell int, slice int, member boolean, id long, n long, v {kind}")
    n = int(classes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return dealt.repartition(n, "cell", "slice").sortWithinPartitions("cell", "slice", "member").mapInPandas(_joined(cosine), "a long, b long, links long")


def near_duplicates(embeddings: DataFrame, cosine: float = 0.95, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """One row per input row: key, n_links, component_id, kept.

    n_links: other vectors with a cosine of ``cosine`` or more, in double precision; component_id: the smallest key that links
    reach, itself included; kept: key = component_id. Vectors that are null, empty, zero or hold null or non-finite
    components, and rows with a null key, link with nothing (a null key has null component and isn't kept). Vectors of different
    lengths don't link. Rows with one vector count as copies of each other, also if they share a key. An empty table
    gives no rows.

    Equal vectors are one class from the start, named by a number of its own, so keys may repeat with different vectors. Pivots come from a bounded sample; every vector is dealt to cells. A
    class is counted in its home cell only, which holds all that can be in reach, so no pair is counted twice and no pair list
    is made: a cell gives one count a vector and the edges of a spanning forest. A cell over ``home_rows`` vectors is
    split into slices that each see all its members, in a stream.
    """
    rows = pick(embeddings, key, vector).toDF("id", "v")
    fine = F.col("id").isNotNull() & _valid(F.col("v"))
    grouped = rows.where(fine).groupBy("v").agg(F.min(F.col("id").cast("long")).alias("least"), F.count("*").alias("n"), F.min(F.size("v")).alias("dims"))
    classes = materialize(grouped.withColumn("id", F.monotonically_increasing_id()), "vector-classes")
    found = None
    for r in classes.groupBy("dims").agg(F.count("*").alias("n")).orderBy("dims").collect():
        one = _one_dimension(classes, r["n"], r["dims"], cosine)
        found = one if found is None else found.union(one)
    if found is None:
        return rows.select(F.col("id").alias(key), F.lit(0).cast("long").alias("n_links"), F.col("id").cast("long").alias("component_id"), F.col("id").isNotNull().alias("kept"))
    found = materialize(found, "vector-links")
    counts = found.where("links >= 0").select(F.col("a").alias("i"), "links")
    nodes = connected_components(found.where("links < 0").select("a", "b"))
    # 128 bits of a vector find its class again without moving vectors
    marks = lambda ok: [F.when(ok, F.xxhash64(F.col("v"), F.lit(seed))).alias(f"h{seed}") for seed in (1, 2)]
    linked = classes.select("id", "least", *marks(F.lit(True))).join(counts, F.col("id") == F.col("i")).join(nodes, F.col("i") == F.col("node"), "left")
    linked = materialize(linked.select("least", "links", F.coalesce("component", "i").alias("of"), F.col("h1").alias("c1"), F.col("h2").alias("c2")), "vector-facts")
    smallest = linked.groupBy(F.col("of").alias("o")).agg(F.min("least").alias("component"))
    facts = linked.join(smallest, linked["of"] == smallest["o"]).select("c1", "c2", "links", "component")
    of = rows.select("id", *marks(fine))
    out = of.join(facts, (of["h1"] == facts["c1"]) & (of["h2"] == facts["c2"]), "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("component", F.col("id").cast("long")))
    return out.select(F.col("id").alias(key), F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("id"), F.lit(False)).alias("kept"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def sql() -> str:
    fine = "embedding is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0"
    return f"""
with recursive v as (select vec_id, cast(embedding as double[]) as e from embeddings where vec_id is not null and {fine}),
link as (select x.vec_id as a, y.vec_id as b from v x join v y on x.vec_id <> y.vec_id and len(x.e) = len(y.e) and list_cosine_similarity(x.e, y.e) >= 0.95),
r(a, b) as (select vec_id, vec_id from v union select r.a, link.b from r join link on r.b = link.a),
c as (select a, min(b) as component from r group by 1),
n as (select a, count(*) as links from link group by 1)
select vec_id, coalesce(links, 0)::bigint as n_links, coalesce(component, vec_id)::bigint as component_id,
  coalesce(coalesce(component, vec_id) = vec_id, false) as kept
from embeddings left join c on c.a = vec_id left join n on n.a = vec_id
"""
