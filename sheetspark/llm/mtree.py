"""Exact top-k search by inner product in a paged M-tree, best first.

Equal vectors are one entry with its k + 1 smallest ids. Entries are dealt to shards by the nearest of at most
``PIVOTS`` routing objects of a bounded sample; a routing object with more than ``SHARD_BYTES`` of vectors has several
shards, dealt by hash, so no shard grows with the table. Each shard is an M-tree stored as pages, a row each: a routing
page holds, for each child, its routing object, its covering radius, its distance to the page's own routing object and
the child's page; a leaf page holds vectors with their distances to the page's routing object.

The metric is the Euclidean distance d. For a query q and anything x within the ball of c and r, q.x <= q.c + |q| r; and
as d(c, p) is stored for the parent p, q.c <= q.p + |q| d(c, p) without q.c being computed. Pages are taken from a heap by
their bounds; a query leaves out what has a bound below its k-th score found, so the result is exact. Queries of a shard go
down its tree together, so that a page's products are one of matrices. Every query first searches a shard of its nearest routing object; with the k-th score from there it goes on, in blocks with others,
only into shards whose bound reaches it. A shard that many queries visit is searched by several tasks.

Defined cases: vectors that are null or hold null or non-finite components, and rows without an id, take no part; scores
are between vectors of equal length (empty ones score 0); rows of equal id and vector count once, rows of equal id and
different vectors are rows of their own, each with its own results; ties go to the smaller id; a score beyond the range of
a long is held at its end; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .storage import discard, keep, small_batches

K = 10
#: Routing objects at the top are chosen from at most so many vectors and bytes, one for ``SHARD_ROWS`` vectors.
SAMPLE, SAMPLE_BYTES, PIVOTS, SHARD_ROWS = 20_000, 32 << 20, 1024, 4096
#: Bytes of the vectors of one shard; entries of a leaf page and of a routing page; queries of one task and shard, and of
#: them those that go down the tree together.
SHARD_BYTES, LEAF, FANOUT, CHUNK, TOGETHER = 16 << 20, 64, 16, 20_000, 1024
EXACT = float(1 << 53)
LOW, HIGH = -(1 << 63), (1 << 63) - 1

PAGE = "dim int, pivot int, part int, page int, leaf boolean, n int, objects binary, radii binary, distances binary, children binary, ids array<array<long>>"
BLOCK = "dim int, pivot int, block long, n int, qs binary, floors binary, homes binary, vectors binary"
FOUND = "q long, score long, id long, same boolean"


def distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore", invalid="ignore"):
        return np.nan_to_num(np.sqrt(((x - c) ** 2).sum(-1)), nan=np.inf, posinf=np.inf)


# ---- the tree of a shard


def bulk_load(x: np.ndarray, ids: list, pivot: np.ndarray, rng: np.random.Generator) -> list[dict]:
    """Pages of an M-tree over rows of ``x`` below the routing object ``pivot``; page 0 is the root. Groups are split by
    the nearest of ``FANOUT`` of their own members until they fit a leaf."""
    pages: list[dict] = []
    todo = [(np.arange(len(x)), pivot, None, 0)]
    while todo:
        rows, centre, parent, slot = todo.pop()
        if parent is not None:
            pages[parent]["children"][slot] = len(pages)
        at = len(pages)
        if len(rows) <= LEAF:
            pages.append({"leaf": True, "objects": x[rows], "radii": np.zeros(0), "distances": distances(x[rows], centre), "children": np.zeros(0, np.int32), "ids": [ids[i] for i in rows.tolist()]})
            continue
        seeds = x[rng.choice(rows, FANOUT, replace=False)]
        with np.errstate(over="ignore", invalid="ignore"):
            near = np.nan_to_num((seeds**2).sum(1)[None, :] - 2 * (x[rows] @ seeds.T)).argmin(1)
        used = np.unique(near)
        if len(used) == 1:  # distances that overflow or round alike tell nothing: split evenly
            near, used = np.arange(len(rows)) % FANOUT, np.arange(FANOUT)
        radii = np.array([distances(x[rows[near == j]], seeds[j]).max() for j in used])
        pages.append({"leaf": False, "objects": seeds[used], "radii": radii, "distances": distances(seeds[used], centre), "children": np.zeros(len(used), np.int32), "ids": []})
        todo += [(rows[near == j], seeds[j], at, i) for i, j in enumerate(used.tolist())]
    return pages


@dataclass
class Tree:
    """A shard's pages, read back."""

    pages: dict[int, tuple]
    pivot: np.ndarray
    radius: float
    reach: float  # of the longest vector

    @classmethod
    def read(cls, pdf: pd.DataFrame, pivot: np.ndarray) -> Tree:
        pages, dim, radius, reach = {}, len(pivot), 0.0, 0.0
        for r in pdf.itertuples():
            x = np.frombuffer(r.objects).reshape(r.n, dim)
            radii, dist = np.frombuffer(r.radii), np.frombuffer(r.distances)
            pages[r.page] = (r.leaf, x, radii, dist, np.frombuffer(r.children, np.int32), r.ids)
            if r.page == 0:
                radius = float((dist + (0 if r.leaf else radii)).max()) if r.n else 0.0
            if r.leaf and r.n:
                with np.errstate(over="ignore"):
                    reach = max(reach, float(np.sqrt((x**2).sum(1).max())))
        return cls(pages, pivot, radius, reach)

    def search(self, q: np.ndarray, k: int, floor: int = LOW, seen: list | None = None) -> list[tuple[int, int, bool]]:
        """:meth:`search_all` of one query."""
        return self.search_all(q[None, :], k, [floor], seen)[0]

    def search_all(self, qs: np.ndarray, k: int, floors: list[int], seen: list | None = None) -> list[list[tuple[int, int, bool]]]:
        """For each row of ``qs`` the best k (score, id, whether it has the query's own vector) that reach its floor, best
        first. A page is opened once for all queries whose bound reaches it then, the page of the highest bound first.
        ``seen`` gets the number of products computed with what pages hold."""
        best: list[list[tuple[int, int, bool]]] = [[] for _ in floors]
        kth, work = np.array(floors, np.float64), 0
        with np.errstate(over="ignore", invalid="ignore"):
            length = np.sqrt((qs**2).sum(1))
            small = length * self.reach < EXACT  # then products in double precision are exact
            slack = 1 + 1e-12 * length * (self.reach + self.radius)
            heap = [(-np.inf, 0, np.arange(len(qs)), np.full(len(qs), np.inf), qs @ self.pivot)]
            while heap:
                _, number, own, bound, parent = heapq.heappop(heap)
                still = ~(bound + slack[own] < kth[own])
                own, parent = own[still], parent[still]
                leaf, x, radii, dist, children, ids = self.pages[number]
                far = parent[:, None] + length[own, None] * (dist if leaf else dist + radii)[None, :]
                need = ~(far + slack[own, None] < kth[own, None])
                rows, at = np.flatnonzero(need.any(1)), np.flatnonzero(need.any(0))
                if not len(rows):
                    continue
                own, need = own[rows], need[np.ix_(rows, at)]
                work += len(rows) * len(at)
                products = qs[own] @ x[at].T
                if leaf:
                    for i in np.flatnonzero(((products >= kth[own, None]) & need).any(1) | ~small[own]).tolist():
                        q = own[i]
                        if small[q]:
                            hits = np.flatnonzero((products[i] >= kth[q]) & need[i])
                            scores = products[i, hits].astype(np.int64).tolist()
                        else:
                            hits, w = np.flatnonzero(need[i]), [int(c) for c in qs[q].tolist()]
                            scores = [min(HIGH, max(LOW, sum(a * int(b) for a, b in zip(w, v)))) for v in x[at[hits]].tolist()]
                        least = best[q][-1][0] if len(best[q]) == k else floors[q]
                        fresh = [(s, j, same) for s, n in zip(scores, at[hits].tolist()) if s >= least for same in [bool((x[n] == qs[q]).all())] for j in ids[n]]
                        if fresh:
                            best[q] = sorted(best[q] + fresh, key=lambda t: (-t[0], t[1]))[:k]
                            if len(best[q]) == k:
                                kth[q] = max(kth[q], best[q][-1][0])
                else:
                    up = np.nan_to_num(products + length[own, None] * radii[at][None, :], nan=np.inf)
                    reach = need & ~(up + slack[own, None] < kth[own, None])
                    for j, child in enumerate(children[at].tolist()):
                        on = np.flatnonzero(reach[:, j])
                        if len(on):
                            heapq.heappush(heap, (-float(up[on, j].max()), child, own[on], up[on, j], products[on, j]))
        if seen is not None:
            seen.append(work)
        return best


# ---- over all shards


def _nearest_pivot(pivots: dict[int, np.ndarray]):
    """Rows (dim, vec, ...) to (dim, pivot, d, vec, ...)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for dim, own in pdf.groupby("dim"):
                x, p = np.stack(own["vec"].to_list()).reshape(len(own), dim), pivots.get(dim, np.zeros((1, dim)))
                with np.errstate(over="ignore", invalid="ignore"):
                    at = np.nan_to_num((p**2).sum(1)[None, :] - 2 * (x @ p.T)).argmin(1)
                yield own.assign(pivot=at.astype(np.int32), d=distances(x, p[at]))

    return run


def _build(pivots: dict[int, np.ndarray]):
    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        dim, pivot, part = key
        x = np.stack(pdf["vec"].to_list()).reshape(len(pdf), dim)
        order = np.argsort([i[0] for i in pdf["ids"]], kind="stable")  # the same tree whatever the order of rows
        ids = pdf["ids"].to_list()
        made = bulk_load(x[order], [ids[i] for i in order.tolist()], pivots.get(dim, np.zeros((1, dim)))[pivot], np.random.default_rng(7))
        return pd.DataFrame([{"dim": dim, "pivot": pivot, "part": part, "page": n, "leaf": p["leaf"], "n": len(p["objects"]), "objects": p["objects"].astype(np.float64).tobytes(), "radii": p["radii"].tobytes(), "distances": p["distances"].tobytes(), "children": p["children"].tobytes(), "ids": p["ids"]} for n, p in enumerate(made)])

    return run


def _blocks(pivots: dict[int, np.ndarray], radius: dict[int, np.ndarray] | None):
    """Packs queries (dim, q, vec, pivot, home, floor) by the routing objects they go to: their own one without ``radius``,
    else all whose bound reaches their floor."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for dim, own in pdf.groupby("dim"):
                x = np.stack(own["vec"].to_list()).reshape(len(own), dim)
                q, floor, home, mine = (own[c].to_numpy(np.int64) for c in ("q", "floor", "home", "pivot"))
                if radius is None:
                    go = {int(p): np.flatnonzero(mine == p) for p in np.unique(mine)}
                else:
                    p, r = pivots.get(dim, np.zeros((1, dim))), radius.get(dim)
                    with np.errstate(over="ignore", invalid="ignore"):
                        length = np.sqrt((x**2).sum(1))
                        r = np.full(len(p), np.inf) if r is None else r
                        bound = x @ p.T + length[:, None] * r[None, :]
                        bound += 1 + 1e-12 * length[:, None] * (np.sqrt((p**2).sum(1)) + np.where(r < 0, 0, r))[None, :]
                        away = (bound < floor[:, None]) | (r < 0)[None, :]
                    go = {j: np.flatnonzero(~away[:, j]) for j in range(len(p))}
                for p, at in go.items():
                    if len(at):
                        away_home = np.where(mine[at] == p, home[at], -1)
                        out.append((dim, p, int(q[at[0]]), len(at), q[at].tobytes(), floor[at].tobytes(), away_home.tobytes(), x[at].astype(np.float64).tobytes()))
            yield pd.DataFrame(out, columns=["dim", "pivot", "block", "n", "qs", "floors", "homes", "vectors"])

    return run


def _search(pivots: dict[int, np.ndarray], k: int, first: bool):
    """Queries of blocks in one shard. The first time only those at home there, later all others."""

    def run(key, pages: pd.DataFrame, blocks: pd.DataFrame) -> pd.DataFrame:
        dim, pivot, part, _ = key
        out: list[tuple[int, int, int, bool]] = []
        if len(pages) and len(blocks):
            tree = Tree.read(pages, pivots.get(dim, np.zeros((1, dim)))[pivot])
            qs, floors, homes = (np.concatenate([np.frombuffer(v, np.int64) for v in blocks[c]]) for c in ("qs", "floors", "homes"))
            x = np.concatenate([np.frombuffer(b.vectors).reshape(b.n, dim) for b in blocks.itertuples()])
            mine = np.flatnonzero((homes == part) == first)
            for i in range(0, len(mine), TOGETHER):
                some = mine[i : i + TOGETHER]
                for q, hits in zip(qs[some].tolist(), tree.search_all(x[some], k, floors[some].tolist())):
                    out += [(q, *hit) for hit in hits]
        return pd.DataFrame(out, columns=["q", "score", "id", "same"]).astype({"q": "int64", "score": "int64", "id": "int64", "same": "bool"})

    return run


SHARD = ["dim", "pivot", "part"]


class MTree:
    """An index over all rows of ``vectors(id, vec)``; ``vec`` holds whole numbers as doubles. Pages stay in the shared
    folder until :meth:`discard`."""

    def __init__(self, vectors: DataFrame, k: int = K):
        """``k``: the most results a search may ask for."""
        spark = vectors.sparkSession
        self.k = k
        good = vectors.where("id is not null").groupBy("vec", "id").agg(F.lit(1).alias("one"))
        least = good.withColumn("turn", F.row_number().over(Window.partitionBy("vec").orderBy("id"))).where(F.col("turn") <= k + 1)
        classes = least.groupBy("vec").agg(F.array_sort(F.collect_list("id")).alias("ids")).select(F.size("vec").alias("dim"), "vec", "ids")
        classes = keep(classes, "classes")
        counts = {r["dim"]: r["n"] for r in classes.groupBy("dim").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "dim").limit(SAMPLE).collect()}
        widest = max(counts, default=1) or 1
        taken = classes.orderBy(F.xxhash64("vec"), "ids").limit(max(256, min(SAMPLE, SAMPLE_BYTES // (8 * widest)))).select("dim", "vec").toPandas()
        self.pivots: dict[int, np.ndarray] = {}
        for dim, own in taken.groupby("dim"):
            wanted = min(PIVOTS, -(-counts.get(dim, 1) // SHARD_ROWS))
            self.pivots[int(dim)] = np.stack(own["vec"].to_list()).reshape(len(own), int(dim))[:wanted].astype(np.float64)
        dealt = keep(classes.mapInPandas(_nearest_pivot(self.pivots), "dim int, vec array<double>, ids array<long>, pivot int, d double"), "dealt")
        discard(classes)
        self._kept: list[DataFrame] = []
        rows = F.greatest(F.lit(256), F.lit(SHARD_BYTES) / (8 * F.greatest("dim", F.lit(1))))
        self.sizes = keep(dealt.groupBy("dim", "pivot").agg(F.count("*").alias("n"), F.max("d").alias("radius")).withColumn("parts", F.ceil(F.col("n") / rows).cast("int")), "sizes")
        placed = dealt.join(self.sizes.select("dim", "pivot", "parts"), ["dim", "pivot"]).withColumn("part", F.pmod(F.xxhash64("vec"), "parts").cast("int"))
        self.pages = keep(placed.select(*SHARD, "vec", "ids").groupBy(*SHARD).applyInPandas(_build(self.pivots), PAGE), "pages")
        discard(dealt)
        self.radius = {d: np.full(len(p), -1.0) for d, p in self.pivots.items()}  # -1: nothing there
        for r in self.sizes.where(F.col("dim").isin(*self.pivots) if self.pivots else F.lit(False)).collect():
            self.radius[r["dim"]][r["pivot"]] = r["radius"]

    def _round(self, blocks: DataFrame, k: int, first: bool) -> DataFrame:
        """(q, score, id) from the shards of the blocks' routing objects; hot shards are searched in several tasks."""
        blocks = keep(blocks, "blocks")
        visits = blocks.groupBy("dim", "pivot").agg(F.sum("n").alias("queries")).join(self.sizes, ["dim", "pivot"])
        visits = visits.select("dim", "pivot", "parts", F.ceil(F.col("queries") / CHUNK).cast("int").alias("chunks"))
        to = blocks.join(visits, ["dim", "pivot"]).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        to = to.withColumn("chunk", F.pmod(F.xxhash64("block", "part"), "chunks").cast("int")).drop("parts", "chunks")
        pages = self.pages.join(visits.select("dim", "pivot", "chunks"), ["dim", "pivot"]).withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).drop("chunks")
        by = [*SHARD, "chunk"]
        found = keep(pages.groupBy(*by).cogroup(to.groupBy(*by)).applyInPandas(_search(self.pivots, k, first), FOUND), "found")
        discard(blocks)
        self._kept.append(found)
        return found

    def search(self, queries: DataFrame, k: int | None = None) -> DataFrame:
        """The ``k`` best of all rows for each row of ``queries(q, vec)``, q being unique: (q, results), best first; a query
        itself is not left out. Queries of a length that no vector has get no row."""
        k = self.k if k is None else k
        if k > self.k + 1:
            raise ValueError(f"the index is for at most {self.k + 1} results")
        by = Window.partitionBy("q").orderBy(F.desc("score"), "id")
        best = lambda found: found.withColumn("turn", F.row_number().over(by)).where(F.col("turn") <= k)
        rows = queries.select(F.size("vec").alias("dim"), "vec", "q")
        at = rows.mapInPandas(_nearest_pivot(self.pivots), "dim int, vec array<double>, q long, pivot int, d double").drop("d")
        at = keep(at.join(self.sizes.select("dim", "pivot", "parts"), ["dim", "pivot"]).withColumn("home", F.pmod("q", "parts").cast("int")).drop("parts"), "queries")
        self._kept.append(at)
        early = self._round(at.withColumn("floor", F.lit(LOW)).mapInPandas(_blocks(self.pivots, None), BLOCK), k, True)
        floors = best(early).where(F.col("turn") == k).select("q", F.col("score").alias("floor"))
        held = at.join(floors, "q", "left").withColumn("floor", F.coalesce("floor", F.lit(LOW)))
        late = self._round(held.mapInPandas(_blocks(self.pivots, self.radius), BLOCK), k, False)
        both = best(early.unionByName(late))
        return both.groupBy("q").agg(F.array_sort(F.collect_list(F.struct("turn", "score", "id", "same"))).alias("results"))

    def discard(self) -> None:
        """Deletes the pages and whatever searches have kept."""
        for df in (self.pages, self.sizes, *self._kept):
            discard(df)


def whole_numbers(vectors: DataFrame, scale: int = 1024) -> DataFrame:
    """``vectors(vec_id, embedding)`` to (id, vec): floor(scale * x) of each component as a double; rows that take no part
    are left out."""
    scaled = F.transform(F.col("embedding").cast("array<double>"), lambda x: x * scale)
    floored = F.transform("vec", lambda y: F.when(F.abs(y) < float(1 << 52), F.floor(y).cast("double")).otherwise(y))
    fine = F.forall("vec", lambda y: y.isNotNull() & ~F.isnan(y) & (F.abs(y) < F.lit(float("inf"))))
    rows = vectors.select(F.col("vec_id").cast("long").alias("id"), scaled.alias("vec"))
    return rows.where("id is not null and vec is not null").where(F.coalesce(fine, F.lit(False))).select("id", floored.alias("vec"))


def top_k(vectors: DataFrame, queries: DataFrame, k: int = K) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row of ``queries(id, vec)`` the ``k`` rows of ``vectors(id, vec)`` with the
    highest inner product, other than itself."""
    small_batches(vectors.sparkSession)
    index = MTree(vectors, k)
    asked = queries.where("id is not null").distinct()
    texts = keep(asked.groupBy("vec").agg(F.lit(1).alias("one")).select("vec", F.monotonically_increasing_id().alias("q")), "asked")
    found = index.search(texts, k + 1)
    every = asked.join(texts, "vec").join(found, "q")
    others = F.filter("results", lambda r: ~(r["same"] & (r["id"] == F.col("id"))))
    out = every.select(F.col("id").alias("query_id"), F.posexplode(F.slice(others, 1, k)).alias("pos", "r"))
    out = keep(out.select("query_id", (F.col("pos") + 1).alias("rank"), F.col("r.id").alias("vec_id"), F.col("r.score").alias("score")), "top")
    index.discard()
    discard(texts)
    return out


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best of all ``embeddings`` for every hundredth id."""
    rows = whole_numbers(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return top_k(rows, rows.where(F.col("id") % 100 == 0))


OP12_SQL = f"""
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS x FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND list_aggregate(list_transform(embedding, lambda c: CASE WHEN c IS NULL OR NOT isfinite(c) THEN 1 ELSE 0 END), 'sum') = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.x, c.x) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id AND len(c.x) = len(q.x)),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT * FROM r WHERE rank <= {K}
"""
