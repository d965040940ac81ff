"""Near-duplicate vectors by a robust-pruned flat graph.

Vectors of a label are dealt to overlapping shards: every vector belongs to the shards of its nearest centroids, the
nearest being its home. Each shard inserts its vectors in growing batches into a graph whose neighbour lists are pruned
robustly (a candidate goes if a chosen neighbour is nearer to it by a factor). The adjacency lists of a vector's shards
are united into one flat graph. Every vector then searches its shards from their medoids: a greedy beam, then expansion
through everything within range, so a query collects all of a tight group and not only a beam's width. Expansion does
not end at a shard: what a query finds also belongs to other shards, and the query goes on into each of those that it
has not searched, round by round until none is left, so a group that is split into many shards is walked as a whole.
What is found is verified by cosine in double precision and counted at the home of the vector found, so nothing counts
twice and no list of pairs is made: a shard returns a number for each query and a forest of its links. Equal vectors are
one class.

An audit compares a sample of queries, half of them with links, with brute force over all rows; below ``RECALL`` the
search is repeated with more shards a vector and wider beams, and if the last attempt is below it too, all pairs of a
label are compared.

Defined cases: vectors that are null, empty, zero or hold null or non-finite components, and rows without a label, link
with nothing; vectors of different lengths are never compared; repeated rows are rows of their own (with equal ids they
share one result); an empty table gives an empty table; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.closure import components
from .storage import keep, small_batches

THRESHOLD = 0.93
#: Vectors a shard aims at; beyond ``LARGEST`` vectors a shard is searched in parts, and by so many queries at a time.
TARGET, LARGEST = 400, 6000
#: Centroids are fitted on at most so many vectors.
FIT_SAMPLE = 20_000
SHARDS_EACH = 2
DEGREE, BEAM, ALPHA = 24, 48, 1.2
AUDIT, RECALL = 200, 0.97
ATTEMPTS = 3
#: Vectors of a block where all pairs are compared.
BLOCK = 4000


# ---- one shard's graph


def _top(sim: np.ndarray, ids: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    if sim.shape[1] > width:
        at = np.argpartition(-sim, width - 1, axis=1)[:, :width]
        sim, ids = np.take_along_axis(sim, at, 1), np.take_along_axis(ids, at, 1)
    by = np.argsort(-sim, axis=1, kind="stable")
    return np.take_along_axis(sim, by, 1), np.take_along_axis(ids, by, 1)


def robust_prune(x: np.ndarray, of: np.ndarray, ids: np.ndarray, degree: int, alpha: float) -> np.ndarray:
    """For each point of ``of`` the neighbours chosen among candidates ``ids`` (rows, -1 where none), nearest first; a
    candidate goes once a chosen neighbour is ``alpha`` times nearer to it than the point is. Places that stay free are
    filled with the nearest of those that went: around the centre of a tight group all but the centre would go, and
    expansion within range could not walk from one member to the next."""
    sim = np.einsum("bcd,bd->bc", x[ids], x[of])
    sim[(ids < 0) | (ids == of[:, None])] = -np.inf
    by = np.argsort(-sim, axis=1, kind="stable")
    sim, ids = np.take_along_axis(sim, by, 1), np.take_along_axis(ids, by, 1)
    same = np.zeros_like(ids, bool)  # candidates listed twice
    order = np.argsort(ids, axis=1, kind="stable")
    s = np.take_along_axis(ids, order, 1)
    np.put_along_axis(same, order[:, 1:], s[:, 1:] == s[:, :-1], 1)
    alive = (sim > -np.inf) & ~same
    dist = 2 - 2 * sim
    spare = alive.copy()
    out = np.full((len(of), degree), -1)
    rows = np.arange(len(of))
    for k in range(degree):
        if not alive.any():
            break
        pick = alive.argmax(1)
        ok = alive[rows, pick]
        chosen = np.where(ok, ids[rows, pick], -1)
        out[:, k] = chosen
        between = 2 - 2 * np.einsum("bcd,bd->bc", x[ids], x[chosen])
        alive &= ~((alpha * between <= dist) & ok[:, None])
        alive[rows, pick] = False
        spare[rows[ok], pick[ok]] = False
    free = (out < 0).sum(1)
    rank = np.cumsum(spare, axis=1)
    r, c = np.nonzero(spare & (rank <= free[:, None]))
    out[r, degree - free[r] + rank[r, c] - 1] = ids[r, c]
    return out


def beam_search(x: np.ndarray, adj: np.ndarray, start: int, queries: np.ndarray, beam: int, loose: float = np.inf):
    """All queries at once: nodes of the beams, which nodes each query has seen, and (query rows, nodes) of all that
    was seen within ``loose``, in a beam or not."""
    b = len(queries)
    rows = np.arange(b)
    seen = np.zeros((b, len(x)), bool)
    seen[:, start] = True
    ids = np.full((b, beam), -1)
    sim = np.full((b, beam), -np.inf, np.float32)
    done = np.ones((b, beam), bool)
    ids[:, 0], sim[:, 0], done[:, 0] = start, queries @ x[start], False
    near = np.flatnonzero(sim[:, 0] >= loose)
    hit_q, hit_n = [near], [np.full(len(near), start)]
    while True:
        open_ = ~done
        live = np.flatnonzero(open_.any(1))
        if not len(live):
            return ids, seen, np.concatenate(hit_q), np.concatenate(hit_n)
        at = open_[live].argmax(1)
        done[live, at] = True
        nxt = adj[ids[live, at]]
        fresh = (nxt >= 0) & ~seen[live[:, None], nxt]
        if not fresh.any():
            continue
        r = np.repeat(live, nxt.shape[1]).reshape(nxt.shape)
        seen[r[fresh], nxt[fresh]] = True
        s = np.where(fresh, np.einsum("bcd,bd->bc", x[nxt], queries[live]), -np.inf).astype(np.float32)
        if loose < np.inf:
            i, j = np.nonzero(s >= loose)
            hit_q.append(live[i])
            hit_n.append(nxt[i, j])
        all_sim = np.concatenate([sim[live], s], 1)
        by = np.argsort(-all_sim, axis=1, kind="stable")[:, :beam]
        sim[live] = np.take_along_axis(all_sim, by, 1)
        ids[live] = np.take_along_axis(np.concatenate([ids[live], nxt], 1), by, 1)
        done[live] = np.take_along_axis(np.concatenate([done[live], ~fresh], 1), by, 1)


def medoid(x: np.ndarray) -> int:
    return int(np.argmax(x @ x.mean(0)))


def build(x: np.ndarray, degree: int = DEGREE, beam: int = BEAM, alpha: float = ALPHA, most: int = 256) -> np.ndarray:
    """Neighbour lists (n, degree) of unit vectors, -1 where there is none."""
    n = len(x)
    adj = np.full((n, degree), -1)
    if n < 2:
        return adj
    start = medoid(x)
    order = np.random.default_rng(n).permutation(n)
    order = np.concatenate([[start], order[order != start]])
    at, size = 1, 8
    while at < n:
        batch = order[at : at + size]
        ids = beam_search(x, adj, start, x[batch], beam)[0]
        near = x[batch] @ x[batch].T
        np.fill_diagonal(near, -np.inf)
        _, mates = _top(near, np.broadcast_to(batch, near.shape), min(16, len(batch)))
        adj[batch] = robust_prune(x, batch, np.concatenate([ids, mates], 1), degree, alpha)
        _add_back(x, adj, batch, degree, alpha)
        at += len(batch)
        size = min(2 * size, most)
    return adj


def _add_back(x: np.ndarray, adj: np.ndarray, batch: np.ndarray, degree: int, alpha: float) -> None:
    """The reverse of the batch's new edges; lists that overflow are pruned again, their nearest comers first."""
    to = adj[batch].ravel()
    frm = np.repeat(batch, adj.shape[1])[to >= 0]
    to = to[to >= 0]
    if not len(to):
        return
    near = np.einsum("nd,nd->n", x[to], x[frm])
    by = np.lexsort((-near, to))
    to, frm = to[by], frm[by]
    first = np.flatnonzero(np.append(True, to[1:] != to[:-1]))
    place = np.arange(len(to)) - np.repeat(first, np.diff(np.append(first, len(to))))
    keep_ = place < 2 * degree
    nodes = to[first]
    comers = np.full((len(nodes), 2 * degree), -1)
    comers[np.repeat(np.arange(len(nodes)), np.diff(np.append(first, len(to))))[keep_], place[keep_]] = frm[keep_]
    for a in range(0, len(nodes), 512):
        some = nodes[a : a + 512]
        both = np.concatenate([adj[some], comers[a : a + 512]], 1)
        full = (both >= 0).sum(1) > degree
        if full.any():
            adj[some[full]] = robust_prune(x, some[full], both[full], degree, alpha)
        if not full.all():
            rest = both[~full]
            rest = np.take_along_axis(rest, np.argsort(rest < 0, axis=1, kind="stable"), 1)[:, :degree]
            adj[some[~full]] = rest


def both_ways(adj: np.ndarray, most: int = DEGREE) -> np.ndarray:
    """The lists with up to ``most`` nodes more, of those that point to the node: none stays without a way in."""
    n, width = adj.shape
    frm, to = np.repeat(np.arange(n), width), adj.ravel()
    frm, to = frm[to >= 0], to[to >= 0]
    one_way = ~np.isin(frm * n + to, to * n + frm)
    frm, to = frm[one_way], to[one_way]
    by = np.lexsort((frm, to))
    frm, to = frm[by], to[by]
    first = np.flatnonzero(np.append(True, to[1:] != to[:-1])) if len(to) else np.zeros(0, np.int64)
    place = np.arange(len(to)) - np.repeat(first, np.diff(np.append(first, len(to))))
    # a node that few point to comes before one that many do
    weight = np.bincount(adj[adj >= 0], minlength=n)
    by = np.lexsort((weight[frm], to))
    frm = frm[by]
    more = np.full((n, most), -1)
    ok = place < most
    more[to[ok], place[ok]] = frm[ok]
    return np.concatenate([adj, more], 1)


def range_search(x: np.ndarray, adj: np.ndarray, start: int, queries: np.ndarray, radius: float, beam: int):
    """Yields (query rows, nodes) within ``radius`` (a little widened), block by block of queries."""
    loose = radius - 1e-4
    for a in range(0, len(queries), 256):
        q = queries[a : a + 256]
        _, seen, fq, fn = beam_search(x, adj, start, q, beam, loose)
        found_q, found_n = [fq], [fn]
        while len(fq):
            nxt = adj[fn]
            qq = np.repeat(fq, nxt.shape[1])
            nn = nxt.ravel()
            ok = (nn >= 0) & ~seen[qq, nn]
            pair = np.unique(qq[ok].astype(np.int64) * len(x) + nn[ok])
            qq, nn = pair // len(x), pair % len(x)
            seen[qq, nn] = True
            near = np.einsum("nd,nd->n", x[nn], q[qq]) >= loose
            fq, fn = qq[near], nn[near]
            found_q.append(fq)
            found_n.append(fn)
        pair = np.unique(np.concatenate(found_q).astype(np.int64) * len(x) + np.concatenate(found_n))
        yield pair // len(x) + a, pair % len(x)


# ---- distributed


def _unit(rows) -> np.ndarray:
    x = np.stack([np.asarray(r, np.float64) for r in rows])
    return x / np.linalg.norm(x, axis=1)[:, None]


def fit_centroids(sample: pd.DataFrame, total: int, rounds: int = 8) -> dict[tuple[int, int], np.ndarray]:
    """Centroids of each (label, length) by spherical k-means on a bounded sample; their number follows the share of
    rows the sample shows."""
    out = {}
    for key, own in sample.groupby(["label", "dim"]):
        x = _unit(own["vec"]).astype(np.float32)
        k = int(np.clip(round(len(x) / len(sample) * total / TARGET), 1, max(1, len(x) // 10)))
        c = x[np.random.default_rng(5).choice(len(x), k, replace=False)]
        for _ in range(rounds):
            own_c = (x @ c.T).argmax(1)
            sums = np.zeros_like(c)
            np.add.at(sums, own_c, x)
            norm = np.linalg.norm(sums, axis=1)
            c = np.where(norm[:, None] > 0, sums / np.maximum(norm, 1e-12)[:, None], c)
        out[int(key[0]), int(key[1])] = c
    return out


DEALT = "label int, dim int, shard int, id long, hv long, vec {vec}, mult long, home boolean, shards array<int>"


def _deal(shared, each: int, wide: bool):
    """Rows of the shards of each vector; ``shards`` are all of them. ``wide``: components are doubles."""
    component = pa.float64() if wide else pa.float32()
    schema = pa.schema([("label", pa.int32()), ("dim", pa.int32()), ("shard", pa.int32()), ("id", pa.int64()), ("hv", pa.int64()), ("vec", pa.list_(component)), ("mult", pa.int64()), ("home", pa.bool_()), ("shards", pa.list_(pa.int32()))])

    def run(batches):
        centroids = shared.value
        for batch in batches:
            pdf = batch.to_pandas()
            parts = []
            for key, own in pdf.groupby(["label", "dim"]):
                c = centroids.get((int(key[0]), int(key[1])))
                if c is None or len(c) == 1:
                    by = np.zeros((len(own), 1), np.int32)
                else:
                    sim = _unit(own["vec"]).astype(np.float32) @ c.T
                    by = np.argsort(-sim, axis=1, kind="stable")[:, :each].astype(np.int32)
                for k in range(by.shape[1]):
                    parts.append(own.assign(shard=by[:, k], home=k == 0, shards=list(by)))
            if parts:
                yield pa.RecordBatch.from_pandas(pd.concat(parts)[schema.names], schema=schema, preserve_index=False)

    return run


KEYS = ["label", "dim", "shard", "part"]


def _build(pdf: pd.DataFrame) -> pd.DataFrame:
    nodes = pdf[pdf["node"]].sort_values("id", kind="stable")
    adj = build(_unit(nodes["vec"]).astype(np.float32)) if len(nodes) else np.zeros((0, 1), int)
    ids = nodes["id"].to_numpy(np.int64)
    return pd.DataFrame({"id": ids, "neighbours": [ids[a[a >= 0]] for a in adj]})


FOUND = "label int, dim int, id long, hv long, links long, root long, more array<int>"


def _search(beam: int, threshold: float):
    """Rows that ask search the graph of those that are nodes: numbers of links, a forest of them, and the other shards
    of what each has found (``more``)."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["node", "id"], ascending=[False, True], kind="stable").reset_index(drop=True)
        ids = pdf["id"].to_numpy(np.int64)
        n = int(pdf["node"].sum())
        asks = pdf["asks"].to_numpy(bool)
        full = _unit(pdf["vec"])
        x = full.astype(np.float32)
        lists = pdf["neighbours"].tolist()[:n]
        width = max([1, *(len(a) for a in lists if a is not None)])
        adj = np.full((n, width), -1)
        own = ids[:n]
        for i, a in enumerate(lists):
            if a is not None and len(a):
                at = np.minimum(np.searchsorted(own, a), n - 1)
                at = at[own[at] == a]  # neighbours of other shards are met there
                adj[i, : len(at)] = at
        adj = both_ways(adj)
        links = np.zeros(len(pdf), np.int64)
        root = np.arange(len(pdf))
        more = [[] for _ in range(len(pdf))]
        if n and asks.any():
            home, mult = pdf["home"].to_numpy(bool)[:n], pdf["mult"].to_numpy(np.int64)[:n]
            here, shards = int(pdf["shard"].iloc[0]), np.stack(pdf["shards"].tolist()[:n]).astype(np.int64)
            base = int(shards.max()) + 1
            raw = np.stack([np.asarray(v, np.float64) for v in pdf["vec"]])
            norm = np.linalg.norm(raw, axis=1)
            asking = np.flatnonzero(asks)
            for q, t in range_search(x[:n], adj, medoid(x[:n]), x[asking], threshold, beam):
                q = asking[q]
                cosine = np.einsum("nd,nd->n", raw[q], raw[t]) / (norm[q] * norm[t])
                ok = (cosine >= threshold) & (ids[q] != own[t])
                q, t = q[ok], t[ok]
                np.add.at(links, q, np.where(home[t], mult[t], 0))
                unite(root, q, t)
                to = np.unique(np.concatenate([q * base + shards[t, k] for k in range(shards.shape[1])]))
                for i, s in zip((to // base).tolist(), (to % base).tolist()):
                    if s != here:
                        more[i].append(s)
        out = pdf[["label", "dim", "id", "hv"]].assign(links=links, root=ids[root], more=more)
        return out[asks | (root != np.arange(len(pdf)))]

    return run


def unite(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Joins the trees of the pairs (a, b); every row points to the first row of its tree, before and after."""
    while True:
        ra, rb = root[a], root[b]
        apart = ra != rb
        if not apart.any():
            return
        a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
        np.minimum.at(root, np.maximum(ra, rb), np.minimum(ra, rb))
        while True:
            up = root[root]
            if (up == root).all():
                break
            root[:] = up


def flat_graph(dealt: DataFrame) -> DataFrame:
    """(id, neighbours): the united adjacency lists of each vector's shards."""
    made = dealt.groupBy(*KEYS).applyInPandas(_build, "id long, neighbours array<long>")
    return made.groupBy("id").agg(F.array_distinct(F.flatten(F.collect_list("neighbours"))).alias("neighbours"))


ROW = [*KEYS, "chunk", "id", "hv", "vec", "mult", "home", "shards", "neighbours", "node", "asks"]


def _round(classes: DataFrame, centroids: dict, each: int, beam: int, threshold: float) -> DataFrame:
    spark = classes.sparkSession
    shared = spark.sparkContext.broadcast(centroids)  # of a bounded sample
    vec = dict(classes.dtypes)["vec"]
    dealt = keep(classes.mapInArrow(_deal(shared, each, vec == "array<double>"), DEALT.format(vec=vec)), "dealt")
    parts = keep(dealt.groupBy("label", "dim", "shard").agg(F.ceil(F.count("*") / LARGEST).cast("int").alias("parts")), "parts")
    own = F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")
    numbered = dealt.join(parts, ["label", "dim", "shard"])
    nodes = numbered.withColumn("part", own).withColumn("node", F.lit(True)).drop("parts")
    graph = keep(flat_graph(nodes), "graph")
    nodes = keep(nodes.join(graph, "id", "left"), "nodes")
    first = F.lit(0).alias("chunk")
    others = numbered.where("parts > 1").withColumn("own", own).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).where("part <> own")
    guests = others.withColumns({"neighbours": F.lit(None).cast("array<long>"), "node": F.lit(False)})
    asked = nodes.unionByName(guests.select(*nodes.columns)).select("*", first, F.lit(True).alias("asks"))
    search = lambda rows: keep(rows.select(*ROW).groupBy(*KEYS, "chunk").applyInPandas(_search(beam, threshold), FOUND), "found")
    every = now = search(asked)
    pair = ["label", "dim", "shard", "id", "hv"]
    visited = dealt.select(*pair)
    while True:  # on into the shards of what was found
        wanted = now.select("label", "dim", "id", "hv", F.explode("more").alias("shard")).distinct()
        new = keep(wanted.join(visited, pair, "left_anti").select(*pair), "new")
        if new.isEmpty():
            return every
        visited = visited.unionByName(new)
        chunks = new.groupBy("label", "dim", "shard").agg(F.ceil(F.count("*") / LARGEST).cast("int").alias("chunks"))
        there = nodes.join(chunks, ["label", "dim", "shard"]).withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).withColumn("asks", F.lit(False))
        askers = new.join(chunks, ["label", "dim", "shard"]).join(parts, ["label", "dim", "shard"]).join(classes.select("label", "dim", "id", "hv", "vec", "mult"), ["label", "dim", "id", "hv"])
        askers = askers.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).withColumns({
            "chunk": F.pmod(F.xxhash64("hv"), F.col("chunks")).cast("int"), "home": F.lit(False), "shards": F.lit(None).cast("array<int>"),
            "neighbours": F.lit(None).cast("array<long>"), "node": F.lit(False), "asks": F.lit(True),
        })
        now = search(there.select(*ROW).unionByName(askers.select(*ROW)))
        every = every.unionByName(now)


def _block_links(threshold: float):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        ask, there = pdf[pdf["asks"]], pdf[~pdf["asks"]]
        q, t = (_unit(p["vec"]) if len(p) else None for p in (ask, there))
        links, root = np.zeros(len(ask), np.int64), np.arange(len(pdf))
        ids, own, mult = ask["id"].to_numpy(np.int64), there["id"].to_numpy(np.int64), there["mult"].to_numpy(np.int64)
        if q is not None and t is not None:
            raw_q, raw_t = (np.stack([np.asarray(v, np.float64) for v in p["vec"]]) for p in (ask, there))
            norm_q, norm_t = np.linalg.norm(raw_q, axis=1), np.linalg.norm(raw_t, axis=1)
            for a in range(0, len(q), 512):
                i, j = np.nonzero(q[a : a + 512] @ t.T >= threshold - 1e-9)
                i += a
                ok = (np.einsum("nd,nd->n", raw_q[i], raw_t[j]) / (norm_q[i] * norm_t[j]) >= threshold) & (ids[i] != own[j])
                i, j = i[ok], j[ok]
                np.add.at(links, i, mult[j])
                unite(root, i, len(q) + j)
        out = pd.concat([ask[["label", "dim", "id", "hv"]].assign(links=links), there[["label", "dim", "id", "hv"]].assign(links=0)])
        return out.assign(root=np.concatenate([ids, own])[root], more=[[]] * len(out))

    return run


def all_pairs(classes: DataFrame, threshold: float) -> DataFrame:
    """The same as a search finds, by comparing all vectors of a label and length, block with block."""
    sizes = classes.groupBy("label", "dim").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    placed = classes.join(sizes, ["label", "dim"]).withColumn("own", F.pmod(F.xxhash64("hv"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = ["label", "dim", "id", "hv", "vec", "mult"]
    asks = placed.select(*rows, F.col("own").alias("a"), F.col("other").alias("b"), F.lit(True).alias("asks"))
    there = placed.select(*rows, F.col("other").alias("a"), F.col("own").alias("b"), F.lit(False).alias("asks"))
    return keep(asks.unionByName(there).groupBy("label", "dim", "a", "b").applyInPandas(_block_links(threshold), FOUND), "found")


def _audit_rows(sample: pd.DataFrame, threshold: float):
    """Numbers of true links of the sampled queries in each batch of rows."""
    raw = [np.asarray(v, np.float64) for v in sample["vec"]]
    groups = {k: g.index.to_numpy() for k, g in sample.reset_index(drop=True).groupby(["label", "dim"])}
    ids = sample["id"].to_numpy()

    def run(batches):
        for pdf in batches:
            total = np.zeros(len(raw), np.int64)
            for key, own in pdf.groupby(["label", "dim"]):
                at = groups.get(key)
                if at is None:
                    continue
                x, q = np.stack([np.asarray(v, np.float64) for v in own["vec"]]), np.stack([raw[i] for i in at])
                c = (q @ x.T) / (np.linalg.norm(q, axis=1)[:, None] * np.linalg.norm(x, axis=1))
                hit = (c >= threshold) & (ids[at][:, None] != own["id"].to_numpy()[None, :])
                total[at] += (hit * own["mult"].to_numpy()[None, :]).sum(1)
            yield pd.DataFrame({"id": ids, "true": total})

    return run


def audit(classes: DataFrame, found: DataFrame, threshold: float) -> float:
    """Recall of ``found(id, links)`` on a bounded sample of queries against brute force over all classes: that of all
    links or the mean of the queries, whichever is less. Half of the sample are vectors that have links."""
    by = [F.xxhash64("id", F.lit(3)), F.col("id")]
    linked = classes.join(found.where("links > 0").select("id"), "id", "left_semi").select(*classes.columns)
    sample = pd.concat([classes.orderBy(*by).limit(AUDIT).toPandas(), linked.orderBy(*by).limit(AUDIT).toPandas()]).drop_duplicates(["id", "hv"])
    if not len(sample):
        return 1.0
    truth = classes.mapInPandas(_audit_rows(sample, threshold), "id long, true long").groupBy("id").agg(F.sum("true").alias("true")).where(F.col("true") > 0)
    got = F.least("true", F.coalesce("links", F.lit(0)))
    row = truth.join(found, "id", "left").agg(F.sum("true"), F.sum(got), F.avg(got / F.col("true"))).first()
    return min(row[1] / row[0], row[2]) if row[0] else 1.0


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``vectors(vec_id, embedding, label)`` to (vec_id, n_links, component_id, kept). Components other than floats are
    taken as doubles, and equality of vectors and cosines are those of doubles."""
    spark = vectors.sparkSession
    kind = "array<float>" if dict(vectors.dtypes)["embedding"] == "array<float>" else "array<double>"
    small_batches(spark)
    rows = vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast(kind).alias("vec"), F.col("label").cast("int"))
    fine = F.forall("vec", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf")))) & F.exists("vec", lambda v: v != 0)
    usable = F.coalesce(F.col("label").isNotNull() & F.col("vec_id").isNotNull() & fine, F.lit(False))
    rows = rows.withColumn("_ok", usable)
    good = rows.where("_ok").select("vec_id", "label", F.size("vec").cast("int").alias("dim"), "vec")
    classes = keep(good.groupBy("label", "dim", "vec").agg(F.min("vec_id").alias("id"), F.count("*").alias("mult")).select("id", F.xxhash64("vec").alias("hv"), "label", "dim", "vec", "mult"), "classes")
    total = classes.count()
    each, beam = SHARDS_EACH, BEAM
    centroids = fit_centroids(classes.orderBy(F.xxhash64("id"), "id").limit(FIT_SAMPLE).select("label", "dim", "vec").toPandas(), total) if total else {}
    numbers = lambda rows: keep(rows.groupBy("id").agg(F.sum("links").alias("links")), "links")
    for _ in range(ATTEMPTS):
        found = _round(classes, centroids, each, beam, threshold)
        by_id = numbers(found)
        if audit(classes, by_id, threshold) >= RECALL:
            break
        each, beam = 2 * each, 2 * beam
    else:
        found = all_pairs(classes, threshold)
        by_id = numbers(found)
    names = components(found.where("id <> root").select(F.col("id").alias("a"), F.col("root").alias("b")))
    told = classes.join(by_id, "id", "left").join(names.withColumnRenamed("node", "id"), "id", "left").select(
        "label", "dim", "vec", (F.coalesce("links", F.lit(0)) + F.col("mult") - 1).alias("n_links"), F.coalesce("component", "id").alias("component_id")
    )
    linked = good.join(told, ["label", "dim", "vec"]).select("vec_id", "n_links", "component_id")
    alone = rows.where("not _ok").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of all ``embeddings``."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


OP5_SQL = f"""
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS x FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND list_aggregate(list_transform(embedding, lambda c: CASE WHEN c IS NULL OR NOT isfinite(c) THEN 1 ELSE 0 END), 'sum') = 0
), f AS (SELECT vec_id, label, len(x) AS d, x, sqrt(list_inner_product(x, x)) AS norm FROM v),
e AS (SELECT a.vec_id AS a, b.vec_id AS b FROM f a JOIN f b ON a.label = b.label AND a.d = b.d AND a.vec_id <> b.vec_id AND a.norm > 0 AND b.norm > 0
  WHERE list_inner_product(a.x, b.x) / (a.norm * b.norm) >= {THRESHOLD}),
reach(vec_id, other) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT reach.vec_id, e.b FROM reach JOIN e ON reach.other = e.a),
c AS (SELECT vec_id, min(other) AS component_id FROM reach GROUP BY vec_id), n AS (SELECT a, count(*) AS n_links FROM e GROUP BY a)
SELECT c.vec_id, coalesce(n.n_links, 0) AS n_links, c.component_id, c.vec_id = c.component_id AS kept FROM c LEFT JOIN n ON n.a = c.vec_id
"""
