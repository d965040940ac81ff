"""Resistor network solves.

Components are solved where they are: grouped by component, each by conjugate gradients with incomplete or diagonal
scaling in numpy, or directly when small; before that, nodes of large ones that have at most two neighbours are folded
away exactly (:func:`fold`), as a chain of n nodes would take n steps. ``solve_by_size``, which plans use, gives components of more than ``LARGE``
edges to ``distributed_cg``, a diagonally-scaled conjugate gradient of joins and sums; in ``solve_components`` a component
is one task's whatever its size.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import discard, keep

DIRECT = 1200
#: Residual by right side, and steps, of conjugate gradients within a task and across tasks.
TOLERANCE, STEPS = 1e-12, 20_000
#: Edges of a component beyond which it is solved across tasks (about 0.3 GB of one).
LARGE = 4_000_000


def assemble(entries: DataFrame) -> DataFrame:
    """Sums duplicate (i, j) entries."""
    return entries.groupBy("i", "j").agg(F.sum("v").alias("v"))


def stamp(edges: DataFrame) -> DataFrame:
    """Matrix entries of edges (a, b, g)."""
    one = lambda i, j, v: edges.select(F.col(i).alias("i"), F.col(j).alias("j"), v.alias("v"))
    g = F.col("g")
    return one("a", "a", g).unionByName(one("b", "b", g)).unionByName(one("a", "b", -g)).unionByName(one("b", "a", -g))


def spmv(matrix: DataFrame, x: DataFrame) -> DataFrame:
    """(i, y) of matrix(i, j, v) times x(i, x)."""
    v = x.select(F.col("i").alias("j"), "x")
    return matrix.join(v, "j").groupBy("i").agg(F.sum(F.col("v") * F.col("x")).alias("y"))


def incomplete_cholesky(n: int, rows: np.ndarray, cols: np.ndarray, vals: np.ndarray):
    """IC(0) of a symmetric matrix given by its lower triangle in row order; None where a pivot fails."""
    start = np.searchsorted(rows, np.arange(n + 1))
    low = vals.astype(float).copy()
    at = {(int(r), int(c)): k for k, (r, c) in enumerate(zip(rows, cols))}
    for i in range(n):
        for k in range(start[i], start[i + 1]):
            j = int(cols[k])
            s = low[k]
            for m in range(start[i], k):
                other = at.get((j, int(cols[m])))
                if other is not None and cols[m] < j:
                    s -= low[m] * low[other]
            if j == i:
                if s <= 0:
                    return None
                low[k] = s**0.5
            else:
                low[k] = s / low[at[j, j]]
    return start, low


def pcg(n: int, i: np.ndarray, j: np.ndarray, v: np.ndarray, b: np.ndarray, x0: np.ndarray | None = None, tol: float = TOLERANCE, most: int = STEPS) -> np.ndarray:
    """Diagonally scaled conjugate gradients; raises on breakdown or if it does not converge."""
    diag = np.bincount(i[i == j], v[i == j], n)
    if (diag <= 0).any():
        raise ValueError("matrix has a diagonal entry that is not positive")
    mul = lambda x: np.bincount(i, v * x[j], n)
    x = np.zeros(n) if x0 is None else x0.astype(float).copy()
    r = b - mul(x)
    limit = tol * max(np.linalg.norm(b), 1e-300)
    z = r / diag
    p, rz = z.copy(), r @ z
    for _ in range(most):
        if np.linalg.norm(r) <= limit:
            return x
        q = mul(p)
        pq = p @ q
        if pq <= 0:
            raise ValueError("conjugate gradients broke down")
        a = rz / pq
        x += a * p
        r -= a * q
        z = r / diag
        rz, old = r @ z, rz
        p = z + rz / old * p
    raise ValueError("conjugate gradients did not converge")


def _simple(n: int, p: np.ndarray, q: np.ndarray, g: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Edges between different nodes, p < q, each pair once with its summed conductance."""
    one = p != q
    low, high = np.minimum(p[one], q[one]), np.maximum(p[one], q[one])
    pair, at = np.unique(low * n + high, return_inverse=True)
    return pair // n, pair % n, np.bincount(at, g[one], len(pair))


def fold(n: int, p: np.ndarray, q: np.ndarray, g: np.ndarray, leak: np.ndarray, rhs: np.ndarray):
    """Eliminates nodes with at most two neighbours until none is left: branches and chains go, and what hangs together by
    more stays. In a round all of them go that come before their like neighbours in a random order, so a chain of n nodes
    takes about log n rounds. Nothing is subtracted, so nothing cancels. ``leak`` is the conductance of each node to a node
    at 0, ``rhs`` the current into it. Returns the edges, leaks and currents that remain, whether each node does, and the
    steps by which :func:`unfold` finds the others."""
    leak, rhs, alive, steps = leak.astype(float).copy(), rhs.astype(float).copy(), np.ones(n, bool), []
    rng = np.random.default_rng(1)
    p, q, g = _simple(n, p, q, g)
    while True:
        degree = np.bincount(p, minlength=n) + np.bincount(q, minlength=n)
        go = alive & (degree <= 2)
        if not go.any():
            return p, q, g, leak, rhs, alive, steps
        turn = rng.permutation(n)
        both = go[p] & go[q]
        go[np.where(turn[p[both]] > turn[q[both]], p[both], q[both])] = False
        # the edges of those that go, by node: none, one or two each
        out, back = go[p], go[q]
        v, w, c = np.concatenate([p[out], q[back]]), np.concatenate([q[out], p[back]]), np.concatenate([g[out], g[back]])
        order = np.argsort(v, kind="stable")
        v, w, c = v[order], w[order], c[order]
        nodes = np.flatnonzero(go)
        first = np.searchsorted(v, nodes)
        count = degree[nodes]
        end = lambda k: (np.where(count > k, w[np.minimum(first + k, len(w) - 1)], -1), np.where(count > k, c[np.minimum(first + k, len(w) - 1)], 0.0)) if len(w) else (np.full(len(nodes), -1), np.zeros(len(nodes)))
        (a, ga), (b, gb) = end(0), end(1)
        total = ga + gb + leak[nodes]
        if (total <= 0).any():
            raise ValueError("matrix has a diagonal entry that is not positive")
        steps.append((nodes, a, ga, b, gb, rhs[nodes], total))
        for other, own in ((a, ga), (b, gb)):
            has = other >= 0
            np.add.at(leak, other[has], own[has] * leak[nodes[has]] / total[has])
            np.add.at(rhs, other[has], own[has] * rhs[nodes[has]] / total[has])
        alive[nodes] = False
        rest, two = ~(out | back), count == 2
        p, q, g = _simple(n, np.concatenate([p[rest], a[two]]), np.concatenate([q[rest], b[two]]), np.concatenate([g[rest], (ga * gb / total)[two]]))


def unfold(u: np.ndarray, steps: list) -> np.ndarray:
    """The potentials of folded nodes from those that remained; in place."""
    for nodes, a, ga, b, gb, current, total in reversed(steps):
        u[nodes] = (current + ga * u[a] + gb * u[b]) / total  # where there is no neighbour its conductance is 0
    return u


def solve_dirichlet(n: int, a: np.ndarray, b: np.ndarray, g: np.ndarray, fixed: np.ndarray, value: np.ndarray, warm: np.ndarray | None = None) -> np.ndarray:
    """Potentials of n nodes with edges (a, b, g): fixed ones eliminated, nodes of parts without a fixed node at 0."""
    root = np.arange(n)
    while True:  # smallest label in reach
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)  # labels hang on to smaller ones, so a long chain takes few rounds
        np.minimum.at(new, root[b], low)
        while (new[new] != new).any():
            new = new[new]
        if (new == root).all():
            break
        root = new
    held = np.zeros(n, bool)
    held[root[fixed]] = True
    u = np.where(fixed, value, 0.0)
    free = ~fixed & held[root]
    if not free.any():
        return u
    at = np.cumsum(free) - 1
    rhs = np.zeros(int(free.sum()))
    ii, jj, vv = [], [], []
    for p, q in ((a, b), (b, a)):
        m = free[p]
        ii.append(at[p[m]]), jj.append(at[p[m]]), vv.append(g[m])
        both = m & free[q]
        ii.append(at[p[both]]), jj.append(at[q[both]]), vv.append(-g[both])
        to_fixed = m & fixed[q]
        np.add.at(rhs, at[p[to_fixed]], g[to_fixed] * u[q[to_fixed]])
    k = len(rhs)
    if k <= DIRECT:
        dense = np.zeros((k, k))
        np.add.at(dense, (np.concatenate(ii), np.concatenate(jj)), np.concatenate(vv))
        u[free] = np.linalg.solve(dense, rhs)
        return u
    inner, leak = free[a] & free[b], np.zeros(k)
    for p, q in ((a, b), (b, a)):
        m = free[p] & fixed[q]
        np.add.at(leak, at[p[m]], g[m])
    p, q, c, leak, rhs, alive, steps = fold(k, at[a[inner]], at[b[inner]], g[inner], leak, rhs)
    x = np.zeros(k)
    if alive.any():
        new, left = np.cumsum(alive) - 1, int(alive.sum())
        p, q, diag = new[p], new[q], np.arange(left)
        own = leak[alive] + np.bincount(p, c, left) + np.bincount(q, c, left)
        i, j, v = np.concatenate([diag, p, q]), np.concatenate([diag, q, p]), np.concatenate([own, -c, -c])
        if left <= DIRECT:
            dense = np.zeros((left, left))
            np.add.at(dense, (i, j), v)
            x[alive] = np.linalg.solve(dense, rhs[alive])
        else:
            x[alive] = pcg(left, i, j, v, rhs[alive], None if warm is None else warm[free][alive])
    u[free] = unfold(x, steps)
    return u


def solve_components(edges: DataFrame, fixed: DataFrame, key: str = "component") -> DataFrame:
    """``edges(key, a, b, g)``, ``fixed(key, node, value)`` to (key, node, u); later values of a fixed node win."""
    kind = dict(edges.dtypes)[key]

    def run(k, e: pd.DataFrame, f: pd.DataFrame) -> pd.DataFrame:
        nodes = np.unique(np.concatenate([e["a"], e["b"], f["_node"]]).astype(np.int64))
        n = len(nodes)
        hold, value = np.zeros(n, bool), np.zeros(n)
        where = np.searchsorted(nodes, f["_node"].to_numpy())
        hold[where] = True
        value[where] = f["_value"].to_numpy()
        u = solve_dirichlet(n, np.searchsorted(nodes, e["a"].to_numpy()), np.searchsorted(nodes, e["b"].to_numpy()), e["g"].to_numpy(float), hold, value)
        return pd.DataFrame({key: k[0], "node": nodes, "u": u})

    # both sides may come from one table; new names keep their columns apart
    held = fixed.select(F.col(key).alias("_key"), F.col("node").alias("_node"), F.col("value").alias("_value")).groupBy("_key")
    return edges.select(key, "a", "b", "g").groupBy(key).cogroup(held).applyInPandas(run, f"{key} {kind}, node long, u double")


def solve_by_size(edges: DataFrame, fixed: DataFrame, key: str = "component", large: int | None = None) -> DataFrame:
    """As :func:`solve_components`, but components of more than ``large`` edges are solved across tasks, one after
    another. ``edges`` should be a kept table, as it is read more than once."""
    most = LARGE if large is None else large
    big = [r[key] for r in edges.groupBy(key).agg(F.count("*").alias("n")).where(F.col("n") > most).select(key).collect()]  # all edges / most of them
    if not big:
        return solve_components(edges, fixed, key)
    kind, one = dict(edges.dtypes)[key], F.col(key)
    out = solve_components(edges.where(~one.isin(big)), fixed.where(~one.isin(big)), key)
    for k in big:
        held = fixed.where(one == F.lit(k)).groupBy("node").agg(F.max("value").alias("value"))
        out = out.unionByName(distributed_cg(edges.where(one == F.lit(k)), held).select(F.lit(k).cast(kind).alias(key), "node", "u"))
    return out


def power(edges: DataFrame, solved: DataFrame, key: str = "component") -> DataFrame:
    """(key, power): sum of g du^2 over the edges."""
    ua, ub = solved.select(key, F.col("node").alias("a"), F.col("u").alias("ua")), solved.select(key, F.col("node").alias("b"), F.col("u").alias("ub"))
    du = F.col("ua") - F.col("ub")
    # Spark knows the size of neither side: edges made of exploded cells look small and must not be broadcast
    return edges.join(ua.hint("merge"), [key, "a"]).join(ub.hint("merge"), [key, "b"]).groupBy(key).agg(F.sum(F.col("g") * du * du).alias("power"))


def resistance(edges: DataFrame, terminals: DataFrame, key: str = "component") -> DataFrame:
    """(key, r): between ``terminals(key, node, value)`` at 1 and 0; infinite where no power flows."""
    p = power(edges, solve_components(edges, terminals, key), key)
    return p.select(key, F.when(F.abs("power") < 1e-300, float("inf")).otherwise(1 / F.col("power")).alias("r"))


def distributed_cg(edges: DataFrame, fixed: DataFrame, tol: float = TOLERANCE, most: int = STEPS) -> DataFrame:
    """(node, u) of one large connected network ``edges(a, b, g)``, ``fixed(node, value)``: each step is a join and two
    sums, and its vectors are written to the shared folder, so a lost executor costs one step. Raises as :func:`pcg` does."""
    entries = keep(assemble(stamp(edges)), "matrix")
    hold = fixed.select(F.col("node").alias("i"), F.col("value"))
    inner = entries.join(hold.select("i"), "i", "left_anti")
    a = keep(inner.join(hold.select(F.col("i").alias("j")), "j", "left_anti"), "inner")
    rhs = inner.join(hold.select(F.col("i").alias("j"), "value"), "j").groupBy("i").agg(F.sum(-F.col("v") * F.col("value")).alias("r"))
    diag = a.where("i = j").select("i", F.col("v").alias("d"))
    zero = F.lit(0.0)
    state = keep(diag.join(rhs, "i", "left").select("i", "d", zero.alias("x"), F.coalesce("r", zero).alias("r"), (F.coalesce("r", zero) / F.col("d")).alias("p")), "cg")
    rz, bb, worst = state.agg(F.sum(F.col("r") * F.col("r") / F.col("d")), F.sum(F.col("r") * F.col("r")), F.min("d")).first()
    if worst is not None and worst <= 0:
        raise ValueError("matrix has a diagonal entry that is not positive")
    rr = bb
    for _ in range(most):
        if not bb or rr <= tol * tol * bb:
            break
        q = spmv(a, state.select("i", F.col("p").alias("x")))
        with_q = keep(state.join(q, "i", "left").withColumn("q", F.coalesce("y", zero)).drop("y"), "cg")
        pq = with_q.agg(F.sum(F.col("p") * F.col("q"))).first()[0]
        if pq <= 0:
            raise ValueError("conjugate gradients broke down")
        alpha = rz / pq
        stepped = with_q.select("i", "d", (F.col("x") + alpha * F.col("p")).alias("x"), (F.col("r") - alpha * F.col("q")).alias("r"), "p")
        new, rr = stepped.agg(F.sum(F.col("r") * F.col("r") / F.col("d")), F.sum(F.col("r") * F.col("r"))).first()
        after = keep(stepped.withColumn("p", F.col("r") / F.col("d") + (new / rz) * F.col("p")), "cg")
        discard(state), discard(with_q)
        state, rz = after, new
    if bb and rr > tol * tol * bb:
        raise ValueError("conjugate gradients did not converge")
    discard(entries), discard(a)
    return state.select(F.col("i").alias("node"), F.col("x").alias("u")).unionByName(hold.select(F.col("i").alias("node"), F.col("value").alias("u")))


def sweep(edges: DataFrame, drains: DataFrame, sources: DataFrame, gates: list[float], conductance: Callable[[Column], Column], key: str = "key") -> DataFrame:
    """(key, vgs, r): the resistance of networks (key, a, b, g) between ``sources(key, node)`` at 1 V and ground, which they
    reach from ``drains(key, node)`` through a channel whose conductance is a function of the gate voltage; all voltages
    are solved at once, each as a network of its own."""
    at = F.explode(F.array(*[F.lit(float(v) + 0.0) for v in gates]))
    ground = F.lit(-1).cast("long")
    of = lambda df: df.withColumn("vgs", at)
    channel = of(drains).select(key, "vgs", F.col("node").alias("a"), ground.alias("b"), conductance(F.col("vgs")).alias("g"))
    every = of(edges.select(key, "a", "b", "g")).unionByName(channel)
    held = of(sources).select(key, "vgs", "node", F.lit(1.0).alias("value")).unionByName(of(drains).select(key, "vgs", ground.alias("node"), F.lit(0.0).alias("value")).distinct())
    flat = lambda df, *c: df.select(F.concat(F.col(key).cast("string"), F.lit("\0"), F.col("vgs").cast("string")).alias("_k"), *c)
    names = every.select(key, "vgs").distinct()
    r = resistance(flat(every, "a", "b", "g"), flat(held, "node", "value"), "_k")
    return flat(names, key, "vgs").join(r, "_k").select(key, "vgs", "r")
