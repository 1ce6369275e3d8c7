"""Nearest neighbours, permutation and rank-sum tests, PCA, multiple testing."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import metrics
from .matrix import dealt, numbered


#: Numbers of a block of distances, and of the coordinates of the pairs that are measured exactly, at once.
AT_ONCE = 1 << 19
#: Bytes of points that go to every executor, and ids; beyond it joins shuffle.
BROADCAST, BROADCAST_IDS = 64 << 20, 1_000_000


def least(d: np.ndarray, k: int) -> np.ndarray:
    """For each row a bound that at least ``k`` of its numbers keep to, and few others: the k-th least of the minima of groups of them."""
    n = d.shape[1]
    if n < k:
        return np.full(len(d), np.inf)
    groups = min(n, 16 * k)
    minima = d[:, : n // groups * groups].reshape(len(d), -1, groups).min(1)
    return np.partition(minima, k - 1, axis=1)[:, k - 1]


def nearest(u: np.ndarray, v: np.ndarray, own: np.ndarray, ids: np.ndarray, k: int, metric: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of u, row of v, distance) of the k nearest rows of v for each of u but those of its own id, ties by place. ``ids``, of v, are in order.

    A matrix product bounds the distances; only pairs within the bound are measured."""
    found, n = [], len(v)
    first, last = np.searchsorted(ids, own), np.searchsorted(ids, own, "right")
    if metric == "l0":
        p, q = (u > 0).astype(float), (v > 0).astype(float)
        p = np.c_[-2.0 * n * p, n * p.sum(1), np.ones(len(p))]
        q = np.c_[q, np.ones(n), n * q.sum(1) + np.arange(n)].T  # a product is the distance times n and the place: no ties
        slack = np.zeros(len(u))
    else:
        of_u, of_v = (u * u).sum(1), (v * v).sum(1)
        p, q = np.c_[-2.0 * u, of_u, np.ones(len(u))], np.c_[v, np.ones(n), of_v].T
        slack = (of_u + of_v.max()) * (4.0 * (u.shape[1] + 4) * np.finfo(float).eps)  # the product's rounding
    for at in range(0, len(u), rows := max(1, AT_ONCE // n)):
        d = p[at : at + rows] @ q
        for i in np.flatnonzero(first[at : at + rows] < last[at : at + rows]):
            d[i, first[at + i] : last[at + i]] = np.inf
        most = least(d, k)
        if metric != "l0":  # distances are compared to six places
            most = (np.sqrt(np.maximum(most + slack[at : at + rows], 0)) + 1.01e-6) ** 2 + slack[at : at + rows]
        i, j = np.nonzero((d <= most[:, None]) & (d < np.inf))
        if metric == "l0":
            far = np.floor(d[i, j] / n)
        else:
            far, step = np.empty(len(i)), max(1, AT_ONCE // u.shape[1])
            for x in range(0, len(i), step):
                a, b = i[x : x + step], j[x : x + step]
                far[x : x + step] = np.round(np.sqrt(((u[at + a] - v[b]) ** 2).sum(-1)), 6)
        order = np.lexsort((j, far, i))
        i, j, far = i[order], j[order], far[order]
        rank = np.arange(len(i)) - np.searchsorted(i, i)
        found.append((at + i[rank < k], j[rank < k], far[rank < k]))
    return tuple(np.concatenate(c) for c in zip(*found, strict=True))


def knn(points: DataFrame, k: int, metric: str = "l2", block: int = 8192) -> DataFrame:
    """(anchor, rank, nbr, dist): the k nearest others, ties by id. ``points``: (id, vec). Blocks of points meet block by block;
    each task keeps only the k best of its block for each anchor. They are found once, whoever reads them."""
    blocks = max(1, -(-points.count() // block))
    side = lambda name: points.select(F.col("id").alias(name), F.col("vec").alias(f"v_{name}"))
    a = side("anchor").withColumn("i", F.pmod(F.xxhash64("anchor"), F.lit(blocks))).withColumn("j", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
    b = side("nbr").withColumn("j", F.pmod(F.xxhash64("nbr"), F.lit(blocks))).withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))

    def best(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        none = pd.DataFrame({"anchor": [], "nbr": [], "dist": []}).astype({"anchor": "int64", "nbr": "int64", "dist": "float64"})
        if x.empty or y.empty:
            return none
        y = y.sort_values("nbr")
        u, v = np.stack(x.v_anchor.to_list()).astype(float), np.stack(y.v_nbr.to_list()).astype(float)
        fine = [np.isfinite(w).all(1) if metric != "l0" else np.ones(len(w), bool) for w in (u, v)]  # others are at no distance from any
        own, ids, u, v = x.anchor.to_numpy()[fine[0]], y.nbr.to_numpy()[fine[1]], u[fine[0]], v[fine[1]]
        if not len(u) or not len(v):
            return none
        i, j, d = nearest(u, v, own, ids, k, metric)
        return pd.DataFrame({"anchor": own[i], "nbr": ids[j], "dist": d})

    near = a.groupBy("i", "j").cogroup(b.groupBy("i", "j")).applyInPandas(lambda x, y: best(x, y), "anchor long, nbr long, dist double")
    w = Window.partitionBy("anchor").orderBy("dist", "nbr")
    return dealt(near.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= k).select("anchor", "rank", "nbr", "dist"))


def neighbour_points(df: DataFrame, mode: str) -> tuple[DataFrame, str]:
    """(id, vec) and metric of a neighbour mode of (id, x, y, expr)."""
    vec = F.array("x", "y") if mode.startswith("spatial") else F.col("expr")
    return df.select("id", vec.alias("vec")), "l0" if mode == "expression-l0" else "l2"


#: Names of the neighbour modes in labels.
MODE_LABELS = {"spatial": "spatial", "spatial-l0": "spatialL0", "expression": "exprL2", "expression-l0": "exprL0"}


def label(mode: str, test: str, pca: bool = False) -> str:
    """``test``: perm or utest."""
    return f"{MODE_LABELS[mode]}{'_pca' if pca else ''}_{test}"


#: Which metrics each neighbour mode tests, on expression unless named xy; on raw values and on scores.
MODE_METRICS = {
    "spatial": (("cosine", "l2", "l0"), ("cosine", "l2")),
    "spatial-l0": (("l0",), ("l0",)),
    "expression": (("cosine", "l2", "xy"), ("cosine", "l2", "xy")),
    "expression-l0": (("l0",), ("cosine", "l2", "xy")),
}


def least_prime(n: int) -> int:
    """The least prime that is n or more."""
    n = max(n, 2)
    while any(n % d == 0 for d in range(2, math.isqrt(n) + 1)):
        n += 1
    return n


def random_partners(points: DataFrame, near: DataFrame, k: int, perms: int, seed: str) -> DataFrame:
    """(anchor, perm, nbr): k distinct others that aren't neighbours, all of them if there are fewer.

    Ids are numbered from 0. A walk over the residues of a prime, whose start and step come from md5 of seed, anchor and permutation,
    meets each id once; the first k that qualify are drawn. So work grows with what is drawn, not with all pairs."""
    ids = numbered(points.select("id"), ["id"]).select(F.col("id").alias("nbr"), F.col("idx").alias("at"))
    n, most = points.count(), near.groupBy("anchor").count().agg(F.max("count")).first()[0] or 0
    prime = least_prime(n)
    steps = min(prime, k + most + 1 + prime - n)  # at most so many are passed over
    h = F.md5(F.concat_ws("|", F.lit(seed), "anchor", "perm"))
    part = lambda start: F.conv(F.substring(h, start, 15), 16, 10).cast("long")
    walks = near.groupBy("anchor").agg(F.collect_list("nbr").alias("held")).withColumn("perm", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(perms).cast("long"))))
    walks = walks.select("anchor", "held", "perm", (part(1) % prime).alias("start"), (part(17) % (prime - 1) + 1).alias("step"))
    met = walks.withColumn("t", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(steps - 1).cast("long")))).withColumn("at", (F.col("start") + F.col("step") * F.col("t")) % prime)
    pool = met.join(F.broadcast(ids) if n <= BROADCAST_IDS else ids, "at").where((F.col("nbr") != F.col("anchor")) & ~F.array_contains("held", F.col("nbr")))
    w = Window.partitionBy("anchor", "perm").orderBy("t")
    return pool.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k).select("anchor", "perm", "nbr")


def with_distance(pairs: DataFrame, points: DataFrame, distance) -> DataFrame:
    size = points.agg(F.sum(F.size("vec"))).first()[0] or 0
    points = F.broadcast(points) if 8 * size <= BROADCAST else points
    a = points.select(F.col("id").alias("anchor"), F.col("vec").alias("va"))
    b = points.select(F.col("id").alias("nbr"), F.col("vec").alias("vb"))
    return pairs.join(a, "anchor").join(b, "nbr").withColumn("d", F.round(distance(F.col("va"), F.col("vb")).cast("double"), 6)).drop("va", "vb")


def preview(near: DataFrame, points: DataFrame, expr: DataFrame) -> DataFrame:
    """Each neighbour pair's distance in place (L2 of ``points``) and in expression (L0 of ``expr``), both (id, vec)."""
    xy = with_distance(near, points, metrics.l2).withColumnRenamed("d", "xy_l2")
    return with_distance(xy, expr, metrics.l0).withColumnRenamed("d", "expr_l0").select("anchor", "rank", "nbr", "xy_l2", "expr_l0")


def permutation_test(points: DataFrame, near: DataFrame, k: int, perms: int, distance, seed: str = "42", draws: bool = False) -> DataFrame:
    """(anchor, observed, p): p = (#{random mean <= observed} + 1) / (perms + 1); 1 where nothing is left to draw. With ``draws`` the random means, too."""
    observed = with_distance(near.select("anchor", "nbr"), points, distance).groupBy("anchor").agg(F.round(F.avg("d"), 6).alias("observed"))
    drawn = with_distance(random_partners(points, near, k, perms, seed), points, distance).groupBy("anchor", "perm").agg(F.round(F.avg("d"), 6).alias("m"))
    means = [F.transform(F.sort_array(F.collect_list(F.when(F.col("m").isNotNull(), F.struct("perm", "m")))), lambda x: x["m"]).alias("draws")] if draws else []
    both = observed.join(drawn, "anchor", "left").groupBy("anchor", "observed").agg(F.count_if(F.col("m") <= F.col("observed") + 1e-12).alias("low"), F.count("m").alias("n"), *means)
    return both.select("anchor", "observed", F.round((F.col("low") + 1) / (F.col("n") + 1), 9).alias("p"), *(["draws"] if draws else []))


def mode_distances(df: DataFrame, k: int, mode: str, pca: bool = False, found: dict | None = None) -> dict[str, DataFrame]:
    """For each metric that a neighbour mode tests, (anchor, nbr, d) of the k nearest. ``df``: (id, x, y, expr), expr the scores for ``pca``.
    ``found`` keeps neighbours for other modes of the same ``df`` and ``k``."""
    points, metric = neighbour_points(df, mode)
    found, key = {} if found is None else found, (mode.startswith("spatial"), metric)
    if key not in found:
        found[key] = knn(points, k, metric).select("anchor", "nbr")
    near = found[key]
    expr, xy = df.select("id", F.col("expr").alias("vec")), df.select("id", F.array("x", "y").alias("vec"))
    how = {"cosine": (expr, metrics.cosine), "l2": (expr, metrics.l2), "l0": (expr, metrics.l0), "xy": (xy, metrics.l2)}
    return {m: with_distance(near, *how[m]) for m in MODE_METRICS[mode][pca]}


#: A rational approximation of the error function, good to 1.5e-7.
ERF_P, ERF_A = 0.3275911, (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)


def normal_cdf(z: Column) -> Column:
    """The standard normal distribution function."""
    x = F.abs(z) / F.lit(2.0**0.5)
    t = 1 / (1 + F.lit(ERF_P) * x)
    poly = F.lit(0.0)
    for a in reversed(ERF_A):
        poly = (poly + F.lit(a)) * t
    tail = poly * F.exp(-x * x) / 2
    return F.when(z < 0, tail).otherwise(1 - tail)


def rank_sum(samples: DataFrame, key: str) -> DataFrame:
    """(key, u, z, p) of x against y: ``samples`` (key, side in 'x' and 'y', v). Average ranks; p of the left tail by the normal approximation with
    ties and without continuity correction, null where all values tie. Keys with an empty side have no row; null values don't count. Only distinct values are put in order."""
    x = F.col("side") == "x"
    d = samples.where("v IS NOT NULL").groupBy(key, "v").agg(F.count("*").alias("t"), F.count_if(x).alias("tx"))
    before = F.coalesce(F.sum("t").over(Window.partitionBy(key).orderBy("v").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    t = F.col("t").cast("double")
    s = d.withColumn("r", before + (t + 1) / 2).groupBy(key).agg(F.sum(F.col("tx") * F.col("r")).alias("r1"), F.sum("tx").alias("n1"), F.sum(F.col("t") - F.col("tx")).alias("n2"), F.sum(t * (t * t - 1)).alias("ties"))
    n = (F.col("n1") + F.col("n2")).cast("double")
    u = F.col("r1") - F.col("n1") * (F.col("n1") + 1) / 2
    var = F.col("n1").cast("double") * F.col("n2") / 12.0 * (n + 1 - F.try_divide(F.col("ties"), n * (n - 1)))
    z = F.try_divide(u - F.col("n1").cast("double") * F.col("n2") / 2, F.sqrt(var))
    return s.where("n1 > 0 AND n2 > 0").select(key, F.round(u, 4).alias("u"), F.round(z, 6).alias("z"), F.round(normal_cdf(z), 6).alias("p"))


def neighbour_rank_sum(points: DataFrame, near: DataFrame, k: int, distance, seed: str = "42") -> DataFrame:
    """(anchor, u, p, obs, rand): each anchor's distances to its neighbours against those to as many random others; u and p are null if a side is empty."""
    obs = with_distance(near.select("anchor", "nbr"), points, distance).select("anchor", F.lit("x").alias("side"), F.col("d").alias("v"))
    rand = with_distance(random_partners(points, near, k, 1, seed).select("anchor", "nbr"), points, distance).select("anchor", F.lit("y").alias("side"), F.col("d").alias("v"))
    both = obs.unionByName(rand)
    held = lambda side: F.sort_array(F.collect_list(F.when(F.col("side") == side, F.col("v"))))
    return both.groupBy("anchor").agg(held("x").alias("obs"), held("y").alias("rand")).join(rank_sum(both, "anchor"), "anchor", "left").select("anchor", "u", "p", "obs", "rand")


def pca(points: DataFrame, k: int) -> DataFrame:
    """(id, scores) on the leading eigenvectors of the covariance, which is one distributed sum; ``vec`` is centred already. The vectors' signs are those
    of their product with a fixed vector."""
    dim = points.select(F.size("vec")).first()[0]

    def gram(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((dim, dim))
        for df in batches:
            if len(df):
                x = np.stack(df.vec.to_list()).astype(float)
                total += x.T @ x
        yield pd.DataFrame({"i": np.arange(dim), "row": list(total)})

    rows = points.select("vec").mapInPandas(gram, "i int, row array<double>").groupBy("i").agg(F.array(*[F.sum(F.col("row")[j]) for j in range(dim)]).alias("row")).orderBy("i").collect()
    values, vectors = np.linalg.eigh(np.array([r.row for r in rows]))
    v = vectors[:, np.argsort(-values, kind="stable")[: min(k, dim)]]
    start = (np.arange(dim) * 7 + 13) % 97  # fixed values: components point to this side
    out = (v * np.where(start @ v < 0, -1.0, 1.0)).T
    score = lambda v: F.round(metrics._sum(F.col("vec"), F.array(*[F.lit(float(x)) for x in v]), lambda a, b: a * b), 6)
    return points.select("id", F.array(*[score(v) for v in out]).alias("scores"))


def benjamini_hochberg(df: DataFrame, keys: list[str], p: str = "p") -> DataFrame:
    """``df`` with q. Bad values (null, NaN, infinite, negative) count in m and get none. Equal p-values share their rank, so only
    distinct values are put in order."""
    ok = F.col(p).isNotNull() & ~F.isnan(p) & (F.col(p) >= 0) & (F.col(p) < float("inf"))
    m = df.groupBy(*keys).agg(F.count("*").alias("_m"))
    distinct = df.where(ok).groupBy(*keys, p).agg(F.count("*").alias("_c"))
    by, down = Window.partitionBy(*keys).orderBy(p), Window.partitionBy(*keys).orderBy(F.desc(p))  # a running minimum from the largest
    ranked = distinct.join(m, keys).withColumn("_rank", F.sum("_c").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    q = F.least(F.lit(1.0), F.min(F.col("_m") * F.col(p) / F.col("_rank")).over(down.rowsBetween(Window.unboundedPreceding, 0)))
    return df.join(ranked.withColumn("q", q).select(*keys, p, "q"), [*keys, p], "left")


def significant(adjusted: DataFrame, keys: list[str], level: float = 0.05) -> DataFrame:
    return adjusted.groupBy(*keys).agg(F.count_if((F.col("q") >= 0) & (F.col("q") < level)).alias("significant"), F.count("*").alias("total"))
