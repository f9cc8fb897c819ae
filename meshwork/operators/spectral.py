"""Division of a graph into k parts of similar size by eigenvectors of its normalised Laplacian.

The smallest eigenvectors of I - N, with N = D^-1/2 A D^-1/2, are the largest of
(I + N) / 2, none of whose eigenvalues is negative. They are found for all k columns at
once by block power iteration: a round multiplies STEPS times by joining edges with
the rows of the block, and sums up the k x k products of its columns while it writes
them; their Cholesky factor, which is all that reaches the driver, makes the columns
orthonormal in the next round (Gram and Schmidt's process in one go). The rows are then
divided by k-means from centres chosen farthest first, whose rounds return k sums, and
parts above the tolerated size hand vertices to the smallest ones.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meshwork.graph import Graph, checkpointed, dropped, looped, measured
from meshwork.operators.communities import weighed

#: Multiplications in one round.
STEPS = 3
#: Buckets of vertices by hash, by which vertices are picked to change parts.
BUCKETS = 4096


def _times(x: DataFrame, entries: DataFrame, k: int, n: int) -> DataFrame:
    """x (id and columns x0, x1, ...) multiplied by a sparse matrix with entries u, v, w."""
    return entries.join(looped(x.withColumnRenamed("id", "v"), n), "v").groupBy(F.col("u").alias("id")).agg(*(F.sum(F.col("w") * F.col(f"x{i}")).alias(f"x{i}") for i in range(k)))


def _mapped(x: DataFrame, matrix: np.ndarray) -> DataFrame:
    """The rows of x times a small matrix."""
    columns = (sum((F.col(f"x{i}") * F.lit(float(matrix[i, j])) for i in range(len(matrix))), F.lit(0.0)) for j in range(matrix.shape[1]))
    return x.select("id", *(c.alias(f"x{j}") for j, c in enumerate(columns)))


def _inverse_root(gram: np.ndarray) -> np.ndarray:
    """R^-1 of G = R'R; what vanishes is kept from dividing by zero."""
    scale = max(np.linalg.eigvalsh(gram)[-1], 1e-300)
    return np.linalg.inv(np.linalg.cholesky(gram + np.eye(len(gram)) * scale * 1e-13)).T


def embedding(graph: Graph, k: int, weight: str | None = None, rounds: int = 60, tolerance: float = 1e-4) -> tuple[DataFrame, list[float]]:
    """id and x, the vertex's row in the k smallest eigenvectors of the Laplacian, and the eigenvalues.

    Rounds end when no eigenvalue changes by the tolerance; two columns more than asked
    for make that sooner. Direction is ignored; vertices without edges have zeros.
    """
    step = checkpointed(Graph(weighed(graph, weight)).adjacency("w").where("u <> v").groupBy("u", "v").agg(F.sum("w").alias("w")))
    d, (n,) = measured(step.groupBy("u").agg(F.sum("w").alias("d")), F.count("*"))
    du, dv = looped(d, n), looped(d.select(F.col("u").alias("v"), F.col("d").alias("dv")), n)
    halved = step.join(du, "u").join(dv, "v").select("u", "v", (F.col("w") / F.sqrt(F.col("d") * F.col("dv")) / 2).alias("w"))
    entries = checkpointed(halved.union(d.select("u", F.col("u").alias("v"), F.lit(0.5).alias("w"))))
    wide = k + 2
    # The first column is the known eigenvector of eigenvalue zero, the others are drawn by hash.
    drawn = [(F.pmod(F.xxhash64("u", F.lit(j)), F.lit(1 << 20)) / F.lit(float(1 << 20)) - 0.5).alias(f"x{j}") for j in range(1, wide)]
    products = [F.sum(F.col(f"x{i}") * F.col(f"x{j}")) for i in range(wide) for j in range(i, wide)]

    def gram(values: tuple) -> np.ndarray:
        out = np.zeros((wide, wide))
        out[np.triu_indices(wide)] = [v or 0.0 for v in values]
        return out + np.triu(out, 1).T

    x, values = measured(d.select(F.col("u").alias("id"), F.sqrt("d").alias("x0"), *drawn), *products)
    before = None
    for _ in range(rounds):
        y = _mapped(x, _inverse_root(gram(values)))
        for _ in range(STEPS):
            y = _times(y, entries, wide, n)
        last, (x, values) = x, measured(y, *products)
        dropped(last)
        now = np.sort(np.linalg.eigvalsh(gram(values)))[::-1][:k].clip(0) ** (0.5 / STEPS)
        if before is not None and np.abs(now - before).max() < tolerance:
            break
        before = now
    # Rayleigh and Ritz: the eigenvectors inside the block.
    q = checkpointed(_mapped(x, _inverse_root(gram(values))))
    aq = _times(q, entries, wide, n).select("id", *(F.col(f"x{j}").alias(f"y{j}") for j in range(wide)))
    row = q.join(looped(aq, n), "id").agg(*(F.sum(F.col(f"x{i}") * F.col(f"y{j}")) for i in range(wide) for j in range(wide))).first()
    small = np.array([v or 0.0 for v in row]).reshape(wide, wide)
    found, vectors = np.linalg.eigh((small + small.T) / 2)
    order = np.argsort(-found)[:k]
    rows = _mapped(q, vectors[:, order]).select("id", F.array(*(f"x{j}" for j in range(k))).alias("x"))
    out = graph.ids().join(looped(rows, n), "id", "left").select("id", F.coalesce("x", F.array(*[F.lit(0.0)] * k)).alias("x"))
    return checkpointed(out), [float(2 - 2 * v) for v in found[order]]


def _gap(centre: list[float]) -> Column:
    """The squared distance of a row from a centre."""
    return sum(((F.col("x")[i] - F.lit(float(c))) ** 2 for i, c in enumerate(centre)), F.lit(0.0))


def k_means(points: DataFrame, k: int, rounds: int = 100) -> tuple[DataFrame, list[list[float]]]:
    """id, x and part (0 to k - 1) of points (id, x), and the centres.

    The first centre is the point of the smallest id, each further one the point
    farthest from all before, ties going to the smallest id. An empty part keeps its centre.
    """
    dims = len(points.first()["x"])
    centres = [list(points.agg(F.min_by("x", "id")).first()[0])]
    for _ in range(1, k):
        near = F.least(*(F.round(_gap(c), 12) for c in centres)) if len(centres) > 1 else F.round(_gap(centres[0]), 12)
        centres.append(list(points.agg(F.max_by("x", F.struct(near.alias("near"), (-F.hash("id")).alias("tie")))).first()[0]))
    placed = points
    for _ in range(rounds):
        part = F.array_min(F.array(*(F.struct(F.round(_gap(c), 12).alias("gap"), F.lit(j).alias("part")) for j, c in enumerate(centres))))["part"]
        placed = points.withColumn("part", part)
        sums = {r["part"]: r for r in placed.groupBy("part").agg(F.count("*").alias("n"), *(F.sum(F.col("x")[i]).alias(f"s{i}") for i in range(dims))).collect()}  # k rows
        new = [[sums[j][f"s{i}"] / sums[j]["n"] for i in range(dims)] if j in sums else centres[j] for j in range(k)]
        if np.allclose(new, centres, rtol=0, atol=1e-12):
            break
        centres = new
    return placed, centres


def balanced(placed: DataFrame, k: int, tolerance: float = 1.2) -> DataFrame:
    """id and part, after the largest part handed vertices to the smallest until none is larger than the tolerance times the mean.

    How many change is reckoned from the k sizes; which ones, by hash: whole buckets of
    a part and then the smallest ids of one bucket more.
    """
    size = {r["part"]: r["count"] for r in placed.groupBy("part").count().collect()}  # k rows
    sizes = [size.get(j, 0) for j in range(k)]
    most = max(sum(sizes) * tolerance / k, -(-sum(sizes) // k))
    quota: list[tuple[int, int, int]] = []  # from, to, how many
    while max(sizes) > most and max(sizes) - min(sizes) > 1:
        a, b = sizes.index(max(sizes)), sizes.index(min(sizes))
        m = max(1, int(min(sizes[a] - most, (sizes[a] - sizes[b]) // 2)))
        quota.append((a, b, m))
        sizes[a] -= m
        sizes[b] += m
    bucket = F.pmod(F.xxhash64("id"), F.lit(BUCKETS)).cast("int")
    for a, b, m in quota:
        placed = placed.withColumn("bucket", bucket)
        left, first, rest = m, 0, 0
        for r in placed.where(F.col("part") == a).groupBy("bucket").count().orderBy("bucket").collect():  # BUCKETS rows at most
            first = r["bucket"]
            if r["count"] > left:
                rest = left
                break
            left -= r["count"]
            first += 1
        # Only the one bucket that is handed over in part is ranked.
        last = placed.where((F.col("part") == a) & (F.col("bucket") == first)).withColumn("rank", F.row_number().over(Window.partitionBy("bucket").orderBy("id"))).where(F.col("rank") <= rest).select("id", F.lit(True).alias("goes"))
        moves = (F.col("part") == a) & ((F.col("bucket") < first) | F.coalesce("goes", F.lit(False)))
        placed = checkpointed(placed.join(last, "id", "left").select("id", F.when(moves, F.lit(b)).otherwise(F.col("part")).alias("part")))
    return placed.select("id", "part")


def partition(graph: Graph, k: int, weight: str | None = None, tolerance: float = 1.2) -> DataFrame:
    """id and part (0 to k - 1) of every vertex."""
    if k < 2:
        raise ValueError("a partition has two parts at least")
    points, _ = embedding(graph, k, weight)
    placed, _ = k_means(points, k)
    return balanced(checkpointed(placed.select("id", "part")), k, tolerance)


def partition_report(graph: Graph, parts: DataFrame) -> DataFrame:
    """part, size, cut (edges that leave it) and balance (size over the mean size)."""
    n = parts.agg(F.count("*").alias("n"), F.countDistinct("part").alias("k"))
    ends = graph.edges.select("src", "dst").join(parts.select(F.col("id").alias("src"), F.col("part").alias("a")), "src").join(parts.select(F.col("id").alias("dst"), F.col("part").alias("b")), "dst").where("a <> b")
    cut = ends.select(F.explode(F.array("a", "b")).alias("part")).groupBy("part").agg(F.count("*").alias("cut"))
    sizes = parts.groupBy("part").agg(F.count("*").alias("size"))
    return sizes.join(cut, "part", "left").join(F.broadcast(n)).select("part", "size", F.coalesce("cut", F.lit(0)).alias("cut"), (F.col("size") * F.col("k") / F.col("n")).alias("balance"))  # one row is broadcast
