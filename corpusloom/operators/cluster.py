"""Clusters and projections of vectors: sums over Arrow batches travel, vectors stay."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.operators.order import numbered
from corpusloom.session import stored


def soft_gmm(x: np.ndarray, k: int, steps: int = 10, least: float = 0.15) -> np.ndarray:
    """Membership (n, k) of a diagonal Gaussian mixture after ``steps`` EM steps; centres start at evenly spaced rows; each row has its arg-max."""
    n, dims = x.shape
    k = max(1, min(k, n))
    mean = x[np.linspace(0, n - 1, k).astype(int)].astype(float)
    var = np.full((k, dims), x.var(0).mean() + 1e-3)
    mix = np.full(k, 1 / k)
    for _ in range(steps):
        logp = np.log(mix + 1e-12) - 0.5 * (np.log(var).sum(1) + (((x[:, None] - mean) ** 2) / var).sum(2))
        r = np.exp(logp - logp.max(1, keepdims=True))
        r /= r.sum(1, keepdims=True)
        w = r.sum(0) + 1e-9
        mean = (r.T @ x) / w[:, None]
        var = np.maximum((r.T @ (x**2)) / w[:, None] - mean**2, 1e-3)
        mix = w / n
    out = r > least
    out[np.arange(n), r.argmax(1)] = True
    return out


def _responsibilities(x: np.ndarray, mean: np.ndarray, var: np.ndarray, mix: np.ndarray, cells: int = 1 << 21) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """([part, part**2] of some rows of x, their share of each component), by matrix products; ``cells`` bounds rows times components."""
    fixed = np.log(mix + 1e-12) - 0.5 * (np.log(var) + mean**2 / var).sum(1)
    weights = np.concatenate([mean / var, -0.5 / var], 1).T
    step = max(1, cells // max(1, len(mean)))
    for i in range(0, len(x), step):
        both = np.concatenate([x[i : i + step], x[i : i + step] ** 2], 1)
        r = both @ weights
        r += fixed
        r -= r.max(1, keepdims=True)
        np.exp(r, out=r)
        r /= r.sum(1, keepdims=True)
        yield both, r


#: From so many components on, a block of ``LEAF`` alike rows is first held against all in single precision; those whose share is under exp(-BEYOND) of the largest for each of its rows are left out, as they change no digit.
SCREENED, LEAF, BEYOND, STRIP = 2048, 96, 64.0, 8192


def _leaves(x: np.ndarray, at: np.ndarray, size: int) -> Iterator[np.ndarray]:
    """``at`` in parts of at most ``size`` alike rows of x, halved along their main axis."""
    if len(at) <= size:
        yield at
        return
    part = x[at]
    axis = np.linalg.eigh(np.cov(part.T).reshape(x.shape[1], -1))[1][:, -1]
    order = np.argsort(part @ axis, kind="stable")
    for half in (order[: len(at) // 2], order[len(at) // 2 :]):
        yield from _leaves(x, at[half], size)


def _shares(x: np.ndarray, mean: np.ndarray, var: np.ndarray, mix: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray | slice, np.ndarray]]:
    """(rows of x, [1, part, part**2] of them, components, the rows' share of each of these); shares of other components are under exp(-BEYOND) of a row's largest."""
    if len(mean) < SCREENED:
        at = 0
        for both, r in _responsibilities(x, mean, var, mix, 1 << 18):
            yield np.arange(at, at + len(both)), np.concatenate([np.ones((len(both), 1)), both], 1), slice(None), r
            at += len(both)
        return
    fixed = np.log(mix + 1e-12) - 0.5 * (np.log(var) + mean**2 / var).sum(1)
    weights = np.concatenate([fixed[:, None], mean / var, -0.5 / var], 1)
    rough, most = np.ascontiguousarray(weights.T, np.float32), np.abs(weights).max(0)
    size, skipped = max(16, min(LEAF, (1 << 24) // len(mean))), 0
    held = np.empty((size, len(mean)), np.float32)
    for at in _leaves(x, np.arange(len(x)), size):
        part = x[at]
        both = np.concatenate([np.ones((len(part), 1)), part, part**2], 1)
        off = (both.shape[1] + 2) * 2.0**-23 * float(np.abs(both).max(0) @ most)  # how far a sum in single precision can be off
        near = slice(None)
        if off >= BEYOND or skipped:  # after a block that needs most components the next seven are not held against all
            skipped = max(0, skipped - 1)
        else:
            q, e = held[: len(part)], both.astype(np.float32)
            top = np.full((len(part), 1), -np.inf, np.float32)
            for i in range(0, len(mean), STRIP):
                np.matmul(e, rough[:, i : i + STRIP], out=q[:, i : i + STRIP])
                np.maximum(top, q[:, i : i + STRIP].max(1, keepdims=True), out=top)
            near = np.flatnonzero(np.concatenate([(q[:, i : i + STRIP] - top).max(0) for i in range(0, len(mean), STRIP)]) > -(BEYOND + 2 * off))
            skipped = 7 if len(near) > 0.6 * len(mean) else 0
        r = both @ weights[near].T
        r -= r.max(1, keepdims=True)
        np.exp(np.maximum(r, -BEYOND, out=r), out=r)
        r /= r.sum(1, keepdims=True)
        yield at, both, near, r


def _stack(column: pa.ChunkedArray) -> np.ndarray:
    held = column.combine_chunks()
    return held.flatten().to_numpy().reshape(len(held), -1) if len(held) else np.zeros((0, 0))


def _packed(grp: pa.Scalar, rows: list[tuple[int, np.ndarray]], **more) -> pa.Table:
    """One row (grp, b, s) for each block of numbers, with the same ``more`` columns."""
    kinds = {"n": pa.int64(), "salt": pa.int32(), "dims": pa.int32(), "each": pa.int64()}
    data = {"grp": pa.array([grp.as_py()] * len(rows), grp.type), "b": pa.array([b for b, _ in rows], pa.int32()), "s": pa.array([np.ascontiguousarray(m).tobytes() for _, m in rows], pa.binary())}
    return pa.table(data | {k: pa.array([v] * len(rows), kinds[k]) for k, v in more.items()})


#: Vectors of a task that are not parted further.
LEAST_ROWS = 1024


def mixture(vectors: DataFrame, k: Column, steps: int = 10, least: float = 0.15, rows_per_task: int = 65536, cut_every: int = 3, block: int = 256) -> DataFrame:
    """(grp, pos, cluster): soft members of a diagonal Gaussian mixture in each group of ``vectors`` (grp, pos, x); ``soft_gmm`` over any number of tasks.

    ``pos``: the place of a vector in its group, from 0. ``k``: components, a Column over ``n``, the group's size.
    Vectors are dealt by group and place once and stay; in each step the components' means, variances and shares travel to
    them, and sums over their responsibilities come back (2 * dims + 1 numbers a component and task), packed by ``block``
    components a row, and are added up per block. A task holds its vectors and one group's components; it has at most
    ``rows_per_task`` vectors, and no more than its part of all products of vectors and components, two tasks a core.
    """
    spark = vectors.sparkSession
    given = stored(vectors.select("grp", "pos", F.col("x").cast("array<double>").alias("x")), "vectors")
    components = F.greatest(F.lit(1), F.least(k.cast("long"), F.col("n")))
    counts = given.groupBy("grp").agg(F.count("*").alias("n")).withColumn("k", components)
    share = F.lit((counts.agg(F.sum(F.col("n").cast("double") * F.col("k"))).first()[0] or 1.0) / (2 * spark.sparkContext.defaultParallelism))
    counts = stored(counts.select(F.col("grp").alias("g"), F.least(F.lit(rows_per_task), F.greatest(F.lit(LEAST_ROWS), F.ceil(share / F.col("k")))).cast("long").alias("each"), "n"), "counts")
    tasks = counts.agg(F.sum(F.ceil(F.col("n") / F.col("each")))).first()[0] or 1
    salted = given.join(counts.select("g", "each"), F.col("grp").eqNullSafe(F.col("g"))).select("grp", "pos", "x", F.floor(F.col("pos") / F.col("each")).cast("int").alias("salt"), "each")
    held = salted.repartition(max(2 * tasks, int(spark.conf.get("spark.sql.shuffle.partitions"))), "grp", "salt").persist(StorageLevel.DISK_ONLY)
    group = held.schema["grp"].dataType.simpleString()

    def moments_of(rows: pa.Table) -> pa.Table:
        x = _stack(rows["x"])
        return _packed(rows["grp"][0], [(0, np.concatenate([x.sum(0), (x**2).sum(0)]))], n=len(x), salt=rows["salt"][0].as_py(), each=rows["each"][0].as_py())

    def spread_of(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("salt")
        n = sum(rows["n"].to_pylist())
        total = sum(np.frombuffer(s) for s in rows["s"].to_pylist())
        mean, square = total.reshape(2, -1) / n
        return pa.table({"grp": rows["grp"].slice(0, 1), "each": rows["each"].slice(0, 1), "n": pa.array([n], pa.int64()), "spread": [float((square - mean**2).sum() / len(mean) + 1e-3)]})

    parts = held.groupBy("grp", "salt").applyInArrow(moments_of, f"grp {group}, b int, s binary, n long, salt int, each long")
    sizes = parts.groupBy("grp").applyInArrow(spread_of, f"grp {group}, each long, n long, spread double").withColumn("k", components)
    salts = F.sequence(F.lit(0), F.floor((F.col("n") - 1) / F.col("each")).cast("int"))
    sizes = stored(sizes.withColumn("salts", salts).drop("each"), "sizes")
    seeds = sizes.select("grp", "n", "k", "spread", F.explode(F.sequence(F.lit(0).cast("long"), F.col("k") - 1)).alias("c"))
    place = F.when((F.col("c") == F.col("k") - 1) & (F.col("k") > 1), F.col("n") - 1).when(F.col("k") == 1, F.lit(0)).otherwise(F.floor(F.col("c") * ((F.col("n") - 1) / (F.col("k") - 1))))
    seeds = seeds.select(F.col("grp").alias("g"), F.col("c").cast("int").alias("c"), place.cast("long").alias("p"), "k", "spread")
    first = held.join(seeds, F.col("grp").eqNullSafe(F.col("g")) & (F.col("pos") == F.col("p"))).select("grp", F.floor(F.col("c") / block).cast("int").alias("b"), "c", "k", "spread", "x")

    def seeded(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("c")
        x = _stack(rows["x"])
        columns = [1 / rows["k"].to_numpy()[:, None], x, np.repeat(rows["spread"].to_numpy()[:, None], x.shape[1], 1)]
        return _packed(rows["grp"][0], [(rows["b"][0].as_py(), np.concatenate(columns, 1))])

    params = first.groupBy("grp", "b").applyInArrow(seeded, f"grp {group}, b int, s binary")

    def meet(params: DataFrame, f, schema: str) -> DataFrame:
        sent = params.join(sizes.select(F.col("grp").alias("g"), "n", "salts"), F.col("grp").eqNullSafe(F.col("g"))).select(F.col("grp").alias("sg"), F.explode("salts").alias("ss"), "b", "n", "s")

        def run(left: pa.Table, right: pa.Table) -> pa.Table:
            right, x = right.sort_by("b"), _stack(left["x"])
            held = np.concatenate([np.frombuffer(s).reshape(-1, 1 + 2 * x.shape[1]) for s in right["s"].to_pylist()])
            return f(left, right["n"][0].as_py(), x, *np.split(held[:, 1:], 2, 1), held[:, 0])

        return held.groupBy("grp", "salt").cogroup(sent.groupBy("sg", "ss")).applyInArrow(run, schema)

    def sums(left: pa.Table, n: int, x: np.ndarray, mean: np.ndarray, var: np.ndarray, mix: np.ndarray) -> pa.Table:
        total = np.zeros((len(mean), 1 + 2 * x.shape[1]))
        for _, both, near, r in _shares(x, mean, var, mix):
            total[near] += r.T @ both
        return _packed(left["grp"][0], [(i // block, total[i : i + block]) for i in range(0, len(total), block)], n=n, salt=left["salt"][0].as_py(), dims=x.shape[1])

    def added(rows: pa.Table) -> pa.Table:
        """The next parameters of a block of components, from its sums of all tasks."""
        rows = rows.sort_by("salt")
        total = sum(np.frombuffer(s) for s in rows["s"].to_pylist()).reshape(-1, 1 + 2 * rows["dims"][0].as_py())
        w = total[:, :1] + 1e-9
        mean, square = np.split(total[:, 1:] / w, 2, 1)
        return _packed(rows["grp"][0], [(rows["b"][0].as_py(), np.concatenate([w / rows["n"][0].as_py(), mean, np.maximum(square - mean**2, 1e-3)], 1))])

    def members(left: pa.Table, n: int, x: np.ndarray, mean: np.ndarray, var: np.ndarray, mix: np.ndarray) -> pa.Table:
        row, cluster = [], []
        for at, _, near, r in _shares(x, mean, var, mix):
            chosen = r > least
            chosen[np.arange(len(at)), r.argmax(1)] = True
            i, c = np.nonzero(chosen)
            row.append(at[i])
            cluster.append(np.arange(len(mean))[near][c])
        rows = pa.array(np.concatenate(row))
        return pa.table({"grp": left["grp"].combine_chunks().take(rows), "pos": left["pos"].combine_chunks().take(rows), "cluster": pa.array(np.concatenate(cluster), pa.int32())})

    for step in range(1, steps):
        found = meet(params, sums, f"grp {group}, b int, s binary, n long, salt int, dims int")
        params = found.groupBy("grp", "b").applyInArrow(added, f"grp {group}, b int, s binary")
        if step % cut_every == 0:
            params = stored(params, "components")
    out = stored(meet(params, members, f"grp {group}, pos long, cluster int"), "members")
    held.unpersist()
    return out


def gmm_members(vectors: DataFrame, k: int = 3, group: str = "label", id_col: str = "vec_id", vec: str = "embedding") -> DataFrame:
    """(group, id, cluster): soft memberships within each group; null vectors take no part. Rows of one id are told apart by their vectors' order only."""
    given = vectors.select(F.col(group).alias("grp"), F.col(id_col).alias("id"), F.col(vec).alias("x")).where(F.col("x").isNotNull())
    placed = stored(numbered(given, [F.col("id"), F.col("x")], ["grp"]).select("grp", "id", "x", (F.col("rank") - 1).alias("pos")), "placed")
    found = mixture(placed, F.lit(k)).select(F.col("grp").alias("g"), F.col("pos").alias("p"), "cluster")
    return placed.join(found, F.col("grp").eqNullSafe(F.col("g")) & (F.col("pos") == F.col("p"))).select(F.col("grp").alias(group), F.col("id").alias(id_col), "cluster")


def raptor_tree(chunks: DataFrame, levels: int = 3, group: str = "source", pieces: int = 3) -> DataFrame:
    """(group, level, node, children, text): chunks (group, chunk_id, text, vector) clustered and summarised level by level.

    A level is a DataFrame: groups of three nodes or more are parted into a fifth as many soft clusters, a cluster's
    text is the first ``pieces`` sentences of its members in their order, its vector their mean, and the clusters are
    the next level's nodes. Of a member's text only what can be among the first sentences goes to its cluster.
    """
    given = chunks.select(F.col(group).alias("grp"), F.col("chunk_id").cast("string").alias("id"), F.coalesce("text", F.lit("")).alias("text"), F.col("vector").cast("array<double>").alias("x"), F.col("chunk_id").alias("o"))
    nodes = stored(numbered(given, [F.col("o"), F.col("x")], ["grp"]).select("grp", "id", "text", "x", (F.col("rank") - 1).alias("pos"), F.col("rank_of").alias("n")), "nodes")
    made = []
    for level in range(1, levels + 1):
        nodes = nodes.where("n >= 3")
        if not nodes.limit(1).count():
            break
        found = mixture(nodes, F.greatest(F.lit(2), F.floor(F.col("n") / 5))).select(F.col("grp").alias("g"), F.col("pos").alias("p"), "cluster")
        joined = nodes.join(found, F.col("grp").eqNullSafe(F.col("g")) & (F.col("pos") == F.col("p"))).select("grp", "cluster", "pos", "id", F.substring_index("text", ".", pieces).alias("t"), (F.length("text") > F.length(F.substring_index("text", ".", pieces))).alias("more"), "x")
        joined = stored(joined, "joined")
        means = joined.select("grp", "cluster", F.posexplode("x").alias("i", "v")).groupBy("grp", "cluster", "i").agg(F.avg("v").alias("v")).groupBy(F.col("grp").alias("mg"), F.col("cluster").alias("mc")).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "v"))), lambda c: c["v"]).alias("x"))
        members = F.array_sort(F.collect_list(F.struct("pos", "id", F.concat("t", F.when(F.col("more"), ".").otherwise("")).alias("t"))))
        clusters = joined.groupBy("grp", "cluster").agg(members.alias("m"))
        text = F.array_join(F.transform(F.slice(F.split(F.array_join("m.t", " "), r"\."), 1, pieces), lambda s: F.regexp_replace(s, r"(?U)^\s+|\s+$", "")), ". ")
        clusters = clusters.select("grp", "cluster", F.col("m.id").alias("children"), text.alias("text"))
        both = clusters.join(means, F.col("grp").eqNullSafe(F.col("mg")) & (F.col("cluster") == F.col("mc")))
        both = numbered(both.select("grp", "cluster", "children", "text", "x", F.concat(F.lit(f"{level}-"), F.col("cluster").cast("string")).alias("id")), [F.col("cluster")], ["grp"])
        nodes = stored(both.withColumn("pos", F.col("rank") - 1).withColumn("n", F.col("rank_of")), "nodes")
        made.append(nodes.select(F.col("grp").alias(group), F.lit(level).alias("level"), F.col("id").alias("node"), "children", "text"))
        nodes = nodes.select("grp", "id", "text", "x", "pos", "n")
    if not made:
        return given.limit(0).select(F.col("grp").alias(group), F.lit(1).alias("level"), F.col("id").alias("node"), F.array("id").alias("children"), "text")
    return reduce(DataFrame.unionByName, made)


def pca_2d(vectors: DataFrame, id_col: str = "vec_id", vec: str = "embedding") -> DataFrame:
    """(id, x, y): the two main axes, from moments summed in Arrow batches (dims**2 numbers a batch); the sign makes each axis's largest weight positive; scaled to [-1, 1]."""

    def moments(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, total, square = 0, 0.0, 0.0
        for p in batches:
            if len(p):
                x = np.stack(p["v"].to_numpy()).astype(float)
                n, total, square = n + len(x), total + x.sum(0), square + x.T @ x
        if n:
            yield pd.DataFrame({"n": [n], "s": [total.tolist()], "q": [square.ravel().tolist()]})

    given = vectors.select(id_col, F.col(vec).alias("v")).where(F.col("v").isNotNull())
    part = given.select("v").mapInPandas(moments, "n long, s array<double>, q array<double>")
    cells = part.select("n", F.posexplode(F.concat("s", "q")).alias("i", "x")).groupBy("i").agg(F.sum("n").alias("n"), F.sum("x").alias("x")).orderBy("i").collect()  # dims + dims**2 numbers
    if not cells:
        return given.select(id_col, F.lit(0.0).alias("x"), F.lit(0.0).alias("y"))
    dims = int((np.sqrt(1 + 4 * len(cells)) - 1) / 2)
    n, held = cells[0].n, np.array([r.x for r in cells])
    mean = held[:dims] / n
    _, axes = np.linalg.eigh((held[dims:].reshape(dims, dims) - n * np.outer(mean, mean)) / max(1, n - 1))
    out = given
    for name, k in (("x", -1), ("y", -2)):
        a = axes[:, max(k, -dims)] * np.sign(axes[np.abs(axes[:, max(k, -dims)]).argmax(), max(k, -dims)])
        w, at = F.array(*[F.lit(float(z)) for z in a]), float(a @ mean)
        out = out.withColumn(name, F.aggregate(F.zip_with("v", w, lambda p, q: p.cast("double") * q), F.lit(-at), lambda s, z: s + z))
    top = out.agg(F.max(F.greatest(F.abs("x"), F.abs("y"))).alias("top"))
    return out.crossJoin(F.broadcast(top)).select(id_col, (F.col("x") / F.col("top")).alias("x"), (F.col("y") / F.col("top")).alias("y"))
