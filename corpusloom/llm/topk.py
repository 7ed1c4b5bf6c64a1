"""Exact top-k inner-product search by block-at-a-time pruning.

Vectors are cut into blocks of consecutive ids. A block keeps the maximum and minimum of each
component (its "terms"); the sum over components of the larger of q*max and q*min bounds every
score in the block. Each query visits blocks in falling order of that bound and scores them
through the block's forward index (its matrix) until the bound falls below the k-th score so far.

Scale: the score space is a grid of cells of about ``rows_per_cell`` vectors and
``queries_per_cell`` queries; vectors go to the cells of their row, queries to those of their
column, so nothing is broadcast or collected and a cell's memory is bounded. Rows are dealt by
their place in a written table, not by id, so a repeated id burdens no cell. The first row of cells
is searched alone; each query's k-th score there is a floor for the others, whose blocks are passed
over when their bound lies below it. Cells return their k best per query, which a window over the
query merges.

Defined results: vectors that are null or hold null, NaN or infinite components take no part.
Rows that repeat an id are candidates each; as queries each has a list of its own under the one
id, and its own row is left out (without ``place`` their lists are merged, and all rows of the id left out). Null ids take no part. Vectors of different
length are compared as if padded with zeros. Components and scores beyond a long are an error, not
clipped. An empty table gives no rows. Ties go to the smaller id. Other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  used as pa.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusloom.llm.common import Scratch

def quantized(df: DataFrame, id_col: str, vec_col: str, scale: float = 64.0) -> DataFrame:
    """(id, v array<long>): floor(scale * x) per component, valid vectors only."""
    given = df.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("x"))
    bad = F.exists("x", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    part = lambda x: F.lit(scale) * x.cast("double")
    whole = lambda x: F.when(F.abs(part(x)) < 2.0**63, F.floor(part(x))).otherwise(F.raise_error(F.lit("a component is too large for a long")).cast("long"))
    return given.where(F.col("id").isNotNull() & F.col("x").isNotNull() & ~F.coalesce(bad, F.lit(False))).select("id", F.transform("x", whole).alias("v"))


def placed(vectors: DataFrame) -> DataFrame:
    """``vectors`` stored with ``place``, which tells rows of one id apart."""
    return Scratch(vectors.sparkSession).stored(vectors.withColumn("place", F.monotonically_increasing_id()), "vectors")


def _matrix(column: pa.ListArray, dims: int) -> np.ndarray:
    sizes = np.diff(column.offsets.to_numpy())
    out = np.zeros((len(column), dims), np.int64)
    if len(column):
        out[np.repeat(np.arange(len(column)), sizes), np.concatenate([np.arange(n) for n in sizes]) if len(set(sizes.tolist())) > 1 else np.tile(np.arange(sizes[0]), len(column))] = column.flatten().to_numpy()
    return out


def search_cell(qid: np.ndarray, q: np.ndarray, vid: np.ndarray, v: np.ndarray, k: int, block: int = 256, floor: np.ndarray | None = None, q_row: np.ndarray | None = None, v_row: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(places of queries, vector ids, scores): the k best of each query within the cell that reach its ``floor``, exact, ties to smaller ids.

    ``q_row``, ``v_row``: what tells rows apart, by default their ids; a query's own row is no candidate.
    """
    q_row, v_row = (qid if q_row is None else q_row), (vid if v_row is None else v_row)
    order = np.argsort(vid, kind="stable")
    vid, v, v_row = vid[order], v[order], v_row[order]
    reach = float(np.abs(q).sum(1).max(initial=0)) * float(np.abs(v).max(initial=0))
    kind = np.float64 if reach < 2**52 else np.int64 if reach < 2**62 else object  # float64 sums of integers below 2**53 are exact, and use BLAS; objects are whole numbers of any size
    q, v = q.astype(kind), v.astype(kind)
    starts = np.arange(0, len(vid), block)
    high = np.maximum.reduceat(v, starts, axis=0)
    low = np.minimum.reduceat(v, starts, axis=0)
    bound = np.maximum(q, 0) @ high.T + np.minimum(q, 0) @ low.T
    tour = np.argsort(-bound, axis=1, kind="stable")
    least = np.iinfo(np.int64).min + 1  # its negative is a long, too
    best = np.full((len(qid), k), least, np.int64)
    floor = np.full(len(qid), least, np.int64) if floor is None else floor
    ids = np.full((len(qid), k), np.iinfo(np.int64).max, np.int64)
    for t in range(len(starts)):
        b = tour[:, t]
        top = bound[np.arange(len(qid)), b]
        live = ((best[:, -1] == least) | (top > best[:, -1]) | ((top == best[:, -1]) & (vid[starts[b]] < ids[:, -1]))) & (top >= floor)
        live = live.astype(bool)
        if not (live | ((top >= floor) & ((best[:, -1] == least) | (top >= best[:, -1])))).any():
            break  # every later bound of every query is lower
        for x in np.unique(b[live]):
            rows = np.flatnonzero(live & (b == x))
            mine = vid[starts[x] : starts[x] + block]
            own = v_row[starts[x] : starts[x] + block][None, :] == q_row[rows][:, None]
            s = np.where(own, 0, q[rows] @ v[starts[x] : starts[x] + block].T).astype(np.int64)
            alls = np.concatenate([best[rows], np.where(own, least, s)], axis=1)
            alli = np.concatenate([ids[rows], np.where(own, np.iinfo(np.int64).max, np.broadcast_to(mine, s.shape))], axis=1)
            if alls.shape[1] > 4 * k:  # keep all that tie with the k-th, then order exactly
                kth = -np.partition(-alls, k - 1, axis=1)[:, k - 1]
                width = int((alls >= kth[:, None]).sum(1).max())
                if width < alls.shape[1]:
                    keep = np.argsort(-alls, axis=1, kind="stable")[:, :width]
                    alls, alli = np.take_along_axis(alls, keep, 1), np.take_along_axis(alli, keep, 1)
            pos = np.lexsort((alli, -alls), axis=1)[:, :k]
            best[rows], ids[rows] = np.take_along_axis(alls, pos, 1), np.take_along_axis(alli, pos, 1)
    there = best != least
    return np.repeat(np.arange(len(qid)), there.sum(1)), ids[there], best[there]


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 20, rows_per_cell: int = 16384, queries_per_cell: int = 65536, block: int = 256) -> DataFrame:
    """Search ``queries`` (id, v) against ``vectors`` (id, v): query_id, rank, vec_id, score.

    Rows of a query's id are left out; if both have a column ``place`` (see ``placed``), only the query's own row is.
    """
    scratch = Scratch(vectors.sparkSession)
    same = "place" in vectors.columns and "place" in queries.columns
    if not same:
        vectors = scratch.stored(vectors.withColumn("place", F.monotonically_increasing_id()), "vectors")
        queries = scratch.stored(queries.withColumn("place", F.monotonically_increasing_id()), "queries")
    n_v, n_q = vectors.count(), queries.count()
    rows, cols = max(1, -(-n_v // rows_per_cell)), max(1, -(-n_q // queries_per_cell))
    of_row = F.pmod(F.xxhash64(F.floor(F.col("place") / block)), F.lit(rows))
    of_col = F.pmod(F.xxhash64("place"), F.lit(cols))
    dealt_v = vectors.select(of_row.alias("r"), F.explode(F.sequence(F.lit(0), F.lit(cols - 1))).alias("c"), "place", "id", "v", F.lit(None).cast("long").alias("floor"), F.lit(False).alias("is_query"))
    dealt_q = lambda q, first, last: q.select(F.explode(F.sequence(F.lit(first), F.lit(last))).alias("r"), of_col.alias("c"), "place", "id", "v", "floor", F.lit(True).alias("is_query"))
    none = np.iinfo(np.int64).min + 1

    def run(t: pa.Table) -> pa.Table:
        is_q = t["is_query"].combine_chunks()
        dims = int(max(np.diff(t["v"].combine_chunks().offsets.to_numpy()).max(initial=0), 1))
        q, v = t.filter(is_q), t.filter(pa.compute.invert(is_q))
        if not q.num_rows or not v.num_rows:
            return pa.table({"place": pa.array([], pa.int64()), "query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.int64())})
        floor = q["floor"].combine_chunks().fill_null(none).to_numpy()
        at, vec, score = search_cell(q["id"].to_numpy(), _matrix(q["v"].combine_chunks(), dims), v["id"].to_numpy(), _matrix(v["v"].combine_chunks(), dims), k, block, floor, *((q["place"].to_numpy(), v["place"].to_numpy()) if same else ()))
        return pa.table({"place": q["place"].to_numpy()[at], "query_id": q["id"].to_numpy()[at], "vec_id": vec, "score": score})

    schema = "place long, query_id long, vec_id long, score long"
    search = lambda vs, qs: vs.union(qs).groupBy("r", "c").applyInArrow(run, schema)
    plain = queries.withColumn("floor", F.lit(None).cast("long"))
    found = search(dealt_v.where("r = 0"), dealt_q(plain, 0, 0))
    if rows > 1:
        found = scratch.stored(found, "first")
        kth = found.groupBy(F.col("place").alias("p")).agg(F.min("score").alias("floor"), F.count("*").alias("n")).where(F.col("n") >= k).select("p", "floor")
        floored = queries.join(kth, F.col("place") == F.col("p"), "left").select("place", "id", "v", "floor")
        found = found.union(search(dealt_v.where("r > 0"), dealt_q(floored, 1, rows - 1)))
    rank = F.row_number().over(Window.partitionBy("place" if same else "query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
