"""Exact top-k by inner product: a Voronoi kNN join.

Vectors are turned into integers, floor(scale * x). Pivots (a hashed sample of bounded size) cut the data
into cells; a cell's summary is its count and radius r. For a query q and a cell with pivot p every score lies
within q.p - |q| r and q.p + |q| r. So the cells with the highest lower bounds that together hold k + 1 rows
(one may be the query's own) give the query a score that its k-th best is not below, and only cells whose upper bound reaches it can hold a result. Queries are grouped by pivots; a cell's rows are replicated to just the groups with a query that
needs the cell. A group's rows are dealt in slices of bounded size (by a hash of the id, so a cell of very many
equal vectors is spread too), each slice is solved alone, and the best k of the slices' bests are the result.

Defined cases: vectors that are null or hold null, NaN or infinite components, and rows without an id take no
part; vectors of other lengths than the query's are no candidates; rows that repeat an id are separate queries and
separate candidates: a query leaves out its own row alone, so a copy of it is found; ties go to the smaller id;
fewer candidates than k are all returned; an empty table gives none; very long vectors are compared whole; other
columns are not read, whatever their names. Scores beyond 64 bits stop at the ends of the range.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridlore.llm.common import stage

SCALE, MAX_PIVOTS, GROUP_QUERIES, SLICE_ROWS = 1024, 1024, 1024, 4096


def _matrix(column) -> np.ndarray:
    return np.frombuffer(b"".join(column), np.int64).reshape(len(column), -1)


def scores(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact integer inner products: in doubles where they hold all sums, else in 64 bits, else without bound."""
    most = float(np.abs(q).max(initial=0)) * float(np.abs(x).max(initial=0)) * max(1, q.shape[1])
    if most < 2.0**53:
        return (q.astype(np.float64) @ x.astype(np.float64).T).astype(np.int64)
    if most < 2.0**62:
        return q @ x.T
    wide = q.astype(object) @ x.T.astype(object)
    return np.clip(wide, -(1 << 63), (1 << 63) - 1).astype(np.int64)


def clean(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", scale: float = SCALE) -> DataFrame:
    """(uid, key, v: int64 components as bytes, dim) of the rows that take part."""
    ok = F.col(key).isNotNull() & F.col(vector).isNotNull() & F.forall(F.col(vector), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))

    def run(batches):
        for pdf in batches:
            v = [np.clip(np.floor(scale * np.asarray(x, np.float64)), -(2.0**62), 2.0**62).astype(np.int64) for x in pdf["v"]]
            yield pd.DataFrame({"uid": pdf["uid"], "key": pdf["key"], "v": [x.tobytes() for x in v], "dim": [len(x) for x in v]})

    return vectors.filter(ok).select(F.monotonically_increasing_id().alias("uid"), F.col(key).cast("long").alias("key"), F.col(vector).cast("array<double>").alias("v")).mapInPandas(run, "uid long, key long, v binary, dim int")


def _assigned(rows: DataFrame, pivots: np.ndarray) -> DataFrame:
    """Adds the cell (the nearest pivot's number) and the distance to its pivot."""
    sent = rows.sparkSession.sparkContext.broadcast(pivots)

    def run(batches):
        p = sent.value.astype(np.float64)
        half = (p * p).sum(1) / 2
        for pdf in batches:
            x = _matrix(pdf["v"]).astype(np.float64) if len(pdf) else np.zeros((0, p.shape[1]))
            cell = (x @ p.T - half).argmax(1) if len(x) else np.zeros(0, int)
            yield pdf.assign(cell=cell.astype(np.int32), dist=np.sqrt(((x - p[cell]) ** 2).sum(1)))

    return rows.mapInPandas(run, "uid long, key long, v binary, dim int, cell int, dist double")


def needs(q: np.ndarray, pivots: np.ndarray, counts: np.ndarray, radii: np.ndarray, k: int) -> np.ndarray:
    """Which cells each query needs. Bounds are widened a little against rounding."""
    centre = q.astype(np.float64) @ pivots.astype(np.float64).T
    reach = np.sqrt((q.astype(np.float64) ** 2).sum(1))[:, None] * radii[None, :]
    slack = 1e-9 * (np.abs(centre) + reach) + 1e-6
    low, high = centre - reach - slack, centre + reach + slack
    order = np.argsort(-low, axis=1)
    held = np.cumsum(counts[order], axis=1)
    enough = (held >= k + 1).argmax(1)  # the query's own row may be among them
    floor = np.where(held[:, -1] >= k + 1, np.take_along_axis(low, np.take_along_axis(order, enough[:, None], 1), 1)[:, 0], -np.inf)
    return high >= floor[:, None]


def top_k(vectors: DataFrame, is_query, key: str = "vec_id", vector: str = "embedding", k: int = 10, scale: float = SCALE, slice_rows: int = SLICE_ROWS, group_queries: int = GROUP_QUERIES) -> DataFrame:
    """(query_id, rank from 1, key, score) for the rows for which is_query (a column over the key, named `key`) holds.
    A row of the result for each query row: rows that repeat an id are asked one by one."""
    rows = stage(clean(vectors, key, vector, scale), "vectors")
    out = None
    for r in rows.groupBy("dim").agg(F.count("*").alias("n"), F.sum(is_query.cast("long")).alias("q")).orderBy("dim").collect():  # a row for each length of vectors
        if r["q"]:
            part = _one_length(rows.filter(F.col("dim") == r["dim"]), r["dim"], r["n"], r["q"], is_query, k, slice_rows, group_queries)
            out = part if out is None else out.unionByName(part)
    if out is None:
        out = rows.sparkSession.createDataFrame([], "query_id long, rank int, key long, score long")
    return out.withColumnRenamed("key", key)


def _one_length(rows: DataFrame, dim: int, n: int, n_queries: int, is_query, k: int, slice_rows: int, group_queries: int) -> DataFrame:
    spark = rows.sparkSession
    most = max(1, min(MAX_PIVOTS, int(n**0.5)))
    drawn = rows.select(F.xxhash64("key").alias("h"), "key", "v").orderBy("h", "key", "v").limit(most).collect()  # at most MAX_PIVOTS rows
    pivots = np.unique(_matrix([r["v"] for r in drawn]), axis=0) if dim else np.zeros((1, 0), np.int64)
    cells = stage(_assigned(rows, pivots), "cells")
    counts, radii = np.zeros(len(pivots)), np.zeros(len(pivots))
    for r in cells.groupBy("cell").agg(F.count("*").alias("n"), F.max("dist").alias("r")).collect():  # a row for each pivot
        counts[r["cell"]], radii[r["cell"]] = r["n"], r["r"] * (1 + 1e-12) + 1e-6
    full = counts > 0
    groups = max(1, -(-n_queries // group_queries))
    sent = spark.sparkContext.broadcast((pivots, counts, radii, full, groups))

    def group(batches):
        pivots, counts, radii, full, groups = sent.value
        heads = pivots[: min(groups, len(pivots))].astype(np.float64)
        ids = np.flatnonzero(full)
        for pdf in batches:
            if len(pdf):
                q = _matrix(pdf["v"])
                g = (q.astype(np.float64) @ heads.T - (heads * heads).sum(1) / 2).argmax(1)
                need = needs(q, pivots[ids], counts[ids], radii[ids], k)
                yield pd.DataFrame({"uid": pdf["uid"], "key": pdf["key"], "v": pdf["v"], "g": g.astype(np.int32), "need": [ids[x].astype(np.int32) for x in need]})

    queries = stage(cells.filter(is_query).select("uid", "key", "v").mapInPandas(group, "uid long, key long, v binary, g int, need array<int>"), "query-groups")
    # Only a group that many queries fall into is cut into blocks, by its own count.
    many = queries.groupBy("g").agg(F.ceil(F.count("*") / group_queries).cast("int").alias("blocks"))  # a row for each pivot at most
    queries = stage(queries.join(F.broadcast(many), "g").withColumn("block", F.pmod(F.xxhash64("uid"), F.col("blocks")).cast("int")).drop("blocks"), "queries")
    wanted = stage(queries.select("g", "block", F.explode("need").alias("cell")).distinct(), "needs")
    sizes = wanted.join(F.broadcast(spark.createDataFrame(pd.DataFrame({"cell": np.arange(len(counts)), "of": counts.astype(int)}), "cell int, of long")), "cell")
    slices = stage(sizes.groupBy("g", "block").agg(F.greatest(F.lit(1), F.ceil(F.sum("of") / slice_rows)).cast("int").alias("slices")), "slices")
    data = cells.select("uid", "key", "v", "cell").join(wanted.join(slices, ["g", "block"]), "cell")
    data = data.select("g", "block", F.pmod(F.xxhash64("uid"), F.col("slices")).cast("int").alias("slice"), "uid", "key", "v")
    asked = queries.join(slices, ["g", "block"]).select("g", "block", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("slice"), "uid", "key", "v")
    best = asked.groupBy("g", "block", "slice").cogroup(data.groupBy("g", "block", "slice")).applyInPandas(_solver(k), "uid long, query_id long, key long, score long")
    order = Window.partitionBy("uid").orderBy(F.desc("score"), F.asc("key"))
    return best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "key", "score")


def _solver(k: int):
    def solve(q: pd.DataFrame, x: pd.DataFrame) -> pd.DataFrame:
        if not len(q) or not len(x):
            return pd.DataFrame({"uid": [], "query_id": [], "key": [], "score": []}).astype("int64")
        rows, ids, out = x["uid"].to_numpy(), x["key"].to_numpy(), []
        data = _matrix(x["v"])
        for i in range(0, len(q), 256):
            s = scores(_matrix(q["v"][i : i + 256]), data)
            for uid, asked, row in zip(q["uid"].to_numpy()[i : i + 256], q["key"].to_numpy()[i : i + 256], s):
                at = np.flatnonzero(rows != uid)
                if len(at) > k:
                    at = at[row[at] >= np.partition(row[at], len(at) - k)[len(at) - k]]
                at = at[np.lexsort((ids[at], -row[at].astype(object) if row.min() == -(1 << 63) else -row[at]))][:k]
                out.append(pd.DataFrame({"uid": uid, "query_id": asked, "key": ids[at], "score": row[at]}))
        return pd.concat(out)

    return solve
