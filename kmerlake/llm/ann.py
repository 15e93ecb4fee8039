"""Nearest neighbours by cosine through a block matrix join over int8 codes.

Each vector is coded once: its unit vector as int8, a scale, and the norm of the rounding
error. Codes are cut into query blocks and candidate blocks; every query block meets every
candidate block once, as one tile. In a tile a matrix product of the codes gives approximate
cosines, and the errors give a bound on how far off each can be. Pairs whose upper bound
reaches the k-th best lower bound survive the tile. Heaps merge tiles' lower bounds, a fixed
number of tiles at a time, which sorts out further pairs. Only for the survivors of all tiles
the original vectors are fetched, and the cosine is taken in double precision.

Vectors that are null, empty, zero or hold null or non-finite components take no part,
nor do vectors of another length than the query's. Null ids take no part. Every candidate
row counts, also of rows with one vec_id, but for those with the query's id; rows of one
query id are one query, which has the k best of what any of them finds.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F, types as T

from . import shared

K = 5
QUERY_BLOCK = 2048
CANDIDATE_BLOCK = 2048
FAN_IN = 16


def coded(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes (int8 values as float32, so that the product is exact), scales, and error norms of unit vectors."""
    scale = np.abs(vectors).max(axis=1) / 127
    scale[scale == 0] = 1
    codes = np.rint(vectors / scale[:, None])
    error = np.sqrt(((vectors - codes * scale[:, None]) ** 2).sum(axis=1))
    return codes.astype(np.int8), scale, error


def product(a: np.ndarray, b: np.ndarray, part: int = 1024) -> np.ndarray:
    """Integer product of int8 codes; float32 holds the sums of up to 1024 products exactly."""
    out = np.zeros((len(a), len(b)), dtype=np.float64)
    for i in range(0, a.shape[1], part):
        out += a[:, i : i + part].astype(np.float32) @ b[:, i : i + part].astype(np.float32).T
    return out


def cosines(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Cosine of each row of q with the same row of c, in double precision."""
    q, c = (np.ldexp(x, -np.frexp(np.abs(x).max(axis=1))[1][:, None]) for x in (q, c))  # exact, so that no square overflows
    return (q * c).sum(axis=1) / (np.sqrt((q * q).sum(axis=1)) * np.sqrt((c * c).sum(axis=1)))


def units(vectors: np.ndarray) -> np.ndarray:
    vectors = np.ldexp(vectors, -np.frexp(np.abs(vectors).max(axis=1))[1][:, None])
    return vectors / np.sqrt((vectors * vectors).sum(axis=1))[:, None]


def bounded(q: tuple, c: tuple, k: int, rows: int = 256) -> dict[int, tuple[list[float], list[tuple[float, int, int]]]]:
    """For each query id its k best lower bounds, best first, and what survives them: (upper bound, query row, candidate row).

    q and c: ids, row numbers, codes, scales and errors of vectors of one length.
    """
    ids, numbers, codes_q, scale_q, error_q = q
    names, others, codes_c, scale_c, error_c = c
    norm_c = 1 + error_c  # of the decoded candidates, at most
    out: dict[int, tuple[list, list]] = {}
    for i in range(0, len(ids), rows):
        part = slice(i, i + rows)
        near = product(codes_q[part], codes_c) * scale_q[part, None] * scale_c[None, :]
        off = error_q[part, None] * norm_c[None, :] + error_c[None, :] + 1e-9
        own = ids[part, None] == names[None, :]
        low = np.where(own, -np.inf, near - off)
        take = min(k, low.shape[1])
        best = -np.sort(-np.partition(low, low.shape[1] - take, axis=1)[:, low.shape[1] - take :], axis=1)
        bar = best[:, -1] if take == k else np.full(len(best), -np.inf)
        row, col = np.nonzero((near + off >= bar[:, None]) & ~own)
        high = (near + off)[row, col]
        cuts = np.searchsorted(row, np.arange(len(low) + 1))
        for r in range(len(low)):
            x, y = cuts[r], cuts[r + 1]
            pairs = list(zip(high[x:y].tolist(), [int(numbers[i + r])] * int(y - x), others[col[x:y]].tolist()))
            lows, have = out.get(int(ids[i + r]), ([], []))
            out[int(ids[i + r])] = sorted_out([lows, [v for v in best[r].tolist() if v > -np.inf]], [have, pairs], k)
    return out


def sorted_out(lows: list[list[float]], pairs: list[list[tuple]], k: int) -> tuple[list[float], list[tuple]]:
    """The k best of lists of lower bounds that descend, and the pairs whose upper bounds reach the last of them."""
    best = heapq.nsmallest(k, heapq.merge(*([-x for x in own] for own in lows)))
    bar = -best[-1] if len(best) == k else -np.inf
    return [-x for x in best], [p for own in pairs for p in own if p[0] >= bar]


def blocks_of(frame: pd.DataFrame) -> dict[int, tuple]:
    """ids, rows, codes, scales and errors by vector length."""
    out = {}
    for n, part in frame.groupby("n"):
        codes = np.frombuffer(b"".join(part["code"]), dtype=np.int8).reshape(len(part), n)
        out[int(n)] = (part["id"].to_numpy(), part["row"].to_numpy(), codes, part["scale"].to_numpy(), part["error"].to_numpy())
    return out


def with_codes(rows: DataFrame) -> DataFrame:
    """(row, id, v, n, code, scale, error) of (id, v); row numbers are unique."""

    def scan(frames):
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 40
        for frame in frames:
            frame = frame.assign(row=np.arange(number, number + len(frame)), n=frame["v"].map(len).astype("int32"))
            number += len(frame)
            for n, part in frame.groupby("n"):
                codes, scale, error = coded(units(np.array(part["v"].tolist(), dtype=np.float64).reshape(len(part), n)))
                yield part.assign(code=[x.tobytes() for x in codes], scale=scale, error=error)[["row", "id", "v", "n", "code", "scale", "error"]]

    return rows.mapInPandas(scan, "row long, id long, v array<double>, n int, code binary, scale double, error double")


def usable(vectors: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    """(id, v) of the rows that take part."""
    v = F.col("v")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    return vectors.select(F.col(vec_id).cast("long").alias("id"), F.col(embedding).cast("array<double>").alias("v")).filter(F.col("id").isNotNull() & v.isNotNull() & F.coalesce(fine, F.lit(False)))


def search(queries: DataFrame, candidates: DataFrame, k: int = K, vec_id: str = "vec_id", embedding: str = "embedding", query_block: int = QUERY_BLOCK, candidate_block: int = CANDIDATE_BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score: for each query its k nearest of all candidates but its own id."""
    spark = queries.sparkSession
    folder = shared.new_folder(spark, "neighbours")
    left = shared.written(with_codes(usable(queries, vec_id, embedding)), f"{folder}/queries")
    right = shared.written(with_codes(usable(candidates, vec_id, embedding)), f"{folder}/candidates")
    nq = max(1, -(-left.count() // query_block))
    nc = tiles = max(1, -(-right.count() // candidate_block))
    code = ["row", "id", "n", "code", "scale", "error"]
    # rows of one query id share a block; the original vectors stay where they are
    q = left.select(*code, F.pmod(F.xxhash64("id"), F.lit(nq)).cast("int").alias("qb")).withColumn("cb", F.explode(F.sequence(F.lit(0), F.lit(nc - 1))))
    c = right.select(*code, F.pmod(F.xxhash64("row", F.lit(1)), F.lit(nc)).cast("int").alias("cb")).withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(nq - 1))))
    pair = T.ArrayType(T.StructType.fromDDL("high double, q long, c long"))
    tile = T.StructType.fromDDL("qb int, cb int, query_id long, lows array<double>").add("pairs", pair)

    def tile_rows(key, found: dict) -> pd.DataFrame:
        pairs = pd.Series([[{"high": h, "q": x, "c": y} for h, x, y in p] for _, p in found.values()], dtype=object)
        lows = pd.Series([x for x, _ in found.values()], dtype=object)
        return pd.DataFrame({"qb": pd.Series([key[0]] * len(found), dtype="int32"), "cb": pd.Series([key[1]] * len(found), dtype="int32"), "query_id": pd.Series(list(found), dtype="int64"), "lows": lows, "pairs": pairs})

    def meet(key, left, right):
        have, found = blocks_of(right), {}
        for n, block in blocks_of(left).items():
            for query, (lows, pairs) in (bounded(block, have[n], k) if n in have else {}).items():
                had = found.get(query, ([], []))
                found[query] = sorted_out([had[0], lows], [had[1], pairs], k)
        return tile_rows(key, found)

    def merge(key, frame):
        found: dict[int, tuple[list, list]] = {}
        for query, lows, pairs in zip(frame["query_id"].tolist(), frame["lows"], frame["pairs"]):
            had = found.setdefault(query, ([], []))
            had[0].append(list(lows))
            had[1].append([(x["high"], x["q"], x["c"]) for x in pairs])
        return tile_rows(key, {query: sorted_out(*had, k) for query, had in found.items()})

    best = q.groupBy("qb", "cb").cogroup(c.groupBy("qb", "cb")).applyInPandas(meet, tile)
    while tiles > 1:
        tiles = -(-tiles // FAN_IN)
        best = best.withColumn("cb", F.floor(F.col("cb") / FAN_IN).cast("int")).groupBy("qb", "cb").applyInPandas(merge, tile)
    survivors = best.select("query_id", F.explode("pairs").alias("p")).select("query_id", F.col("p.q").alias("q"), F.col("p.c").alias("c"))

    def exact(frames):
        for frame in frames:
            score = np.zeros(len(frame))
            for _, part in frame.groupby(frame["qv"].map(len)):
                at = part.index.to_numpy()
                score[at] = cosines(np.array(part["qv"].tolist(), dtype=np.float64), np.array(part["cv"].tolist(), dtype=np.float64))
            yield frame[["query_id", "vec_id"]].assign(score=score)

    pairs = survivors.join(left.select(F.col("row").alias("q"), F.col("v").alias("qv")), "q").join(right.select(F.col("row").alias("c"), F.col("id").alias("vec_id"), F.col("v").alias("cv")), "c")
    found = pairs.select("query_id", "vec_id", "qv", "cv").mapInPandas(exact, "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    out = found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
    return shared.settled(out, folder)
