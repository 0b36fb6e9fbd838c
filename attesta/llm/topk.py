"""Exact top-k search by inner product.

Vectors are handled by descending length. Both sides are rotated by the right singular vectors of a sample, so that
the first coordinates carry most of the length; a partial sum over them plus the Cauchy-Schwarz bound of the
rest (product of the residual lengths) prunes candidates. What survives is scored on the whole integers.
Pruning is safe for any rotation: the sample decides how much is pruned, never what is found.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

K = 5
QUERY_EVERY = 50
#: Vectors of a block, for queries and for candidates; a task holds one block of each.
BLOCK = 2048
#: Vectors of the sample that gives the rotation, and of the longest ones that give the first thresholds.
SAMPLE = 2048
HEAD = 16
#: Classes of length by which candidates are dealt to blocks.
LEVELS = 64
SLACK = 1e-6


def quantised(vector: Column) -> Column:
    """Each component x as floor(256 * x), x as double; null if the vector is null or holds null or a non-finite value."""
    good = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) != F.lit(float("inf"))))
    return F.when(vector.isNotNull() & good, F.transform(vector, lambda x: F.floor(F.lit(256.0) * x.cast("double")).cast("long")))


def _matrix(rows: list[list[int]], width: int) -> np.ndarray:
    out = np.zeros((len(rows), width), np.int64)
    for i, row in enumerate(rows):
        out[i, : len(row)] = row
    return out


def _unpacked(data: bytes, width: int) -> tuple[np.ndarray, np.ndarray]:
    both = np.frombuffer(data, np.int64).reshape(-1, width + 1)
    return both[:, 0], both[:, 1:]


def _exact(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Integer inner products, by floating point where no partial sum can leave 53 bits; beyond 63 bits the nearest that a long holds."""
    most = float(np.abs(q.astype(np.float64)).max()) * float(np.abs(c.astype(np.float64)).max()) * q.shape[1] if q.size and c.size else 0.0
    if most < 2**52:
        return (q.astype(np.float64) @ c.astype(np.float64).T).astype(np.int64)
    if most < 2**62:
        return q @ c.T
    whole = q.astype(object) @ c.astype(object).T
    return np.clip(whole, -(2**63), 2**63 - 1).astype(np.int64)


def _best(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k highest scores, ties to the smaller id."""
    return np.lexsort((ids, -scores))[:k]


def search_block(qid: np.ndarray, q: np.ndarray, floor: np.ndarray, cid: np.ndarray, c: np.ndarray, rotation: np.ndarray, k: int = K) -> Iterator[tuple[int, int, int]]:
    """Yield (query, candidate, score) of the k best candidates of the block for each query.

    ``floor``: a score that the query's k-th best reaches anyway; candidates below it are pruned.
    """
    order = np.argsort(-np.sqrt((c.astype(np.float64) ** 2).sum(1)), kind="stable")
    cid, c = cid[order], c[order]
    cr, qr = c @ rotation, q @ rotation
    head = min(HEAD, c.shape[1])
    length = np.sqrt((cr**2).sum(1))
    c_rest, q_rest = np.sqrt((cr[:, head:] ** 2).sum(1)), np.sqrt((qr[:, head:] ** 2).sum(1))
    q_length = np.sqrt((qr**2).sum(1))
    least = floor.astype(np.float64)
    found: list[list[tuple[int, int]]] = [[] for _ in qid]
    for at in range(0, len(cid), 256):
        part = slice(at, at + 256)
        slack = SLACK * (1 + q_length * length[at])
        live = np.flatnonzero(q_length * length[at] + slack >= least)
        if not len(live):
            break  # by descending length: nothing that follows can reach a threshold
        bound = qr[live, :head] @ cr[part, :head].T + np.outer(q_rest[live], c_rest[part]) + slack[live, None]
        keep = bound >= least[live, None]
        cols = np.flatnonzero(keep.any(0))
        rows = np.flatnonzero(keep.any(1))
        if not len(cols):
            continue
        scores = _exact(q[live[rows]], c[part][cols])
        ids = cid[part][cols]
        for r, s in zip(rows, scores, strict=True):
            i = live[r]
            ok = keep[r, cols] & (ids != qid[i])
            if ok.any():
                pairs = found[i] + list(zip(ids[ok].tolist(), s[ok].tolist(), strict=True))
                pairs.sort(key=lambda x: (-x[1], x[0]))
                found[i] = pairs[:k]
                if len(found[i]) == k:
                    least[i] = max(least[i], found[i][-1][1])
    for i, pairs in zip(qid.tolist(), found, strict=True):
        for cand, score in pairs:
            yield i, cand, score


def top_k(vectors: DataFrame, k: int = K, query_every: int = QUERY_EVERY, block: int = BLOCK, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Return query_id, rank (from 1), vec_id, score: the k best rows for each query, ties to the smaller vec_id.

    Queries are the rows whose id is divisible by ``query_every``; every row with another id is a candidate.
    Vectors that are null, or hold null or non-finite components, and rows without an id take no part. Shorter
    vectors count as padded by zeros. Repeated rows count as often as they stand there. A query with fewer
    than k candidates gets them all; an empty table gives no rows; other columns are left out. Components and scores
    beyond 63 bits count as the nearest value that a long holds.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), quantised(F.col(vector_col)).alias("v")).where("id IS NOT NULL AND v IS NOT NULL")
    rows = rows.withColumn("norm", F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))))
    queries = rows.where(F.col("id") % query_every == 0)
    counts = rows.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.max(F.size("v")), F.lit(0)).alias("width"), F.count_if(F.col("id") % query_every == 0).alias("q")).first()
    width, blocks, query_blocks = counts["width"], max(1, -(-counts["n"] // block)), max(1, -(-counts["q"] // block))
    # The longest vectors (their number is a constant): they set the rotation and each query's first threshold.
    longest = rows.orderBy(F.desc("norm"), "id").limit(SAMPLE).select("id", "v").collect()
    top = _matrix([r["v"] for r in longest], width)
    top_ids = np.array([r["id"] for r in longest], np.int64)
    rotation = np.linalg.svd(top.astype(np.float64), full_matrices=True)[2].T if width and len(longest) else np.eye(width)

    def pack(groups: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in groups:
            yield pa.RecordBatch.from_arrays([pa.array([np.column_stack([np.array(i, np.int64), _matrix(v, width)]).tobytes() for i, v in zip(batch["ids"].to_pylist(), batch["vs"].to_pylist(), strict=True)], pa.binary()), batch["no"]], ["data", "no"])

    def blocked(df: DataFrame, n: int, by_length: bool) -> DataFrame:
        # Runs of similar length make the bound of a block sharp; a block is bounded by a second, hashed key.
        no = F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
        if by_length and n > 1:
            levels = min(n, LEVELS)
            cuts = df.select(F.percentile_approx("norm", [i / levels for i in range(1, levels)], 10_000).alias("c")).first()["c"]
            if cuts:
                cuts = sorted(set(cuts))
                level = F.size(F.filter(F.array(*[F.lit(x) for x in cuts]), lambda x: x < F.col("norm")))
                sub = max(1, -(-n // (len(cuts) + 1)))
                no = (level * sub + F.pmod(F.xxhash64("id"), F.lit(sub))).cast("int")
        return df.withColumn("no", no).groupBy("no").agg(F.collect_list("id").alias("ids"), F.collect_list("v").alias("vs")).mapInArrow(pack, "data binary, no int")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for q_data, c_data in zip(batch["q"].to_pylist(), batch["c"].to_pylist(), strict=True):
                (qid, q), (cid, c) = _unpacked(q_data, width), _unpacked(c_data, width)
                floor = np.full(len(qid), -np.inf)
                if len(top_ids) > k:
                    start = _exact(q, top[: 4 * k + 1]).astype(np.float64)
                    start[qid[:, None] == top_ids[None, : 4 * k + 1]] = -np.inf
                    if start.shape[1] >= k:
                        floor = np.sort(start, axis=1)[:, -k]
                hits = list(search_block(qid, q, floor, cid, c, rotation, k))
                cols = list(zip(*hits, strict=True)) or [(), (), ()]
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in cols], ["query_id", "vec_id", "score"])

    # Each block of queries meets each block of candidates: both sides are bounded blobs, joined on the number of the query block.
    right = blocked(queries, query_blocks, False).select(F.col("data").alias("q"), F.col("no").alias("qno"))
    left = blocked(rows, blocks, True).select(F.col("data").alias("c"), "no", F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))).alias("qno"))
    pairs = left.repartition(max(1, min(blocks * query_blocks, 100_000)), "no", "qno").join(F.broadcast(right) if counts["q"] * (width + 1) * 8 <= 16 << 20 else right, "qno").select("q", "c")
    hits = pairs.mapInArrow(search, "query_id long, vec_id long, score long")
    ranked = hits.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")).cast("int"))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
