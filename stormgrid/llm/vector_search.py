"""Exact top-k inner products by MaxScore over shards of integer vectors.

A vector's dimensions are its terms and its components the term weights; component x
counts as floor(scale * x). Candidates form shards of bounded size, each with its
largest and smallest value per dimension, and queries form blocks. For a query, a
dimension can add between min and max of (weight * the shard's extremes), so after
adding the smallest value to every document the score is a sum of non-negative parts
with known upper bounds, which is what MaxScore prunes by:

* dimensions are taken by falling bound; the longest tail whose bounds add up to less
  than what is missing to the k-th best score so far is non-essential;
* the essential dimensions' postings are traversed for the whole shard;
* the others are probed, one group at a time, only for documents that can still reach
  the k-th best score.

Every (query, shard) gives its k best, and the shards' lists are merged by Spark.

Defined results: null vectors, and vectors with a null or non-finite component, take no
part on either side; vectors are compared with those of the same length only; equal
scores go to the smaller id; rows that repeat both id and vector count once, queries that
share an id share one list, and a query skips every candidate of its own id; a null id
takes no part; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import map_batches, stored

SHARD_ROWS, QUERY_ROWS = 8192, 256
SCALE = 256


def _blocks(vectors: DataFrame, vec_id: str, vector: str, scale: int, rows: int, every: int | None) -> DataFrame:
    """Blocks of up to ``rows`` vectors of one length: dim, n, ids and components (int64 bytes)."""
    usable = (F.col(vec_id).isNotNull() & F.col(vector).isNotNull()
              & F.forall(F.col(vector), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))))
    chosen = vectors.filter(usable)
    if every:
        chosen = chosen.filter(F.col(vec_id) % every == 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}

        def row(dim: int) -> pa.RecordBatch:
            ids = np.concatenate([x[0] for x in held[dim]])
            comps = np.concatenate([x[1] for x in held[dim]])
            out = [pa.array([dim], pa.int32()), pa.array([len(ids)], pa.int32()), pa.array([ids.tobytes()], pa.binary()), pa.array([comps.tobytes()], pa.binary())]
            held[dim] = []
            return pa.RecordBatch.from_arrays(out, names=["dim", "n", "ids", "comps"])

        for b in batches:
            ids, lists = b.column(0).to_numpy(zero_copy_only=False).astype(np.int64), b.column(1)
            lengths = np.asarray(lists.value_lengths())
            flat = np.asarray(lists.flatten(), np.float64)
            at = np.cumsum(lengths) - lengths
            for dim in np.unique(lengths).tolist():
                own = np.flatnonzero(lengths == dim)
                comps = np.floor(scale * flat[at[own][:, None] + np.arange(dim)]).astype(np.int64)
                for lo in range(0, len(own), rows):
                    part = held.setdefault(dim, [])
                    if part and sum(len(x[0]) for x in part) + len(own[lo:lo + rows]) > rows:
                        yield row(dim)
                    held[dim].append((ids[own[lo:lo + rows]], comps[lo:lo + rows]))
        for dim in held:
            if held[dim]:
                yield row(dim)

    cols = chosen.select(F.col(vec_id).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"))
    return map_batches(cols, run, "dim int, n int, ids binary, comps binary")


def search_shard(q_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, docs: np.ndarray, k: int) -> tuple[list, list, list]:
    """Each query's k best documents of one shard: (query ids, document ids, scores)."""
    top, low = docs.max(0), docs.min(0)
    a, b = queries * top, queries * low
    most, least = np.maximum(a, b), np.minimum(a, b)
    bound = most - least
    exact = float(np.abs(queries).max(initial=0)) * float(np.abs(docs).max(initial=0)) * docs.shape[1] < 2.0 ** 53
    kind = np.float64 if exact else np.int64  # sums below 2^53 are exact in doubles
    q, d, base = queries.astype(kind), docs.astype(kind), least.sum(1)
    by_id = np.argsort(ids, kind="stable")
    ids, d = ids[by_id], d[by_id]
    columns = np.ascontiguousarray(d.T)
    out_q, out_d, out_s = [], [], []
    seed = min(len(ids), max(4 * k, 64))
    for i in range(len(q)):
        order = np.argsort(-bound[i], kind="stable")
        rest = np.concatenate([np.cumsum(bound[i][order][::-1])[::-1], [0]])  # bound of the terms from a rank on
        alive = np.flatnonzero(ids != q_ids[i])
        # the k-th best of a few documents is a score that the result can't fall below
        first = alive[:seed]
        known = np.sort(d[first] @ q[i])[::-1]
        floor = known[k - 1] if len(known) >= k else None
        part = np.full(len(alive), base[i], kind)
        at = 0
        if floor is not None:
            essential = int(np.searchsorted(-rest, -(floor - base[i]), side="right"))  # the tail alone can't reach the floor
        else:
            essential = len(order)
        step = max(1, min(essential, len(order)))
        while at < len(order):
            terms = order[at:at + step]
            postings = columns[terms] if len(alive) == len(ids) else columns[np.ix_(terms, alive)]
            share = q[i][terms] @ postings - least[i][terms].sum()
            part = part + share
            at += len(terms)
            step = max(4, (len(order) - at) // 2)
            if len(part) > k:
                floor_now = np.partition(part, len(part) - k)[len(part) - k]  # parts only grow
                floor = floor_now if floor is None else max(floor, floor_now)
                keep = part + rest[at] >= floor
                if not keep.all():
                    alive, part = alive[keep], part[keep]
        best = np.lexsort((ids[alive], -part))[:k]
        out_q += [int(q_ids[i])] * len(best)
        out_d += ids[alive[best]].tolist()
        out_s += [int(x) for x in part[best]]
    return out_q, out_d, out_s


def top_k(vectors: DataFrame, k: int = 5, every: int = 50, vec_id: str = "vec_id", vector: str = "embedding",
          scale: int = SCALE) -> DataFrame:
    """The ``k`` best rows for every row whose id is divisible by ``every``: query_id, rank, vec_id, score."""
    distinct = vectors.select(F.col(vec_id).alias("_id"), F.col(vector).alias("_v")).dropDuplicates(["_id", "_v"])
    shards = _blocks(distinct, "_id", "_v", scale, SHARD_ROWS, None)
    blocks = stored(_blocks(distinct, "_id", "_v", scale, QUERY_ROWS, every), "queries")
    groups = max(1, blocks.count())
    queries = blocks.select("dim", F.pmod(F.xxhash64("dim", "ids"), F.lit(groups)).cast("int").alias("block"),
                            F.col("ids").alias("q_ids"), F.col("comps").alias("q_comps"))
    # the stated query set against all rows, in blocks: each shard goes to each group of query blocks once
    meets = shards.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    pairs = meets.join(queries, ["dim", "block"]).select("dim", "ids", "comps", "q_ids", "q_comps")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in range(b.num_rows):
                dim, ids, comps, q_ids, q_comps = (b.column(c)[r].as_py() for c in range(5))
                docs = np.frombuffer(comps, np.int64).reshape(-1, dim) if dim else np.zeros((len(ids) // 8, 0), np.int64)
                qs = np.frombuffer(q_comps, np.int64).reshape(-1, dim) if dim else np.zeros((len(q_ids) // 8, 0), np.int64)
                out = search_shard(np.frombuffer(q_ids, np.int64), qs, np.frombuffer(ids, np.int64), docs, k)
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], names=["query_id", "vec_id", "score"])

    lists = map_batches(pairs, run, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    # a query's lists hold k rows a shard; rows beyond k are dropped before and after the shuffle
    return (lists.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))
