"""Near-duplicate vectors by a pivot-permutation index, every link verified in double precision.

Pivots are vectors of the table that are not too close to each other. A vector is described
by the permutation prefix of its ``PREFIX`` nearest pivots, in order of nearness. Each vector
is posted in the inverted lists of its ``POSTED`` nearest pivots, one list a pivot and group
(rows of one label and length). Two vectors that meet in a list are a candidate pair if their
prefixes share at least ``SHARED`` pivots; the list of the smallest pivot that both are posted
under verifies the pair's cosine.

* Equal vectors are one class from the start; only classes are described and compared.
* A list is dealt in blocks of at most about ``BLOCK`` classes, and each pair of blocks is a
  task's group of its own, so that no list is ever whole in one task. Pairs are counted in
  numpy and never leave their task: a class returns how many vectors it links with there and
  one edge to the smallest class reachable there.
* Components spread their smallest class number along these edges until nothing changes.

The pivots are fitted on a bounded sample: from 2 * ``count`` classes of the smallest hashes,
those no closer than ``APART`` to an earlier one. ``count`` grows with the square root of the
classes up to ``MOST_PIVOTS``, so lists grow with the square root too; every row is indexed. A
group with no pivot of its length is one list, still dealt in blocks and verified in full.

The count of links of a vector needs all cosines inside a group of mutual near copies; those
are blocked matrix products, never rows. Retrieval is approximate (measured recall on the
check tables: 1.0, see the README); below ``least`` nothing links.

Defined results: a vector that is null, empty, zero or holds null or non-finite components, or
whose label is null, links with nothing; so does a row without vec_id, whose component is null
and which is not kept; rows of equal vectors and labels are linked with each other, repeated
rows of one vec_id too, each counting as a vector; vectors of different lengths do not link;
an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches, stored, table_join
from .near_dedup import components

LEAST = 0.98
PREFIX, POSTED, SHARED = 8, 4, 3
PIVOTS_PER_ROOT, LEAST_PIVOTS, MOST_PIVOTS = 2, 64, 4096
APART = 0.9
BLOCK = 1024


def _values(v: list | None) -> np.ndarray | None:
    """The components as doubles, or None for a vector that takes no part."""
    if not v or None in v:
        return None
    x = np.array(v, np.float64)
    return x if np.isfinite(x).all() and x.any() else None


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length 1 (scaled first, so that squares neither overflow nor vanish)."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _described(vectors: DataFrame, vec_id: str, embedding: str, label: str) -> DataFrame:
    """id, label, dim, two halves of the vector's hash and its values (nulls where it takes no part)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for i, lab, v in zip(*(b.column(c).to_pylist() for c in range(3))):
                x = _values(v) if i is not None and lab is not None else None
                if x is None:
                    rows.append((i, None, None, None, None, None))
                    continue
                x += 0.0  # one sign of zero
                h = hashlib.blake2b(f"{len(x)} {lab}\0".encode() + x.tobytes(), digest_size=16).digest()
                rows.append((i, lab, len(x), int.from_bytes(h[:8], "little", signed=True), int.from_bytes(h[8:], "little", signed=True), x.tobytes()))
            kinds = (pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], t) for c, t in enumerate(kinds)],
                                             names=["id", "label", "dim", "h1", "h2", "data"])

    rows = vectors.select(F.col(vec_id).cast("long"), F.col(label).cast("string"), F.col(embedding).cast("array<double>"))
    return map_batches(rows, run, "id long, label string, dim int, h1 long, h2 long, data binary")


def fit_pivots(classes: DataFrame, count: int) -> dict[int, np.ndarray]:
    """Unit pivots by vector length, from a bounded sample (at most 2 * count rows reach the driver)."""
    sample = classes.select("h1", "h2", "dim", "data").orderBy("h1", "h2").limit(2 * count).collect()
    by_dim: dict[int, list[np.ndarray]] = {}
    for r in sample:
        by_dim.setdefault(r["dim"], []).append(np.frombuffer(r["data"], np.float64))
    return {dim: _apart(unit(np.stack(rows)), count) for dim, rows in by_dim.items()}


def _apart(rows: np.ndarray, count: int) -> np.ndarray:
    """The first ``count`` rows that are not within APART of one taken before."""
    taken = np.empty((0, rows.shape[1]))
    for r in rows:
        if len(taken) == count:
            break
        if not len(taken) or (taken @ r).max() < APART:
            taken = np.vstack([taken, r])
    return taken


def permutation_prefixes(units: np.ndarray, pivots: np.ndarray, length: int = PREFIX) -> np.ndarray:
    """The numbers of each row's nearest pivots, the nearest first (ties: the smaller number)."""
    length = min(length, len(pivots))
    near = units @ pivots.T
    if length < len(pivots):
        some = np.sort(np.argpartition(-near, length - 1, axis=1)[:, :length], axis=1)
    else:
        some = np.broadcast_to(np.arange(len(pivots)), near.shape)
    order = np.argsort(-np.take_along_axis(near, some, 1), axis=1, kind="stable")
    return np.take_along_axis(some, order, 1).astype(np.int32)


def _posted(classes: DataFrame, pivots: dict[int, np.ndarray]) -> DataFrame:
    """rep, c, label, dim, pivot, prefix and data: a row for each list a class is posted in."""
    shared = classes.sparkSession.sparkContext.broadcast(pivots)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            dims = b.column(3).to_numpy()
            data = b.column(4).to_pylist()
            for dim in np.unique(dims).tolist():
                rows = np.flatnonzero(dims == dim)
                known = shared.value.get(dim)
                if known is None:
                    prefixes = np.full((len(rows), 1), -1, np.int32)
                else:
                    prefixes = permutation_prefixes(unit(np.stack([np.frombuffer(data[r], np.float64) for r in rows])), known)
                posted = prefixes[:, :POSTED]
                take = pa.array(np.repeat(rows, posted.shape[1]))
                own = [b.column(c).take(take) for c in range(5)]
                prefix = pa.array([p.tobytes() for p in prefixes for _ in range(posted.shape[1])], pa.binary())
                yield pa.RecordBatch.from_arrays([*own[:4], pa.array(posted.ravel()), prefix, own[4]],
                                                 names=["rep", "c", "label", "dim", "pivot", "prefix", "data"])

    return map_batches(classes.select("rep", "c", "label", "dim", "data"), run,
                       "rep long, c long, label string, dim int, pivot int, prefix binary, data binary")


def shared_pivots(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many pivots each row of ``a`` shares with each row of ``b`` (rows hold distinct numbers)."""
    known, place = np.unique(np.concatenate([a.ravel(), b.ravel()]), return_inverse=True)
    has = np.zeros((len(a) + len(b), len(known)), np.float32)
    has[np.repeat(np.arange(len(a) + len(b)), a.shape[1]), place] = 1
    return has[:len(a)] @ has[len(a):].T


def links_between(a: np.ndarray, b: np.ndarray, pa_: np.ndarray, pb: np.ndarray, pivot: int, least: float) -> np.ndarray:
    """Which pairs are candidates that this list verifies and whose cosine is at least ``least``."""
    wanted = shared_pivots(pa_, pb) >= min(SHARED, pa_.shape[1])
    earlier_a, earlier_b = (np.where(p[:, :POSTED] < pivot, p[:, :POSTED], -2 - np.arange(min(POSTED, p.shape[1]))) for p in (pa_, pb))
    earlier_b = np.where(earlier_b < -1, earlier_b - POSTED, earlier_b)  # fillers that meet nothing
    wanted &= shared_pivots(earlier_a, earlier_b) == 0
    out = np.zeros(wanted.shape, bool)
    for r in np.flatnonzero(wanted.any(axis=1)):
        cols = np.flatnonzero(wanted[r])
        out[r, cols] = b[cols] @ a[r] >= least
    return out


def _roots(linked: np.ndarray) -> np.ndarray:
    """The smallest row reachable from each row by a symmetric boolean matrix."""
    root = np.arange(len(linked))
    while True:
        best = np.minimum(root, np.where(linked, root[None, :], len(linked)).min(axis=1))
        best = best[best]
        if (best == root).all():
            return root
        root = best


def _verified(lists: DataFrame, least: float) -> DataFrame:
    """rep, links (linked vectors of other classes) and root, of the classes with a link in a pair of blocks."""
    def run(key: tuple, group: pa.Table) -> pa.Table:
        pivot, first, second = key[2].as_py(), key[3].as_py(), key[4].as_py()
        block = group.column("block").to_numpy()
        rep, c = group.column("rep").to_numpy(), group.column("c").to_numpy()
        units = unit(np.stack([np.frombuffer(x, np.float64) for x in group.column("data").to_pylist()]))
        prefixes = np.stack([np.frombuffer(x, np.int32) for x in group.column("prefix").to_pylist()])
        if first == second:
            linked = links_between(units, units, prefixes, prefixes, pivot, least)
            np.fill_diagonal(linked, False)
            linked |= linked.T  # rounding may differ by the order of a product's factors
        else:
            one, two = np.flatnonzero(block == first), np.flatnonzero(block == second)
            linked = np.zeros((len(rep), len(rep)), bool)
            linked[np.ix_(one, two)] = links_between(units[one], units[two], prefixes[one], prefixes[two], pivot, least)
            linked |= linked.T
        has = linked.any(axis=1)
        root = _roots(linked)
        return pa.table({"rep": rep[has], "links": (linked @ c)[has].astype(np.int64), "root": rep[root[has]]})

    return lists.groupBy("label", "dim", "pivot", "first", "second").applyInArrow(run, "rep long, links long, root long")


def near_vectors(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label",
                 least: float = LEAST) -> DataFrame:
    """vec_id, n_links (other vectors linked directly), component_id and kept of every row."""
    signed = stored(_described(vectors, vec_id, embedding, label), "vectors")
    classes = stored(signed.filter("h1 is not null").groupBy("h1", "h2")
                     .agg(F.min("id").alias("least_id"), F.count(F.lit(1)).alias("c"), F.first("label").alias("label"),
                          F.first("dim").alias("dim"), F.first("data").alias("data"))
                     .withColumn("rep", F.monotonically_increasing_id()), "classes")
    count = min(MOST_PIVOTS, max(LEAST_PIVOTS, PIVOTS_PER_ROOT * math.isqrt(classes.count())))
    lists = stored(_posted(classes, fit_pivots(classes, count)), "postings")
    key = ["label", "dim", "pivot"]
    long = stored(lists.groupBy(*key).agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks")).filter("blocks > 1"), "long")
    dealt = (table_join(lists, long, key).withColumn("blocks", F.coalesce("blocks", F.lit(1)))
             .withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
             .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
             .withColumn("first", F.least("block", "other")).withColumn("second", F.greatest("block", "other")))
    found = stored(_verified(dealt.drop("blocks", "other"), least), "links")
    labels = components(found.filter("rep <> root"), "root", "rep")

    nodes = labels.withColumnRenamed("node", "rep")
    own = classes.select("rep", "h1", "h2", "c", "least_id")
    smallest = stored(table_join(nodes, own.select("rep", "least_id"), ["rep"], "inner").groupBy("label").agg(F.min("least_id").alias("winner")), "winners")
    nodes = stored(table_join(nodes, smallest, ["label"], "inner").select("rep", "winner"), "nodes")
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    known = stored(own.join(nodes, "rep", "left").join(links, "rep", "left")
                   .select("h1", "h2", (F.col("c") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("winner", "least_id").alias("component")), "known")
    out = table_join(signed.select("id", "h1", "h2"), known, ["h1", "h2"])
    return out.select(F.col("id").alias("vec_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
                      F.coalesce("component", "id").alias("component_id"), F.coalesce(F.col("id") == F.coalesce("component", "id"), F.lit(False)).alias("kept"))
