"""Near-duplicate groups by circulant MinHash, with every link confirmed on the full sets.

A document's set holds its distinct shingles of some words (ASCII letters in lower case).
Two permutations of the 32-bit universe give all signature coordinates: coordinate k is the
smallest value of the second permutation, circularly shifted by k, over the images of the
set under the first. ``BANDS`` bands of ``ROWS`` coordinates make candidates: at a
similarity of 0.8 a pair shares no band with a probability of 1e-6.

* Documents with equal sets are one class from the start; only classes are compared.
* A band's bucket is never expanded into pairs. First, each class is compared with one
  hub, the class that shares the most buckets with others among its buckets' best ones.
* Links found that way form components. What is left are buckets with members of several
  components. While these would make over ``PAIRS_A_MEMBER`` pairs for each member of a
  bucket, and for a few rounds at most, members outside of a bucket's largest component are
  each compared with one of its members; then those still outside meet all members of
  other components, so that no link between components stays unseen. There a sketch of
  each set comes first: its distance bounds the sets' difference from below, so that only
  pairs which no bound rules out leave the join and are compared.
* Components spread their smallest id along the links until nothing changes.

Joins that a hub or a bucket could crowd read both sides from tables, so that Spark splits
a crowded key's partition over tasks (see :func:`common.table_join`). Sets travel to the hub they
are compared with, a bounded number to a task; a hub's set is repeated for each such share.

Classes have numbers of their own and rows are known by id and text, so that texts that
share an id are judged one by one.

Defined results: a document without words has an empty set and is linked with nothing;
with fewer words than a shingle the whole sequence is its one shingle; in groups a null id
takes no part and is a component of its own, but :func:`keep_one` drops its near copies too
(a null id comes after all others); of a component's texts of the smallest id one is kept;
repeated rows share their result; an empty table gives an empty result; extra columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import chunks_by_size, fresh_names, map_batches, partitions, stored, table_join
from .recompression import fingerprints
from .suffix_dedup import _mixed

BANDS, ROWS = 36, 5
WORDS, PERCENT = 5, 80
#: Rounds in which members outside of a bucket's largest component meet some of its members,
#: and how many of these each bucket offers; whatever is open then is compared in full.
ROUNDS_OF_PARTNERS, PARTNERS = 3, 8
#: Pairs across components, for each member of a bucket, that are few enough to look at without such rounds.
PAIRS_A_MEMBER = 256
#: Classes compared with one copy of a hub's set.
SHARE = 64
#: 64-bit words of a set's sketch.
SKETCH_WORDS = 16
#: Shingles that numpy works on at a time.
CHUNK_SHINGLES = 1 << 17

_U = np.uint64
_C = _U(0x9E3779B97F4A7C15)


def shingle_sets(texts: list[bytes], words: int) -> list[np.ndarray]:
    """Sorted distinct 64-bit shingles of each text."""
    ids, sizes = fingerprints([t.lower() for t in texts])  # bytes: A-Z only
    total = np.zeros(len(ids), np.uint64)
    if len(ids) >= words:
        rolled = np.zeros(len(ids) - words + 1, np.uint64)
        for k in range(words):
            rolled = _mixed(rolled * _C + ids[k:len(ids) - words + 1 + k] + _U(k + 1))
        total[:len(rolled)] = rolled
    out, at = [], 0
    for n in sizes.tolist():
        if n >= words:
            out.append(np.unique(total[at:at + n - words + 1]))
        elif n:
            one = _U(n)
            for w in ids[at:at + n]:
                one = _mixed(np.array([w]) ^ _mixed(np.array([one])))[0]
            out.append(np.array([one], np.uint64))
        else:
            out.append(np.zeros(0, np.uint64))
        at += n
    return out


def _first_permutation(x: np.ndarray) -> np.ndarray:
    """A permutation of the 32-bit numbers (odd multipliers and xor-shifts can be undone)."""
    x = x ^ (x >> np.uint32(15))
    x = x * np.uint32(0x2C1B3C6D)
    x ^= x >> np.uint32(12)
    x *= np.uint32(0x297A2D39)
    return x ^ (x >> np.uint32(15))


def signatures(sets: list[np.ndarray], count: int = BANDS * ROWS) -> np.ndarray:
    """Circulant MinHash coordinates of non-empty sets."""
    out = np.empty((len(sets), count), np.uint32)
    for lo, hi in chunks_by_size([len(s) for s in sets], CHUNK_SHINGLES):
        part = sets[lo:hi]
        flat = np.concatenate(part)
        start = np.cumsum([0, *map(len, part[:-1])])
        image = _first_permutation((flat ^ (flat >> _U(32))).astype(np.uint32))
        y, z = np.empty_like(image), np.empty_like(image)
        for k in range(count):
            np.add(image, np.uint32(k), out=y)  # the circular shift
            for shift, times in ((16, 0x85EBCA6B), (13, 0xC2B2AE35), (16, None)):  # the second permutation
                np.right_shift(y, np.uint32(shift), out=z)
                np.bitwise_xor(y, z, out=y)
                if times:
                    np.multiply(y, np.uint32(times), out=y)
            out[lo:hi, k] = np.minimum.reduceat(y, start)
    return out


def bands_of(sets: list[np.ndarray]) -> np.ndarray:
    """A 64-bit name for each band of each set."""
    rows = signatures(sets).reshape(len(sets), BANDS, ROWS).astype(np.uint64)
    name = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), rows.shape[:2])
    for k in range(ROWS):
        name = _mixed(name * _C + rows[:, :, k])
    return name.astype(np.int64)


def similar(a: np.ndarray, b: np.ndarray, percent: int = PERCENT) -> bool:
    """Whether 100 * |a & b| >= percent * |a | b|, for sorted distinct arrays."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def _row_key(doc_id: str, text: str) -> Column:
    """The hash of a row's id and text, as :func:`repeats.repeated` knows it."""
    return F.xxhash64(F.col(doc_id).cast("long"), F.coalesce(F.col(text), F.lit("")))


def _set_hash(s: np.ndarray) -> tuple[np.int64, np.int64]:
    return _mixed(s).sum().astype(np.int64), _mixed(s * _C + _U(1)).sum().astype(np.int64)


def _signed(docs: DataFrame, words: int) -> DataFrame:
    """id, key, n, two halves of the set's hash, and the bands (null for an empty set)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = shingle_sets(b.column(2).to_pylist(), words)
            full = [i for i, s in enumerate(sets) if len(s)]
            bands: list = [None] * len(sets)
            h = np.zeros((len(sets), 2), np.int64)
            if full:
                names = bands_of([sets[i] for i in full])
                for i, x in zip(full, names):
                    bands[i] = x
                    h[i] = _set_hash(sets[i])
            cols = [b.column(0), b.column(1), pa.array([len(s) for s in sets], pa.int64()), pa.array(h[:, 0]), pa.array(h[:, 1]), pa.array(bands, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(cols, names=["id", "key", "n", "h1", "h2", "bands"])

    return map_batches(docs, run, "id long, key long, n long, h1 long, h2 long, bands array<long>")


def _sets(docs: DataFrame, classes: DataFrame, words: int) -> DataFrame:
    """id (the class's number) and set (sorted shingles as bytes) of the classes.

    Documents and classes are merged in the order of the rows' keys whatever their sizes, so
    that the plan is the same for a few classes and for many.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = None
        for b in batches:
            ids, data = [], []
            for rep, h1, h2, s in zip(*(b.column(c).to_pylist() for c in range(3)), shingle_sets(b.column(3).to_pylist(), words)):
                if rep != at and _set_hash(s) == (h1, h2):  # repeated rows come one after another
                    at = rep
                    ids.append(rep)
                    data.append(s.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(data, pa.binary())], names=["id", "data"])

    rows = docs.join(classes.hint("merge"), "key").select("rep", "h1", "h2", "text")
    return stored(map_batches(rows, run, "id long, data binary"), "sets")


def _confirmed(sets: DataFrame, pairs: DataFrame, percent: int) -> DataFrame:
    """The pairs (hub, id) whose documents' sets are similar.

    Each id's set goes to its share of the hub's pairs, and the hub's set to each share.
    """
    shares = pairs.groupBy("hub").agg(F.ceil(F.count(F.lit(1)) / SHARE).cast("int").alias("_shares"))
    shares = stored(shares, "shares")
    dealt = (table_join(pairs, shares, ["hub"], "inner")
             .select("id", "hub", F.pmod(F.xxhash64("id"), F.col("_shares")).cast("int").alias("share"), F.lit(1).alias("role")))
    hubs = shares.select(F.col("hub").alias("id"), "hub", F.explode(F.sequence(F.lit(0), F.col("_shares") - 1)).alias("share"), F.lit(0).alias("role"))
    wanted = stored(dealt.unionByName(hubs), "pairs")
    rows = sets.join(wanted, "id").select("hub", "share", "role", "id", "data")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, mine = None, np.zeros(0, np.uint64)
        for b in batches:
            links: list[tuple[int, int]] = []
            for hub, share, role, i, data in zip(*(b.column(c).to_pylist() for c in range(5))):
                own = np.frombuffer(data, np.uint64)
                if role == 0:
                    at, mine = (hub, share), own
                elif at == (hub, share) and similar(mine, own, percent):
                    links.append((hub, i))
            yield pa.RecordBatch.from_arrays([pa.array([x[c] for x in links], pa.int64()) for c in (0, 1)], names=["hub", "id"])

    dealt_rows = rows.repartition(partitions(sets.sparkSession), "hub", "share").sortWithinPartitions("hub", "share", "role")
    return map_batches(dealt_rows, compare, "hub long, id long")


def components(links: DataFrame, a: str = "hub", b: str = "id") -> DataFrame:
    """node and label (smallest id reachable) of every node of the links."""
    both = stored(links.select(F.col(a).alias("node"), F.col(b).alias("other"))
                  .union(links.select(F.col(b), F.col(a))), "links")
    labels = stored(both.groupBy("node").agg(F.least(F.col("node"), F.min("other")).alias("label")), "labels")
    while True:
        ends = labels.select(F.col("node").alias("other"), "label")
        near = table_join(both, ends, ["other"], "inner").groupBy("node").agg(F.min("label").alias("_near"))
        # the label of the label: halves the way to the smallest id in each round
        far = labels.select(F.col("node").alias("label"), F.col("label").alias("_far"))
        new = stored(table_join(labels.join(near, "node"), far, ["label"])
                     .select("node", "label", F.least("label", "_near", F.coalesce("_far", "label")).alias("_new")), "labels")
        changed = new.filter("_new < label").limit(1).count()
        labels = new.select("node", F.col("_new").alias("label"))
        if not changed:
            return labels


def near_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest id reachable) and kept of every document."""
    return _decided(docs, doc_id, text, words, percent, False).drop("key")


def _decided(docs: DataFrame, doc_id: str, text: str, words: int, percent: int, nulls: bool) -> DataFrame:
    """The columns of :func:`near_groups` and the row's key; with ``nulls``, null ids take part."""
    own = docs.select(F.col(doc_id).cast("long").alias("id"), _row_key(doc_id, text).alias("key"),
                      F.coalesce(F.col(text), F.lit("")).cast("binary").alias("text"))
    signed = stored(_signed(own, words), "signed")
    takes_part = (F.col("n") > 0) & (F.col("id").isNotNull() | F.lit(nulls))
    best = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "key")).alias("best")
    classes = stored(signed.filter(takes_part).groupBy("h1", "h2").agg(best, F.first("n").alias("n"), F.first("bands").alias("bands"))
                     .withColumn("rep", F.monotonically_increasing_id()), "classes")
    banded = classes.select("rep", "n", F.explode("bands").alias("band"))
    crowded = stored(banded.groupBy("band").agg(F.count(F.lit(1)).alias("c")).filter("c > 1"), "crowded")
    members = stored(table_join(banded, crowded, ["band"], "inner"), "members")

    met = members.groupBy("rep").agg(F.sum("c").alias("met"))
    known = stored(members.join(met, "rep"), "met")
    best = stored(known.groupBy("band").agg(F.max(F.struct("met", F.negative("rep").alias("r"), "n")).alias("best")), "best")
    offers = (table_join(known.select("band", "rep", "n"), best, ["band"], "inner")
              .select("rep", "n", F.col("best.met").alias("hub_met"), (-F.col("best.r")).alias("hub"), F.col("best.n").alias("hub_n"))
              .filter(F.col("hub") != F.col("rep")).filter(_near_sizes("n", "hub_n", percent)))
    hubs = offers.groupBy("rep").agg(F.max(F.struct("hub_met", F.negative("hub").alias("h"))).alias("x"))
    first = stored(hubs.select((-F.col("x.h")).alias("hub"), F.col("rep").alias("id")), "first")
    wanted = classes.select("rep", "h1", "h2", F.col("best.key").alias("key")).join(members.select("rep").distinct(), "rep", "left_semi")
    sets = _sets(own, wanted, words)
    links = stored(_confirmed(sets, first, percent), "links")
    labels = components(links)
    tried, (left, across) = first, _unsettled(members, labels)
    few, k = PAIRS_A_MEMBER * members.count(), 0
    while across:  # else every bucket lies in one component
        last = k == ROUNDS_OF_PARTNERS or across <= few
        if last:
            pairs = stored(_all_across(left, sets, percent), "pairs")
        else:
            done = tried.select(F.least("hub", "id").alias("_a"), F.greatest("hub", "id").alias("_b"))
            pairs = stored(_partners(left, percent, k).join(done, (F.least("hub", "id") == F.col("_a")) & (F.greatest("hub", "id") == F.col("_b")), "left_anti"), "pairs")
        if pairs.limit(1).count():
            new = stored(_confirmed(sets, pairs, percent), "links")
            tried = tried.unionByName(pairs)
            if new.limit(1).count():
                links = stored(links.unionByName(new), "links")
                labels = components(links)
                if not last:
                    left, across = _unsettled(members, labels)
        if last:
            break
        k += 1

    nodes = labels.withColumnRenamed("node", "rep")
    winners = stored(table_join(nodes, classes.select("rep", "best"), ["rep"], "inner").groupBy("label").agg(F.min("best").alias("winner")), "winners")
    nodes = stored(table_join(nodes, winners, ["label"], "inner").select("rep", "winner"), "nodes")
    labelled = table_join(classes.select("h1", "h2", "rep", "best"), nodes, ["rep"]).select("h1", "h2", F.coalesce("winner", "best").alias("winner"))
    out = table_join(signed.select("id", "key", "n", "h1", "h2"), labelled, ["h1", "h2"])
    group = F.when(takes_part, F.col("winner.id")).otherwise(F.col("id"))
    kept = ~takes_part | (F.col("id").eqNullSafe(F.col("winner.id")) & (F.col("key") == F.col("winner.key")))
    return out.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), group.alias("component_id"), kept.alias("kept"), "key")


def _unsettled(members: DataFrame, labels: DataFrame) -> tuple[DataFrame, int]:
    """(members of buckets that hold several components, with their bucket's largest one; the most pairs that
    those outside of it can make)."""
    grouped = stored(table_join(members.select("band", "rep", "n"), labels.withColumnRenamed("node", "rep"), ["rep"])
                     .select("band", "rep", "n", F.coalesce("label", "rep").alias("label")), "grouped")
    sizes = grouped.groupBy("band", "label").agg(F.count(F.lit(1)).alias("m"))
    mixed = (sizes.groupBy("band").agg(F.count(F.lit(1)).alias("k"), F.max(F.struct("m", "label")).alias("x"), F.sum("m").alias("all"))
             .filter("k > 1").select("band", F.col("x.label").alias("largest"), (F.col("all") * (F.col("all") - F.col("x.m"))).alias("across")))
    mixed = stored(mixed, "mixed")
    left = stored(table_join(grouped, mixed.drop("across"), ["band"], "inner"), "unsettled")
    return left, mixed.agg(F.sum(F.col("across").cast("double"))).first()[0] or 0


def _partners(left: DataFrame, percent: int, k: int) -> DataFrame:
    """For each member outside of its bucket's largest component, one of PARTNERS of that component's members there."""
    picked = [F.max(F.struct(F.xxhash64("rep", F.lit(PARTNERS * k + j)), "rep", "n")).alias(f"p{j}") for j in range(PARTNERS)]
    some = left.filter("label = largest").groupBy("band").agg(*picked)
    some = stored(some.select("band", F.array(*(f"p{j}" for j in range(PARTNERS))).alias("p")), "partners")
    outside = left.filter("label <> largest").select("band", "rep", "n")
    one = F.get("p", F.pmod(F.xxhash64("rep", "band"), F.lit(PARTNERS)).cast("int"))
    return (table_join(outside, some, ["band"], "inner").withColumn("x", one)
            .select(F.col("x.rep").alias("hub"), F.col("rep").alias("id"), F.col("x.n").alias("hub_n"), "n")
            .filter(_near_sizes("n", "hub_n", percent)).select("hub", "id").distinct())


def sketch(members: np.ndarray) -> np.ndarray:
    """For each bin of shingles, whether it holds an odd number of the set's, as bits of 64-bit words.

    Two sketches differ in at most as many bits as shingles lie in one of the sets only.
    """
    bins = 64 * SKETCH_WORDS  # a power of two: the upper bits of a shingle are its bin
    odd = np.bincount((members >> _U(65 - bins.bit_length())).astype(np.int64), minlength=bins) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _all_across(left: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs that share a bucket, whose components differ and whose sketches allow a link."""
    words = [f"s{k}" for k in range(SKETCH_WORDS)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [sketch(np.frombuffer(x, np.uint64)) for x in b.column(1).to_pylist()]
            flat = np.array(rows, np.int64).reshape(-1, SKETCH_WORDS)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(flat[:, k]) for k in range(SKETCH_WORDS))], names=["rep", *words])

    sketches = map_batches(sets, run, ", ".join(f"{c} long" for c in ["rep", *words]))
    known = stored(table_join(left, sketches, ["rep"], "inner"), "sketched")
    few = known.filter("label <> largest").select("band", *(F.col(c).alias(f"a_{c}") for c in ("rep", "n", "label", *words)))
    apart = " + ".join(f"bit_count({c} ^ a_{c})" for c in words)
    # 100 * both >= percent * either, with both = (sum - apart) / 2 and either = (sum + apart) / 2
    possible = F.expr(f"({apart}) * {100 + percent} <= (n + a_n) * {100 - percent}")
    return (known.join(few, "band").filter("label <> a_label and (label = largest or a_rep < rep)")
            .filter(_near_sizes("n", "a_n", percent)).filter(possible)
            .select(F.least("a_rep", "rep").alias("hub"), F.greatest("a_rep", "rep").alias("id")).distinct())


def _near_sizes(a: str, b: str, percent: int):
    """Sets of such sizes can be similar."""
    return 100 * F.least(a, b) >= percent * F.greatest(a, b)


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """``docs`` with one document of each group; all columns stay."""
    gone_id, gone_key = fresh_names(docs, "_gone", "_gone_key")
    gone = (_decided(docs, doc_id, text, words, percent, True).filter(~F.col("kept"))
            .select(F.col("doc_id").alias(gone_id), F.col("key").alias(gone_key)).distinct())
    return docs.join(gone, F.col(doc_id).cast("long").eqNullSafe(F.col(gone_id)) & (_row_key(doc_id, text) == F.col(gone_key)), "left_anti")
