"""The prefix trie of conversations, screened by a count-min sketch of prefix digests.

A conversation is a sequence of turns (role, text); a node is a distinct sequence of first
turns of some conversation, the root the sequence of none.

* Turns are dealt by range of (conversation, turn, ...), so that a conversation of any length
  spreads over many tasks. A task digests each turn (128 bits) and its own prefixes (a
  polynomial of the turns' digests modulo a prime of 127 bits, which composes): a prefix that
  began in earlier chunks is completed with the chunks' sums, of which there are two a chunk
  at most that cross a border. From here on rows hold numbers only, no texts.
* A count-min sketch (``ROWS_OF_CELLS`` rows of cells that count to two) of all prefix digests
  is built in tasks, merged block by block and broadcast as one bit a cell. Its estimate is
  never too small, so an estimate of one proves that a prefix, and with it all longer ones,
  is in one conversation only. Such a tail is emitted from its conversation's row; only
  prefixes with an estimate of two or more shuffle, for exact grouping by depth and digest.
* Nodes whose smallest member is the same conversation form a path, and paths a tree in which
  the path of c hangs off that of a smaller id. Totals of subtrees go up this tree by pointer
  doubling, in log2(depth) rounds, and down each path as suffix sums over buckets of
  ``BUCKET`` depths, so that no path is ever in one window.
* The ids of a node's whole members are sorted by range and joined to pieces of ``PIECE`` ids
  in many tasks; one task hashes a node's pieces in order, as SHA-256 must, holding one at a time.

The sketch has as many cells a row as four times the prefixes need, up to ``MOST_CELLS`` (4 MB
broadcast): beyond that it proves less and more prefixes shuffle, with the same result.
Sequences are told apart by 127-bit digests. The aggregates of a very frequent prefix are
combined before the shuffle.

Defined results: a null turn number comes first; turns that tie are ordered by role (first
``HEAD`` characters), then text (first ``HEAD`` characters), then the SHA-256 of both; a null
role or text is empty; rows without a conversation id are ignored; repeated rows are repeated
turns; very long texts are digested whole; an empty table gives no node, not even a root; extra
columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import map_batches, partitions, stored, table_join

#: The modulus 2^127 - 1 and the base of the prefix digests.
PRIME, BASE = (1 << 127) - 1, 0x5851F42D4C957F2D14057B7EF767814F
ROWS_OF_CELLS, LEAST_CELLS, MOST_CELLS = 2, 1 << 16, 1 << 24
#: Cells of a sketch that are merged together.
BLOCK_CELLS = 1 << 16
HEAD = 64
BUCKET = 4096
PIECE = 1024
#: Turns of the shared beginning that a rebuilt conversation may take over.
MOST_TAKEN = 5


def turn_digest(role: bytes, text: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(b"%d " % len(role) + role + text, digest_size=16).digest(), "little") % PRIME


def halves(x: int) -> tuple[int, int]:
    return x >> 64, (x & ((1 << 64) - 1)) - (1 << 63)


def whole(high: int, low: int) -> int:
    return (high << 64) | (low + (1 << 63))


def _digested(turns: DataFrame, conv_id: str, turn: str, role: str, text: str) -> DataFrame:
    """chunk, conv_id, j, q1, q2 (prefix within the chunk), x1, x2 (the turn) and n_chars, conversations in order."""
    rows = turns.filter(F.col(conv_id).isNotNull()).select(
        F.col(conv_id).cast("long").alias("conv_id"), F.col(turn).cast("long").alias("turn"),
        F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = rows.withColumn("role_head", F.left("role", F.lit(HEAD))).withColumn("text_head", F.left("text", F.lit(HEAD)))
    order = ["conv_id", "turn", "role_head", "text_head", "both"]  # nulls first
    rows = rows.withColumn("both", F.sha2(F.concat_ws("\0", "role", "text"), 256)).withColumn("row", F.monotonically_increasing_id())
    dealt = rows.repartitionByRange(partitions(turns.sparkSession), *order, "row").sortWithinPartitions(*order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, j, prefix = None, 0, 0
        for b in batches:
            out: list[tuple] = []
            for conv, role, text, chars in zip(*(b.column(c).to_pylist() for c in range(4))):
                if conv != at:
                    at, j, prefix = conv, 0, 0
                x = turn_digest(role, text)
                j, prefix = j + 1, (prefix * BASE + x) % PRIME
                out.append((conv, j, *halves(prefix), *halves(x), chars))
            names = ["conv_id", "j", "q1", "q2", "x1", "x2", "n_chars"]
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in out], pa.int64()) for c in range(7)], names=names)

    schema = "conv_id long, j long, q1 long, q2 long, x1 long, x2 long, n_chars long"
    texts = dealt.select("conv_id", F.col("role").cast("binary"), F.col("text").cast("binary"), F.length("text").cast("long").alias("n_chars"))
    return stored(map_batches(texts, run, schema).withColumn("chunk", F.spark_partition_id()), "turns")


def _carried(turns: DataFrame) -> dict[tuple[int, int], tuple[int, int]]:
    """What precedes a conversation's turns of a chunk: their count and prefix digest.

    Only conversations that cross chunks count: at most two rows a chunk reach the driver.
    """
    ends = turns.groupBy("conv_id", "chunk").agg(F.max(F.struct("j", "q1", "q2")).alias("end"))
    chunks = stored(ends.groupBy("conv_id").agg(F.min("chunk").alias("low"), F.max("chunk").alias("high")).filter("low < high"), "crossing")
    rows = ends.join(F.broadcast(chunks), "conv_id").select("conv_id", "chunk", "end.*").collect()
    carried: dict[tuple[int, int], tuple[int, int]] = {}
    at, n, prefix = None, 0, 0
    for r in sorted(rows):
        if r["conv_id"] != at:
            at, n, prefix = r["conv_id"], 0, 0
        if n:
            carried[r["conv_id"], r["chunk"]] = (n, prefix)
        n, prefix = n + r["j"], (prefix * pow(BASE, r["j"], PRIME) + whole(r["q1"], r["q2"])) % PRIME
    return carried


def _numbered(turns: DataFrame) -> DataFrame:
    """conv_id, i, q1, q2 (prefix of i turns), x1, x2 and n_chars of every turn."""
    carried = turns.sparkSession.sparkContext.broadcast(_carried(turns))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            conv, j, q1, q2 = (b.column(c).to_pylist() for c in range(4))
            for r, key in enumerate(zip(conv, b.column(7).to_pylist())):
                if before := carried.value.get(key):
                    q1[r], q2[r] = halves((before[1] * pow(BASE, j[r], PRIME) + whole(q1[r], q2[r])) % PRIME)
                    j[r] += before[0]
            cols = [b.column(0), *(pa.array(c, pa.int64()) for c in (j, q1, q2)), *(b.column(c) for c in (4, 5, 6))]
            yield pa.RecordBatch.from_arrays(cols, names=["conv_id", "i", "q1", "q2", "x1", "x2", "n_chars"])

    return map_batches(turns, run, "conv_id long, i long, q1 long, q2 long, x1 long, x2 long, n_chars long")


def taken_turns(conv_id: Column) -> Column:
    """How many turns the contract's rebuilt conversations begin with those of another."""
    return (F.crc32(conv_id.cast("string")) % (MOST_TAKEN + 1)).cast("long")


def prefixes(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
             rebuild: bool = False) -> tuple[DataFrame, DataFrame]:
    """(conv_id, n) of all conversations, and all their prefixes (d, digest, parent's digest, last turn's length).

    ``rebuild`` first gives each conversation c the beginning of conversation c - c % 100
    in place of its own first :func:`taken_turns`.
    """
    numbered = _numbered(_digested(turns, conv_id, turn, role, text))
    kept = ["q1", "q2", "x1", "x2", "n_chars"]
    heads = [F.max(F.when(F.col("i") == k + 1, F.struct(*kept))).alias(f"h{k}") for k in range(MOST_TAKEN)]
    convs = numbered.groupBy("conv_id").agg(F.max("i").alias("n"), *heads)
    convs = stored(convs.select("conv_id", "n", F.array(*(f"h{k}" for k in range(MOST_TAKEN))).alias("heads")), "conversations")
    if rebuild:
        base = convs.select(F.col("conv_id").alias("_base"), F.col("n").alias("base_n"), F.col("heads").alias("base_heads"))
        known = (convs.withColumn("_base", F.col("conv_id") - F.col("conv_id") % 100).join(base, "_base", "left")
                 .withColumn("h", taken_turns(F.col("conv_id"))))
    else:
        known = convs.withColumns({"h": F.lit(0).cast("long"), "base_n": F.lit(0).cast("long"), "base_heads": F.col("heads")})
    known = known.withColumn("k", F.least("h", F.coalesce("base_n", F.lit(0))))
    known = known.withColumn("total", F.col("k") + F.greatest(F.col("n") - F.col("h"), F.lit(0)))
    known = stored(known.select("conv_id", "h", "k", F.col("total").alias("n"), F.slice("base_heads", F.lit(1), F.greatest(F.col("k"), F.lit(1)).cast("int")).alias("front"),
                                F.get("heads", (F.col("h") - 1).cast("int")).alias("own"),
                                F.get("base_heads", (F.col("k") - 1).cast("int")).alias("base")), "rebuilt")
    front = known.filter("k > 0").select("conv_id", F.posexplode("front").alias("p", "t")).select("conv_id", (F.col("p") + 1).cast("long").alias("i"), "t.*")
    zero = F.struct(F.lit(halves(0)[0]).cast("long").alias("q1"), F.lit(halves(0)[1]).cast("long").alias("q2"))
    start = known.select("conv_id", "h", "k", *(F.coalesce(F.when(F.col(at) > 0, F.struct(f"{c}.q1", f"{c}.q2")), zero).alias(c) for c, at in (("own", "h"), ("base", "k"))))
    own = table_join(numbered, start, ["conv_id"], "inner").filter("i > h")
    own = own.select("conv_id", "i", *kept, "h", "k", "own.q1", "own.q2", "base.q1", "base.q2")
    own = own.toDF("conv_id", "i", *kept, "h", "k", "o1", "o2", "b1", "b2")
    none = [F.lit(None).cast("long").alias(c) for c in ("h", "k", "o1", "o2", "b1", "b2")]
    rows = own.unionByName(front.select("*", *none))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        back = pow(BASE, -1, PRIME)
        for b in batches:
            out: list[tuple] = []
            for conv, i, q1, q2, x1, x2, chars, h, k, o1, o2, b1, b2 in zip(*(b.column(c).to_pylist() for c in range(13))):
                q, d = whole(q1, q2), i
                if h is not None:
                    d = k + i - h
                    q = (q + (whole(b1, b2) - whole(o1, o2)) * pow(BASE, i - h, PRIME)) % PRIME
                out.append((conv, d, *halves(q), *halves((q - whole(x1, x2)) * back % PRIME), chars))
            names = ["conv_id", "d", "q1", "q2", "p1", "p2", "n_chars"]
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in out], pa.int64()) for c in range(7)], names=names)

    found = map_batches(rows, run, "conv_id long, d long, q1 long, q2 long, p1 long, p2 long, n_chars long")
    return known.select("conv_id", "n"), stored(found, "prefixes")


# ------------------------------------------------------------- count-min screening

def cells_of(q1: np.ndarray, q2: np.ndarray, cells: int) -> list[np.ndarray]:
    """A cell a row for each digest (its two halves are independent hashes)."""
    return [(half.view(np.uint64) & np.uint64(cells - 1)).astype(np.int64) for half in (q2, (q1 << 1) ^ (q2 >> 40))]


def _sketch(found: DataFrame, cells: int) -> list[np.ndarray]:
    """For each row of cells, whether a cell was hit more than once (packed bits)."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((ROWS_OF_CELLS, cells), np.uint8)
        for b in batches:
            for row, at in enumerate(cells_of(b.column(0).to_numpy(), b.column(1).to_numpy(), cells)):
                hit, times = np.unique(at, return_counts=True)
                counts[row, hit] = np.minimum(counts[row, hit] + np.minimum(times, 2), 2)
        blocks = counts.reshape(-1, BLOCK_CELLS)
        for k in np.flatnonzero(blocks.any(axis=1)).tolist():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([np.packbits(np.stack([blocks[k] & 1, blocks[k] >> 1])).tobytes()], pa.binary())], names=["block", "data"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, total = None, np.zeros(BLOCK_CELLS, np.uint8)

        def done() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([np.packbits(total > 1).tobytes()], pa.binary())], names=["block", "data"])

        for b in batches:
            for block, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if block != at:
                    if at is not None:
                        yield done()
                    at, total = block, np.zeros(BLOCK_CELLS, np.uint8)
                bits = np.unpackbits(np.frombuffer(data, np.uint8)).reshape(2, -1)
                total = np.minimum(total + bits[0] + 2 * bits[1], 2)
        if at is not None:
            yield done()

    blocks = ROWS_OF_CELLS * cells // BLOCK_CELLS
    parts = map_batches(found.select("q1", "q2"), count, "block int, data binary")
    merged = parts.repartition(min(blocks, partitions(found.sparkSession)), "block").sortWithinPartitions("block")
    bits = np.zeros((blocks, BLOCK_CELLS // 8), np.uint8)
    for r in map_batches(merged, merge, "block int, data binary").collect():
        bits[r["block"]] = np.frombuffer(r["data"], np.uint8)
    return list(bits.reshape(ROWS_OF_CELLS, -1))


def _screened(found: DataFrame) -> DataFrame:
    """The prefixes with ``maybe``: whether the sketch allows that another conversation shares them."""
    cells = LEAST_CELLS
    rows = found.count()
    while cells < min(4 * rows, MOST_CELLS):
        cells *= 2
    sketch = found.sparkSession.sparkContext.broadcast(_sketch(found, cells))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            maybe = np.ones(b.num_rows, bool)
            for bits, at in zip(sketch.value, cells_of(b.column(2).to_numpy(), b.column(3).to_numpy(), cells)):
                maybe &= ((bits[at >> 3] >> (7 - (at & 7))) & 1).astype(bool)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(maybe)], names=[*b.schema.names, "maybe"])

    return map_batches(found, run, "conv_id long, d long, q1 long, q2 long, p1 long, p2 long, n_chars long, maybe boolean")


# ------------------------------------------------------------- nodes

def trie(convs: DataFrame, found: DataFrame) -> DataFrame:
    """The nodes of the conversations' prefixes (see :func:`prefixes`)."""
    key = ["d", "q1", "q2"]
    screened = _screened(found)
    tails = screened.groupBy("conv_id").agg(F.min(F.when(~F.col("maybe"), F.col("d"))).alias("tail"))
    convs = stored(convs.join(tails, "conv_id", "left").withColumn("tail", F.coalesce("tail", F.col("n") + 1)), "tails")
    none = F.lit(None).cast("long")
    roots = convs.select("conv_id", F.lit(0).cast("long").alias("d"), F.lit(halves(0)[0]).cast("long").alias("q1"), F.lit(halves(0)[1]).cast("long").alias("q2"),
                         none.alias("p1"), none.alias("p2"), F.lit(0).cast("long").alias("n_chars"), "n", "tail")
    members = table_join(screened.filter("maybe").drop("maybe"), convs, ["conv_id"], "inner").filter("d < tail").unionByName(roots)
    members = stored(members.withColumn("leaves", (F.col("tail") == F.col("d") + 1) & (F.col("tail") <= F.col("n"))), "members")
    nodes = stored(members.groupBy(*key).agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.sum(F.col("leaves").cast("long")).alias("tails"),
                                             F.first("n_chars").alias("n_chars"), F.first("p1").alias("p1"), F.first("p2").alias("p2")), "nodes")

    ids = nodes.select(*key, F.col("conv_id").alias("above"))
    paths = _paths(nodes, ids)
    sums = _totals(paths)
    nodes = _summed(nodes, paths, sums)
    ended = _end_digests(members.filter("d = n").select(*key, "conv_id"))
    empty = hashlib.sha256(b"").hexdigest()
    shared = nodes.join(ended, key, "left").select(
        "conv_id", F.col("d").alias("depth"), F.when(F.col("d") == 0, none).when(F.col("d") > F.col("top"), F.col("conv_id")).otherwise(F.col("above")).alias("parent_conv_id"),
        "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(empty)).alias("ends_sha256"))

    hung = table_join(members.filter("leaves").select(*key, F.col("conv_id").alias("c"), "n", "tail"), ids, key, "inner")
    parts = hung.select("c", "n", "tail", "above", F.explode(F.sequence("tail", "n", F.lit(BUCKET).cast("long"))).alias("part"))
    parts = parts.repartition(partitions(members.sparkSession), "c", "part")
    one = parts.withColumn("depth", F.explode(F.sequence("part", F.least(F.col("part") + BUCKET - 1, F.col("n")))))
    last = F.col("depth") == F.col("n")
    alone = one.select(F.col("c").alias("conv_id"), "depth", F.when(F.col("depth") == F.col("tail"), F.col("above")).otherwise(F.col("c")).alias("parent_conv_id"),
                       F.lit(1).cast("long").alias("n_convs"), F.when(last, 0).otherwise(1).cast("long").alias("n_children"), F.lit(1).cast("long").alias("n_leaves"),
                       F.lit(0).cast("long").alias("saved_tokens"), F.when(last, F.sha2(F.col("c").cast("string").cast("binary"), 256)).otherwise(F.lit(empty)).alias("ends_sha256"))
    return shared.unionByName(alone)


def _paths(nodes: DataFrame, ids: DataFrame) -> DataFrame:
    """conv_id, top and bottom depth, above (the path it hangs off), own leaves and tokens, of every path."""
    paths = nodes.groupBy("conv_id").agg(F.min(F.struct("d", "p1", "p2")).alias("head"), F.max(F.struct("d", "tails")).alias("foot"),
                                         F.sum("tails").alias("leaves"), F.sum((F.col("n_convs") - 1) * F.col("n_chars")).alias("tokens"))
    paths = stored(paths.select("conv_id", F.col("head.d").alias("top"), F.col("foot.d").alias("bottom"), F.col("foot.tails").alias("foot_tails"), "leaves", "tokens",
                                (F.col("head.d") - 1).alias("d"), F.col("head.p1").alias("q1"), F.col("head.p2").alias("q2")), "heads")
    paths = stored(table_join(paths, ids, ["d", "q1", "q2"]).select("conv_id", "top", "bottom", "foot_tails", "above", "leaves", "tokens"), "hung")
    below = paths.filter("above is not null").groupBy(F.col("above").alias("conv_id"), (F.col("top") - 1).alias("bottom")).agg(F.count(F.lit(1)).alias("hung"))
    # the last node of a path is a leaf if nothing hangs off it
    leaf = (F.col("foot_tails") == 0) & F.col("hung").isNull()
    return stored(paths.join(below, ["conv_id", "bottom"], "left")
                  .select("conv_id", "top", "bottom", "above", leaf.cast("long").alias("leaf"), F.col("leaves") + leaf.cast("long"), "tokens")
                  .toDF("conv_id", "top", "bottom", "above", "leaf", "leaves", "tokens"), "paths")


def _totals(paths: DataFrame) -> DataFrame:
    """conv_id, leaves and tokens of each path with all that hangs off it."""
    now = paths.select("conv_id", F.col("above").alias("to"), "leaves", "tokens")
    while True:
        # after each round, sums of all within twice the distance, and pointers twice as far
        sent = now.filter("to is not null").groupBy(F.col("to").alias("conv_id")).agg(F.sum("leaves").alias("l"), F.sum("tokens").alias("t"))
        far = now.select(F.col("conv_id").alias("to"), F.col("to").alias("next"))
        now = stored(table_join(now, far, ["to"]).join(sent, "conv_id", "left")
                     .select("conv_id", F.col("next").alias("to"), (F.col("leaves") + F.coalesce("l", F.lit(0))).alias("leaves"),
                             (F.col("tokens") + F.coalesce("t", F.lit(0))).alias("tokens")), "totals")
        if now.filter("to is not null").isEmpty():
            return now.select("conv_id", "leaves", "tokens")


def _summed(nodes: DataFrame, paths: DataFrame, totals: DataFrame) -> DataFrame:
    """The nodes with top, above, n_children, n_leaves and saved_tokens."""
    hung = (paths.filter("above is not null").drop("leaves", "tokens").join(totals, "conv_id")
            .groupBy(F.col("above").alias("conv_id"), (F.col("top") - 1).alias("d"))
            .agg(F.count(F.lit(1)).alias("hung"), F.sum("leaves").alias("hung_leaves"), F.sum("tokens").alias("hung_tokens")))
    rows = table_join(nodes, paths.select("conv_id", "top", "bottom", "above", "leaf"), ["conv_id"], "inner").join(hung, ["conv_id", "d"], "left")
    goes_on = F.col("d") < F.col("bottom")
    rows = rows.select("d", "q1", "q2", "conv_id", "n_convs", "top", "above",
                       (goes_on.cast("long") + F.col("tails") + F.coalesce("hung", F.lit(0))).alias("n_children"),
                       (F.col("tails") + F.coalesce("hung_leaves", F.lit(0)) + F.when(goes_on, 0).otherwise(F.col("leaf"))).alias("own_leaves"),
                       ((F.col("n_convs") - 1) * F.col("n_chars") + F.coalesce("hung_tokens", F.lit(0))).alias("own_tokens"),
                       F.floor(F.col("d") / BUCKET).cast("long").alias("bucket"))
    rows = stored(rows, "weights")
    after = Window.partitionBy("conv_id").orderBy(F.desc("bucket")).rowsBetween(Window.unboundedPreceding, -1)
    buckets = rows.groupBy("conv_id", "bucket").agg(F.sum("own_leaves").alias("l"), F.sum("own_tokens").alias("t"))
    buckets = buckets.select("conv_id", "bucket", F.sum("l").over(after).alias("after_leaves"), F.sum("t").over(after).alias("after_tokens"))
    within = Window.partitionBy("conv_id", "bucket").orderBy(F.desc("d")).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.join(buckets, ["conv_id", "bucket"])
    return rows.select("d", "q1", "q2", "conv_id", "n_convs", "top", "above", "n_children",
                       (F.sum("own_leaves").over(within) + F.coalesce("after_leaves", F.lit(0))).alias("n_leaves"),
                       (F.sum("own_tokens").over(within) + F.coalesce("after_tokens", F.lit(0))).alias("saved_tokens"))


def _end_digests(ends: DataFrame) -> DataFrame:
    """d, q1, q2 and ends_sha256 (of the ids in ascending order, joined by commas)."""
    key, schema = ["d", "q1", "q2"], "d long, q1 long, q2 long"
    n = partitions(ends.sparkSession)

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, []
        names = [*key, "first", "text"]

        def piece() -> tuple:
            return (*at, held[0], ",".join(map(str, held)))

        for b in batches:
            out = []
            for *node, conv in zip(*(b.column(c).to_pylist() for c in range(4))):
                if held and (node != at or len(held) == PIECE):
                    out.append(piece())
                    held = []
                at = node
                held.append(conv)
            yield _rows(out, names)
        if held:
            yield _rows([piece()], names)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, sha = None, hashlib.sha256()
        names = [*key, "ends_sha256"]
        for b in batches:
            out = []
            for *node, text in zip(*(b.column(c).to_pylist() for c in range(4))):
                if node != at:
                    if at is not None:
                        out.append((*at, sha.hexdigest()))
                    at, sha = node, hashlib.sha256(text.encode())
                else:
                    sha.update(b"," + text.encode())
            yield _rows(out, names)
        if at is not None:
            yield _rows([(*at, sha.hexdigest())], names)

    dealt = ends.repartitionByRange(n, *key, "conv_id").sortWithinPartitions(*key, "conv_id")
    joined = map_batches(dealt, pieces, f"{schema}, first long, text string")
    ordered = joined.repartition(n, *key).sortWithinPartitions(*key, "first").select(*key, "text")
    return map_batches(ordered, hashed, f"{schema}, ends_sha256 string")


def _rows(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    kinds = [pa.string() if c in ("text", "ends_sha256") else pa.int64() for c in names]
    return pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], t) for c, t in enumerate(kinds)], names=names)


def prefix_trie(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
                rebuild: bool = False) -> DataFrame:
    """conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens and ends_sha256 of every node."""
    return trie(*prefixes(turns, conv_id, turn, role, text, rebuild))
