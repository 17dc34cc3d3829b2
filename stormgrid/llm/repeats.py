"""Exchange of marks between documents, shared by the two repeat-removing operators.

A text is covered by windows of a fixed length. Each window picks a *mark*, a short piece
of its own content, by a rule that looks at the window alone, so equal windows pick equal
marks at equal places. The job has five steps, all keyed by hashes:

1. ``marks``    every document's marks go to buckets by their name;
2. ``shared``   a bucket returns the names that occur at least twice to their documents;
3. ``details``  documents send what their windows at shared names hold to buckets again;
4. ``solve``    a bucket finds the repeated windows and returns them to their documents;
5. ``finish``   documents drop what repeated windows cover.

Marks and details travel as a packed row for each bucket and batch. What a batch can
settle by itself (all but the first of equal details) doesn't travel at all. Windows over the
edge of a very common passage differ from document to document and can't be settled so:
step 2 counts each name's documents and tells all homes the names of ``HOT_DOCUMENTS`` or
more, and the windows at these go to buckets by their own content, not by their mark's
name, so that no mark fills a bucket. A hot name also has a document for every ``2 ** HOT_SHIFT``
bytes of all texts, which bounds the names that homes are told.

Buckets are the square root of the text's bytes over ``ROW_BYTES``, whatever the cluster's
partitions: a step makes one row at most for every pair of a home and a bucket, so its rows
grow in proportion to the text, and a bucket with the square root of it. From the size on at
which a bucket would hold ``BUCKET_BYTES`` of text (2 TB) buckets stay so large, and rows are
bounded by the marks that they hold. The documents' texts are shuffled once, compressed;
steps 3 and 5 read the same exchange.

A row is known by the hash of its id and text; rows that repeat both share their result.
"""

from __future__ import annotations

import math
import struct
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import chunks_by_size

#: Bytes of text for each packed row of a step, and in a bucket at most.
ROW_BYTES, BUCKET_BYTES = 1 << 15, 1 << 28
#: Compression of packed rows and of texts.
LEVEL = 3
#: Bytes of text that numpy works on at a time.
CHUNK_BYTES = 1 << 20
PACKED = "dest int, kind int, data binary"
#: Marks that a task gathers before it sends them.
BATCH_MARKS = 400_000
#: Documents of a mark from which on its windows are dealt by their own content.
HOT_DOCUMENTS, HOT_SHIFT = 4000, 24
#: Names travel as 48 bits: a chance match only sends details that nothing equals.
_SIX = np.uint64((1 << 48) - 1)
#: Order of a null id: before all others.
FIRST_ID = -(1 << 63)


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays as one compressed byte string."""
    head = struct.pack(f"<{len(arrays)}q", *(a.nbytes for a in arrays))
    return zstandard.ZstdCompressor(level=LEVEL).compress(head + b"".join([np.ascontiguousarray(a).tobytes() for a in arrays]))


def unpack(data: bytes, *types: str) -> list[np.ndarray]:
    data = zstandard.ZstdDecompressor().decompress(data)
    sizes = struct.unpack_from(f"<{len(types)}q", data)
    out, at = [], 8 * len(types)
    for t, n in zip(types, sizes):
        out.append(np.frombuffer(data, t, n // np.dtype(t).itemsize, at))
        at += n
    return out


def merged(parts: list[bytes], *types: str) -> list[np.ndarray]:
    """Columns of several packed rows, one after another."""
    cols = [unpack(p, *types) for p in parts]
    return [np.concatenate([c[i] for c in cols]) if cols else np.zeros(0, t) for i, t in enumerate(types)]


def rows(found: list[tuple[int, int, bytes]]) -> pa.Table:
    d, k, b = zip(*found) if found else ((), (), ())
    return pa.table([pa.array(d, pa.int32()), pa.array(k, pa.int32()), pa.array(b, pa.binary())], names=["dest", "kind", "data"])


def deal(dest: np.ndarray, kind: int, *columns: np.ndarray) -> list[tuple[int, int, bytes]]:
    """One packed row for each destination."""
    if not len(dest):
        return []
    order = np.argsort(dest, kind="stable")
    at = dest[order]
    cut = np.flatnonzero(np.diff(at)) + 1
    return [(int(at[lo]), kind, pack(*(c[order[lo:hi]] for c in columns))) for lo, hi in zip([0, *cut], [*cut, len(at)])]


def text_bytes(docs: DataFrame, text: str) -> int:
    return docs.agg(F.sum(F.octet_length(F.col(text))).alias("size")).first()["size"] or 0


def buckets_for(size: int) -> int:
    """Buckets of a table, from the bytes of its texts alone."""
    return max(1, math.isqrt(size // ROW_BYTES), size // BUCKET_BYTES)


def bucket_of(names: np.ndarray, n: int) -> np.ndarray:
    return (names.astype(np.uint64) % np.uint64(n)).astype(np.int64)


def home_of(keys: np.ndarray, n: int) -> np.ndarray:
    """Destination of a document's key, as Spark's pmod gives it."""
    return keys.astype(np.int64) % n


def spans(key: np.ndarray, at: np.ndarray, kind: int, n: int) -> list[tuple[int, int, bytes]]:
    """Window starts of documents as packed runs."""
    if not len(key):
        return []
    by = np.lexsort((at, key))
    key, at = key[by], at[by]
    cut = np.flatnonzero((key[1:] != key[:-1]) | (np.diff(at) > 1)) + 1
    lo, hi = np.r_[0, cut], np.r_[cut, len(at)] - 1
    return deal(home_of(key[lo], n), kind, key[lo], at[lo], at[hi])


def in_steps(dest: np.ndarray, kind: int, a, b, key, order, at) -> list[tuple[int, int, bytes]]:
    """Windows as one packed row for each destination; what repeats or counts up from row to row packs to next to nothing."""
    if not len(dest):
        return []
    by = np.lexsort((at, key, dest))
    a, b, key, order, at, dest = (c[by] for c in (a, b, key, order, at, dest))
    cut = np.r_[np.flatnonzero(np.diff(dest, prepend=-1)), len(dest)]
    return [(int(dest[lo]), kind, pack(a[lo:hi], b[lo:hi], *(np.diff(c[lo:hi], prepend=np.int64(0)) for c in (key, order, at))))
            for lo, hi in zip(cut[:-1], cut[1:])]


def from_steps(parts: list[bytes]) -> list[np.ndarray]:
    """The windows of several rows of :func:`in_steps`: two parts of the name, key, order, start."""
    cols: list[list[np.ndarray]] = [[np.zeros(0, t)] for t in ("<u8", "<u4", "<i8", "<i8", "<i8")]
    for p in parts:
        a, b, *steps = unpack(p, "<u8", "<u4", "<i8", "<i8", "<i8")
        for c, v in zip(cols, (a, b, *map(np.cumsum, steps))):
            c.append(v)
    return [np.concatenate(c) for c in cols]


def batches_of(keys: list[int], texts: list[bytes], limit: int = CHUNK_BYTES) -> Iterator[tuple[np.ndarray, list[bytes]]]:
    for lo, hi in chunks_by_size([len(t) + 64 for t in texts], limit):
        yield np.array(keys[lo:hi], np.int64), texts[lo:hi]


def repeated(docs: DataFrame, doc_id: str, text: str,
             marks: Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]],
             details: Callable[[np.ndarray, np.ndarray, list[bytes], Callable[[np.ndarray, np.ndarray], np.ndarray],
                                Callable[[np.ndarray], np.ndarray], int], list],
             solve: Callable[[list[bytes], int], list],
             finish: Callable[[list, list[bytes], list[tuple[np.ndarray, np.ndarray]]], list[pa.Array]],
             schema: str, carry: list[str] | None = None, within: bool = True) -> DataFrame:
    """Run the five steps; ``finish`` gives the columns of ``schema`` for a list of documents.

    ``marks(texts)``: names and document numbers. ``details(keys, orders, texts, is_shared, is_hot, n)``:
    packed rows, kind 0 for buckets and kind 1 for documents. ``solve(parts, n)``, of kind 0: packed
    rows of (key, first, last) for documents. ``finish(ids, texts, spans)``. The columns named in
    ``carry`` come along in a last column, the struct ``rest``. Without ``within``, a name that one
    document alone has several times isn't shared.
    """
    size = text_bytes(docs, text)
    hot_from = max(HOT_DOCUMENTS, size >> HOT_SHIFT)
    n = buckets_for(size)
    body = F.coalesce(F.col(text), F.lit(""))
    own = docs.select(F.col(doc_id).cast("long").alias("id"), body.cast("binary").alias("text"),
                      F.xxhash64(F.col(doc_id).cast("long"), body).alias("key"),
                      *([F.struct(*carry).alias("rest")] if carry else []))

    def compressed(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z = zstandard.ZstdCompressor(level=LEVEL)
        for b in it:
            small = pa.array([z.compress(t) for t in b.column(1).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0), small, *b.columns[2:]], names=b.schema.names)

    def texts_in(t: pa.Table) -> list[bytes]:
        z = zstandard.ZstdDecompressor()
        return [z.decompress(x) for x in t.column("text").to_pylist()]

    at_home = own.mapInArrow(compressed, own.schema).withColumn("dest", F.pmod("key", F.lit(n)).cast("int"))

    def step_marks(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys: list[int] = []
        found: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def settle() -> list[pa.RecordBatch]:
            # one entry for each name and document; names seen in several documents here are shared already
            names, number, twice = _distinct(np.concatenate([x[0] for x in found]), np.concatenate([x[1] for x in found]))
            first = np.r_[True, names[1:] != names[:-1]] if len(names) else np.zeros(0, bool)
            many = (twice & within) | _several(names)
            sent = np.array(keys, np.int64)[number]
            count = np.diff(np.r_[np.flatnonzero(first), len(names)])
            at = np.argsort(number[first], kind="stable")  # by document: its key repeats in a row
            by = np.flatnonzero(first)[at]
            out = deal(bucket_of(names[by], n), 0, _six(names[by]), sent[by], (2 * count[at] + many[by]).astype("<u4"))
            return rows(out + deal(home_of(sent[many], n), 1, sent[many], names[many])).to_batches()

        for b in it:
            for own, texts in batches_of(b.column(2).to_pylist(), b.column(1).to_pylist()):
                names, number = marks(texts)
                found.append((names & _SIX, number + len(keys)))
                keys += own.tolist()
                size += len(names)
                if size > BATCH_MARKS:
                    yield from settle()
                    keys, found, size = [], [], 0
        if found:
            yield from settle()

    def step_shared(t: pa.Table) -> pa.Table:
        kinds, parts = t.column("kind").to_pylist(), t.column("data").to_pylist()
        names, keys, count = merged([p for k, p in zip(kinds, parts) if k == 0], "u1", "<i8", "<u4")
        names = _eight(names)
        order = np.argsort(names, kind="stable")
        names, keys, count = names[order], keys[order], count[order].astype(np.int64)
        tell = _several(names) & (count & 1 == 0)
        out = deal(home_of(keys[tell], n), 0, keys[tell], names[tell])
        if len(names):
            start = np.flatnonzero(np.r_[True, names[1:] != names[:-1]])
            hot = names[start][np.add.reduceat(count >> 1, start) >= hot_from]
            if len(hot):
                told = pack(hot)
                out += [(d, 2, told) for d in range(n)]
        # settled before: these rows are with their documents' bucket already
        out += [(d, 0, p) for d, k, p in zip(t.column("dest").to_pylist(), kinds, parts) if k == 1]
        return rows(out)

    def step_details(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return rows([])
        kinds, parts = right.column("kind").to_pylist(), right.column("data").to_pylist()
        keys, names = merged([p for k, p in zip(kinds, parts) if k == 0], "<i8", "<u8")
        (hot,) = merged([p for k, p in zip(kinds, parts) if k == 2], "<u8")
        if not len(keys):
            return rows([])
        is_shared = _lookup(keys, names)
        mine = left.column("key").to_numpy()
        known = np.flatnonzero(np.isin(mine, keys))
        _, unique = np.unique(mine[known], return_index=True)
        left = left.take(known[np.sort(unique)])
        orders = np.array([FIRST_ID if i is None else i for i in left.column("id").to_pylist()], np.int64)

        def is_hot(name: np.ndarray) -> np.ndarray:
            return np.isin(name & _SIX, hot)

        return rows(details(left.column("key").to_numpy(), orders, texts_in(left), is_shared, is_hot, n))

    def step_solve(t: pa.Table) -> pa.Table:
        kinds, parts = t.column("kind").to_pylist(), t.column("data").to_pylist()
        out = [(d, 0, p) for d, k, p in zip(t.column("dest").to_pylist(), kinds, parts) if k == 1]
        return rows(out + solve([p for k, p in zip(kinds, parts) if k == 0], n))

    out_type = T.StructType(list(T.StructType.fromDDL(schema)) + ([own.schema["rest"]] if carry else []))

    def step_finish(left: pa.Table, right: pa.Table) -> pa.Table:
        keys, first, last = merged(right.column("data").to_pylist(), "<i8", "<i8", "<i8")
        order = np.lexsort((first, keys))
        keys, first, last = keys[order], first[order], last[order]

        def spans_of(key: int) -> tuple[np.ndarray, np.ndarray]:
            lo, hi = np.searchsorted(keys, [key, key + 1]) if key < (1 << 63) - 1 else (np.searchsorted(keys, key), len(keys))
            return first[lo:hi], last[lo:hi]

        spans = [spans_of(k) for k in left.column("key").to_pylist()]
        cols = finish(left.column("id").to_pylist(), texts_in(left), spans)
        return pa.table([*cols, *([left.column("rest")] if carry else [])], names=out_type.names)

    sent = own.select("id", "text", "key").mapInArrow(step_marks, PACKED)
    shared = sent.groupBy("dest").applyInArrow(step_shared, PACKED)
    detailed = at_home.groupBy("dest").cogroup(shared.groupBy("dest")).applyInArrow(step_details, PACKED)
    solved = detailed.groupBy("dest").applyInArrow(step_solve, PACKED)
    return at_home.groupBy("dest").cogroup(solved.groupBy("dest")).applyInArrow(step_finish, out_type)


def _lookup(keys: np.ndarray, names: np.ndarray) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """Whether marks (document key, name), a document's side by side, are among the given ones."""
    order = np.lexsort((names, keys))
    keys, names = keys[order], names[order]
    bounds, edge = np.unique(keys, return_index=True)
    edge = np.r_[edge, len(keys)]

    def among(key: np.ndarray, name: np.ndarray) -> np.ndarray:
        out, wanted = np.zeros(len(key), bool), name & _SIX
        if not len(bounds) or not len(key):
            return out
        cut = np.flatnonzero(np.diff(key)) + 1
        for lo, hi in zip([0, *cut], [*cut, len(key)]):
            i = np.searchsorted(bounds, key[lo])
            if i < len(bounds) and bounds[i] == key[lo]:
                have = names[edge[i]:edge[i + 1]]
                j = np.minimum(np.searchsorted(have, wanted[lo:hi]), len(have) - 1)
                out[lo:hi] = have[j] == wanted[lo:hi]
        return out

    return among


def _six(names: np.ndarray) -> np.ndarray:
    """The low 48 bits of names, as bytes."""
    return np.ascontiguousarray(names.astype("<u8")).view(np.uint8).reshape(-1, 8)[:, :6]


def _eight(flat: np.ndarray) -> np.ndarray:
    out = np.zeros((len(flat) // 6, 8), np.uint8)
    out[:, :6] = flat.reshape(-1, 6)
    return out.reshape(-1).view("<u8")


def _several(names: np.ndarray) -> np.ndarray:
    """For sorted names, whether an entry's neighbour has the same name."""
    if not len(names):
        return np.zeros(0, bool)
    same = names[1:] == names[:-1]
    return np.r_[False, same] | np.r_[same, False]


def _distinct(names: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (name, document), by name; and whether a document has the name more than once."""
    order = np.lexsort((number, names))
    names, number = names[order], number[order]
    if not len(names):
        return names, number, np.zeros(0, bool)
    new = np.r_[True, (names[1:] != names[:-1]) | (number[1:] != number[:-1])]
    count = np.diff(np.r_[np.flatnonzero(new), len(names)])
    return names[new], number[new], count > 1
