"""Removal of repeated byte strings with suffix arrays.

A string of ``WINDOW`` bytes is repeated if it also starts in a document of a smaller id;
every byte that a repeated string covers is removed. Strings are judged on the input.

Each string's mark (:mod:`repeats`) is the ``GRAM``-byte piece of the smallest hash in it,
the leftmost of equal ones. Documents send, for every shared mark, the bytes that the
strings around it span. In a bucket, the bytes right of the marks, eight to a symbol and
each mark's name before them, form one string; its suffix array, built by grouping
suffixes by their Lyndon prefix (:mod:`suffix_array`), puts marks with equal bytes to the
right side by side. The common prefixes of neighbours give, for each offset of a mark in
its string, the classes of equal right parts, which the bytes on the left divide further.
The smallest document of each class stays; a string is removed only if its bytes equal those
of its class's first one. Of a hot mark, each string travels by itself to a bucket of its own
content and is settled there in the same way, so that a mark's strings are divided before they
meet. Equal right parts of a mark enter the suffix array once.

Defined results: a null text is the empty text; a null id is smaller than all others; rows
that repeat a ``doc_id`` never make each other's strings repeated; repeated rows share
their result; an empty table gives an empty result; texts shorter than ``WINDOW`` bytes
stay whole; extra columns are ignored unless carried along.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh_names
from .repeats import CHUNK_BYTES, batches_of, bucket_of, deal, home_of, merged, repeated
from .suffix_array import lyndon_suffix_array

WINDOW, GRAM = 50, 18
SIDE = WINDOW - GRAM  # bytes of a string on either side of its mark at most
WIDE = SIDE + WINDOW  # bytes that all strings around a mark span
#: Entries of whole marks whose suffixes are sorted together (more if one mark's entries in a bucket are more).
SORTED = 20_000

_RNG = np.random.default_rng(20240607)
_BYTE = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_C = [np.uint64(pow(0x9E3779B97F4A7C15, k, 1 << 64)) for k in (1, 2, 4, 8)]
_MIX = np.uint64(0xD6E8FEB86659FD93)
_LOW = np.uint64((1 << 24) - 1)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _MIX
    return (h ^ (h >> np.uint64(29))) * _MIX


def _smallest(v: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each stretch of ``width`` values."""
    done, out = 1, v
    while done * 2 <= width:
        out = np.minimum(out[:len(out) - done], out[done:])
        done *= 2
    if done < width:
        out = np.minimum(out[:len(out) - (width - done)], out[width - done:])
    return out


def _segment(flat: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, ...] | None:
    """Marks of one stretch of bytes: first window, last window, mark's place, name."""
    x = _BYTE[flat]
    h2 = x[:-1] * _C[0] + x[1:]
    h4 = h2[:-2] * _C[1] + h2[2:]
    h8 = h4[:-4] * _C[2] + h4[4:]
    h16 = h8[:-8] * _C[3] + h8[8:]
    name = _mixed(h16[:len(flat) - GRAM + 1] * _C[1] + h2[16:])
    value = (name & ~_LOW) | np.arange(len(name), dtype=np.uint64)
    mark = (_smallest(value, SIDE + 1) & _LOW).astype(np.int64)
    whole = doc[:len(mark)] == doc[WINDOW - 1:]
    at = np.flatnonzero(whole)
    if not len(at):
        return None
    mark = mark[at]
    cut = np.flatnonzero((np.diff(mark) != 0) | (np.diff(at) != 1)) + 1
    lo, hi = np.r_[0, cut], np.r_[cut, len(at)] - 1
    return at[lo], at[hi], mark[lo], name[mark[lo]]


def marks_of(texts: list[bytes]) -> Iterator[tuple[np.ndarray, ...]]:
    """Of stretches of the joined texts: document, first and last window, mark's place, name.

    Places are in the joined texts. A mark at a stretch's edge may come twice, with the
    windows of each stretch.
    """
    flat = np.frombuffer(b"".join(texts), np.uint8)
    sizes = np.array([len(t) for t in texts], np.int64)
    doc = np.repeat(np.arange(len(texts)), sizes)
    for lo in range(0, max(0, len(flat) - WINDOW + 1), CHUNK_BYTES):
        hi = min(len(flat), lo + CHUNK_BYTES + WINDOW - 1)
        found = _segment(flat[lo:hi], doc[lo:hi])
        if found:
            first, last, mark, name = found
            yield doc[lo + first], lo + first, lo + last, lo + mark, name


def marks(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    found = list(marks_of(texts))
    if not found:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.concatenate([x[4] for x in found]), np.concatenate([x[0] for x in found])


def details(keys: np.ndarray, orders: np.ndarray, texts: list[bytes], is_shared, is_hot, n: int) -> list:
    """Entries of shared marks; of equal ones only those of the smallest document travel."""
    cols: list[list[np.ndarray]] = [[] for _ in range(7)]
    done = 0
    for own_keys, part in batches_of(keys.tolist(), texts):
        start = np.cumsum([0, *map(len, part)])
        flat = np.frombuffer(b"\0" * SIDE + b"".join(part) + b"\0" * WINDOW, np.uint8)
        for doc, first, last, mark, name in marks_of(part):
            keep = is_shared(own_keys[doc], name)
            doc, first, last, mark, name = doc[keep], first[keep], last[keep], mark[keep], name[keep]
            if not len(doc):
                continue
            wide = flat[(mark[:, None] + np.arange(WIDE))]  # from SIDE bytes before the mark on
            place = np.arange(-SIDE, WINDOW)
            left, least = mark - first, mark - last
            outside = (place < -left[:, None]) | (place >= WINDOW - least[:, None])
            wide = np.where(outside, 0, wide).astype(np.uint8)
            for c, v in zip(cols, (name, own_keys[doc], orders[done + doc], first - start[doc], left.astype(np.uint8), least.astype(np.uint8), wide)):
                c.append(v)
        done += len(part)
    if not cols[0]:
        return []
    name, key, order, first, left, least, wide = (np.concatenate(c) for c in cols)
    hot = is_hot(name)
    entries = name, key, order, first, left, least, wide
    split = _strings(*(c[hot] for c in entries))
    name, key, order, first, left, least, wide = (np.concatenate([c[~hot], d]) for c, d in zip(entries, split))
    whole = np.arange(len(name)) < len(hot) - hot.sum()  # entries of marks that aren't hot
    code = np.concatenate([wide[lo:lo + SORTED].astype(np.uint64) @ _BYTE[:WIDE] for lo in range(0, len(wide), SORTED)])
    code = _mixed(code + left * _BYTE[100] + least * _BYTE[101])
    dest = bucket_of(np.where(whole, name, code), n)
    by = np.lexsort((order, code, name))
    name, key, order, first, left, least, wide, code, dest = (c[by] for c in (name, key, order, first, left, least, wide, code, dest))
    new = np.ones(len(name), bool)
    new[1:] = (name[1:] != name[:-1]) | (code[1:] != code[:-1]) | (left[1:] != left[:-1]) | (least[1:] != least[:-1]) | (wide[1:] != wide[:-1]).any(1)
    group = np.cumsum(new) - 1
    later = order > order[np.flatnonzero(new)][group]
    sent = ~later
    out = deal(dest[sent], 0, key[sent], order[sent], first[sent], left[sent], least[sent], wide[sent])
    count = left.astype(np.int64) - least
    return out + deal(home_of(key[later], n), 1, key[later], first[later], first[later] + count[later])


def _strings(name, key, order, first, left, least, wide) -> list[np.ndarray]:
    """Entries of one string each for all strings of the given entries."""
    place = np.arange(-SIDE, WINDOW)
    cols: list[list[np.ndarray]] = [[x[:0]] for x in (name, key, order, first, left, least, wide)]
    for l in range(SIDE + 1):  # the string starts l bytes before the mark
        own = np.flatnonzero((least <= l) & (l <= left))
        inside = (place >= -l) & (place < WINDOW - l)
        size = np.full(len(own), l, np.uint8)
        for c, v in zip(cols, (name[own], key[own], order[own], first[own] + left[own] - l, size, size, np.where(inside, wide[own], 0).astype(np.uint8))):
            c.append(v)
    return [np.concatenate(c) for c in cols]


def solve(parts: list[bytes], n: int) -> list:
    """Repeated strings of a bucket's entries, as runs of window starts."""
    key, order, first, left, least, wide = merged(parts, "<i8", "<i8", "<i8", "u1", "u1", "u1")
    if not len(key):
        return []
    wide = wide.reshape(-1, WIDE)
    name = np.concatenate([_names(wide[lo:lo + SORTED, SIDE:SIDE + GRAM]) for lo in range(0, len(wide), SORTED)])
    by = np.lexsort((order, name))
    start = np.flatnonzero(np.r_[True, name[by][1:] != name[by][:-1]])
    ends = np.r_[start[1:], len(by)]
    # a mark of a single document has nothing to compare with
    several = order[by][start] < order[by][ends - 1]
    by = by[np.repeat(several, ends - start)]
    if not len(by):
        return []
    edges = np.r_[np.flatnonzero(np.r_[True, name[by][1:] != name[by][:-1]]), len(by)]
    out, lo = [], 0
    for k in range(1, len(edges)):
        if edges[k] - lo >= SORTED or k == len(edges) - 1:
            own = by[lo:edges[k]]
            out += _repeats(name[own], key[own], order[own], first[own], left[own].astype(np.int64), least[own].astype(np.int64), wide[own], n)
            lo = edges[k]
    return out


def _names(grams: np.ndarray) -> np.ndarray:
    """Names of marks from their bytes, as :func:`_segment` gives them."""
    x = _BYTE[grams]
    h2 = x[:, :-1] * _C[0] + x[:, 1:]
    h4 = h2[:, :-2] * _C[1] + h2[:, 2:]
    h8 = h4[:, :-4] * _C[2] + h4[:, 4:]
    return _mixed((h8[:, 0] * _C[3] + h8[:, 8]) * _C[1] + h2[:, 16])


def right_order(name: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Entries in order of (name, right bytes), from the suffix array of the distinct ones' symbols."""
    symbols = np.ascontiguousarray(right).view(">u8").astype(np.uint64)
    code = name
    for k in range(symbols.shape[1]):
        code = _mixed(code * _C[0] + symbols[:, k])
    by = np.argsort(code, kind="stable")
    new = np.r_[True, (name[by][1:] != name[by][:-1]) | (symbols[by][1:] != symbols[by][:-1]).any(1)]
    own = np.empty(len(name), np.int64)
    own[by] = np.cumsum(new) - 1
    heads = by[new]
    rank = np.empty(len(heads), np.int64)
    rank[_suffix_order(name[heads], symbols[heads])] = np.arange(len(heads))
    return np.argsort(rank[own], kind="stable")


def _suffix_order(name: np.ndarray, symbols: np.ndarray) -> np.ndarray:
    """Rows in order of (name, symbols), from the suffix array of all of them in one string."""
    m = len(name)
    values, ranked = np.unique(symbols, return_inverse=True)
    _, named = np.unique(name, return_inverse=True)
    text = np.ones((m, symbols.shape[1] + 2), np.int64)  # 1 separates rows
    text[:, 0] = 2 + len(values) + named.reshape(-1)
    text[:, 1:-1] = 2 + ranked.reshape(symbols.shape)
    suffixes = lyndon_suffix_array(np.r_[text.reshape(-1), 0])
    width = text.shape[1]
    heads = suffixes[(suffixes % width == 0) & (suffixes < m * width)]
    return heads // width


def _repeats(name, key, order, first, left, least, wide, n: int) -> list:
    by = right_order(name, wide[:, SIDE + GRAM:])
    name, key, order, first, left, least, wide = (c[by] for c in (name, key, order, first, left, least, wide))
    m = len(name)
    right = wide[:, SIDE + GRAM:]
    common = np.zeros(m, np.int64)
    if m > 1:
        differs = right[1:] != right[:-1]
        common[1:] = np.where(differs.any(1), differs.argmax(1), SIDE)
        common[1:][name[1:] != name[:-1]] = -1
    common[0] = -1
    hit = np.zeros((m, SIDE + 1), bool)  # by window start, ascending
    before = np.zeros(m, np.uint64)
    for l in range(SIDE + 1):  # the string starts l bytes before the mark
        if l:
            before = before * _C[0] + _BYTE[wide[:, SIDE - l]]
        own = np.flatnonzero((least <= l) & (l <= left))
        if len(own) < 2:
            continue
        klass = np.cumsum(common < SIDE - l)[own].astype(np.uint64)
        both = _mixed(before[own] + klass * _MIX)
        at = np.lexsort((order[own], klass, both))
        b, k, o = both[at], klass[at], order[own][at]
        same = (b[1:] == b[:-1]) & (k[1:] == k[:-1])
        pair = np.flatnonzero(same)
        x = wide[own[at]][:, SIDE - l:SIDE]
        same[pair] = (x[pair] == x[pair + 1]).all(1)
        new = np.r_[True, ~same]
        later = o > o[np.flatnonzero(new)][np.cumsum(new) - 1]
        hit[own[at[later]], SIDE - l] = True
    edge = np.diff(np.pad(hit.astype(np.int8), ((0, 0), (1, 1))), axis=1)
    row, lo = np.nonzero(edge == 1)
    _, hi = np.nonzero(edge == -1)
    base = first[row] - (SIDE - left[row])
    return deal(home_of(key[row], n), 0, key[row], base + lo, base + hi - 1)


def kept_bytes(text: bytes, first: np.ndarray, last: np.ndarray, whole_chars: bool = False) -> tuple[bytes, int, int]:
    """What is left of a text, the bytes removed and the maximal removed runs."""
    if not len(first):
        return text, 0, 0
    end = np.maximum.accumulate(last) + WINDOW
    new = np.r_[True, first[1:] > end[:-1]]
    starts, ends = first[new], end[np.r_[np.flatnonzero(new)[1:] - 1, len(end) - 1]]
    parts, at, removed, spans = [], 0, 0, 0
    for lo, hi in zip(starts.tolist(), ends.tolist()):
        if whole_chars:
            while lo < hi and text[lo] & 0xC0 == 0x80:
                lo += 1
            while hi > lo and hi < len(text) and text[hi] & 0xC0 == 0x80:
                hi -= 1
        if hi > lo:
            parts.append(text[at:lo])
            at, removed, spans = hi, removed + hi - lo, spans + 1
    parts.append(text[at:])
    return b"".join(parts), removed, spans


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", whole_chars: bool = False,
                   carry: list[str] | None = None) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept (bytes) of every document.

    ``whole_chars`` keeps characters of which only a part is covered.
    """
    def finish(ids: list, texts: list[bytes], found: list) -> list[pa.Array]:
        done = [kept_bytes(t, lo, hi, whole_chars) for t, (lo, hi) in zip(texts, found)]
        return [pa.array(ids, pa.int64()), pa.array([len(t) for t in texts], pa.int64()), pa.array([d[1] for d in done], pa.int64()),
                pa.array([d[2] for d in done], pa.int64()), pa.array([d[0] for d in done], pa.binary())]

    return repeated(docs, doc_id, text, marks, details, solve, finish,
                    "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary", carry, False)


def without_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: str = "n_chars") -> DataFrame:
    """``docs`` with repeated strings taken out of the texts (whole characters only); other columns
    stay, the text's size in characters is set anew, and a null text stays null."""
    (none,) = fresh_names(docs, "_none")
    left = remove_repeats(docs.withColumn(none, F.col(text).isNull()), doc_id, text, True, [*(c for c in docs.columns if c != text), none])
    kept = F.when(~F.col("rest")[none], F.col("kept").cast("string"))
    out = []
    for c in docs.columns:
        if c == text:
            out.append(kept.alias(c))
        elif c == size:
            out.append(F.when(F.col("rest")[none] | (F.col("n_removed") == 0), F.col("rest")[c])
                       .otherwise(F.length(F.col("kept").cast("string"))).cast(docs.schema[c].dataType).alias(c))
        else:
            out.append(F.col("rest")[c].alias(c))
    return left.select(*out)
