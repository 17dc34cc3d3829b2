"""Ids of the ``tokenizers`` library, one library call per distinct piece of text.

Byte-level BPE never merges across the pre-tokenizer's cuts. A single space between
two non-space characters always starts a new pre-token, and a single newline between
them is one of its own, so a text may be cut there and each piece encoded by itself
with the same ids. Pieces repeat, so most of them are looked up, not encoded.
"""

from __future__ import annotations

import os
import re
import string
import sys
from array import array
from collections.abc import Callable, Iterable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import chunks_by_size

#: Pieces remembered per Python worker in each of two generations.
MEMO_PIECES = 300_000
#: Pieces whose ids are remembered per Python worker, in arrays of about 50 bytes a piece.
MEMO_IDS = 700_000
#: Longer pieces are encoded each time, so that remembered pieces stay small.
MEMO_PIECE_CHARS = 64
#: Characters cut and looked up at a time (or one text).
CHUNK_CHARS = 1 << 23
#: One pre-token of Latin letters, which are letters in every version of Unicode that the library may follow.
_LATIN_WORD = re.compile(" ?[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]+")
_SAFE_SPACE = re.compile(r"(?<=\S)(?= \S)")


def _odd(text: str) -> bool:
    """Whether ``text`` holds other white space than single blanks and newlines, or several together."""
    return "  " in text or "\n\n" in text or " \n" in text or "\n " in text or not text.replace("\n", "").isprintable()


def pieces(text: str) -> list[str]:
    """Cut ``text`` where the pre-tokenizer cuts whatever stands on either side."""
    if not text:
        return []
    if _odd(text):
        return _SAFE_SPACE.split(text)
    return text.replace(" ", "\x01 ").replace("\n", "\x01\n\x01").split("\x01")


def pieces_of(texts: list[str]) -> tuple[pa.LargeStringArray, np.ndarray]:
    """The :func:`pieces` of all texts, one after another, and where each text's begin (one entry more than texts)."""
    odd = [i for i, t in enumerate(texts) if _odd(t)]
    plain = pa.array(texts, pa.large_string())
    if odd:  # cut by the expression, then joined by the mark, which such a piece may hold itself
        skip = np.zeros(len(texts), bool)
        skip[odd] = True
        plain = pc.if_else(pa.array(skip), pa.scalar("", pa.large_string()), plain)
    marked = pc.replace_substring(pc.replace_substring(plain, " ", "\x01 "), "\n", "\x01\n\x01")
    cut = pc.split_pattern(marked, "\x01")
    flat, at = cut.flatten(), np.asarray(cut.offsets).astype(np.int64)
    at = at - at[0]
    if not odd:
        return flat, at
    own = {i: _SAFE_SPACE.split(texts[i]) for i in odd}
    parts, counts, done = [], np.diff(at), 0
    for i in odd:
        parts += [flat.slice(done, at[i] - done), pa.array(own[i], pa.large_string())]
        counts[i], done = len(own[i]), at[i + 1]
    parts.append(flat.slice(done))
    return pa.concat_arrays(parts), np.concatenate([[0], np.cumsum(counts)])


class PieceMemo:
    """Results by piece of text, made once for each new piece of a batch.

    The generation before the current one is kept, so that frequent pieces stay known.
    Letters that end in ASCII punctuation are two pre-tokens, so such a piece is
    put together from the results of its word and its marks.
    """

    def __init__(self, make: Callable[[list[str]], Iterable], join: Callable, size: int = 0):
        self.make, self.join, self.size = make, join, size or MEMO_PIECES
        self.now: dict = {}
        self.before: dict = {}
        self.long: list[str] = []

    def cover(self, cut: list[list[str]]) -> dict:
        """A dict that holds the results of all pieces of ``cut`` (until the next call)."""
        for p in self.long:
            self.now.pop(p, None)
        need = set().union(*cut)
        new = need.difference(self.now)
        if len(self.now) + len(new) > self.size:
            self.before, self.now = self.now, {}
            new = need
        old = self.before
        self.now.update([(p, old[p]) for p in new if p in old])
        rest = [p for p in new if p not in old]
        marked = []
        for p in rest:
            word = p.rstrip(string.punctuation)
            if len(word) < len(p) and (word[1:] if word[:1] == " " else word).isalpha():
                marked.append((p, word, p[len(word):]))
        fresh = set(rest).difference([m[0] for m in marked])
        fresh.update([m[1] for m in marked], [m[2] for m in marked])
        fresh = [p for p in fresh if p not in self.now]
        self.now.update(zip(fresh, self.make(fresh), strict=True))
        now, join = self.now, self.join
        now.update([(p, join(now[word], now[marks])) for p, word, marks in marked])
        self.long = [p for p in new if len(p) > MEMO_PIECE_CHARS]
        return now


#: Two random values of each byte and two odd factors: two hashes of a piece.
_LETTERS = np.random.default_rng(50_000).integers(0, 1 << 64, (2, 256), np.uint64)
_FACTORS = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)


def _powers(factor: int, n: int) -> np.ndarray:
    out = np.full(n + 1, factor, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def hashes(words: pa.LargeStringArray) -> list[np.ndarray]:
    """Two 64-bit hashes of each word's bytes."""
    at = np.frombuffer(words.buffers()[1], np.int64)[words.offset:words.offset + len(words) + 1]
    data = np.frombuffer(words.buffers()[2] or b"", np.uint8)[at[0]:at[-1]]
    at = at - at[0]
    out = []
    for letters, factor in zip(_LETTERS, _FACTORS, strict=True):
        total = np.concatenate([[np.uint64(0)], np.cumsum(letters[data] * _powers(factor, len(data))[:-1], dtype=np.uint64)])
        back = _powers(pow(factor, -1, 1 << 64), len(data))  # a word's hash does not depend on where it stands
        h = (total[at[1:]] - total[at[:-1]]) * back[at[:-1]] + np.diff(at).astype(np.uint64) * np.uint64(factor)
        out.append(h ^ (h >> np.uint64(31)))
    return out


class IdMemo:
    """Ids of pieces by two hashes of 64 bits each, in arrays; when it is full, the half used last stays."""

    def __init__(self, size: int):
        self.size, self.turn, self.used = size, 0, 0
        self.ids = np.zeros(1 << 16, np.uint32)
        self.keys, self.slot = np.zeros(0, np.uint64), np.zeros(0, np.int32)  # ascending, and each one's place in the others
        self.check, self.first = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.count, self.seen = np.zeros(0, np.int32), np.zeros(0, np.int32)

    def find(self, key: np.ndarray, check: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Which pieces are known, where their ids begin and how many they are."""
        if not len(self.keys):
            return np.zeros(len(key), bool), np.zeros(len(key), np.int64), np.zeros(len(key), np.int64)
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        slot = self.slot[at]
        known = (self.keys[at] == key) & (self.check[slot] == check)
        self.seen[slot[known]] = self.turn
        return known, self.first[slot], self.count[slot].astype(np.int64)

    def write(self, parts: list[bytes], key: np.ndarray, check: np.ndarray, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the ids of new pieces begin and how many they are; those not to ``keep`` stay until the next call."""
        count = np.fromiter(map(len, parts), np.int64, len(parts)) // 4
        if len(self.keys):  # of pieces that share a key the first one is remembered
            keep = keep & (self.keys[np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)] != key)
        once = np.zeros(len(key), bool)
        once[np.unique(key, return_index=True)[1]] = True
        keep = keep & once
        order = np.argsort(~keep, kind="stable")
        first = np.empty(len(parts), np.int64)
        first[order] = self.used + np.cumsum(count[order]) - count[order]
        end = self.used + int(count.sum())
        if end > len(self.ids):
            self.ids = np.concatenate([self.ids[:self.used], np.zeros(end + end // 8 - self.used, np.uint32)])
        self.ids[self.used:end] = np.frombuffer(b"".join([parts[i] for i in order.tolist()]), "<u4")
        self.used += int(count[keep].sum())
        new = key[keep]
        by = np.argsort(new)
        at = np.searchsorted(self.keys, new[by])
        self.slot = np.insert(self.slot, at, len(self.check) + by)
        self.keys = np.insert(self.keys, at, new[by])
        self.check, self.first = np.concatenate([self.check, check[keep]]), np.concatenate([self.first, first[keep]])
        self.count = np.concatenate([self.count, count[keep].astype(np.int32)])
        self.seen = np.concatenate([self.seen, np.full(len(new), self.turn, np.int32)])
        return first, count

    def trim(self) -> None:
        """Begin a new turn; the pieces used longest ago go if there are too many."""
        self.turn += 1
        if len(self.keys) <= self.size:
            return
        slots = np.sort(np.argsort(self.seen, kind="stable")[-(self.size // 2):])
        count = self.count[slots].astype(np.int64)
        first = np.cumsum(count) - count
        self.ids = self.ids[np.repeat(self.first[slots] - first, count) + np.arange(count.sum())]
        self.used = len(self.ids)
        place = np.full(len(self.check), -1, np.int32)
        place[slots] = np.arange(len(slots))
        left = place[self.slot]
        self.keys, self.slot = self.keys[left >= 0], left[left >= 0]
        self.check, self.first, self.count, self.seen = self.check[slots], first, self.count[slots], self.seen[slots]


def _little(ids: list[int]) -> bytes:
    a = array("I", ids)
    if sys.byteorder == "big":
        a.byteswap()
    return a.tobytes()


class LibraryEncoder:
    """``tokenizers`` ids as little-endian unsigned 32-bit bytes."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.no_truncation()
        self.tok.no_padding()
        self._batch = getattr(self.tok, "encode_batch_fast", self.tok.encode_batch)
        self.memo = IdMemo(MEMO_IDS)
        self.letters = self._letters()

    def _letters(self) -> np.ndarray | None:
        """The vocabulary's letter of each byte, if a word is one pre-token and may go to the library's model by itself."""
        from tokenizers import models, pre_tokenizers

        from .bpe import byte_letters

        cut, known = self.tok.pre_tokenizer, self.tok.get_added_tokens_decoder().values()
        if not isinstance(cut, pre_tokenizers.ByteLevel) or cut.add_prefix_space or not cut.use_regex or self.tok.normalizer is not None:
            return None
        if not isinstance(self.tok.model, models.BPE) or any(t.content.replace(" ", "a").isalpha() for t in known):
            return None
        return np.array([ord(c) for c in byte_letters()], "<u4")

    def _encode(self, parts: list[str]) -> list[bytes]:
        if self.letters is None:
            return self._encode_all(parts)
        plain = [p for p in parts if _LATIN_WORD.fullmatch(p)]
        tokenize, ids, ends = self.tok.model.tokenize, [], [0]
        # all words in the vocabulary's letters at once; the newline's letter stands between them
        lettered = self.letters[np.frombuffer("\n".join(plain).encode(), np.uint8)].tobytes().decode("utf-32-le")
        for word in lettered.split(chr(self.letters[10])) if plain else ():
            ids += [t.id for t in tokenize(word)]
            ends.append(4 * len(ids))
        every = _little(ids)
        found = {p: every[a:b] for p, a, b in zip(plain, ends, ends[1:], strict=False)}
        rest = [p for p in parts if p not in found]
        found.update(zip(rest, self._encode_all(rest), strict=True))
        return [found[p] for p in parts]

    def _encode_all(self, parts: list[str]) -> list[bytes]:
        """Ids of parts that the library cuts itself."""
        return [_little(e.ids) for e in self._batch(parts, add_special_tokens=False)] if parts else []

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        out: list[bytes] = []
        for lo, hi in chunks_by_size([len(t) for t in texts], CHUNK_CHARS):
            out += self._encode_chunk(texts[lo:hi])
        return out

    def _encode_chunk(self, texts: list[str]) -> list[bytes]:
        """Each distinct piece is looked up once; the texts' ids are gathered by the pieces' numbers."""
        flat, at = pieces_of(texts)
        coded = flat.dictionary_encode()
        first, n = self._places(coded.dictionary)
        which = np.asarray(coded.indices)
        each = n[which]
        ends = np.concatenate([[0], np.cumsum(each)])
        every = self.memo.ids[np.repeat(first[which] - ends[:-1], each) + np.arange(ends[-1])].astype("<u4", copy=False).tobytes()
        bounds = (4 * ends[at]).tolist()
        return [every[a:b] for a, b in zip(bounds, bounds[1:])]

    def _places(self, words: pa.LargeStringArray) -> tuple[np.ndarray, np.ndarray]:
        """Where the memo holds the ids of distinct pieces (until the next call), and how many they are."""
        self.memo.trim()
        key, check = hashes(words)
        known, first, n = self.memo.find(key, check)
        new = np.flatnonzero(~known)
        if len(new):
            parts = words.take(pa.array(new)).to_pylist()
            made, more = self._made(parts)
            extra = hashes(pa.array(more, pa.large_string()))
            short = np.fromiter((len(p) <= MEMO_PIECE_CHARS for p in (*parts, *more)), bool, len(made))
            at, count = self.memo.write(made, *(np.concatenate([h[new], e]) for h, e in zip((key, check), extra, strict=True)), short)
            first[new], n[new] = at[:len(new)], count[:len(new)]
        return first, n

    def _made(self, parts: list[str]) -> tuple[list[bytes], list[str]]:
        """Ids of new pieces and of some more, and these.

        Letters that end in ASCII punctuation are two pre-tokens, so such a piece is put together
        from the ids of its word and its marks.
        """
        marked = {}
        for p in parts:
            word = p.rstrip(string.punctuation)
            if len(word) < len(p) and (word[1:] if word[:1] == " " else word).isalpha():
                marked[p] = (word, p[len(word):])
        halves = list({x for pair in marked.values() for x in pair}.difference(parts))
        known, first, n = self.memo.find(*hashes(pa.array(halves, pa.large_string())))
        found = {halves[i]: self.memo.ids[first[i]:first[i] + n[i]].tobytes() for i in np.flatnonzero(known).tolist()}
        more = [p for p in halves if p not in found]
        rest = [p for p in (*parts, *more) if p not in marked]
        found.update(zip(rest, self._encode(rest), strict=True))
        found.update([(p, found[word] + found[marks]) for p, (word, marks) in marked.items()])
        return [found[p] for p in (*parts, *more)], more


_ENCODERS: dict[str, LibraryEncoder] = {}


def encoder(path: str) -> LibraryEncoder:
    """The encoder of this Python worker for a vocabulary file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = LibraryEncoder(path)
    return _ENCODERS[path]


def vocabulary_path() -> str:
    """Default vocabulary file (a parameter everywhere it is used)."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")
