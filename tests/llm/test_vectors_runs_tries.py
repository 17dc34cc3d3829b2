"""Embedding near-dedup, periodic runs and the conversation trie against brute force."""

import hashlib
import random
import zlib
from collections import defaultdict
from fractions import Fraction

import duckdb
import numpy as np
import pytest

from stormgrid.llm import periodic_runs, pivot_index, prefix_trie, queries
from stormgrid.llm.common import prepare


def sha(b):
    return hashlib.sha256(b).hexdigest()


# ------------------------------------------------------------------ vectors

def vectors(rng, label, near, n, noise):
    """Vectors around ``near`` others, some of them equal."""
    centres = rng.normal(size=(near, 16))
    out = [(label, (centres[rng.integers(near)] + noise * rng.normal(size=16)).tolist()) for _ in range(n)]
    return out + [(label, list(out[k][1])) for k in range(0, n, 9)]


def linked(rows):
    """n_links and component of each row, by all pairs."""
    part = []
    for k, (i, label, v) in enumerate(rows):
        if i is not None and label is not None and v and None not in v and all(np.isfinite(v)) and any(v):
            x = np.array(v, np.float64)
            part.append((k, label, x / np.abs(x).max() / np.linalg.norm(x / np.abs(x).max())))
    links = defaultdict(set)
    for a, la, x in part:
        for b, lb, y in part:
            if a != b and la == lb and len(x) == len(y) and x @ y >= 0.98:
                links[a].add(b)
    out = []
    for k, (i, _, _) in enumerate(rows):
        seen, todo = {k}, [k]
        while todo:
            for o in links[todo.pop()] - seen:
                seen.add(o)
                todo.append(o)
        least = None if i is None else min(rows[o][0] for o in seen)
        out.append((i, len(links[k]), least, i is not None and i == least))
    return out


def found(df):
    return sorted(map(tuple, df.select("vec_id", "n_links", "component_id", "kept").collect()), key=repr)


@pytest.mark.parametrize("block", [1024, 16])
def test_embedding_dedup(spark, monkeypatch, block):
    prepare(spark)
    monkeypatch.setattr(pivot_index, "BLOCK", block)  # 16: lists of many blocks
    rng = np.random.default_rng(5)
    data = vectors(rng, 1, 3, 150, 0.05) + vectors(rng, 2, 40, 120, 0.09) + vectors(rng, 3, 200, 60, 0.02)
    odd = [(1, None), (1, []), (1, [0.0] * 16), (1, [float("nan")] * 16), (1, [1.0, None] * 8), (1, [float("inf")] * 16), (None, data[0][1]),
           (1, data[0][1][:8]), (1, data[0][1][:8]), (1, (3 * np.array(data[0][1])).tolist()), (2, [1e300] * 16), (2, [1e-300] * 16)]
    rows = [(i, label, v) for i, (label, v) in enumerate(data + odd)]
    rows += [rows[0], (7, 2, rows[40][2]), (None, 1, rows[0][2])]
    random.Random(1).shuffle(rows)
    frame = spark.createDataFrame([(i, label, v, 0, "x", 1.0) for i, label, v in rows],
                                  "vec_id long, label int, embedding array<double>, rep long, pivot string, c double").repartition(3)
    want = sorted(linked(rows), key=repr)
    assert found(pivot_index.near_vectors(frame)) == want
    assert sum(w[1] for w in want) > 1000
    assert found(pivot_index.near_vectors(frame.limit(0))) == []


def test_pivot_lists():
    rng = np.random.default_rng(2)
    pivots = pivot_index._apart(pivot_index.unit(rng.normal(size=(60, 8))), 40)
    assert len(pivots) == 40 and (pivots @ pivots.T - np.eye(40)).max() < pivot_index.APART
    units = pivot_index.unit(rng.normal(size=(30, 8)))
    got = pivot_index.permutation_prefixes(units, pivots)
    assert got.tolist() == [sorted(range(40), key=lambda p: (-(pivots[p] @ u), p))[:pivot_index.PREFIX] for u in units]
    assert pivot_index.shared_pivots(got, got).tolist() == [[len(set(a) & set(b)) for b in got.tolist()] for a in got.tolist()]


def test_recall_on_whole_table(spark):
    """The registered query finds every link of the given table."""
    df = queries.op11_embedding_dedup(spark, "/root/testdata/sf0.01")
    assert df.dtypes == [("vec_id", "bigint"), ("n_links", "bigint"), ("component_id", "bigint"), ("kept", "boolean")]
    con = duckdb.connect()
    con.execute("create view embeddings as select * from '/root/testdata/sf0.01/embeddings.parquet'")
    assert found(df) == sorted(con.execute(f"select vec_id, n_links, component_id, kept from ({queries.ORACLE['op11_embedding_dedup']})").fetchall(), key=repr)


# ------------------------------------------------------------------ runs

def runs_of(x):
    """All runs by their definition: every period, every stretch."""
    out = set()
    for q in range(1, len(x) // 4 + 1):
        t = 0
        while t + q < len(x):
            s = t
            while t + q < len(x) and x[t] == x[t + q]:
                t += 1
            length = t + q - s
            if length >= max(6, 4 * q) and not any(x[s + r:s + length] == x[s:s + length - r] for r in range(1, q)):
                out.add((s, length, q))
            t += 1
    return sorted(out)


def digest_row(i, text):
    words = (text or "").encode().split()
    h = zlib.crc32(str(i).encode()) if i is not None else 1
    if h % 10 == 0 and words:
        g, n = h // 10, len(words)
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[k] if k < a else words[a + (k - a) % p] for k in range(n)]
    runs = runs_of(words)
    gone = {k for s, length, q in runs for k in range(s + q, s + length)}
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=(None, None, None))
    return (i, len(runs), *best, None if best[0] is None else 1000 * best[1] // best[2], sha("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()),
            sha(b" ".join(w for k, w in enumerate(words) if k not in gone)))


RUN_COLUMNS = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]


def test_find_runs():
    rng, texts = random.Random(4), []
    for _ in range(1500):
        x = [rng.randrange(rng.choice([1, 2, 3, 9])) for _ in range(rng.randint(0, 50))]
        if x and rng.random() < 0.7:
            s, p = rng.randrange(len(x)), rng.randint(1, 11)
            x = x[:s] + (x[s:s + p] * 60)[:rng.randint(1, 70)] + x[s:]
        texts.append(x)
    flat = np.array([w for x in texts for w in x], np.int64)
    got = periodic_runs.find_runs(flat, [len(x) for x in texts])
    assert got == [runs_of(x) for x in texts] and sum(map(len, got)) > 800


def test_periodic_runs(spark, monkeypatch):
    prepare(spark)
    monkeypatch.setattr(periodic_runs, "CHUNK_WORDS", 500)
    rng = random.Random(9)
    text = lambda n, v: " ".join(rng.choice("aàbcde") * rng.randint(1, v) for _ in range(n))
    data = [(i, text(rng.randint(0, 90), rng.choice([1, 3]))) for i in range(120)]
    plain = next(i for i in range(207, 300) if zlib.crc32(str(i).encode()) % 10)
    data += [(200, None), (201, ""), (202, " \n\t\x0b "), (203, "the " * 5), (204, "the " * 6), (205, "a b\xa0c　d " * 4), (206, "a\x1cb c " * 9), (None, "x y " * 8),
             (plain, "p q r " * 30000), (plain, "p q r " * 4), (plain, "p q r " * 4), (-11, "m n " * 20), (-11, None)]
    frame = spark.createDataFrame([(i, t, 1, 2, "r", 0) for i, t in data], "doc_id long, text string, start long, length long, runs string, n long").repartition(3)
    rows = lambda df: sorted(map(tuple, df.select(*RUN_COLUMNS).collect()), key=repr)
    got = rows(periodic_runs.run_digests(periodic_runs.periodic_runs(frame, plant=True)))
    long = (plain, 1, 0, 90000, 3, 30_000_000, sha(b"0,90000,3\n"), sha(b"p q r"))
    assert long in got
    got.remove(long)
    assert got == sorted((digest_row(i, t) for i, t in data if len(t or "") < 100_000), key=repr)
    assert sum(zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in data) > 5
    assert periodic_runs.run_digests(periodic_runs.periodic_runs(frame.limit(0))).count() == 0


def test_periodic_runs_over_a_mebibyte(spark):
    """A text of several MiB is worked on whole."""
    prepare(spark)
    words = [b"w%d" % i for i in range(200_000)]
    text = b" ".join(words + words[:50_000] * 4).decode()
    frame = spark.createDataFrame([(3, text)], "doc_id long, text string")
    row = periodic_runs.periodic_runs(frame).first()
    assert (row.starts, row.lengths, row.periods) == ([200_000], [200_000], [50_000])
    assert bytes(row.collapsed) == b" ".join(words + words[:50_000])


def test_periodic_runs_query(spark):
    """The registered query on the smallest table, all columns, by brute force on its shorter texts."""
    df = queries.op12_periodic_runs(spark, "/root/testdata/sf0.001")
    assert df.dtypes == [(c, "string" if "sha" in c else "bigint") for c in RUN_COLUMNS]
    got = {r.doc_id: tuple(r) for r in df.collect()}
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    assert len(got) == len(docs)
    short = [r for r in docs if len(r.text or "") < 6000]
    assert len(short) > 100 and all(got[r.doc_id] == digest_row(r.doc_id, r.text) for r in short)
    assert sum(r[1] for r in got.values()) > 0


# ------------------------------------------------------------------ trie

def nodes_of(turns, rebuild=True):
    """The trie by holding every prefix of every conversation."""
    order = lambda t: (t[1] is not None, t[1] or 0, (t[2] or "")[:64], (t[3] or "")[:64].encode(), sha(((t[2] or "") + "\0" + (t[3] or "")).encode()))
    own = defaultdict(list)
    for t in sorted((t for t in turns if t[0] is not None), key=order):
        own[t[0]].append((t[2] or "", t[3] or ""))
    built = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 6 if rebuild else 0
        base = c - (abs(c) % 100 if c >= 0 else -(abs(c) % 100))
        built[c] = tuple(own.get(base, [])[:h] + own[c][h:])
    members = defaultdict(list)
    for c, seq in built.items():
        for d in range(len(seq) + 1):
            members[seq[:d]].append(c)
    kids, leaves, saved = defaultdict(int), defaultdict(int), defaultdict(int)
    for p in members:
        if p:
            kids[p[:-1]] += 1
    for p, m in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += kids[p] == 0
            saved[p[:d]] += (len(m) - 1) * len(p[-1][1]) if p else 0
    return sorted((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), kids[p], leaves[p], saved[p],
                   sha(",".join(str(c) for c in sorted(m) if built[c] == p).encode())) for p, m in members.items())


NODE_COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def talks(rng):
    out = []
    for c in list(range(0, 260, 3)) + [100, 200, -5, -101, 7000, 7001]:
        for turn in range(rng.randint(1, 9)):
            out.append((c, turn, rng.choice(["user", "assistant", None]), rng.choice(["hi", "hé 漢", "", None, "x" * 90, "y" * rng.randint(1, 3)])))
    long = [("user", f"turn {k % 7}") for k in range(150)]
    for c, n in ((301, 150), (302, 150), (303, 90), (304, 149)):
        out += [(c, k, *t) for k, t in enumerate(long[:n])]
    out += [(305, None, "a", "b"), (305, None, "a", "b"), (305, 0, "c", "d"), (None, 0, "user", "hi"), (305, 0, "c", "x" * 70 + "b"), (305, 0, "c", "x" * 70 + "a")]
    return out + [out[5], out[5]]


@pytest.mark.parametrize("rebuild", [True, False])
def test_prefix_trie(spark, monkeypatch, rebuild):
    prepare(spark)
    monkeypatch.setattr(prefix_trie, "BUCKET", 16)
    monkeypatch.setattr(prefix_trie, "PIECE", 3)
    data = talks(random.Random(6))
    frame = spark.createDataFrame([(*t, 1, "z", 5) for t in data], "conv_id long, turn long, role string, text string, d long, chunk string, n long").repartition(4)
    got = sorted(map(tuple, prefix_trie.prefix_trie(frame, rebuild=rebuild).select(*NODE_COLUMNS).collect()), key=repr)
    assert got == sorted(nodes_of(data, rebuild), key=repr)
    assert prefix_trie.prefix_trie(frame.limit(0), rebuild=rebuild).count() == 0


def test_prefix_trie_of_a_full_sketch(spark, monkeypatch):
    """A sketch in which most cells collide proves little; the result is the same."""
    prepare(spark)
    for name in ("LEAST_CELLS", "MOST_CELLS", "BLOCK_CELLS"):
        monkeypatch.setattr(prefix_trie, name, 64)
    data = talks(random.Random(8))
    frame = spark.createDataFrame(data, "conv_id long, turn long, role string, text string")
    got = prefix_trie.prefix_trie(frame, rebuild=True).select(*NODE_COLUMNS).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(nodes_of(data), key=repr)


def test_conversation_that_crosses_chunks(spark):
    """One conversation holds most rows: it is dealt over several chunks, its prefixes still agree with a copy's."""
    prepare(spark)
    data = [(c, k, "user", f"t{k % 11}") for c in (1, 2) for k in range(700)] + [(3, 0, "user", "t0")]
    turns = prefix_trie._digested(spark.createDataFrame(data, "conv_id long, turn long, role string, text string"), "conv_id", "turn", "role", "text")
    assert turns.filter("conv_id = 1").select("chunk").distinct().count() > 1
    numbered = {(r.conv_id, r.i): (r.q1, r.q2) for r in prefix_trie._numbered(turns).collect()}
    assert all(numbered[1, k] == numbered[2, k] for k in range(1, 701))
    frame = spark.createDataFrame(data, "conv_id long, turn long, role string, text string")
    got = prefix_trie.prefix_trie(frame).select(*NODE_COLUMNS).collect()
    assert len(got) == 701 and sorted(map(tuple, got), key=repr)[:5] == sorted(nodes_of(data, False), key=repr)[:5]


def test_conversation_trie_query(spark):
    df = queries.op13_conversation_trie(spark, "/root/testdata/sf0.001")
    assert df.dtypes == [(c, "string" if "sha" in c else "bigint") for c in NODE_COLUMNS]
    turns = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet").select("conv_id", "turn", "role", "text")
    assert sorted(map(tuple, df.collect()), key=repr) == sorted(nodes_of([tuple(r) for r in turns.collect()]), key=repr)
