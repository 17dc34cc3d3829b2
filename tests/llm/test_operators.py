"""Operators against brute force, on small tables with nulls, empty and long texts, ties and repeats."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
import zstandard

from stormgrid.llm import (bpe, exact_dedup, language, lexicon, near_dedup, packing, quality, recompression, repeats, suffix_array,
                           suffix_dedup, token_ids, token_store, vector_search)
from stormgrid.llm.common import prepare

VOCABULARY = token_ids.vocabulary_path()


@pytest.fixture()
def docs(spark):
    """Documents from (doc_id, text) rows, with columns that clash with internal names."""
    def make(rows):
        rows = [(i, t, "en", "s", 0, 1, "x", 2) for i, t in rows]
        return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, id long, key string, band int").repartition(3)
    return make


@pytest.fixture(autouse=True)
def many_buckets(monkeypatch):
    """Small tables use several buckets, as large ones do."""
    monkeypatch.setattr(repeats, "ROW_BYTES", 1024)


def corpus(seed=3):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 5)))
    vocab = [word() for _ in range(300)]
    text = lambda n: " ".join(rng.choice(vocab) + rng.choice(["", "", ",", ".\n"]) for _ in range(n))
    passage, base = text(60), text(200)
    out = []
    for i in range(60):
        t = text(rng.randint(0, 120))
        if i % 4 == 0:
            t += " " + passage + " " + text(5)
        if i % 5 == 0:
            w = base.split(" ")
            w[rng.randrange(len(w))] = word()
            t = " ".join(w)
        out.append((i, t))
    out += [(100, base), (101, base), (102, ""), (103, None), (104, " \n\t "), (105, "one"), (106, "the the " * 60), (107, "the " * 90),
            (108, text(9000)), (109, "ABC def"), (109, "ABC def"), (110, "<|endoftext|> it's  two\n\n x y\x01z\x1c!"), (111, "漢字かな" * 40), (112, None)]
    rng.shuffle(out)
    return out


def rows_of(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def sha(b):
    return hashlib.sha256(b).hexdigest()


def test_exact_dedup(spark, docs):
    data = corpus()
    groups = defaultdict(list)
    for i, t in data:
        groups[t or ""].append(i)
    want = sorted((i, max(groups[t or ""]), len(groups[t or ""]), i == max(groups[t or ""]), sha((t or "").encode())) for i, t in data)
    got = exact_dedup.exact_dedup(docs(data), hash_all=True)
    assert rows_of(got, "doc_id", "keep_id", "group_size", "kept", "text_sha256") == want
    odd = exact_dedup.exact_dedup(docs([(None, "a"), (1, "a"), (None, "b")]))
    assert sorted((r.doc_id is None, r.keep_id, r.kept) for r in odd.collect() if r.keep_id) == [(False, 1, True), (True, 1, False)]
    assert exact_dedup.exact_dedup(docs([])).count() == 0
    assert exact_dedup.keep_unique(docs(data)).columns == docs([]).columns


def test_word_repeats(spark, docs):
    prepare(spark)
    data, first = corpus(), {}
    split = [(i, (t or "").encode().split()) for i, t in sorted(data, key=lambda r: r[0])]
    for i, w in split:
        for k in range(len(w) - 19):
            first.setdefault(tuple(w[k:k + 20]), (i, k))
    want = []
    for i, w in split:
        gone = set()
        for k in range(len(w) - 19):
            if first[tuple(w[k:k + 20])] < (i, k):
                gone.update(range(k, k + 20))
        want.append((i, len(w), len(gone), b" ".join(x for k, x in enumerate(w) if k not in gone)))
    got = recompression.remove_repeats(docs(data))
    assert sorted((r.doc_id, r.n_words, r.n_removed, bytes(r.kept)) for r in got.collect()) == sorted(want)
    assert sum(w[2] for w in want) > 500
    assert recompression.remove_repeats(docs([])).count() == 0


def test_byte_repeats(spark, docs):
    prepare(spark)
    data, first = corpus(), {}
    raw = [(i, (t or "").encode()) for i, t in sorted(data, key=lambda r: r[0])]
    for i, b in raw:
        for k in range(len(b) - 49):
            first.setdefault(b[k:k + 50], i)
    want = []
    for i, b in raw:
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - 49):
            if first[b[k:k + 50]] < i:
                gone[k:k + 50] = True
        spans = int((np.diff(np.r_[0, gone.astype(int)]) == 1).sum())
        want.append((i, len(b), int(gone.sum()), spans, bytes(x for x, g in zip(b, gone) if not g)))
    got = suffix_dedup.remove_repeats(docs(data))
    assert sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in got.collect()) == sorted(want)
    whole = suffix_dedup.without_repeats(docs(data))
    assert whole.columns == docs([]).columns and whole.count() == len(data)
    assert {r.doc_id for r in whole.filter("text is null").collect()} == {103, 112}
    assert suffix_dedup.remove_repeats(docs([])).count() == 0


@pytest.mark.parametrize("operator", [suffix_dedup, recompression])
def test_hot_marks_are_divided(spark, docs, operator, monkeypatch):
    """With hot marks the results are the same, and no bucket gets all windows of a mark."""
    prepare(spark)
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    passage = " ".join(word() for _ in range(30))
    data = corpus() + [(1000 + i, " ".join([*(word() for _ in range(25)), passage, *(word() for _ in range(25))])) for i in range(60)]
    texts = [t.encode() for i, t in data if i >= 1000]
    always = lambda *x: np.ones(len(x[-1]), bool)
    never = lambda *x: np.zeros(len(x[-1]), bool)
    most = {}
    for hot in (never, always):
        got = defaultdict(int)
        for dest, kind, packed in operator.details(np.arange(60), np.arange(60), texts, always, hot, 1 << 20):
            if kind != 1:
                got[dest] += int(np.frombuffer(zstandard.ZstdDecompressor().decompress(packed), "<i8", 1)[0]) // 8
        most[hot] = max(got.values())
    assert most[never] >= 50 and most[always] < 20
    want = sorted(map(tuple, operator.remove_repeats(docs(data)).collect()), key=str)
    monkeypatch.setattr(repeats, "HOT_DOCUMENTS", 2)
    assert sorted(map(tuple, operator.remove_repeats(docs(data)).collect()), key=str) == want


@pytest.mark.parametrize("letters", [1, 2, 5])
def test_suffix_array(letters):
    rng = random.Random(letters)
    for _ in range(300):
        s = [rng.randint(1, letters) for _ in range(rng.randint(0, 40))] + [0]
        assert suffix_array.lyndon_suffix_array(np.array(s)).tolist() == sorted(range(len(s)), key=lambda i: s[i:])


def test_sketches_never_rule_out_a_link():
    rng = np.random.default_rng(5)
    for n in (1, 9, 100, 3000):
        a = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64) * np.uint64(2))
        for share in (0.0, 0.1, 0.5, 1.0):
            b = np.unique(np.concatenate([a[rng.random(len(a)) >= share], rng.integers(0, 1 << 63, int(n * share)).astype(np.uint64)]))
            apart = sum(int(x & 0xFFFFFFFFFFFFFFFF).bit_count() for x in (near_dedup.sketch(a) ^ near_dedup.sketch(b)).tolist())
            assert apart <= len(np.setxor1d(a, b))


@pytest.mark.parametrize(("words", "rounds"), [(2, 3), (5, 3), (2, 0)])
def test_near_groups(spark, docs, words, rounds, monkeypatch):
    monkeypatch.setattr(near_dedup, "ROUNDS_OF_PARTNERS", rounds)
    prepare(spark)
    data = corpus()
    sets, parent = {}, {}
    for i, t in data:
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[k:k + words]) for k in range(len(w) - words + 1)} if len(w) >= words else ({tuple(w)} if w else set())
        parent[i] = i

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    want = sorted((i, len(sets[i]), root(i), root(i) == i) for i, _ in data)
    got = near_dedup.near_groups(docs(data), words=words)
    assert rows_of(got, "doc_id", "n_shingles", "component_id", "kept") == want
    assert near_dedup.near_groups(docs([])).count() == 0


@pytest.mark.parametrize("most", [near_dedup.PAIRS_A_MEMBER, 0])
def test_near_groups_by_pairs_left(spark, docs, most, monkeypatch):
    """Few pairs across components are looked at without rounds of partners; the groups are the same with them."""
    rounds = []
    partners = near_dedup._partners
    monkeypatch.setattr(near_dedup, "PAIRS_A_MEMBER", most)
    monkeypatch.setattr(near_dedup, "_partners", lambda *a: (rounds.append(1), partners(*a))[1])
    prepare(spark)
    words = [f"w{k}" for k in range(60)]
    near = lambda at: " ".join(words[:at] + [f"x{at}"] + words[at + 1:])
    chain = [" ".join(words[k:k + 44]) for k in range(0, 17, 4)]  # each like the next one only
    data = [(i, t) for i, t in enumerate([*map(near, range(0, 60, 7)), *chain, "all of its own"])]
    sets = {i: set(zip(t.split(), t.split()[1:])) for i, t in data}
    group = {i: i for i, _ in data}
    for _ in data:
        for a in sets:
            for b in sets:
                if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                    group[a] = min(group[a], group[b])
    got = near_dedup.near_groups(docs(data), words=2)
    assert rows_of(got, "doc_id", "component_id") == sorted(group.items())
    assert bool(rounds) == (most == 0)


def test_dedup_stages_judge_rows(spark, docs):
    """Null ids and an id on several texts: a row goes for its own text only."""
    prepare(spark)
    a, b, c, d = (" ".join(f"{x}{k}" for k in range(40)) for x in "abcd")
    exact = exact_dedup.keep_unique(docs([(1, a), (None, a), (2, a), (1, b), (None, c), (None, ""), (3, None)]))
    assert {(r.doc_id, r.text) for r in exact.collect()} == {(2, a), (1, b), (None, c), (3, None)}
    rows = [(5, a), (None, a + " x"), (7, a + " y"), (7, b), (None, c), (None, c + " z"), (9, d), (9, d + " q"), (3, None), (None, "")]
    near = near_dedup.keep_one(docs(rows))
    assert near.columns == docs([]).columns
    got = [(r.doc_id, r.text) for r in near.collect()]
    assert {(5, a), (7, b), (3, None), (None, "")} <= set(got) and len(got) == 6
    assert len({(None, c), (None, c + " z")} & set(got)) == len({(9, d), (9, d + " q")} & set(got)) == 1
    groups = {(r.doc_id, r.component_id, r.n_shingles, r.kept) for r in near_dedup.near_groups(docs(rows[:4])).collect()}
    assert groups == {(5, 5, 36, True), (None, None, 37, True), (7, 5, 37, False), (7, 7, 36, True)}


def test_bpe_round_trip(spark, docs):
    prepare(spark)
    from tokenizers import Tokenizer
    tok, data = Tokenizer.from_file(VOCABULARY), corpus()
    ids = [(i, tok.encode(t or "", add_special_tokens=False).ids) for i, t in data]
    want = sorted((i, len(x), sha(",".join(map(str, x)).encode()), sha(tok.decode(x, skip_special_tokens=False).encode())) for i, x in ids)
    assert rows_of(bpe.round_trip_digest(docs(data), lexicon_words=50), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == want
    encoded = bpe.encode(docs(data), lexicon_words=50)
    assert sorted((r.doc_id, r.ids) for r in encoded.collect()) == sorted(ids)
    assert {r.text for r in bpe.decode(encoded).collect()} == {t or "" for _, t in data}
    assert bpe.round_trip_digest(docs([])).count() == 0


def test_lexicon_is_exact_and_shares_suffixes():
    words = {f"{a}{b}ing".encode(): [i] for i, (a, b) in enumerate((a, b) for a in "xyz" for b in "pqr")}
    lex = lexicon.Lexicon(lexicon.build(words))
    assert all(lex.get(w) == tuple(i) for w, i in words.items())
    assert lex.get(b"xp") is None and lex.get(b"xpinga") is None and lex.get(b"") is None
    assert lex.n_states == 6


def test_token_store(spark, docs, tmpdir_path):
    prepare(spark)
    from tokenizers import Tokenizer
    tok, data = Tokenizer.from_file(VOCABULARY), corpus()
    token_store.write_store(docs(data), f"{tmpdir_path}/store")
    got = {(r.doc_id, r.start): (r.n_tokens, r.ids_crc32) for r in token_store.read_digests(spark, f"{tmpdir_path}/store").collect()}
    start, want = 0, {}
    for i, t in sorted(data, key=lambda r: r[0]):
        x = np.array(tok.encode(t or "", add_special_tokens=False).ids + [2], "<u4")
        want[i, start] = (len(x), zlib.crc32(x.tobytes()))
        start += len(x)
    assert got == want
    assert token_store.read_document(spark, f"{tmpdir_path}/store", 105) == [tok.encode("one").ids + [2]]
    token_store.write_store(docs([]), f"{tmpdir_path}/none")
    assert token_store.read_digests(spark, f"{tmpdir_path}/none").count() == 0


def test_packing(spark, docs):
    prepare(spark)
    from tokenizers import Tokenizer
    tok, data = Tokenizer.from_file(VOCABULARY), corpus()
    pieces, seqs = defaultdict(list), defaultdict(list)
    for r in packing.pack(docs(data), length=256).collect():
        pieces[r.doc_id].append(r)
        seqs[r.sequence_id].append(r)
    for i, t in data:
        x = np.array(tok.encode(t or "", add_special_tokens=False).ids + [0], "<u4")
        own = sorted(pieces[i], key=lambda r: r.start)
        copies = sum(k == i for k, _ in data)
        assert sum(r.length for r in own) == len(x) * copies
        assert all(zlib.crc32(x[r.start:r.start + r.length].tobytes()) == r.ids_crc32 and r.doc_tokens == len(x) for r in own)
    padding = 0
    for s in seqs.values():
        at = 0
        for r in sorted(s, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 256
        padding += 0 if at & (at - 1) == 0 else 256 - at
    assert padding < 0.1 * 256 * len(seqs)
    assert packing.pack(docs([])).count() == 0


def test_best_cuts_are_best():
    rng = random.Random(5)
    for _ in range(60):
        pos = np.array(sorted({0, *(rng.randrange(1, 60) for _ in range(12)), *range(8, 60, 8), 60}))
        cost = np.array([0, *(rng.randrange(5) for _ in pos[1:-1]), 0])
        best = [0] + [10 ** 9] * (len(pos) - 1)
        price = lambda n: packing.EACH_SEQUENCE + (0 if n & (n - 1) == 0 else 16 - n)
        for j in range(1, len(pos)):
            best[j] = min(best[i] + price(pos[j] - pos[i]) + cost[j] for i in range(j) if pos[j] - pos[i] <= 16)
        cuts = packing.best_cuts(pos, cost, 16)
        at = {p: c for p, c in zip(pos.tolist(), cost.tolist())}
        assert sum(price(b - a) + at[b] for a, b in zip(cuts, cuts[1:])) == best[-1]


def test_top_k(spark):
    prepare(spark)
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(size=8).tolist()) for i in range(400)]
    rows += [(400, None), (401, [None] * 8), (402, [float("nan")] * 8), (403, [1.0, 2.0]), (None, [0.0] * 8), (404, rows[3][1]), (405, rows[3][1]), (405, rows[3][1])]
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], "vec_id long, embedding array<double>, score int")
    ints = {i: np.floor(256 * np.array(v)).astype(np.int64) for i, v in rows if i is not None and i not in (400, 401, 402)}
    want = []
    for q in (i for i in ints if i % 50 == 0):
        scored = sorted((-int(v @ ints[q]), i) for i, v in ints.items() if i != q and len(v) == len(ints[q]))[:5]
        want += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scored)]
    assert rows_of(vector_search.top_k(df), "query_id", "rank", "vec_id", "score") == sorted(want)
    assert vector_search.top_k(df.limit(0)).count() == 0


def test_language_and_quality(spark, docs):
    from pyspark.sql import functions as F
    prepare(spark)
    rng = random.Random(1)
    words = {"aa": ["kala", "maki", "tuuli", "jarvi"], "bb": ["strom", "blitz", "schrank", "wolke"], "cc": ["queso", "ciudad", "nino", "llave"]}
    rows = [(i, " ".join(rng.choice(words[x]) for _ in range(rng.randint(3, 40))), x) for i in range(150) for x in [rng.choice("abc") * 2]]
    rows += [(200, None, "aa"), (201, "", None), (202, "123 !!", "bb"), (203, "kala", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.fit(df, F.col("doc_id") % 4 != 2)
    got = {r.doc_id: (r.lang_pred, r.score) for r in language.identify(df, model).collect()}
    assert all(got[i][0] == x for i, t, x in rows[:150]) and got[203][0] == "aa"
    assert all(got[i] == ("und", 0.0) for i in (200, 201, 202)) and all(0 <= s <= 1 for _, s in got.values())
    assert {r.doc_id for r in language.keep_identified(df, model).collect()} == {*range(150), 203}
    assert {r.lang_pred for r in language.identify(df, language.fit(df.limit(0), F.lit(True))).collect()} == {"und"}
    junk = df.select("doc_id", F.when(F.col("doc_id") % 3 == 0, F.regexp_replace("text", " ", "### ")).otherwise(F.col("text")).alias("text"))
    labels = df.select("doc_id", F.when(F.col("doc_id") % 3 == 0, 0).otherwise(1).alias("quality")).filter("doc_id < 150")
    m = quality.fit(junk, labels, F.col("doc_id") % 5 != 0)
    scores = {r.doc_id: r.score for r in quality.score(junk, m).collect()}
    assert np.mean([(scores[i] >= 0.5) == (i % 3 != 0) for i in range(0, 150, 5)]) > 0.9
    assert all(0 <= s <= 1 for s in scores.values()) and len(scores) == len(rows)
    assert {r.score for r in quality.score(junk, quality.fit(junk, labels.limit(0), F.lit(True))).collect()} == {0.5}


def plain_near(rows):
    """Of each group of linked rows, the one of the smallest id (null last, as no id is smaller)."""
    def shingles(t):
        w = [x.lower() for x in t.encode().split()]
        return {tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    sets = [shingles(t) for _, t in rows]
    label = list(range(len(rows)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                x, y = label[i], label[j]
                label = [x if k == y else k for k in label]
    first = {}
    for k, (i, _) in enumerate(rows):
        first.setdefault(label[k], []).append((i is None, i if i is not None else 0, k))
    return [rows[min(g)[2]] for g in first.values()]


def plain_repeats(rows):
    """Texts without the 50-byte strings that also start in a document of a smaller id, whole characters only."""
    order = lambda i: -1 if i is None else i
    first, out = {}, []
    for i, t in sorted(rows, key=lambda r: order(r[0])):
        b = t.encode()
        for k in range(len(b) - 49):
            first.setdefault(b[k:k + 50], order(i))
    for i, t in rows:
        b = t.encode()
        gone = bytearray(len(b) + 1)
        for k in range(len(b) - 49):
            if first[b[k:k + 50]] < order(i):
                gone[k:k + 50] = b"\1" * 50
        inside = lambda k: k < len(b) and b[k] & 0xC0 == 0x80
        k = 0
        while k < len(b):
            if not gone[k]:
                k += 1
                continue
            end = k
            while gone[end]:
                end += 1
            lo, hi = k, end
            while lo < hi and inside(lo):
                gone[lo], lo = 0, lo + 1
            while hi > lo and inside(hi):
                hi -= 1
                gone[hi] = 0
            k = end
        out.append((i, bytes(x for x, g in zip(b, gone) if not g).decode()))
    return out


def test_pipeline(spark, docs):
    """Every stage against a plain version of it, on what its predecessor kept."""
    import corpus_pipeline
    from tokenizers import Tokenizer
    data = [*corpus(), (None, "a text without an id " + "lorem ipsum dolor " * 9)]
    at, plain = docs(data), [(i, t) for i, t in data if t and any(c.isalpha() for c in t)]
    largest = {}
    for i, t in plain:
        largest[t] = max(largest.get(t, -1), -1 if i is None else i)
    unique = [(None if i < 0 else i, t) for t, i in largest.items()]
    near = plain_near(unique)
    steps = [plain, unique, near, plain_repeats(near)]
    assert len(near) < len(unique) < len(plain) and steps[-1] != near
    key = lambda r: (str(r[0]), r[1])
    for (name, stage), want in zip(corpus_pipeline.STAGES, steps):
        at = corpus_pipeline.stored(stage(spark, at, ""), name)
        assert at.columns == docs([]).columns
        assert sorted({(r.doc_id, r.text) for r in at.collect()}, key=key) == sorted(set(want), key=key), name
    tok, found = Tokenizer.from_file(VOCABULARY), defaultdict(list)
    for r in corpus_pipeline.STAGES[-1][1](spark, at, "").collect():
        found[r.doc_id].append((r.start, r.length, r.ids_crc32))
    for i, t in steps[-1]:
        x, end = np.array(tok.encode(t, add_special_tokens=False).ids + [0], "<u4"), 0
        for start, n, crc in sorted(set(found[i])):
            assert start == end and crc == zlib.crc32(x[start:start + n].tobytes())
            end += n
        assert end == len(x)
    assert set(found) == {i for i, _ in steps[-1]}


def test_pipeline_of_an_empty_table(spark, docs):
    import corpus_pipeline
    at = docs([])
    for name, stage in corpus_pipeline.STAGES:
        at = corpus_pipeline.stored(stage(spark, at, ""), name)
    assert at.count() == 0


def test_stage_keeps_letters_without_a_model(spark, docs):
    kept = language.keep_identified(docs([(1, "word"), (None, "é"), (2, "12"), (3, None), (4, "")]), None).collect()
    assert sorted((r.text, r.id) for r in kept) == [("word", 1), ("é", 1)]


def test_votes_and_codewords_as_written(spark):
    """The neighbours' vote and the codewords' decoding, one document and one number at a time."""
    rng = random.Random(4)
    words = {0: ["zap", "qux", "###", "buy"], 1: ["river", "stone", "meadow", "light"]}
    rows = [(i, " ".join(rng.choice(words[rng.random() < (0.8 if i % 2 else 0.3)]) for _ in range(rng.randint(1, 30))), i % 2) for i in range(120)]
    rows += [(None, "river", 1), (500, "", 0), (501, None, 1), (502, "river " * 40_000, 1)]
    df = spark.createDataFrame([(i, t, y, "h") for i, t, y in rows], "doc_id long, text string, quality int, _h string")
    m = quality.fit(df.select("doc_id", "text"), df.select("doc_id", "quality"), df.doc_id % 5 != 0)
    got = [(r.doc_id, r.score) for r in quality.score(df, m).collect()]
    assert len(got) == len(rows)
    got = dict(got)
    for i, t, _ in rows[::7] + rows[-4:]:
        (_, _, x), = quality.terms([t or ""], m.idf)
        q = [float(x[0] @ m.axes[:, k]) for k in range(m.axes.shape[1])]
        size = sum(v * v for v in q) ** 0.5
        cosines = sorted(((sum(a * b for a, b in zip(q, v.tolist())) / max(size, 1e-9), -k) for k, v in enumerate(m.vectors)), reverse=True)[:quality.NEIGHBOURS]
        weights = [(max(c, 0) ** quality.POWER, m.labels[-k]) for c, k in cosines]
        total = sum(w for w, _ in weights)
        assert got[i] == pytest.approx(sum(w * y for w, y in weights) / total if total > 1e-30 else m.share, abs=2e-3), i
    assert quality.score(df.limit(0), m).count() == 0

    names = ["aa", "bb", "cc", "dd", "ee", "ff", "gg"]
    words = {n: [n[0] * 2 + c + n[1] for c in "xyz"] for n in names}
    rows = [(i, " ".join(rng.choice(words[names[i % 7]]) for _ in range(rng.randint(2, 9))), names[i % 7]) for i in range(140)] + [(None, "aaxa", None)]
    df = spark.createDataFrame([(i, t, x, 0.0) for i, t, x in rows], "doc_id long, text string, lang string, score double")
    model = language.fit(df, df.doc_id.isNotNull())
    assert model.languages == names
    got = {r.doc_id: r for r in language.identify(df, model).collect()}
    for i, t, _ in rows[::9] + rows[-1:]:
        (_, _, counts), = language.count_blocks([t.lower().encode()], language.BUCKETS)
        x = language.normal_rows(counts)[0]
        margins = [float(x @ model.weights[:, b]) + float(model.bias[b]) for b in range(model.code.shape[1])]
        loss = [sum(float(w) * float(np.logaddexp(0, -s * f)) for w, s, f in zip(model.trust, code, margins)) for code in model.code.tolist()]
        best = min(range(7), key=lambda k: loss[k])
        assert got[i].lang_pred == names[best]
        assert got[i].score == pytest.approx(1 / sum(np.exp(-model.code.shape[1] * (v - loss[best])) for v in loss), abs=1e-3)
        assert got[i].ambiguous == (sorted(loss)[1] - loss[best] < language.AMBIGUOUS)
    assert language.identify(df.limit(0), model).count() == 0


def test_packing_cuts_everywhere():
    """Documents of a middling length without a sentence's end leave little padding; full-width ends count."""
    ends, rng = np.zeros(10, bool), np.random.default_rng(3)
    for size in (200, 345, 400, 520):
        docs = [np.full(size, 5, "<u4")] * 60
        used = defaultdict(int)
        for _, _, n, s, _ in packing.pack_stretch(docs, ends):
            used[s] += n
        padding = sum(0 if n & (n - 1) == 0 else 1024 - n for n in used.values())
        assert sum(used.values()) == 60 * size and padding < 0.05 * 1024 * len(used), size
    enc, widths = token_ids.encoder(VOCABULARY), packing.byte_widths(VOCABULARY)
    text = "漢字です。次の文！「はい。」 end <|endoftext|>？x"
    ids = np.frombuffer(enc.encode_batch([text])[0], "<u4")
    at = packing.wide_ends(text, ids, widths)
    assert {enc.tok.decode(ids[:k].tolist(), skip_special_tokens=False) for k in at} <= {text[:5], text[:9], text[:14], text[:text.index("？") + 1]}
    assert len(at) >= 3 and len(packing.wide_ends("plain.", ids, widths)) == 0


def test_small_stores_have_a_dictionary(spark, docs, tmpdir_path):
    prepare(spark)
    rows = [(7, "one small text of a few words"), (7, "another text of the same id"), (None, "x")]
    token_store.write_store(docs(rows), f"{tmpdir_path}/small")
    assert len(token_store._dictionary(spark, f"{tmpdir_path}/small")[1]) > 0
    got = token_store.read_digests(spark, f"{tmpdir_path}/small").collect()
    assert sum(r.n_tokens for r in got) == 3 + sum(len(token_ids.encoder(VOCABULARY).tok.encode(t).ids) for _, t in rows)
    data = bytes(range(256)) * 400
    cut = token_store.samples(data)
    assert len(cut) == token_store.SAMPLES and data.startswith(cut[0]) and data.endswith(cut[-1]) and all(len(x) == token_store.SAMPLE_BYTES for x in cut)


@pytest.mark.parametrize("parts", [8, 128])
def test_exchange_rows_follow_the_text(spark, docs, parts, monkeypatch):
    """Packed rows are bounded by the bytes of the texts, whatever the shuffle partitions."""
    prepare(spark)
    rng = random.Random(21)
    text = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(n))
    passage = text(60)
    data = [(i, f"{text(100)} {passage} {text(100)}") for i in range(60)]
    size = sum(len(t) for _, t in data)
    table, got = docs(data), {}
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        n = repeats.buckets_for(repeats.text_bytes(table, "text"))
        assert 1 <= n and n * n <= size / repeats.ROW_BYTES
        for operator in (suffix_dedup, recompression):
            got[operator] = {r.doc_id: r.n_removed for r in operator.remove_repeats(table).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert all(v >= len(passage) for i, v in got[suffix_dedup].items() if i)
    assert all(v == 60 for i, v in got[recompression].items() if i) and got[recompression][0] == got[suffix_dedup][0] == 0


def test_repeats_of_very_long_texts_and_null_ids(spark, docs, monkeypatch):
    """A text of 3 MiB that starts with a hot passage; a null id comes before all others."""
    prepare(spark)
    monkeypatch.setattr(repeats, "HOT_DOCUMENTS", 3)
    rng = random.Random(5)
    text = lambda n: " ".join("".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(n))
    passage = text(40)
    own = text(450_000)
    data = [(5, f"{passage} {own}"), (None, f"{passage} x"), *((10 + i, f"{text(9)} {passage} {text(9)}") for i in range(6)), (99, own[-70_000:])]
    assert len(data[0][1]) > 3 << 20
    found = {r.doc_id: r for r in suffix_dedup.remove_repeats(docs(data)).collect()}
    assert found[None].n_removed == 0 and found[99].n_removed == 70_000 and found[5].n_removed in (len(passage), len(passage) + 1)
    assert all(len(passage) <= found[10 + i].n_removed <= len(passage) + 4 for i in range(6))
    words = {r.doc_id: r.n_removed for r in recompression.remove_repeats(docs(data)).collect()}
    assert words[None] == 0 and words[5] == 40 and all(words[10 + i] == 40 for i in range(6)) and words[99] in (9999, 10000)


def test_encoder_sends_plain_words_to_the_model_once():
    enc = token_ids.LibraryEncoder(VOCABULARY)
    whole, given = enc._encode_all, []
    enc._encode_all = lambda parts: given.extend(parts) or whole(parts)
    texts = ["Nuit calme$$$ über été, mot's 12 ab\n\n  x\x01y", "", "ſtart ɐ ͅ漢字。 <|endoftext|>a", "calme$$$ über", "\nmot \t été,"] * 3
    want = [np.array(e.ids, "<u4").tobytes() for e in enc.tok.encode_batch(texts, add_special_tokens=False)]
    assert enc.encode_batch(texts) == want and [enc.encode_batch([t])[0] for t in texts] == want
    assert "$$$" in given and len(given) == len(set(given)) and not {" calme", "Nuit", " über", " calme$$$", " été,"} & set(given)


def test_cut_points_mark_every_kind_of_cut():
    pos, cost = packing.cut_points(100, np.array([40, 40, 100]), np.array([7, 40, 99]), 1024)
    assert dict(zip(pos.tolist(), cost.tolist())) == {0: 0, 7: packing.SENTENCE_CUT, 39: packing.OTHER_CUT, 40: 0, 72: packing.OTHER_CUT,
                                                      99: packing.SENTENCE_CUT, 100: 0}


def test_encoder_remembers_pieces_in_little_room():
    """Ids stay right while pieces are forgotten and learned again; a remembered piece takes some 50 bytes."""
    enc = token_ids.LibraryEncoder(VOCABULARY)
    enc.memo = token_ids.IdMemo(400)
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdeéü") for _ in range(rng.randint(1, 7))) + rng.choice(["", "", ".", "!!", "$$"])
    for _ in range(8):
        texts = [" ".join(word() for _ in range(60)) + rng.choice(["", "\n\n x", "漢字" * 40, " \x01"]) for _ in range(12)]
        assert enc.encode_batch(texts) == [np.array(e.ids, "<u4").tobytes() for e in enc.tok.encode_batch(texts, add_special_tokens=False)]
    memo = token_ids.IdMemo(10_000)
    names = pa.array([f" piece{i}" for i in range(20_000)], pa.large_string())
    key, check = token_ids.hashes(names)
    assert all(np.array_equal(a[7:], b) for a, b in zip((key, check), token_ids.hashes(names.slice(7))))
    assert len(set(key.tolist())) == len(set(check.tolist())) == 20_000
    memo.write([i.to_bytes(4, "little") for i in range(20_000)], key, check, np.ones(20_000, bool))
    memo.trim()
    known, first, n = memo.find(key, check)
    assert known.sum() == 5000 and (n[known] == 1).all() and (memo.ids[first[known]] == np.flatnonzero(known)).all()
    assert not memo.find(key, check ^ np.uint64(1))[0].any()  # the second hash decides too
    assert sum(x.nbytes for x in (memo.ids, memo.keys, memo.slot, memo.check, memo.first, memo.count, memo.seen)) <= 60 * 5000
