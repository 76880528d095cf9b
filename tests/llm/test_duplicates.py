"""Near copies, repeated bytes, fingerprints and embeddings against brute force."""

import hashlib
import math
import random
import re
from collections import Counter

import corpus_pipeline
import numpy as np
import pytest
from pyspark.sql import functions as F

from octavilla.llm import embeddings, fingerprints, near_copies, suffixes


# ---- near copies ------------------------------------------------------------------------------


def brute_classes(rows, threshold=0.8):
    """Class per row by comparing all pairs of different texts."""
    texts = sorted({t or "" for _, t in rows})
    df = np.zeros(1 << near_copies.SLOT_BITS)
    for _, t in rows:
        df[np.unique((near_copies.word_hashes(t or "") >> np.uint64(64 - near_copies.SLOT_BITS)).astype(int))] += 1
    idf = (np.log((1 + len(rows)) / (1 + df)) + 1).astype(np.float32)
    sets = [near_copies.shingles(t, idf) for t in texts]
    own = list(range(len(texts)))

    def root(i):
        while own[i] != i:
            i = own[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if near_copies.similarity(sets[i], sets[j]) >= threshold:
                own[root(i)] = root(j)
    by_id = {}
    for d, t in rows:  # rows with one id are one node
        if d is not None:
            k = texts.index(t or "")
            if d in by_id:
                own[root(k)] = root(by_id[d])
            by_id[d] = k
    least = {}
    for d, t in rows:
        r = root(texts.index(t or ""))
        if d is not None:
            least[r] = min(least.get(r, d), d)
    return sorted((str(d), str(least.get(root(texts.index(t or ""))))) for d, t in rows)


def test_similarity_and_samples():
    idf = np.ones(1 << near_copies.SLOT_BITS, np.float32)
    a, b = near_copies.shingles("a b c d e f g h", idf), near_copies.shingles("A, b c d e f g x", idf)
    assert len(a[0]) == 4 and near_copies.similarity(a, b) == 3 / 5
    assert len(near_copies.shingles("one two", idf)[0]) == 1 and not len(near_copies.shingles(" . ", idf)[0])
    twice = near_copies.shingles("a b c d e a b c d e", idf)
    assert Counter(twice[1].tolist()) == {1.0: 4, 2.0: 1}
    rng = np.random.default_rng(1)
    agree = []
    for _ in range(150):
        ids = np.sort(rng.integers(1, 2**63, 300, dtype=np.uint64))
        w, other = rng.uniform(1, 9, 300).astype(np.float32), rng.uniform(1, 9, 300).astype(np.float32)
        other[50:] = w[50:]
        agree.append((near_copies.samples(ids, w) == near_copies.samples(ids, other)).mean()
                     - np.minimum(w, other).sum() / np.maximum(w, other).sum())
    assert abs(np.mean(agree)) < 0.01


def test_near_copies(spark, docs, none):
    got = near_copies.near_copy_classes(docs).collect()
    expected = brute_classes([(r.doc_id, r.text) for r in docs.collect()])
    assert sorted((str(r.doc_id), str(r.class_id)) for r in got) == expected
    kept = near_copies.keep_one(spark, docs, "")
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    classes = {r.class_id for r in got if r.class_id is not None}
    assert sorted(i for i in ids if i is not None) == sorted(classes) and ids.count(None) == 2
    assert near_copies.near_copy_classes(none).count() == 0


def test_near_copies_that_the_first_of_a_bucket_does_not_link(spark):
    """A chain of edits: members near each other but far from the smallest one."""
    rnd = random.Random(8)
    words = [f"w{k}" for k in rnd.choices(range(10_000), k=260)]
    rows = []
    for step in range(14):
        text = list(words)
        for k in range(step * 3):
            text[(k * 17) % len(text)] = f"new{k}"
        rows.append((step, " ".join(text)))
    rows += [(100 + i, rows[i % 14][1]) for i in range(60)]  # copies of a few texts
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = near_copies.near_copy_classes(frame).collect()
    assert sorted((str(r.doc_id), str(r.class_id)) for r in got) == brute_classes(rows)


# ---- repeated bytes ---------------------------------------------------------------------------


def brute_repeats(texts):
    seen = Counter()
    data = [(t or "").encode() for t in texts]
    for b in data:
        seen.update(b[i:i + suffixes.LENGTH] for i in range(len(b) - suffixes.LENGTH + 1))
    out = []
    for b in data:
        gone = np.zeros(len(b) + 1, int)
        for i in range(len(b) - suffixes.LENGTH + 1):
            if seen[b[i:i + suffixes.LENGTH]] > 1:
                gone[i] += 1
                gone[i + suffixes.LENGTH if i + suffixes.LENGTH <= len(b) else len(b)] -= 1
        mask = np.cumsum(gone)[:-1] > 0 if len(b) else np.zeros(0, bool)
        runs = int((np.diff(np.append(0, mask.astype(int))) == 1).sum())
        out.append((len(b), int(mask.sum()), runs, bytes(np.frombuffer(b, np.uint8)[~mask])))
    return out


@pytest.fixture
def passages():
    rnd = random.Random(6)
    words = ["".join(rnd.choices("abcdeé ", k=rnd.randint(1, 9))) for _ in range(300)]
    prose = lambda n: " ".join(rnd.choices(words, k=n))
    long, other, short = prose(120), prose(90), prose(60)[:399]
    out = [prose(150) for _ in range(10)]
    out += [prose(20) + long + prose(rnd.randint(0, 40)) for _ in range(12)]
    out += [long[rnd.randint(0, 60):] + prose(9) + other + long[: rnd.randint(300, 600)] for _ in range(8)]
    out += [prose(30) + short + prose(30) for _ in range(6)] + [out[3], out[3], out[12]]
    out += ["ab" * 700, "x" * 401, "x" * 400, "x" * 399, "y" * 402, "", None, "é" * 300, "ß" * 199 + "é" * 100]
    out += [long + long, out[1][:450], other[:400], other[:399]]
    return out


@pytest.mark.parametrize("small", [False, True])
def test_repeats(spark, passages, small, monkeypatch):
    if small:  # long texts in parts, and everything that can go to disk does
        monkeypatch.setattr(suffixes, "SCAN", 1200)
        for name, value in (("RUN", 5), ("CHUNK", 7), ("HELD", 3)):
            monkeypatch.setattr(suffixes, name, value)
        own = _in_one_process(passages)
        assert own == [r[:3] for r in brute_repeats(passages)]
        return
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(passages)], "doc_id long, text string").repartition(4)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in suffixes.without_repeats(frame).collect()}
    for i, expected in enumerate(brute_repeats(passages)):
        assert got[i] == expected, (i, passages[i])


def _in_one_process(texts):
    """The same steps without Spark: tuples, then one shard of all."""
    data = [(t or "").encode() for t in texts]
    shard, rows = suffixes.Shard(), []
    for k, b in enumerate(data):
        for base in range(0, max(len(b) - suffixes.LENGTH + 1, 0), suffixes.SCAN // 2):
            part = b[base:base + suffixes.SCAN // 2 + suffixes.LENGTH - 1]
            _, _, _, lo, n, ahead = suffixes._sampled(np.frombuffer(part, np.uint8), np.array([0]), np.array([len(part)]))
            for a, w, d in zip(lo.tolist(), n.tolist(), ahead.tolist()):
                rows.append((k, base + a))
                shard.add(part[a:a + w + suffixes.LENGTH - 1], d, w)
    spans = {}
    for i, windows in shard.repeated():
        k, lo = rows[i]
        spans.setdefault(k, []).extend((lo + int(w), lo + int(w) + suffixes.LENGTH) for w in windows)
    out = []
    for k, b in enumerate(data):
        runs = suffixes.merged(spans.get(k, ()))
        out.append((len(b), sum(z - a for a, z in runs), len(runs)))
    return out


def test_repeats_odd_rows(spark, docs, none):
    rows = docs.collect()
    out = suffixes.without_repeats(docs)
    assert {*out.columns} == {*docs.columns, "n_bytes", "n_removed", "n_spans", "kept"}
    expected = Counter((r.doc_id, *b) for r, b in zip(rows, brute_repeats([r.text for r in rows])))
    assert Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in out.collect()) == expected
    assert suffixes.without_repeats(none).count() == 0
    left = suffixes.remove_repeats(spark, docs, "")
    assert left.columns == docs.columns
    kept = Counter((r.doc_id, r.text, r.part, r.kept) for r in left.collect())
    assert kept == Counter((r.doc_id, b[3].decode("utf-8", "ignore") if b[1] else r.text, -1, 7)
                           for r, b in zip(rows, brute_repeats([r.text for r in rows])))


def brute_passages(texts):
    """What is left without repeated strings of LENGTH bytes and repeated runs of WORDS words."""
    size, data = suffixes.WORDS, [(t or "").encode() for t in texts]
    words = [[(m.group(), m.start(), m.end()) for m in re.finditer(rb"[^\x20\x09-\x0D]+", b)] for b in data]
    runs = [[tuple(x[0] for x in w[k:k + size]) for k in range(len(w) - size + 1)] for w in words]
    seen = Counter(r for some in runs for r in some)
    strings = Counter(b[i:i + suffixes.LENGTH] for b in data for i in range(len(b) - suffixes.LENGTH + 1))
    out = []
    for b, w, mine in zip(data, words, runs):
        gone = np.zeros(len(b), bool)
        for k, run in enumerate(mine):
            if seen[run] > 1:
                gone[w[k][1]:w[k + size - 1][2]] = True
        for i in range(len(b) - suffixes.LENGTH + 1):
            if strings[b[i:i + suffixes.LENGTH]] > 1:
                gone[i:i + suffixes.LENGTH] = True
        out.append(bytes(np.frombuffer(b, np.uint8)[~gone]).decode("utf-8", "ignore"))
    return out


@pytest.fixture
def short_passages():
    rnd = random.Random(8)
    words = ["".join(rnd.choices("abcdeé", k=rnd.randint(1, 6))) for _ in range(900)]
    prose = lambda n: [rnd.choice(words) for _ in range(n)]
    planted, other, fifty = prose(56), prose(70), prose(50)
    out = [" ".join(prose(20) + planted + prose(rnd.randint(0, 40))) for _ in range(9)]
    out += [" ".join(prose(7) + planted[rnd.randint(0, 9):] + prose(5) + other[:rnd.randint(49, 60)]) for _ in range(9)]
    out += ["\n ".join(prose(3) + planted) + "\t", " ".join(planted), " ".join(prose(9) + planted[:51])]
    out += [" ".join(prose(15) + fifty + prose(15)) for _ in range(4)] + [" ".join(prose(120)) for _ in range(5)]
    out += [" ".join(other[:30] + prose(1) + other[30:]), " ".join(prose(3) + other), out[0], "ab " * 52, "cd " * 51]
    return out + ["x" * 401, "x" * 400, "", None, "é" * 300, " \n", " ".join(prose(400) + planted + prose(400))]


def test_short_passages(spark, short_passages):
    planted = short_passages[19]
    assert len(planted.encode()) < suffixes.LENGTH and len(planted.split()) > 50
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(short_passages)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(4)
    out = corpus_pipeline.repeated_passages(spark, docs, "").collect()
    got = {r.doc_id: (r.text or "", r.n_chars or 0) for r in out}
    assert len(out) == len(rows)
    for i, expected in enumerate(brute_passages(short_passages)):
        assert got[i] == (expected, len(expected)), (i, short_passages[i])


def test_parts_of_words(short_passages, monkeypatch):
    whole = [np.concatenate([np.zeros(0, np.uint64), *suffixes._word_hashes((t or "").encode())]) for t in short_passages]
    monkeypatch.setattr(suffixes, "SCAN", 100)
    for t, words in zip(short_passages, whole):
        places = []
        for base, part in suffixes._word_parts((t or "").encode()):
            assert (part == words[base:base + len(part)]).all()
            places += range(base, base + len(part) - suffixes.WORDS + 1)
        assert places == [*range(len(words) - suffixes.WORDS + 1)]


@pytest.mark.parametrize("many", [1, 3])
def test_kinds_with_many_copies(spark, passages, short_passages, many, monkeypatch):
    monkeypatch.setattr(suffixes, "MANY", many)
    texts = passages[:25] + short_passages
    docs = spark.createDataFrame([*enumerate(texts)], "doc_id long, text string").repartition(3)
    left = {r.doc_id: r.text or "" for r in suffixes.remove_repeats(spark, docs, "", passages=True).collect()}
    assert [left[i] for i in range(len(texts))] == brute_passages(texts)


# ---- fingerprints -----------------------------------------------------------------------------


def signature_by_hand(words, hashed):
    """Order MinHash of a word list, given Spark's hash as a function."""
    mask = (1 << 64) - (1 << 24)
    high = lambda h: (h & mask) - (1 << 64 if h & (1 << 63) else 0)
    n = max(len(words) - 4, 1) if words else 0
    seen, entries = Counter(), []
    for i in range(n):
        kmer = high(hashed(*[hashed(w) for w in words[i:i + 5]]) % (1 << 64))
        u = high(hashed(kmer, seen[kmer]) % (1 << 64))
        seen[kmer] += 1
        entries.append((u, i))
    out = {}
    for b in range(64):
        mine = sorted(e for e in entries if (e[0] % (1 << 64)) >> 58 == b)[:2]
        if mine:
            h = hashed(*[u for u, _ in sorted(mine, key=lambda e: e[1])]) % (1 << 64)
            out[b] = (b << 24) | (h >> 40)
    return set(out.values())


def test_order_minhash_by_hand(spark):
    rnd = random.Random(2)
    texts = ["", " ", "one", "a b c d", "a b c d e f", "la la la la la la la la la la la", " ".join(rnd.choices("abcdefgh", k=300)),
             " ".join(f"w{k}" for k in range(200))]
    frame = spark.createDataFrame([(t,) for t in texts], "text string")
    got = {r.text: set(r.m) for r in frame.select("text", fingerprints.order_minhash(F.col("text")).alias("m")).collect()}
    cache = {}

    def hashed(*values):
        if values not in cache:
            types = ["string" if isinstance(v, str) else "int" if k and len(values) == 2 and -1 < v < 1000 else "long"
                     for k, v in enumerate(values)]
            row = spark.createDataFrame([values], ", ".join(f"c{k} {t}" for k, t in enumerate(types)))
            cache[values] = row.select(F.xxhash64(*row.columns)).first()[0]
        return cache[values]

    for t in texts[:6]:
        assert got[t] == signature_by_hand(t.split(), hashed), t
    assert got[texts[6]] and len(got[texts[7]]) > 55


def test_order_matters(spark):
    words = [f"w{k}" for k in range(400)]
    swapped = words[200:] + words[:200]
    edited = words[:100] + ["x"] + words[100:]
    frame = spark.createDataFrame([(" ".join(words), " ".join(swapped), " ".join(edited))], "a string, b string, c string")
    m = {c: fingerprints.order_minhash(F.col(c)) for c in "abc"}
    r = frame.select(fingerprints.likeness(m["a"], m["b"]).alias("moved"), fingerprints.likeness(m["a"], m["c"]).alias("edited"),
                     fingerprints.likeness(m["a"], m["a"]).alias("same")).first()
    assert r.same == 1 and r.edited > 0.85 and r.moved < 0.75


@pytest.mark.parametrize("per_bucket", [3, 20, 100_000])
def test_next_row(spark, per_bucket):
    rnd = random.Random(1)
    ids = rnd.sample(range(-500, 100_000), 90) + [7, 7, None, None] + list(range(10**9, 10**9 + 60))
    rows = [(i, k) for k, i in enumerate(ids)]
    frame = spark.createDataFrame(rows, "id long, v int").repartition(5)
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1]))
    expected = {a[1]: b[1] for a, b in zip(order, order[1:] + order[:1])}
    got = fingerprints.with_next(frame, "id", "v", ["v"], per_bucket)
    assert {r.v: r.next_v for r in got.collect()} == expected
    one = spark.createDataFrame([(None, 5)], "id long, v int")
    assert [r.next_v for r in fingerprints.with_next(one, "id", "v", ["v"]).collect()] == [5]


def test_fingerprint_edits(spark, docs, none):
    out = fingerprints.fingerprint_edits(docs)
    plan = out._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan
    rows = out.collect()
    tie = {r.text or "": r.h for r in docs.select("text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("h")).collect()}
    order = sorted(((r.doc_id, r.text or "") for r in docs.collect()), key=lambda r: (r[0] is None, -(r[0] or 0), tie[r[1]]))
    expected = Counter()
    for (i, t), (_, u) in zip(order, order[1:] + order[:1]):
        half = len(t) // 2
        expected[(i, len(t), hashlib.sha256((t[: len(t) - half] + u[:half]).encode()).hexdigest())] += 1
    assert Counter((r.doc_id, r.n_chars, r.edited_sha256) for r in rows) == expected
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in rows)
    by_id = {}
    for r in rows:
        assert by_id.setdefault(r.doc_id, r.fingerprint) == r.fingerprint or r.doc_id is None
    assert fingerprints.fingerprint_edits(none).count() == 0


# ---- embeddings -------------------------------------------------------------------------------


@pytest.mark.parametrize("dims", [3, 16, 64])
def test_embeddings(spark, dims, monkeypatch):
    monkeypatch.setattr(embeddings, "TILE", 16)  # a crowded cell is many tiles
    rng = np.random.default_rng(dims)
    rows = [(i, [float(np.float32(v)) for v in rng.normal(size=dims)], int(i % 3)) for i in range(120)]
    for k in range(120):
        near = np.array(rows[k % 20][1]) + rng.normal(scale=0.25 / math.sqrt(dims), size=dims) * (k % 7)
        rows.append((200 + k, [float(np.float32(v)) for v in near], rows[k % 20][2]))
    rows += [(400 + k, rows[k % 2][1], rows[k % 2][2]) for k in range(40)] + [(500, [2 * v for v in rows[0][1]], rows[0][2])]
    odd = [(600, None, 1), (601, [0.0] * dims, 1), (602, [None] + [1.0] * (dims - 1), 1), (603, [math.nan] * dims, 1),
           (604, [math.inf] + [1.0] * (dims - 1), 1), (605, rows[0][1], None), (606, [], 1), (607, [1.0] * (dims + 2), 1),
           (None, rows[0][1], rows[0][2])]
    frame = spark.createDataFrame([(*r, 1, 2) for r in rows + odd], "vec_id long, embedding array<float>, label int, n int, rep long").repartition(4)
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embeddings.near_copies(frame).collect()}
    x = np.array([r[1] for r in rows])
    n = np.linalg.norm(x, axis=1)
    label = np.array([r[2] for r in rows])
    linked = ((x @ x.T) / np.outer(n, n) >= embeddings.THRESHOLD) & (label[:, None] == label[None, :])
    np.fill_diagonal(linked, False)
    ids = np.array([r[0] for r in rows])
    component = ids.copy()
    while True:
        new = np.array([min([component[i], *component[linked[i]]]) for i in range(len(ids))])
        if (new == component).all():
            break
        component = new
    assert linked.sum() > 100
    for i, k in enumerate(ids):
        assert got[k] == (linked[i].sum(), component[i], component[i] == k)
    for r in odd:
        assert got[r[0]] == (0, r[0], True)
    assert embeddings.near_copies(frame.limit(0)).count() == 0


def test_pigeonhole_misses_no_pair(spark):
    """Pairs just inside and just outside the threshold."""
    rng = np.random.default_rng(9)
    rows = []
    for k in range(150):
        a = rng.normal(size=64)
        a /= np.linalg.norm(a)
        b = rng.normal(size=64)
        b -= (b @ a) * a
        b /= np.linalg.norm(b)
        c = 0.93 + (1e-4 if k % 2 else -1e-4)
        rows += [(2 * k, a.tolist(), 1), (2 * k + 1, (c * a + math.sqrt(1 - c * c) * b).tolist(), 1)]
    got = {r.vec_id: r.n_links for r in embeddings.near_copies(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    assert all(got[2 * k] == got[2 * k + 1] == k % 2 for k in range(150))
