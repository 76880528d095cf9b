"""Test passages in documents against all windows at all places, and the suffix search by itself."""

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from octavilla.llm import contamination
from octavilla.llm.common import table
from octavilla.llm.contamination import Block, decontaminated, op11_benchmark_overlap, overlaps, search, suffix_array

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words_of(text):
    return re.findall("[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+", (text or "").translate(LOWER))


def brute(texts, items, window=10):
    """Per text: (words, hit word numbers, items, longest match of at least a window)."""
    keys = {}
    for item, text in items:
        w = words_of(text)
        for k in range(max(len(w) - window + 1, 1) if w else 0):
            keys.setdefault(tuple(w[k:k + window]), set()).add(str(item) if item is not None else "")
    sizes = {len(k) for k in keys}
    whole = [(str(i), words_of(t)) for i, t in items]
    out = []
    for text in texts:
        w = words_of(text)
        hit, met, longest = set(), set(), 0
        for size in sizes:
            for k in range(len(w) - size + 1):
                if found := keys.get(tuple(w[k:k + size])):
                    hit |= set(range(k, k + size))
                    met |= found
                    for _, v in whole:
                        for j in range(len(v)):
                            n = 0
                            while k + n < len(w) and j + n < len(v) and w[k + n] == v[j + n]:
                                n += 1
                            if n >= min(window, len(v)) and (n >= window or j == 0):
                                longest = max(longest, n)
        out.append((len(w), hit, sorted(met), longest))
    return out


def spans_of(hit):
    out = []
    for k in sorted(hit):
        if out and out[-1][1] == k:
            out[-1][1] = k + 1
        else:
            out.append([k, k + 1])
    return [tuple(s) for s in out]


@pytest.fixture(scope="module")
def corpus():
    rnd = random.Random(4)
    vocabulary = ["Uno", "dos", "TRES", "cuatro", "ñandú", "seis", "7", "ocho's", "nueve—x", "diez"]
    items = [(k, " ".join(rnd.choices(vocabulary, k=n))) for k, n in enumerate([10, 25, 40, 12, 60, 9, 3, 10])]
    items += [(50, items[1][1].upper()), (1, "otra cosa que no está en ningún lado del todo sino aquí"), (60, ""), (61, None), (62, "?!"),
              (None, "sin nombre hay una prueba de diez palabras justas aquí ya"), (63, "Éste no"), (64, "unico")]
    texts = []
    for k in range(60):
        parts = [" ".join(rnd.choices(vocabulary, k=rnd.randint(0, 30)))]
        for _ in range(k % 3):
            w = words_of(rnd.choice(items)[1])
            a = rnd.randint(0, max(len(w) - 1, 0))
            parts += [" ".join(w[a:a + rnd.randint(1, 60)]), "fuera", " ".join(rnd.choices(vocabulary, k=rnd.randint(0, 20)))]
        texts.append("; ".join(parts))
    texts += [None, "", "...", "unico", "UNICO unico\x00Unico", "éste no Éste No", items[4][1] + " " + items[4][1], "Sin nombre, hay una prueba de diez palabras JUSTAS aquí ya"]
    return items, texts + [texts[3], texts[3]]


def check(rows, items, texts, window=10):
    assert len(rows) == len(texts)
    for r, (n, hit, met, longest) in zip(sorted(rows, key=lambda r: r.i), brute(texts, items, window)):
        assert (r.n_words, r.n_hit, r.n_items, r["items"], r.contaminated) == (n, len(hit), len(met), met, bool(hit)), r.i
        assert [tuple(s) for s in r.spans] == spans_of(hit)
        assert (r.longest.length if r.longest else 0) == longest
        if r.longest:
            assert any(words_of(t)[r.longest.item_start:][:longest] == words_of(texts[r.i])[r.longest.start:][:longest]
                       for i, t in items if (str(i) if i is not None else "") == r.longest["item"])


def test_passages_equal_brute_force(spark, corpus):
    items, texts = corpus
    docs = spark.createDataFrame([(i, t, "own") for i, t in enumerate(texts)], "i int, text string, spans string").repartition(3)
    tests = spark.createDataFrame(items, "item_id int, text string")
    rows = overlaps(docs, tests)
    check(rows.collect(), items, texts)
    assert set(docs.columns) < set(rows.columns) and overlaps(docs.limit(0), tests).count() == 0
    assert all(r.n_hit == 0 and not r.contaminated for r in overlaps(docs, tests.limit(0)).collect())
    kept = decontaminated(docs, tests)
    assert kept.columns == docs.columns
    assert sorted(r.i for r in kept.collect()) == [i for i, b in enumerate(brute(texts, items)) if not b[1]]


def test_blocks_and_pieces_give_the_same(spark, corpus, monkeypatch):
    items, texts = corpus
    monkeypatch.setattr(contamination, "BLOCK", 60)
    docs = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    tests = spark.createDataFrame(items, "item_id int, text string")
    check(overlaps(docs, tests, window=4).collect(), items, texts, window=4)
    monkeypatch.setattr(contamination, "PIECE", 24)
    rows = {r.i: r for r in overlaps(docs, tests).collect()}
    for i, (n, hit, met, longest) in enumerate(brute(texts, items)):
        r = rows[i]
        assert (r.n_hit, r["items"]) == (len(hit), met) and min(longest, 12) <= (r.longest.length if r.longest else 0) <= longest


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.integers(-1, 2), max_size=30), min_size=1, max_size=4), st.lists(st.integers(0, 2), min_size=1, max_size=12), st.integers(1, 4))
def test_search_finds_all_places(texts, test, window):
    ids, bounds = np.array([w for t in texts for w in t], np.int64), np.cumsum([0, *map(len, texts)])
    n = len(test)
    size = min(window, n)
    starts = max(n - window + 1, 1)
    block = Block(pa.array([b""]), np.array([*test, -1]), np.array([size] * starts + [0] * (n - starts + 1)),
                  np.arange(n + 1), np.zeros(n + 1, int), np.arange(n + 1), [str(i) for i in range(n + 1)], ["x"])
    found = search(ids, bounds, block)
    want, longest = set(), {}
    for k, t in enumerate(texts):
        for i in range(len(t)):
            for j in range(starts):
                m = 0
                while i + m < len(t) and j + m < n and t[i + m] == test[j + m]:
                    m += 1
                if m >= size:
                    want.add((bounds[k] + i, tuple(test[j:j + size])))
                    longest[bounds[k] + i] = max(longest.get(bounds[k] + i, 0), m)
    got = [(a, tuple(test[k:k + s])) for a, s, k in zip(found.at, found.size, found.kind)]
    assert len(got) == len(set(got)) and set(got) == want
    assert {i: v for i, v in enumerate(found.longest.tolist()) if v} == longest


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(-1, 3), min_size=1, max_size=80))
def test_suffix_array_is_sorted(words):
    order = suffix_array(np.array(words), 128).tolist()
    suffixes = [words[i:] for i in order]
    assert suffixes == sorted(suffixes) and sorted(order) == list(range(len(words)))


def test_query_equals_brute_force(spark, sf):
    items = [(r.item_id, r.text) for r in table(spark, sf, "benchmark").collect()]
    docs = table(spark, sf, "documents").collect()
    rows = {r.doc_id: r for r in op11_benchmark_overlap(spark, sf).collect()}
    assert len(rows) == len(docs) and any(r.contaminated for r in rows.values())
    for d, (n, hit, met, longest) in zip(docs, brute([d.text for d in docs], items)):
        r = rows[d.doc_id]
        assert (r.n_words, r.n_hit, r.n_items, r.contaminated) == (n, len(hit), len(met), bool(hit))
        assert r.items_sha256 == hashlib.sha256(",".join(met).encode()).hexdigest()
        assert (r.longest.length if r.longest else 0) == longest


def test_very_long_text(spark):
    item = " ".join(f"w{k}" for k in range(6000))
    rows = overlaps(spark.createDataFrame([(0, "a " * 300_000 + item), (1, item * 2)], "i int, text string"),
                    spark.createDataFrame([(9, item), (10, "a")], "item_id int, text string")).collect()
    a, b = sorted(rows, key=lambda r: r.i)
    assert (a.n_hit, a["items"], a.n_words) == (306_000, ["10", "9"], 306_000)
    assert b.n_words == 11_999 and b.n_hit == 11_998 and b.longest.length >= 2048
