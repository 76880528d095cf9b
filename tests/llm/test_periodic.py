"""Periodic runs against all stretches of all periods, and the planted texts of the query."""

import hashlib
import random
import re
import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from octavilla.llm.common import table
from octavilla.llm.periodic import op12_periodic_runs, periodic_runs, runs_of

WORD = re.compile("[^\\x20\\x09-\\x0D]+")


def brute(words, least=6, times=4):
    """Every maximal stretch of every period, of which the smallest period counts."""
    out = {}
    for q in range(1, len(words) // times + 1):
        i = q
        while i < len(words):
            if words[i] != words[i - q]:
                i += 1
                continue
            j = i
            while j < len(words) and words[j] == words[j - q]:
                j += 1
            if j - i + q >= max(least, times * q):
                out.setdefault((i - q, j), q)
            i = j
    return sorted((s, e - s, q) for (s, e), q in out.items())


def collapsed(words, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


@st.composite
def periodic(draw):
    out = []
    for _ in range(draw(st.integers(0, 5))):
        piece = draw(st.lists(st.integers(0, 2), min_size=1, max_size=9))
        out += piece * draw(st.integers(1, 7)) + piece[:draw(st.integers(0, len(piece)))]
    return out


@settings(max_examples=400, deadline=None)
@given(st.lists(st.one_of(periodic(), st.lists(st.integers(0, 1), max_size=60)), min_size=1, max_size=5), st.sampled_from([(6, 4), (1, 3), (9, 5)]))
def test_runs_equal_brute_force(texts, rule):
    ids = np.array([w for t in texts for w in t], np.int64)
    bounds = np.cumsum([0, *map(len, texts)])
    got = [tuple(r) for r in runs_of(ids, bounds, *rule).tolist()]
    assert got == [(k, *r) for k, t in enumerate(texts) for r in brute(t, *rule)]


def test_rows_keep_their_columns(spark, docs, none):
    docs = docs.withColumn("runs", docs.doc_id)
    rows = periodic_runs(docs).collect()
    assert len(rows) == docs.count() and periodic_runs(none).count() == 0
    assert {c for c in docs.columns if c != "runs"} < set(rows[0].asDict())
    for r in rows:
        words = WORD.findall(r.text or "")
        runs = brute(words)
        assert r.n_words == len(words) and [tuple(x) for x in r.runs] == runs
        assert r.collapsed == collapsed(words, runs)


def test_long_and_odd_texts(spark):
    rnd = random.Random(1)
    texts = ["a " * 200_000, "a\x00b c \x1f   " * 50, " ".join(rnd.choice("ab") for _ in range(3000)) + " c", "x", "\n\t", None,
             "ü ö " * 9 + "ü", ("a b a a b b " * 4).strip(), "\r".join(["q"] * 5), "w " * 6]
    rows = {r.i: r for r in periodic_runs(spark.createDataFrame(list(enumerate(texts)), "i int, text string")).collect()}
    assert [tuple(x) for x in rows[0].runs] == [(0, 200_000, 1)] and rows[0].collapsed == "a"
    for i, t in list(enumerate(texts))[1:]:
        words = WORD.findall(t or "")
        assert [tuple(x) for x in rows[i].runs] == brute(words), i
        assert rows[i].collapsed == collapsed(words, brute(words)), i


def _expected(doc_id, text):
    words = WORD.findall(text or "")
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    n, g = len(words), h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
    runs = brute(words)
    best = max(runs, key=lambda r: (r[1], -r[0], -r[2]), default=None)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return (doc_id, len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None,
            sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)), sha(collapsed(words, runs)))


def test_query_equals_brute_force(spark, sf):
    rows = op12_periodic_runs(spark, sf).collect()
    want = {r.doc_id: _expected(r.doc_id, r.text) for r in table(spark, sf, "documents").collect()}
    assert len(rows) == len(want) and sum(r.n_runs > 0 for r in rows) > 5
    for r in rows:
        assert (r.doc_id, r.n_runs, r.start, r.length, r.period, r.exponent_milli, r.runs_sha256, r.collapsed_sha256) == want[r.doc_id]
    assert dict(op12_periodic_runs(spark, sf).dtypes)["exponent_milli"] == "bigint"


def test_query_takes_nulls(spark, tmp_path):
    rows = [(None, "a " * 20), (7, None), (None, None), (30, "a b " * 9), (30, "a b " * 9), *((k, "u v w x y z " * 3) for k in range(40))]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((tuple(r[c] for c in ("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"))
                  for r in op12_periodic_runs(spark, str(tmp_path)).collect()), key=str)
    assert got == sorted((_expected(*r) for r in rows), key=str)
