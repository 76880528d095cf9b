"""Quality grades, mixing rates and toxicity: held-out accuracy, targets met, odd rows."""

import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from octavilla.llm import mixing, models, quality, toxicity
from octavilla.llm.common import bounded_sample, components, table


def test_bounded_sample(spark):
    rows = spark.range(20_000).withColumnRenamed("id", "doc_id")
    assert bounded_sample(rows, "doc_id", 50_000).count() == 20_000
    assert 1700 < bounded_sample(rows, "doc_id", 2000).count() < 2300


def test_components(spark):
    chain = [(i, i + 1) for i in range(0, 40)] + [(100, 101), (103, 101), (7, 7)]
    got = dict(map(tuple, components(spark.createDataFrame(chain, "a long, b long"), "a", "b").collect()))
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 103: 100}
    assert components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


def test_ordinal_regression_orders_grades():
    rng = np.random.default_rng(0)
    x = np.zeros((600, models.FEATURES))
    z = rng.normal(size=600)
    x[:, 3], x[:, 7] = z, -z
    grade = np.digitize(z + rng.normal(scale=0.1, size=600), [-0.5, 0.5])
    g = quality.fit_grades(x, grade, 3)
    assert g.thresholds[0] < g.thresholds[1]
    tails = g.tails(x)
    assert (tails[:, 0] >= tails[:, 1]).all()
    assert ((tails > 0.5).sum(axis=1) == grade).mean() > 0.93
    even = quality.fit_grades(np.zeros((0, models.FEATURES)), np.zeros(0, int), 3).tails(np.zeros((1, models.FEATURES)))
    assert np.allclose(even, [[2 / 3, 1 / 3]])


def test_gradient_of_minimizer():
    best = models.minimize(lambda p: (float(((p - 3) ** 2 * [1, 50]).sum()), 2 * (p - 3) * [1, 50]), np.zeros(2))
    assert np.allclose(best, 3, atol=1e-3)


def test_quality_on_held_out_labels(spark):
    sf = "/root/testdata/sf0.1"
    docs, ratings = table(spark, sf, "documents"), quality.graded(table(spark, sf, "labels"))
    seen = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 != 0
    grader = quality.fit_on_ratings(docs, ratings.filter(seen), 3)
    rest = quality.grade_documents(docs.select("doc_id", "text"), grader).join(ratings.filter(~seen), "doc_id").collect()
    assert len(rest) > 1000
    assert np.mean([r.selected == (r.grade > 0) for r in rest]) > 0.97
    assert all(abs(r.expected_grade - r.tail_1 - r.tail_2) < 1e-12 and r.tail_1 >= r.tail_2 for r in rest)


def test_quality_odd_rows(spark, docs, none):
    grader = quality.fit_on_ratings(docs, spark.createDataFrame([(None, 1, 0), (3, None, 1), (4, 1, None)], "doc_id long, quality int, toxic int")
                                    .transform(quality.graded), 3)
    out = quality.grade_documents(docs, grader).collect()
    assert len(out) == docs.count() and {round(r.tail_1, 6) for r in out} == {0.666667} and all(r.part == -1 for r in out)
    assert quality.grade_documents(none, grader).count() == 0
    rated = spark.createDataFrame([(i, int(i % 2 == 0), 0) for i in range(20)] * 2, "doc_id long, quality int, toxic int")
    kept = quality.grade_documents(docs, quality.fit_on_ratings(docs, quality.graded(rated), 3)).collect()
    by_text = {}
    for r in kept:
        assert by_text.setdefault(r.text or "", r.tail_1) == r.tail_1


def test_rates_meet_targets(spark):
    rng = np.random.default_rng(2)
    rows = []
    for i in range(3000):
        p = rng.dirichlet([0.3, 0.2, 0.1])
        rows.append((i, int(rng.integers(1, 900)), [float(v) for v in p]))
    members = spark.createDataFrame(rows, "doc_id long, n_words long, posterior array<float>").repartition(5)
    weights = {"a": 0.2, "b": 0.5, "c": 0.3}
    steps, report = mixing.fit_rates(members, ["a", "b", "c"], weights, budget=None, least=0.0, most=8.0)
    rated = mixing.with_rates(members, steps, 0.0, 8.0).collect()
    mixed = np.sum([np.array(r.posterior) * r.n_words * r.rate for r in rated], axis=0)
    target = report["target"].to_numpy()
    assert np.allclose(mixed / mixed.sum(), [0.2, 0.5, 0.3], atol=2e-3)
    assert np.abs(mixed - target).sum() / target.sum() < 2e-3
    assert min(r.rate for r in rated) >= 0 and max(r.rate for r in rated) <= 8
    # plain projected gradient on one machine gives totals as close
    n, p = np.array([r.n_words for r in rated], float), np.array([r.posterior for r in rated], float)
    a, r = n[:, None] * p, np.ones(len(n))
    lipschitz = np.linalg.norm(a, 2) ** 2
    for _ in range(3000):
        r = np.clip(r - a @ (a.T @ r - target) / lipschitz, 0, 8)
    assert np.abs(a.T @ r - target).sum() / target.sum() < 2e-3


@pytest.mark.parametrize("alpha", [0.05, 0.5])
def test_rates_of_at_least_one(spark, alpha, monkeypatch):
    """Production bounds: as near as one machine comes, in a few passes."""
    rng = np.random.default_rng(3)
    p = rng.dirichlet(alpha * np.array([8, 4, 2, 1, 1, 0.5]), 2000).astype(np.float32)
    n = rng.integers(1, 900, len(p))
    members = spark.createDataFrame([(i, int(w), [float(v) for v in row]) for i, (w, row) in enumerate(zip(n, p))],
                                    "doc_id long, n_words long, posterior array<float>").repartition(4)
    passes, tried = [], mixing._tried
    monkeypatch.setattr(mixing, "_tried", lambda *a: passes.append(1) or tried(*a))
    steps, report = mixing.fit_rates(members, list("abcdef"), least=1.0)
    rates = {r.doc_id: r.rate for r in mixing.with_rates(members, steps, 1.0).collect()}
    assert len(passes) <= 15 and min(rates.values()) == 1
    target, p = report["target"].to_numpy(), p.astype(float)
    mixed = (n * np.array([rates[i] for i in range(len(p))])) @ p
    assert np.allclose(mixed, report["mixed"], rtol=1e-6)
    # projected gradient on one machine, on the same squares
    gram = (p * n[:, None]).T @ p + 1e-6 * n.sum() * np.eye(6)
    inverse, r = np.linalg.inv(gram), np.ones(len(p))

    def squares(r):
        off = (n * r) @ p - target
        return off @ inverse @ off + mixing.NEARNESS * n @ (r - 1) ** 2

    for _ in range(5000):
        r = np.maximum(r - (p @ (inverse @ ((n * r) @ p - target)) + mixing.NEARNESS * (r - 1)) / (1 + mixing.NEARNESS), 1)
    own = squares(np.array([rates[i] for i in range(len(p))]))
    assert own <= squares(r) * (1 + 1e-6)
    assert own < squares(np.ones(len(p))) / 3


def test_texts_without_blanks_count_by_length(spark):
    docs = spark.createDataFrame([(0, "a b c"), (1, "文" * 160), (2, None), (3, "")], "doc_id long, text string")
    labelled = spark.createDataFrame([], "doc_id long, domain string")
    assert {r.doc_id: r.n_words for r in mixing.mixed_rates(docs, labelled).collect()} == {0: 3, 1: 10, 2: 1, 3: 1}


def test_mixing_repeats_documents(spark, docs, none):
    labelled = spark.createDataFrame([(i, "x" if i < 60 else "y") for i in range(150)], "doc_id long, domain string")
    rates = mixing.mixed_rates(docs, labelled, least=1.0)
    assert rates.count() == docs.count()
    out = mixing.repeated(docs, rates)
    assert out.columns == docs.columns
    times = {r.text: r.n for r in out.groupBy("text").agg(F.count(F.lit(1)).alias("n")).collect()}
    own = {r.text: r.n for r in docs.groupBy("text").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert set(times) == set(own) and all(times[t] >= own[t] for t in own)
    assert sorted(map(str, out.collect())) == sorted(map(str, mixing.repeated(docs, rates).collect()))
    assert mixing.mixed_rates(none, labelled).count() == 0
    alone = mixing.mixed_rates(docs, labelled.limit(0))
    assert {(r.domain, r.rate) for r in alone.collect()} == {("all", 1.0)}


def test_decoding_disguised_words():
    counts = np.zeros(toxicity.ALPHABET**toxicity.ORDER)
    for word in ["stupid", "idiot", "moron", "clown", "worthless", "letter", "the", "pathetic", "coffee"] * 30:
        s = [26, 26, 26, *(ord(c) - 97 for c in word), 26]
        for i in range(len(s) - 3):
            counts[((s[i] * 27 + s[i + 1]) * 27 + s[i + 2]) * 27 + s[i + 3]] += 1
    model = toxicity.CharacterModel(counts)
    assert np.allclose(np.exp(model.log_p).sum(axis=1), 1, atol=1e-4)
    for written, meant in {"1d10t": "idiot", "m0r0n!!": "moron", "stuuuupid": "stupid", "$tupid": "stupid", "s.t.u.p.i.d": "stupid",
                           "cl0wn***": "clown", "w0rthl3ss": "worthless", "LETTER,": "letter", "the": "the", "p4th3t1c": "pathetic",
                           "coffeeee": "coffee", "": "", "***": "", "2026": "2026"}.items():
        assert toxicity.restored(written.lower(), model) == meant, written


def test_plain_words_and_texts_take_the_short_way():
    """What is skipped for plain words and for texts without spaced letters changes nothing."""
    rng = random.Random(8)
    counts = np.random.default_rng(4).integers(0, 3, toxicity.ALPHABET**toxicity.ORDER).astype(float)
    reader = toxicity.Reader(toxicity.CharacterModel(counts))
    signs = "abceio$@!1.,-'*)é "
    for _ in range(4000):
        written = "".join(rng.choices(signs[:-1], weights=[8] * 6 + [1] * 11, k=rng.randint(1, 9)))
        assert reader.slots(written) == reader._kept(reader._meant(written)), written
        text = " ".join("".join(rng.choices(signs, weights=[4] * 6 + [1] * 12, k=rng.choice([1, 1, 2, 2, 5]))) for _ in range(rng.randint(1, 7)))
        if toxicity._SPACED.search(text):
            assert toxicity._may_be_spaced(text.split()), text


def test_decoder_finds_the_best_path():
    """Against all readings of short words."""
    rng = np.random.default_rng(4)
    model = toxicity.CharacterModel(rng.integers(0, 3, toxicity.ALPHABET**toxicity.ORDER).astype(float))

    def cost(word):
        at, c = (26 * 27 + 26) * 27 + 26, 0.0
        for ch in [*(ord(x) - 97 for x in word), 26]:
            c -= model.rows[at][ch]
            at = at % 729 * 27 + ch
        return c

    def readings(signs):
        if not signs:
            yield 0.0, ""
            return
        sign = signs[0]
        plain = sign.isalpha()
        for extra, rest in readings(signs[1:]):
            for letter in sign if plain else toxicity.LEET.get(sign, ""):
                yield extra + (0 if plain else toxicity.SIGN_COST), letter + rest
            if not plain:
                yield extra + toxicity.DROP_COST, rest

    rnd = random.Random(5)
    for _ in range(40):
        signs = "".join(rnd.choice("ab1@03ec") for _ in range(rnd.randint(1, 5)))
        if any(a == b for a, b in zip(signs, signs[1:])):
            continue
        best = min(c + cost(w) for c, w in readings(signs))
        found = model.decode(signs)
        assert any(math.isclose(c + cost(w), best, rel_tol=1e-5) and w == found for c, w in readings(signs))


def test_toxicity_on_held_out_labels(spark):
    sf = "/root/testdata/sf0.1"
    out = toxicity.op8_toxicity(spark, sf).join(table(spark, sf, "labels"), "doc_id").filter("held_out").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in out)
    hit = sum(r.predicted == 1 and r.toxic == 1 for r in out)
    assert hit / sum(r.toxic == 1 for r in out) > 0.9 and hit / sum(r.predicted == 1 for r in out) > 0.97


def test_penalties_chosen_by_folds():
    """Three words tell the label, and hundreds that each stand in two texts tell nothing."""
    rng = np.random.default_rng(5)
    toxic = np.repeat([1, 0], [60, 240])
    slots = [np.unique(np.concatenate([[k % 3] if y else [], rng.integers(10, 250, 6), [k % 3] if rng.random() < 0.02 else []])).astype(np.int32)
             for k, y in enumerate(toxic)]
    grid = ((1e-4, 1e-1), (1.0,), (1.0, 10.0))
    chosen = toxicity.choose_penalties(slots, toxic, grid)
    assert chosen[0] == 1e-4
    scores = np.array([0.9, 0.3, 0.2, 0.02])
    assert toxicity.choose_offset(scores, np.array([1, 1, 1, 0])) == 1.5
    assert toxicity.choose_offset(scores, np.array([1, 0, 0, 0])) == 0
    # copies of a row are scored by models that have not seen it
    twice = toxicity.fold_scores(slots * 2, np.concatenate([toxic, toxic]), chosen)
    assert np.allclose(twice[:300], twice[300:])
    turned = toxicity.fold_scores(slots[::-1], toxic[::-1], chosen)[::-1]
    assert np.allclose(turned, toxicity.fold_scores(slots, toxic, chosen), atol=1e-6)


def test_toxicity_odd_rows(spark, docs, none):
    model = toxicity.fit_characters(docs)
    assert toxicity.fit_characters(none).log_p.shape == model.log_p.shape
    labels = spark.createDataFrame([(i, int(i % 7 == 0)) for i in range(150)] + [(None, 1), (3, None)], "doc_id long, toxic int")
    weights = toxicity.fit_on_labels(docs, labels, model)
    out = toxicity.score_documents(docs, model, weights).collect()
    assert len(out) == docs.count()
    by_text = {}
    for r in out:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) and r.part == -1
        assert by_text.setdefault(r.text or "", r.score) == r.score
    assert toxicity.score_documents(none, model, weights).count() == 0
    assert set(toxicity.fit_on_labels(docs, labels.limit(0), model)) == {-1}


@pytest.mark.parametrize("words", [[], ["a"], ["ab", "zz", "abc"]])
def test_character_counts_are_those_of_the_words(spark, words):
    rows = spark.createDataFrame([(w,) for w in words], "text string")
    model = toxicity.fit_characters(rows)
    counts = np.zeros(toxicity.ALPHABET**toxicity.ORDER)
    for w in words:
        s = [26, 26, 26, *(ord(c) - 97 for c in w), 26]
        for i in range(len(s) - 3):
            counts[((s[i] * 27 + s[i + 1]) * 27 + s[i + 2]) * 27 + s[i + 3]] += np.log1p(1)
    assert np.allclose(model.log_p, toxicity.CharacterModel(counts).log_p)


def test_every_slot_may_carry_weight():
    """1,800 toxic words, each in two or three texts, and none of them hides another."""
    words = [k for k in range(1800) for _ in range(3 if k < 1700 else 2)]
    rows = [np.array([k], np.int32) for k in words] + [np.array([], np.int32)] * len(words)
    weights = toxicity.fit_scorer(rows, np.repeat([1, 0], len(words)))
    assert min(weights.get(k, 0) for k in range(1800)) > 0


def model_of(words):
    counts = np.zeros(toxicity.ALPHABET**toxicity.ORDER)
    for word in words:
        s = [26, 26, 26, *(ord(c) - 97 for c in word), 26]
        for i in range(len(s) - 3):
            counts[((s[i] * 27 + s[i + 1]) * 27 + s[i + 2]) * 27 + s[i + 3]] += 30
    return toxicity.CharacterModel(counts)


def test_signs_at_the_edges_and_blanks_in_words():
    model = model_of(["stupid", "idiot", "loser", "shit", "clown", "hello", "what", "see", "a"])
    for written, meant in {"!diot": "idiot", "idiot!": "idiot", "|oser": "loser", "shi+": "shit", "5h!+": "shit", "(lown": "clown",
                           "(hello)": "hello", "what!!": "what", "[!diot!]": "idiot", "a s t u p i d": "a stupid",
                           "s t u p i d i d i o t": "stupid idiot", "st  up  id": "stupid", "(2026!)": "2026"}.items():
        assert toxicity.restored(written, model) == meant, written
    reader = toxicity.Reader(model)
    stupid, idiot = reader.slots("stupid"), reader.slots("idiot")
    for text in ("so s t u p i d i d i o t,", "s  t\tu  p i d   i d i o t", "st up id id io t", "$tupid !d!ot"):
        assert {*stupid, *idiot} <= reader.read(text), text


def test_decoder_keeps_all_contexts():
    """Signs that may be nothing leave more than 12 contexts; the one needed is dear until its word ends."""
    rng = np.random.default_rng(8)
    rnd = random.Random(9)
    for _ in range(6):
        model = toxicity.CharacterModel(rng.integers(0, 2, toxicity.ALPHABET**toxicity.ORDER) * 1e6)
        signs = "".join(rnd.sample("1234568", 7))

        def least(rest, at):
            if not rest:
                return -model.rows[at][26], ""
            ways = [(toxicity.DROP_COST + c, w) for c, w in [least(rest[1:], at)]]
            for letter in toxicity.LEET[rest[0]]:
                k = ord(letter) - 97
                c, w = least(rest[1:], at % 729 * 27 + k)
                ways.append((toxicity.SIGN_COST - model.rows[at][k] + c, letter + w))
            return min(ways)

        assert model.decode(signs) == least(signs, (26 * 27 + 26) * 27 + 26)[1]


def test_scarce_domain_meets_its_target(spark):
    """A domain of 0.1 % of the tokens beside one of 45 %, with the production parameters."""
    rows = [(i, 100, [1.0, 0.0, 0.0] if i < 450 else [0.0, 0.0, 1.0] if i == 999 else [0.0, 1.0, 0.0]) for i in range(1000)]
    members = spark.createDataFrame(rows, "doc_id long, n_words long, posterior array<float>").repartition(3)
    steps, report = mixing.fit_rates(members, ["big", "bigger", "scarce"])
    rates = {r.doc_id: r.rate for r in mixing.with_rates(members, steps).collect()}
    assert rates[999] > 6
    assert np.allclose(report["mixed"], report["target"], rtol=1e-2)
    assert math.isclose(report["mixed"][2], 100 * rates[999], rel_tol=1e-6)
