"""Toxicity of restored text: disguised words are decoded under a character model, then scored."""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import groupby, product

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_sample, table, texts_of, whole_text
from .models import sigmoid
from .tokens import in_portions

# What a written sign may stand for, and signs that only separate letters.
LEET = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a",
        "$": "s", "!": "i", "|": "il", "+": "t", "€": "e", "£": "l", "(": "c", "¡": "i"}
SEPARATORS = " .-_*~'"
EDGES = ".,;:!?\"'()[]{}<>*&%#~`^=+-_/\\|«»“”„¡¿…"
#: Punctuation that never stands for a letter.
ONLY_EDGES = "".join(ch for ch in EDGES if ch not in LEET)

#: Costs of the channel, as negative log probabilities: a sign for a letter, a sign that stands
#: for nothing, a letter written three times or more for one or two, a letter doubled.
SIGN_COST, DROP_COST, REPEAT_COST, DOUBLE_COST = 1.0, 6.0, 1.0, 3.0
#: Punctuation at the edge of a word may as well be a letter as nothing.
EDGE_COST = 1.0
#: Symbols of the character model: the letters a to z and the edge of a word.
ALPHABET = 27
EDGE = 26
ORDER = 4
#: Hash slots of words and of their beginnings, labelled rows of the scorer at most.
SLOTS = 1 << 20
BEGINNINGS = (4, 5)
SAMPLE = 10_000
#: The scorer's absolute-value penalty, what it adds for a slot in one text, its factor for slots
#: that speak against toxicity: those of ``GRID`` that ``choose_penalties`` gives for the training rows
#: of sf0.1.  Slots that join at once, and the excess of slope that still counts.
PENALTIES = (3e-6, 1.0, 10.0)
GRID = ((3e-6, 1e-5, 3e-5, 1e-4), (1.0, 3.0, 10.0), (3.0, 10.0, 30.0))
#: Added to the log odds, as ``choose_offset`` gives it for the same rows: penalties hold odds down.
OFFSET = 2.0
OFFSETS = tuple(k / 2 for k in range(11))
JOINING, SETTLED = 2000, 1e-2
#: Entries of the scorer's matrix summed at once.
AT_ONCE = 1 << 20
#: Distinct written words a worker remembers before it starts anew.
MOST_WORDS = 400_000

_SUSPECT = re.compile(r"([^\W\d_])\1\1|[^\W\d_].*[0-9@$!|+€£(¡]|[0-9@$|€£(¡].*[^\W\d_]|^(?:\w[.\-_*~']){2,}\w$")
_SPACED = re.compile(r"(?<!\S)(?:[^\W_]|[@$!|+€£(¡]){1,2}(?:\s+(?:[^\W_]|[@$!|+€£(¡]){1,2}){2,}(?=\s|[.,;:?!)]|$)")
_LETTER = re.compile(r"[^\W\d_]")
_TRIPLE = re.compile(r"(.)\1\1")
_BEGINS = zlib.crc32(b"^")


def _unaccented(low: str) -> str:
    plain = unicodedata.normalize("NFKD", low.replace("ß", "ss").replace("œ", "oe").replace("æ", "ae"))
    return "".join(ch for ch in plain if not unicodedata.combining(ch))


#: The same for each letter of the common Latin blocks, which have no combining marks.
_LATIN = {k: _unaccented(chr(k)) for k in range(0x80, 0x180)}


def folded(word: str) -> str:
    """Lower case without accents; letters of other scripts stay."""
    low = word.lower()
    if low.isascii():
        return low
    plain = low.translate(_LATIN)
    return plain if plain.isascii() else _unaccented(low)


def core_of(written: str, edges: str = EDGES) -> str:
    """A written word without the punctuation around it."""
    return re.sub(r"^[$@]{3,}|[$@]{3,}$", "", written.strip(edges)).strip(edges)


class CharacterModel:
    """Interpolated 4-gram model: ``log_p[context, letter]`` with the last three symbols as context."""

    def __init__(self, counts: np.ndarray, strength: float = 8.0):
        grams = counts.reshape((ALPHABET,) * ORDER).astype(float)
        p = np.full(ALPHABET, 1 / ALPHABET)
        for n in range(1, ORDER + 1):
            c = grams.sum(axis=tuple(range(ORDER - n)))
            total = c.sum(axis=-1, keepdims=True)
            p = (c + strength * p) / (total + strength)
        self.log_p = np.log(p.reshape(-1, ALPHABET)).astype(np.float32)
        self.rows = self.log_p.tolist()

    def decode(self, signs: str, edge_cost: float = EDGE_COST) -> str:
        """The most likely words behind the signs: best path through the lattice of readings.

        An arc reads a run of one sign: as its letter, as a letter it may stand for, once or
        twice, or as nothing.  Punctuation at either end is as easily nothing as a letter.  Blanks
        are nothing or the edge of a word, so that signs with blanks may give several words, one
        blank apart.  A path costs its signs and the letters' negative log probabilities, edges
        included.  All contexts are kept.  Equal costs are resolved by spelling.
        """
        edge = (EDGE * ALPHABET + EDGE) * ALPHABET + EDGE
        runs = [(sign, len(list(run))) for sign, run in groupby("".join(" " if ch.isspace() else ch for ch in signs))]
        inner = [i for i, (sign, _) in enumerate(runs) if sign not in EDGES and sign != " "]
        first, last = (inner[0], inner[-1]) if inner else (len(runs), -1)
        # a path is its parts from the last one back, so that long runs are not copied at each sign
        states: dict[int, tuple[float, tuple]] = {edge: (0.0, ())}
        for i, (sign, n) in enumerate(runs):
            if sign == " ":
                for context, (cost, path) in list(states.items()):
                    if context != edge:
                        found = (cost - self.rows[context][EDGE], (path, " "))
                        if edge not in states or _better(found, states[edge]):
                            states[edge] = found
                continue
            if sign in SEPARATORS:
                continue
            plain = "a" <= sign <= "z"
            outside = sign in EDGES and not first < i < last
            arcs = [] if plain else [("", DROP_COST if not outside else edge_cost if sign in LEET else 0.0)]
            for letter in sign if plain else LEET.get(sign, ""):
                cost = 0.0 if plain else SIGN_COST
                arcs.append((letter, cost + (0.0 if n == 1 else DOUBLE_COST if n == 2 else REPEAT_COST)))
                if n > 1:
                    arcs.append((letter * 2, cost + (REPEAT_COST if n > 2 else 0.0)))
            reached: dict[int, tuple[float, tuple]] = {}
            for context, (cost, path) in states.items():
                for letters, extra in arcs:
                    at, c = context, cost + extra
                    for letter in letters:
                        k = ord(letter) - 97
                        c -= self.rows[at][k]
                        at = at % (ALPHABET * ALPHABET) * ALPHABET + k
                    found = (c, (path, letters) if letters else path)
                    if at not in reached or _better(found, reached[at]):
                        reached[at] = found
            states = reached
        # after an edge there is nothing left to end
        ends = [(c if at == edge and path else c - self.rows[at][EDGE], path) for at, (c, path) in states.items()]
        best = ends[0]
        for found in ends[1:]:
            if _better(found, best):
                best = found
        return _spelled(best[1]).strip()


def _spelled(path: tuple) -> str:
    parts = []
    while path:
        path, letters = path
        parts.append(letters)
    return "".join(reversed(parts))


def _better(a: tuple[float, tuple], b: tuple[float, tuple]) -> bool:
    return a[0] < b[0] or (a[0] == b[0] and _spelled(a[1]) < _spelled(b[1]))


def restored(written: str, model: CharacterModel) -> str:
    """The word meant by a written word: itself, unless signs, repeats or separators disguise it.

    Signs with blanks between them may mean several words, which stand one blank apart.
    """
    core = core_of(written)
    whole = core_of(written, ONLY_EDGES)
    if not _LETTER.search(core):
        return folded(core)
    word = folded(core)
    if whole != core:
        return model.decode(folded(whole)) or word
    return (model.decode(word) or word) if _SUSPECT.search(word) or len(word.split()) > 1 else word


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, n): how often each plain word stands in all texts, folded, letters a to z only."""
    def count(batches):
        seen: Counter[str] = Counter()

        def flush():
            words: Counter[str] = Counter()
            for written, n in seen.items():
                word = folded(core_of(written))
                if word.isascii() and word.isalpha():
                    words[word] += n
            seen.clear()
            return pa.RecordBatch.from_arrays([pa.array(list(words), pa.string()), pa.array(list(words.values()), pa.int64())],
                                              names=["word", "n"])

        for batch in batches:
            for texts in in_portions(texts_of(batch.column("text"))):
                for text in texts:
                    seen.update(text.lower().split())
                if len(seen) > MOST_WORDS:
                    yield flush()
        yield flush()

    counted = docs.select(whole_text().alias("text")).mapInArrow(count, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n"))


def fit_characters(docs: DataFrame) -> CharacterModel:
    """The model of all words of all documents; a word weighs the logarithm of its count.

    The words of the whole corpus meet in the shuffle; only counts of 4-grams, at most
    27**4 whatever the corpus, reach the driver and later the tasks (2 MB).
    """
    def grams(frames):
        total = np.zeros(ALPHABET**ORDER)
        for frame in frames:
            weight = np.log1p(frame["n"].to_numpy(float))
            size = frame["word"].str.len().to_numpy(np.int64)
            # each word between three edges before and one after it
            text = np.frombuffer(("{{{" + "{{{{".join(frame["word"]) + "{").encode(), np.uint8).astype(np.int64) - 97
            code = ((text[:-3] * ALPHABET + text[1:-2]) * ALPHABET + text[2:-1]) * ALPHABET + text[3:]
            end = np.cumsum(size + 4)  # positions of first letters: start of each block
            keep = np.ones(len(code), bool)
            keep[(end[:-1, None] - 3 + np.arange(3)).ravel()] = False  # from one word's end into the next one's edges
            which = np.repeat(np.arange(len(size)), size + 1)
            total += np.bincount(code[keep], weights=weight[which], minlength=ALPHABET**ORDER)
        at = np.flatnonzero(total)
        yield pd.DataFrame({"gram": at.astype(np.int32), "w": total[at]})

    rows = (word_counts(docs).mapInPandas(grams, "gram int, w double").groupBy("gram").agg(F.sum("w").alias("w"))).toArrow()
    counts = np.zeros(ALPHABET**ORDER)
    counts[rows["gram"].to_numpy()] = rows["w"].to_numpy()
    return CharacterModel(counts)


def _may_be_spaced(words: list[str]) -> bool:
    """Whether ``_SPACED`` can be found: two words of a letter or two, and a third one, or one that a stop ends."""
    size = np.fromiter(map(len, words), np.int64, len(words))
    first = np.flatnonzero((size[:-2] <= 2) & (size[1:-1] <= 2))
    if (size[first + 2] <= 2).any():
        return True
    return any(not words[i + 2][1:3].isalnum() for i in first.tolist())


class Reader:
    """Feature slots of texts: restored words and their beginnings; each written word is restored once."""

    def __init__(self, model: CharacterModel, wanted: frozenset[int] | None = None):
        self.model, self.wanted, self.known = model, wanted, {}

    def slots(self, written: str) -> tuple[int, ...]:
        plain = written.strip(ONLY_EDGES)
        if plain.isalpha():
            word = folded(plain)
            if word.isalpha() and (len(set(word)) > len(word) - 2 or not _TRIPLE.search(word)):
                return self._kept({word, plain.lower()})  # nothing to restore
        return self._kept(self._meant(written))

    def _meant(self, written: str) -> set[str]:
        """The words that a written word may stand for."""
        core = core_of(written)
        # accents may tell words apart that are alike without them
        words = {*restored(written, self.model).split(), "".join(core.lower().split())}
        whole = core_of(written, ONLY_EDGES)
        if whole != core and _LETTER.search(core):
            # punctuation at the edges as nothing and as letters, whichever is likelier
            words.update(restored(core, self.model).split(), self.model.decode(folded(whole), DROP_COST).split())
        if " " in written:
            # one-letter words are few in the model: a run may begin with one
            words.update(restored(written.partition(" ")[2], self.model).split())
        words.discard("")
        return words

    def _kept(self, words: set[str]) -> tuple[int, ...]:
        """Slots of words and of their beginnings, which are marked by a sign before them."""
        slots = set()
        for w in words:
            data = w.encode("utf-8", "surrogatepass")
            slots.add(zlib.crc32(data) % SLOTS)
            for n in BEGINNINGS:
                if len(w) > n:
                    start = data[:n] if len(data) == len(w) else w[:n].encode("utf-8", "surrogatepass")
                    slots.add(zlib.crc32(start, _BEGINS) % SLOTS)
        return tuple(sorted(slots if self.wanted is None else slots & self.wanted))

    def read(self, text: str) -> set[int]:
        low = text.lower()
        parts = low.split()
        words = set(parts)
        if _may_be_spaced(parts):
            words.update(" ".join(m.group().split()) for m in _SPACED.finditer(low) if _LETTER.search(m.group()))
        if len(self.known) > MOST_WORDS:
            self.known.clear()
        for w in words.difference(self.known):
            self.known[w] = self.slots(w)
        return set().union(*filter(None, map(self.known.__getitem__, words)))


def held_out(key: str) -> Column:
    text = F.coalesce(F.col(key).cast("string"), F.lit("null"))
    return F.crc32(text.cast("binary")) % 5 == 0


def fit_scorer(slots: list[np.ndarray], toxic: np.ndarray, rounds: int = 300,
               penalties: tuple[float, float, float] = PENALTIES) -> dict[int, float]:
    """Slot weights of a logistic regression with an absolute-value penalty; slot -1 is the constant.

    ``slots`` holds the distinct slots of each text, the sparse matrix of the regression.  Every
    slot may carry weight: those that would lower the penalized loss join the ones in work, which
    are fitted anew, until no slot is left that would; the penalty alone leaves slots out.  It is
    larger for slots in few texts and for those that speak against toxicity.
    """
    toxic, rows = toxic.astype(float), len(slots)
    if not rows or toxic.min() == toxic.max():
        rate = (toxic.sum() + 0.5) / (rows + 1)
        return {-1: float(np.log(rate / (1 - rate)))}
    doc = np.repeat(np.arange(rows, dtype=np.int32), [len(s) for s in slots])
    slot = np.concatenate(slots)
    in_toxic = np.bincount(slot, weights=toxic[doc], minlength=SLOTS)
    in_all = np.bincount(slot, minlength=SLOTS)
    n1, n0 = toxic.sum(), rows - toxic.sum()
    least, rare, against = penalties
    penalty = least * (1 + rare / np.maximum(in_all, 1))
    penalty[in_toxic * n0 < (in_all - in_toxic) * n1] *= against
    w, constant = np.zeros(SLOTS), float(np.log(n1 / n0))
    z, work = np.full(rows, constant), np.zeros(0, int)
    while True:
        miss = (sigmoid(z) - toxic) / rows
        slope = np.zeros(SLOTS)
        for k in range(0, len(slot), AT_ONCE):
            slope += np.bincount(slot[k:k + AT_ONCE], weights=miss[doc[k:k + AT_ONCE]], minlength=SLOTS)
        over = np.abs(slope) / penalty
        over[work] = 0
        asking = np.flatnonzero(over > 1 + SETTLED)
        if not len(asking):
            break
        # slots that lost their weight stay in work, so the work only grows and ends
        work = np.union1d(work, asking[np.argsort(-over[asking], kind="stable")[:JOINING]])
        column = np.full(SLOTS, -1, np.int32)
        column[work] = np.arange(len(work))
        here = column[slot] >= 0
        r, c = doc[here].astype(np.intp), column[slot[here]].astype(np.intp)
        in_row = np.bincount(r, minlength=rows) + 1.0
        # each slot's slope grows at most by a quarter of its row of the Gram matrix, summed
        step, constant_step = 4 * rows / np.bincount(c, weights=in_row[r], minlength=len(work)), 4 * rows / in_row.sum()
        now, ahead, constant_ahead, t = w[work], w[work], constant, 1.0
        for _ in range(rounds):
            miss = (sigmoid(np.bincount(r, weights=ahead[c], minlength=rows) + constant_ahead) - toxic) / rows
            moved = ahead - step * np.bincount(c, weights=miss[r], minlength=len(work))
            new = np.sign(moved) * np.maximum(np.abs(moved) - step * penalty[work], 0)
            new_constant = constant_ahead - constant_step * float(miss.sum())
            faster = (1 + (1 + 4 * t * t) ** 0.5) / 2
            ahead, constant_ahead = new + (t - 1) / faster * (new - now), new_constant + (t - 1) / faster * (new_constant - constant)
            now, constant, t = new, new_constant, faster
        w[work] = now
        z = np.bincount(r, weights=now[c], minlength=rows) + constant
    used = np.flatnonzero(w)
    return dict(zip(used.tolist(), w[used].tolist())) | {-1: constant}


def training_rows(docs: DataFrame, labels: DataFrame, model: CharacterModel) -> tuple[list[np.ndarray], np.ndarray]:
    """Slots and labels of rows that are not held out, at most about ``SAMPLE`` of them."""
    rated = labels.filter("toxic is not null and doc_id is not null").filter(~held_out("doc_id")).select("doc_id", "toxic")
    sample = F.broadcast(bounded_sample(rated, "doc_id", SAMPLE))
    texts = docs.select("doc_id", whole_text().alias("text")).join(sample, "doc_id").select("text", "toxic")
    sent = docs.sparkSession.sparkContext.broadcast(model.log_p)

    def read(frames):
        reader = Reader(_model_of(sent.value))
        for frame in frames:
            yield pd.DataFrame({"toxic": frame["toxic"].astype("int32"), "slots": [
                np.array(sorted(reader.read(t)), np.int32).tobytes() for t in frame["text"]]})

    rows = texts.mapInPandas(read, "toxic int, slots binary").toArrow()
    return [np.frombuffer(b.as_buffer(), np.int32) for b in rows["slots"]], rows["toxic"].to_numpy()


def fold_scores(slots: list[np.ndarray], toxic: np.ndarray, penalties, folds: int = 3) -> np.ndarray:
    """Score of each row by a model of the other folds; rows with equal slots share a fold."""
    kinds = {b: k for k, b in enumerate(sorted({s.tobytes() for s in slots}))}
    fold = np.array([kinds[s.tobytes()] % folds for s in slots])
    z = np.zeros(len(slots))
    for f in range(folds):
        learnt = np.flatnonzero(fold != f)
        w = fit_scorer([slots[i] for i in learnt], toxic[learnt], penalties=penalties)
        for i in np.flatnonzero(fold == f):
            z[i] = w[-1] + sum(w.get(int(v), 0.0) for v in slots[i])
    return sigmoid(z)


def _f1(predicted: np.ndarray, toxic: np.ndarray) -> float:
    return 2 * (predicted & (toxic == 1)).sum() / max(predicted.sum() + (toxic == 1).sum(), 1)


def choose_penalties(slots: list[np.ndarray], toxic: np.ndarray, grid=GRID) -> tuple[float, float, float]:
    """The penalties whose predictions over folds of the training rows have the best F1; the first on a tie."""
    return max(product(*grid), key=lambda p: _f1(fold_scores(slots, toxic, p) >= 0.5, toxic))


def choose_offset(scores: np.ndarray, toxic: np.ndarray, offsets=OFFSETS) -> float:
    """The offset of the log odds of ``fold_scores`` with the best F1; the least on a tie."""
    return max(offsets, key=lambda c: _f1(scores >= sigmoid(np.array(-c)), toxic))


def fit_on_labels(docs: DataFrame, labels: DataFrame, model: CharacterModel) -> dict[int, float]:
    """Learns from rows that are not held out, at most about ``SAMPLE`` of them."""
    weights = fit_scorer(*training_rows(docs, labels, model))
    return weights | {-1: weights[-1] + OFFSET} if len(weights) > 1 else weights


def _model_of(log_p: np.ndarray) -> CharacterModel:
    model = CharacterModel.__new__(CharacterModel)
    model.log_p, model.rows = log_p, log_p.tolist()
    return model


def score_documents(docs: DataFrame, model: CharacterModel, weights: dict[int, float]) -> DataFrame:
    """``docs`` with ``score`` (0 to 1) and ``predicted`` (1 from 0.5 on), in one pass without a shuffle.

    Only the text is looked at.  A null or empty text has the score of a text without words;
    repeated rows score alike; other columns are kept, older ones of the new names replaced.
    """
    sent = docs.sparkSession.sparkContext.broadcast((model.log_p, weights))

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        log_p, weights = sent.value
        reader = Reader(_model_of(log_p), frozenset(weights))
        for texts in batches:
            sums = [weights[-1] + sum(weights[s] for s in sorted(reader.read(t))) for t in texts]
            yield pd.Series(sigmoid(np.array(sums, float)))

    return docs.withColumn("score", score(whole_text())).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit_characters(docs)
    weights = fit_on_labels(docs, table(spark, sf_dir, "labels"), model)
    scored = score_documents(docs.select("doc_id", "text"), model, weights)
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), "score", "predicted")
