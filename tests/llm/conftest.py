import os
import random

import pytest


@pytest.fixture(scope="session")
def texts():
    """A few hundred invented texts with copies, near copies, junk, empty and null ones."""
    rnd = random.Random(3)
    words = ["".join(rnd.choice("bdfgklmnprstv") + rnd.choice("aeiou") for _ in range(rnd.randint(1, 4))) for _ in range(400)]
    out = [" ".join(rnd.choices(words, k=rnd.randint(30, 160))) + "." for _ in range(150)]
    for k in range(25):
        edited = out[k].split()
        edited[len(edited) // 2] = "anders"
        out.append(" ".join(edited) if k % 2 else out[k])
    passage = " ".join(rnd.choices(words, k=120))
    out += [f"{out[i][:200]} {passage} {out[i + 1][:150 + i]}" for i in range(30, 45)]
    return out + ["", "", None, "ä", "x" * 3000, "ab " * 900, "ß\n\t ¿Qué?  1d10t"]


@pytest.fixture(scope="session")
def docs(spark, texts):
    """Documents with repeated and null ids and with columns named like the operators' own."""
    rows = [(i, t, "en" if i % 3 else "de", "s", len(t or "")) for i, t in enumerate(texts)]
    rows += [rows[5], (None, texts[7], None, None, None), (None, None, None, None, None)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, score string, part int, kept int, selected int, key int, row int, n long"
    return spark.createDataFrame([(*r, "own", -1, 7, 8, 9, 10, 11) for r in rows], schema).repartition(3)


@pytest.fixture(scope="session")
def none(docs):
    return docs.limit(0)


@pytest.fixture(scope="session")
def sf():
    return os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
