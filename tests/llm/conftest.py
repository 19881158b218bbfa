"""Documents that hold every awkward case, and brute-force helpers."""

import random
import re

import pytest

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, count bigint, name string, h bigint, n string"


def words(text):
    return WORD.findall(text or "")


def row(doc_id, text, lang="en", source="a"):
    return (doc_id, text, lang, source, None if text is None else len(text), 1, "x", 2, "y")


def prose(rng, n, vocabulary=400):
    return " ".join(f"w{int(rng.paretovariate(0.6)) % vocabulary}" for _ in range(n))


@pytest.fixture(scope="session")
def rows():
    rng = random.Random(5)
    passage = prose(rng, 70)
    long_text = prose(rng, 12000)
    out = [row(i, "\n".join(prose(rng, rng.randint(5, 60)) for _ in range(rng.randint(1, 6))), source=rng.choice("abc")) for i in range(60)]
    out += [row(100 + i, prose(rng, 30) + " " + passage + "\n" + prose(rng, 40)) for i in range(6)]
    copied = prose(rng, 90)
    out += [row(200 + i, copied) for i in range(25)]
    out += [row(300 + i, copied + f" tail{i}") for i in range(10)]
    out += [row(400, long_text), row(401, long_text + " end"), row(402, "a " * 300), row(403, "a " * 260 + "b"), row(404, "x y " * 120)]
    out += [row(500, None), row(501, ""), row(502, " \n\t "), row(503, "one"), row(504, "two words\n\n"), row(505, "Ünïcode WÖRDS stay  here\x0b!")]
    out += [row(None, "no id at all but some words " * 4), row(None, None), row(None, copied), row(506, "null source " * 9, None, None)]
    out += [row(7, "repeated row " * 10), row(7, "repeated row " * 10), row(8, "same id, other text " * 12)]
    return out


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
