"""Small documents with every odd case: nulls, empty and long texts, ties, repeated rows, extra columns."""

from __future__ import annotations

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row_number long, shard int"


def make_documents(seed: int = 5, n: int = 240) -> list[tuple]:
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)] + ["Été", "naïve", "Σigma", "don't", "<|endoftext|>", "12", "3.5", "#"]
    rows = []
    texts = []
    for i in range(n):
        kind = i % 12
        if kind == 0 and texts:
            text = rng.choice(texts)  # an exact copy
        elif kind in (1, 2) and texts:
            own = rng.choice(texts).split(" ")
            for _ in range(max(1, len(own) // 60)):  # a near copy
                own[rng.randrange(len(own))] = rng.choice(words)
            text = " ".join(own)
        else:
            text = " ".join(rng.choice(words) for _ in range(rng.choice([1, 2, 5, 30, 80, 150, 300])))
            if kind == 3:
                text = text.upper()
            if kind == 4:
                text = "\n".join([text, text, "\t\x0b ", "a b c a b c"])
        texts.append(text)
        rows.append((i * 3, text, "en", ["s0", "s0", "s0", "s1", None, "s2"][i % 6], len(text), i, 1))
    rows += [(9001, None, None, None, None, 0, 0), (9002, "", "en", "s1", 0, 0, 0), (9003, " \t\n", "en", "s1", 3, 0, 0)]
    rows += [(None, "a text without an id", "en", "s0", 20, 0, 0), (9004, "long " * 20_000, "en", "s0", 100_000, 0, 0)]
    rows += [rows[10], rows[10]]  # repeated rows
    return rows


@pytest.fixture(scope="session")
def rows():
    return make_documents()


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def labels(spark, rows):
    known = [(r[0], 0 if len(set((r[1] or "").split())) < 12 else 1, 0) for r in rows if r[0] is not None]
    return spark.createDataFrame([*known, (None, 1, 0), (1, None, None)], "doc_id long, quality int, toxic int")
