"""A small corpus with the awkward cases: nulls, empties, ties, repeats, long texts, clashing columns."""

from __future__ import annotations

import random

import pytest

LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def lowered(text: str | None) -> bytes:
    return (text or "").encode().translate(LOWER)


def words(rng: random.Random, n: int) -> str:
    syllables = "an er the of ing ion ou re th sh é ñ ü".split()
    return " ".join("".join(rng.choice(syllables) for _ in range(rng.randint(1, 4))) for _ in range(n))


def corpus() -> list[tuple]:
    rng = random.Random(9)
    shared = words(rng, 120)
    rows = [(i, words(rng, rng.randint(1, 300)), "en") for i in range(30)]
    rows += [(30, None, None), (31, "", "en"), (32, " \n\t ", "en"), (None, "no id here at all", "en"), (33, "One Two", "en"), (34, "one two", "en")]
    base = words(rng, 200).split(" ")
    for i in range(35, 45):
        edited = list(base)
        for _ in range(i - 35):
            edited[rng.randrange(len(edited))] = "x" * rng.randint(1, 4)
        rows.append((i, " ".join(edited), "de"))
    rows += [(45 + i, f"{words(rng, 40 + i)}\n{shared}\n{words(rng, 40)}", "fr") for i in range(6)]
    rows += [(60, rows[0][1], "en"), (60, rows[0][1], "en")]
    rows += [(61, "a" * 3000, "xx"), (62, words(rng, 12) + " " + "ab" * 900, "xx"), (63, words(rng, 9000), "en"), (64, "the  double  space ", "en"), (65, "\n".join(["same line of text here"] * 60), "en")]
    return rows


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, rid long, `class` string"


@pytest.fixture(scope="session")
def rows():
    return corpus()


@pytest.fixture(scope="session")
def docs(spark, rows, tmp_path_factory):
    """Written and read back, so that plans scan files; extra columns have the names that operators use inside."""
    path = str(tmp_path_factory.mktemp("docs") / "documents.parquet")
    spark.createDataFrame([(i, t, g, None, None if t is None else len(t), 1, "c") for i, t, g in rows], SCHEMA).repartition(3).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
