"""Fixtures of the training-data operators: awkward documents and helpers."""

import random

import pytest

from henhouse.llm.common import written

DOC_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def awkward_texts(seed: int = 7, n: int = 120) -> list[tuple]:
    """(doc_id, text, lang, source, n_chars): nulls, empty and long texts, ties, repeated
    rows, copies that differ in case, shared passages, multi-byte letters."""
    rng = random.Random(seed)
    vocab = [a + b for a in ("ka", "lé", "mo", "ßu", "ti", "日本", "x") for b in ("r", "n", "on", "é", "")]
    say = lambda k: [rng.choice(vocab) for _ in range(k)]
    passage, boiler = say(60), say(30)
    rows = []
    for i in range(n):
        words = say(rng.choice([0, 1, 4, 5, 8, 19, 20, 21, 40, 150]))
        kind = i % 6
        if kind == 0:
            words = words[:10] + passage + words[10:]
        elif kind == 1:
            words += boiler
        elif kind == 2 and rows and rows[-1][1]:
            words = rows[rng.randrange(len(rows))][1]
            words = words.split() if words else []
            if words:
                words[rng.randrange(len(words))] = rng.choice(vocab)
        elif kind == 3:
            words = (words[:7] or ["a"]) * 9
        text = "".join(w + rng.choice([" ", " ", " ", "\n", "\t", "  "]) for w in words)
        rows.append((i * 3, text, "en", f"s{i % 4}", len(text)))
    rows += [(1, None, None, None, None), (None, "lost id lost id", "en", "s0", 15), (None, None, "en", "s0", 0),
             (4, "", "en", "s0", 0), (7, " \n\t ", "en", "s0", 4), (10, "\x00\x01 odd space   sep", "en", "s0", 20),
             (13, "aaaa " * 400, "en", "s1", 2000), (16, "A" * 30_000 + " end", "en", "s1", 30_004),
             (19, rows[0][1].upper(), "en", "s2", 9), (22, rows[0][1], "en", "s2", 9), (22, rows[0][1], "en", "s2", 9),
             (22, rows[1][1], "en", "s2", 9), (25, " ".join(say(6000)), "en", "s3", 1)]
    rows += [(1000 + i, rows[5][1], "en", "s0", 1) for i in range(25)]
    return rows


@pytest.fixture(scope="session")
def awkward():
    return awkward_texts()


@pytest.fixture(scope="session")
def awkward_docs(spark, awkward):
    """The same as a written table over several files, with a column of a clashing name."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(awkward, DOC_SCHEMA).repartition(4)
    return written(df.withColumn("tie", F.lit("x")).withColumn("length", F.lit(3)).withColumn("kept", F.lit(1)), "awkward")


@pytest.fixture(scope="session")
def no_docs(spark):
    return written(spark.createDataFrame([], DOC_SCHEMA), "empty")
