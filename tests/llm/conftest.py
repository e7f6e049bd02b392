import random

import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, score double, ids string, fp string, block int, length string, kept int, node int"


def texts():
    """Texts that operators tend to stumble over."""
    rng = random.Random(3)
    word = lambda: "".join(rng.choice(["th", "on", "er", "é", "ing", "a", "中", "ß"]) for _ in range(rng.randint(1, 4)))
    long = " ".join(word() for _ in range(9000))
    prose = [" ".join(word() for _ in range(rng.randint(20, 160))) for _ in range(30)]
    return [
        None, "", " ", "\n\n \t\n", "a", "'", "x" * 30_000, "1" * 5000, "@" * 300, "a.b" * 900, "word " * 400, "It's we'll they're DON'T 'tis x'y \n  end ",
        "nul \0 and \u0085 and   space​ 😀👍🏽 ﻿", "<|endoftext|> a <|endoftext|><|endof", "same\nsame\nsame\n\n\nother", long, *prose, prose[0], prose[1], prose[1] + " x",
    ]


@pytest.fixture(scope="session")
def rows():
    """Documents with nulls in every column, repeated rows and ids, and columns whose names operators use."""
    out = [(i, t, ["en", "de", None][i % 3], "s", len(t or ""), 0.5, "x", "y", 1, "z", 0, 7) for i, t in enumerate(texts())]
    last = out[-1]
    return [*out, last, last, (last[0], "another text of the same id", *last[2:]), (None, "no id", *[None] * 10), (None, None, *[None] * 10)]


@pytest.fixture(scope="session")
def docs(spark, rows, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("edge") / "docs")
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def labels(spark, rows):
    made = [(r[0], (r[0] or 0) % 2, (r[0] or 0) % 3 == 0) for r in rows] + [(0, 1, True), (None, None, None), (5, None, None), (7, 9, None)]
    return spark.createDataFrame([(i, q, int(t) if t is not None else None) for i, q, t in made], "doc_id bigint, quality int, toxic int")


@pytest.fixture(scope="session")
def no_labels(spark):
    return spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
