from __future__ import annotations

import os
import random

import pytest

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def tables(spark):
    if not os.path.isdir(DATA):
        pytest.skip("no tables here")
    return lambda name: spark.read.parquet(f"{DATA}/{name}.parquet")


@pytest.fixture
def docs(spark):
    """Makes documents (doc_id, text, lang, source, n_chars), with a column whose name an operator uses itself."""

    def make(rows):
        full = [(i, t, "en", "s", None if t is None else len(t), 7) for i, t in rows]
        return spark.createDataFrame(full, "doc_id bigint, text string, lang string, source string, n_chars bigint, segments int")

    return make


def prose(seed: int, n: int, words: int = 4000) -> str:
    r = random.Random(seed)
    return " ".join(f"w{r.randrange(words):x}q" for _ in range(n))


#: Texts that every operator has to take: null, empty, blank, one character, no word, odd Unicode, very long.
ODD = [None, "", " \n\t ", "x", "!!! ...", "é́ ퟿ \U0001f600 \u0000 İ ß ﬁ", "lorem " * 60_000, "a" * 300_000]
