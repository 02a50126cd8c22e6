import random

import pytest

WORDS = [f"w{i}" for i in range(400)]


def text(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) for _ in range(n))


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, rank int, spans string, body string, id long, key string"


@pytest.fixture(scope="session")
def frame(spark):
    """Documents from (doc_id, text), with extra columns that bear names the operators use inside."""

    def make(rows):
        return spark.createDataFrame([(i, t, "en", "s", len(t or ""), 1, "x", "b", 7, "k") for i, t in rows], SCHEMA)

    return make


@pytest.fixture
def space(spark):
    from streamloom.llm._cluster import Workspace

    return Workspace(spark, "test")
