import pytest

from panelspark.llm.common import ship_package

# Columns with names that the operators use inside.
SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, node string, g string, score double, `row` string, "
          "shard int, component string, `key` string")


@pytest.fixture(autouse=True)
def _shipped(spark):
    ship_package(spark)


@pytest.fixture
def make_docs(spark):
    def make(texts, ids=None, sources=None):
        ids = list(range(len(texts))) if ids is None else ids
        sources = ["s"] * len(texts) if sources is None else sources
        rows = [(i, t, "en", s, None if t is None else len(t), "x", "y", 0.5, "z", 7, "c", "k") for i, t, s in zip(ids, texts, sources)]
        return spark.createDataFrame(rows, SCHEMA)
    return make

