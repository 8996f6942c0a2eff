import pytest

WIDE = "doc_id long, text string, ids int, score double, key string, n int, digest string, `__x.y` string, `TEXT` string, `Doc_Id` int"


@pytest.fixture(scope="session")
def docs_of(spark):
    """Documents with extra columns whose names clash with those that operators use inside."""

    def make(rows, parts=2):
        full = [(i, t, 7, 0.5, "k", 1, "d", None, "other", 3) for i, t in rows]
        return spark.createDataFrame(full, WIDE).repartition(parts)

    return make


@pytest.fixture(scope="session")
def small(spark):
    return "/root/testdata/sf0.001"
