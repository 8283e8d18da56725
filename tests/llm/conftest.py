import pytest


@pytest.fixture(autouse=True, scope="session")
def package_on_workers(spark):
    from cloakwork.llm.registry import ship

    ship(spark)


@pytest.fixture(scope="session")
def documents(spark):
    """A frame of (doc_id, text) with columns whose names could clash."""

    def make(rows):
        full = [(i, t, "x", 1, True, 0.5) for i, t in rows]
        return spark.createDataFrame(full, "doc_id long, text string, id string, n_words int, _kept boolean, score double")

    return make
