import pytest
from pyspark.sql import SparkSession


@pytest.fixture(scope="session")
def spark():
    s = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "3g")
        .getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    return s


@pytest.fixture(scope="session")
def docs_of(spark):
    """Texts -> documents, with ids from 1 on."""

    def make(texts, ids=None, **extra):  # noqa: ARG001
        rows = [(i, t, "en", "s", None, 0.0) for i, t in zip(ids or range(1, len(texts) + 1), texts)]
        return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score double")

    return make
