import pytest

from incidentlens.session import prepare


@pytest.fixture(scope="session")
def corpus(spark):
    """The session with what the corpus queries set."""
    prepare(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    return spark
