import pytest


@pytest.fixture(scope="session")
def make(spark):
    """Rows as a DataFrame with an extra column whose name clashes with the operators' own."""

    def made(rows, schema, extra=("text2", "key", "id", "n", "doc")):
        df = spark.createDataFrame(rows, schema)
        from pyspark.sql import functions as F

        return df.withColumns({c: F.lit("x") for c in extra if c not in df.columns})

    return made
