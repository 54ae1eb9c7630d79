import pytest
from pyspark.sql.types import LongType, StringType, StructField, StructType

ODD = "abc   def"


@pytest.fixture
def make(spark):
    """Documents with columns whose names operators use themselves."""

    def build(rows, **more):
        schema = StructType(
            [
                StructField("doc_id", LongType()),
                StructField("text", StringType()),
                StructField("source", StringType()),
                StructField("lang", StringType()),
                StructField("_id", StringType()),
                StructField("size", StringType()),
                StructField("kept", StringType()),
            ]
        )
        full = [(*r, *[None] * (4 - len(r)), "x", "y", "z") for r in rows]
        return spark.createDataFrame(full, schema)

    return build
