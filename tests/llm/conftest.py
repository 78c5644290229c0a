import pytest
from pyspark.sql import types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
                     T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])


@pytest.fixture
def make_docs(spark):
    """Documents from (doc_id, text) pairs."""
    def make(rows, clash=False):
        df = spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in rows], DOCS)
        if clash:  # names that operators use themselves
            from pyspark.sql import functions as F
            df = df.withColumns({c: F.lit("x") for c in ("rid", "fp", "sid", "line", "n", "ids", "score", "shard", "slot", "id", "tokens", "component_id", "_rid", "_gone", "gone", "blank")})
        return df

    return make
