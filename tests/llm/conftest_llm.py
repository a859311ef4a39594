import pytest
from pyspark.sql import types as T

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
                       T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
                       T.StructField("n_chars", T.LongType())])
ODD_TEXTS = [None, "", " \n\t ", "a", "a b c d e", "A a\x0bb\x0cc\rd\x1ce", "x  y   z \n\n  q", "日本語 テキスト, naïve café !",
             "it's we'll 123 4567 ###!!\n   tail  ", "same line\nsame line\n\nother\nsame line", "w " * 30, "x" * 5000]


@pytest.fixture
def table(spark):
    """A documents table of texts (id by position), or of (id, text) or (id, text, lang, source, n_chars) rows."""
    def make(rows, extra=()):
        full = []
        for i, r in enumerate(rows):
            r = r if isinstance(r, tuple) else (i, r)
            full.append((*r, "en", "s", len(r[1] or ""))[:5] if len(r) == 2 else r)
        df = spark.createDataFrame(full, SCHEMA)
        for name in extra:
            df = df.selectExpr("*", f"1 AS `{name}`")
        return df
    return make


@pytest.fixture(scope="session")
def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
