import pytest
from pyspark.sql import types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
                     T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])

#: Names that the operators use inside, as columns of a table that has nothing to do with them.
CLASHES = ["fp", "class", "ids", "open", "part", "token", "_id", "_text", "_label", "score", "keep_id", "recipe", "_gone", "n", "a", "b", "node", "_t", "_w", "blocks", "rank",
           "verdict", "_host", "_features", "prediction", "chunk", "first", "component_id"]


@pytest.fixture
def documents(spark):
    def make(texts, ids=None, langs=None, extra=False):
        rows = [(i if ids is None else ids[i], t, langs[i] if langs else "en", "s", len(t or "")) for i, t in enumerate(texts)]
        df = spark.createDataFrame(rows, DOCS)
        if extra:
            from pyspark.sql import functions as F
            df = df.select("*", *[F.lit("x").alias(c) for c in CLASHES])
        return df

    return make


#: Null, empty, blank, one word, repeated, long, odd characters: every operator takes these.
HARD = [None, "", " \t\n\x0b\x0c\r ", "word", "word", "Word word word", "a b", "x" * 70_000, "lorem ipsum dolor " * 9_000, "\U0001f600 ́é", "12 34 ...", "Ünter den Größen\nñandú",
        "K İ K I", "a b c", "  two  spaces  ", "\n\n\n"]
