"""Tables that every operator must take: nulls, empty and long texts, ties, repeated rows, clashing column names."""

DATA = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _id string, _k string, _text string, kept string"
LONG = " ".join(f"word{i % 977} of {i}." for i in range(30_000))
SAME = "The quick brown fox jumps over the lazy dog while seven wise owls watch from the old oak tree near the river. " * 3
EDGES = [
    (1, SAME, "en", "a", 5, "x", "y", "z", "k"),
    (1, SAME, "en", "a", 5, "x", "y", "z", "k"),
    (1, "another text with the id one", "en", None, None, None, None, None, None),
    (2, None, None, None, None, None, None, None, None),
    (3, "", "en", "a", 0, "x", "y", "z", "k"),
    (None, SAME + "and more", "en", "b", 5, "x", "y", "z", "k"),
    (None, None, None, None, None, None, None, None, None),
    (4, LONG, "en", "b", 1, "x", "y", "z", "k"),
    (5, "é", "fr", "c", 1, "x", "y", "z", "k"),
    (6, "\n\n \t\n", "de", "c", 1, "x", "y", "z", "k"),
    (7, SAME.upper(), "en", "a", 5, "x", "y", "z", "k"),
    (8, "🙂 \x00 ▁ ümlaut </s>[INST]", "de", "a", 5, "x", "y", "z", "k"),
]


def edges(spark):
    return spark.createDataFrame(EDGES, SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def documents(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


def texts(df):
    return [(r.doc_id, r.text or "") for r in df.select("doc_id", "text").collect()]
