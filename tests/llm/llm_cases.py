"""Rows that every operator must handle: nulls, empty and long texts, ties, repeated rows, clashing columns."""

import duckdb

SF = "/root/testdata/sf0.001"
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that operators use inside.
CLASHING = ("fp", "size", "u", "copies", "copy", "row", "taken_id", "root", "key", "choice", "block", "bucket", "range", "length", "piece",
            "slots", "label", "draw", "digest", "n", "score", "kept", "held_out", "next", "part", "rank", "order", "bin", "windows")
LONG = " ".join(f"word{i % 977} of{i % 31}" for i in range(40_000))
EDGE = [
    (1, None, "en", "a", 0), (2, "", "en", "a", 0), (3, " \n\t ", None, None, None), (4, LONG, "en", "b", len(LONG)),
    (5, "one two three", "en", "a", 13), (5, "one two three", "en", "a", 13), (None, "one two three", None, "b", None),
    (7, "ONE two three", "de", "é", 13), (8, "x" * 3000, "en", None, 3000), (9, "a b c d e f g h i j k l m\na b c\na b c", "en", "b", 1),
    (10, "naïve \U0001F600  text with marks", "fr", "\U0001F600", 3), (-11, "one  two\r\nthree four five six seven", "en", "a", 1),
]


def edge(spark):
    from pyspark.sql import functions as F
    return spark.createDataFrame(EDGE, COLUMNS).repartition(3).withColumns({c: F.lit("clash") for c in CLASHING})


def empty(spark):
    return spark.createDataFrame([], COLUMNS)


def texts(sf=SF):
    return dict(duckdb.sql(f"SELECT doc_id, text FROM '{sf}/documents.parquet'").fetchall())


def same_as_sql(spark, fn, sql, sf=SF):
    import compare
    status, message = compare.compare(spark, compare.duck(sf), fn.__name__, fn, sql, sf)
    assert status == "ok", message
