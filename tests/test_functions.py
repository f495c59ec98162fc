from pyspark.sql import functions as F

from sievewright.functions import text as X
from sievewright.functions.tokens import token_count, token_count_regex, truncate

PATHS = {"a/b.py": ".py", "a/b.PY": ".py", "x/.bashrc": "", "q/Makefile": "", "d.e/f": "", "a.java": ".java", "b.cs": ".cs", "c.go": ".go", None: None}


def test_suffix(spark):
    df = spark.createDataFrame([(p,) for p in PATHS], "p string")
    assert {r["p"]: r["s"] for r in df.select("p", X.suffix(F.col("p")).alias("s")).collect()} == PATHS
    assert {r["p"] for r in df.where(X.parseable(F.col("p"))).collect()} == {"a/b.py", "a/b.PY", "a.java", "b.cs"}


def test_tokens(spark):
    df = spark.createDataFrame([("",), ("abcd",), ("abcde",), (None,), ("ä" * 9,)], "t string")
    assert [r[0] for r in df.select(token_count(F.col("t"))).collect()] == [0, 1, 2, 0, 3]
    assert [r[0] for r in df.select(truncate(F.col("t"), 1)).collect()] == ["", "abcd", "abcd", None, "ä" * 4]
    assert [r[0] for r in spark.createDataFrame([("a, b1",)], "t string").select(token_count_regex(F.col("t"))).collect()] == [3]


def test_text(spark):
    df = spark.createDataFrame([("\t a\r\nb  \n",), ("",), (None,)], "t string")
    t = F.col("t")
    rows = df.select(X.universal_newlines(t), X.right_trim(t), X.is_blank(t), X.indentation(t), X.newlines(t), X.byte_slice(t, 0, 2)).collect()
    assert tuple(rows[0]) == ("\t a\nb  \n", "\t a\r\nb", False, "\t ", 2, bytearray(b"\t "))
    assert rows[1][2] and rows[2][2]
    e = spark.createDataFrame([("m", "p", "c"), ("m", None, None), (None, None, "c")], "m string, p string, c string")
    assert [r[0] for r in e.select(X.error_text(F.col("m"), F.col("p"), F.col("c"))).collect()] == ["m [File: p] (Original exception: c)", "m", " (Original exception: c)"]
