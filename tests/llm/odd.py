"""Small frames with everything that an operator has to survive."""

from pyspark.sql import functions as F

LONG = " ".join(f"w{i % 977}x{i % 31}" for i in range(60_000)) + "\n" + "é" * 5000
TEXTS = [None, "", " \t\n", "one", "one two", "ONE two", "the same words here again and again, once more for luck now",
         "the same words here again and again, once more for luck now", "\x00\x01 ퟿ \U0001F642 漢字 kana かな",
         "12 34 56", "a\r\n\r\nWARC/1.1\r\nContent-Length: 5\r\n\r\nb", LONG, LONG, "### $$$ %%%", "   　\xa0x\x85y  "]
#: Names that operators use inside.
CLASHING = ["score", "n", "row", "part", "label", "token", "x", "pair", "chunk", "key", "keys", "slot", "held_out", "start",
            "digest", "_name", "_md5", "_id", "component_id", "block", "ids", "prefix", "quality", "lang_pred", "flag"]


def docs(spark, clashing=True):
    """Rows with null and repeated ids, and columns with clashing names."""
    rows = [(i, t, ["en", "fr", None][i % 3], None if i % 4 == 0 else f"s{i % 2}", len(t or "")) for i, t in enumerate(TEXTS)]
    rows += [rows[6], rows[1], (None, "no id here at all, but some words to go with it anyway", "de", None, None), (None, None, None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return df.withColumns({c: F.lit(f"other {c}") for c in CLASHING}) if clashing else df


def empty(spark):
    return docs(spark).limit(0)


def labels(spark):
    rows = [(i, i % 2, 0) for i in range(10)] + [(3, 0, None), (4, None, 1), (None, 1, 0), (99, 1, 1)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int").withColumn("x", F.lit(1)).withColumn("label", F.lit(7))
