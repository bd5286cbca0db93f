"""Documents with nulls, empty and long texts, repeated rows and columns whose names the operators use themselves."""

from pyspark.sql import functions as F

LONG = " ".join(f"word{k % 977} {k % 13}" for k in range(20_000))
PROSE = "One two three four five six seven eight nine ten.\n" * 3 + " ".join(f"plain{k}" for k in range(60))
ROWS = [
    (1, PROSE, "en", "a", 10),
    (1, PROSE, "en", "a", 10),
    (2, PROSE, "en", "a", None),
    (3, None, "en", "b", 0),
    (4, "", None, None, 0),
    (5, " \n\t ", "de", "a", 4),
    (6, "word", "de", "a", 4),
    (7, LONG, "en", "b", len(LONG)),
    (8, "écoute l'été 漢字 🙂 á ſ\x1cx\x85y", "fr", "b", None),
    (9, "12345 ... !!!", None, "a", 13),
    (None, "no id at all, but words", "en", "a", 23),
]
CLASHES = ["row", "w", "n", "h", "t", "host", "digest", "slot", "key", "node", "band", "good", "target", "word", "sketch", "length", "kept", "score"]


def odd_documents(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string, lang string, source string, n_chars long")
    return docs.withColumns({c: F.lit(f"own {c}") for c in CLASHES})


def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (1, 1, None), (7, 0, 0), (8, None, 1), (None, 1, 0)], "doc_id long, quality int, toxic int")
