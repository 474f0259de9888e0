"""Inputs that several tests share."""

import random

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, seed bigint, hash string, n_words int"


def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def prose(n, seed, vocabulary=400):
    r = random.Random(seed)
    return " ".join(f"{r.choice('abcdeé')}{r.randrange(vocabulary)}" + ("\n" if r.random() < 0.05 else "") for _ in range(n))


def awkward(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows, copies, and columns with clashing names."""
    a, b, c = prose(120, 1), prose(300, 2), prose(90, 3)
    texts = [
        (0, None), (1, ""), (2, " \t\n "), (3, "word"), (4, a), (5, a), (5, a), (None, a), (6, a + " tail " + b), (7, b[:700] + " " + c),
        (8, c + " " + c), (9, "x" * 5000), (10, "x" * 5000), (11, "é" * 300 + "     ü"), (12, prose(30000, 4, 30000)), (13, "A b\nA b\n\nA b\nc"),
        (14, b), (None, None), (15, prose(60, 5) + "\n" + a[100:400]), (16, "y " * 400), (17, "\x00\x01 z\x0b\x0c" + c), (18, "Hello 123 ***"),
    ]
    return spark.createDataFrame([(i, t, None, None, None, 1, "h", 2) for i, t in texts], SCHEMA)
