"""Small tables with the awkward cases that every corpus operator must take."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

SMALL = "/root/testdata/sf0.001"
LONG = ("alpha beta gamma delta epsilon zeta eta theta " * 4000 + "\n") * 3
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")

ROWS = [
    (1, "one two three four five six seven"),
    (2, None),
    (3, ""),
    (4, "one two three four five six seven"),
    (4, "one two three four five six seven"),
    (5, "  \n\t "),
    (None, "no id at all here"),
    (None, None),
    (6, LONG),
    (7, "é è ü 你好 \U0001F600 mixed\r\ntext"),
    (8, "one two three four five six seven eight"),
    (9, "x" * 30000),
]


def table(spark, rows=ROWS, clash=()):
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("lang", F.lit("en")).withColumn("source", F.lit("s"))
    for name in clash:
        df = df.withColumn(name, F.lit("clash"))
    return df.repartition(3)


def empty(spark, clash=()):
    return table(spark, ROWS, clash).where("1 = 0")


def fold(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def words(text):
    return WORD.findall(fold(text))
