"""Plain counterparts that the tests share."""

import re
import zlib

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"

#: Odd texts: null, empty, blank, one word, ties, controls, other scripts, astral planes, separators.
ODD = [None, "", " \n\t\r\x0b\x0c ", "word", "one two three four five six", "one two three four five six", "ünï ÇÖDÉ 日本語 🙂   a b", "a\r\nb\x00c", "x" * 3000, "<|endoftext|> [UNK] </s> ", "-" * 70, "1 2 3\n" * 40]


def words(text):
    return WORD.findall(text or "")


def fold(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 4


def odd_docs(spark, clash=False):
    rows = [(i, t, "en" if i % 3 else None, "src1" if i % 2 else None, len(t or "")) for i, t in enumerate(ODD)]
    rows += [rows[4], (None, "a row without an id " * 20, None, None, None)]
    docs = spark.createDataFrame(rows, DOCS)
    if clash:  # names that operators use inside
        for c in ("id", "w", "fp", "h", "lid", "row", "doc", "n", "label", "kept", "__row", "__h", "cap", "budget", "length"):
            from pyspark.sql import functions as F

            docs = docs.withColumn(c, F.lit(1))
    return docs


def empty_docs(spark):
    return spark.createDataFrame([], DOCS)
