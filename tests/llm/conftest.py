import hashlib
import re

import pytest

SPACE = re.compile(rb"[^\x20\x09-\x0D]+")
ALNUM = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

#: Nulls, empty and blank texts, one word, ties, a repeated row, no doc_id, and columns whose names clash with the operators' own.
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, words string, n_words string, key string, host string, label string, items string, row string"


def space_words(text):
    return [w.decode() for w in SPACE.findall((text or "").encode())]


def space_words_lower(text):
    return space_words((text or "").translate(UPPER))


def alnum_words(text):
    return ALNUM.findall((text or "").translate(UPPER))


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


@pytest.fixture(scope="session")
def sf_docs(spark, sf_dir):
    """doc_id -> text of the whole small table."""
    return {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()}


@pytest.fixture(scope="session")
def edge(spark):
    """A table of odd rows around given texts."""

    def build(*texts, start=100):
        odd = [(1, None), (2, ""), (3, " \t\n "), (4, "word"), (None, "no id " * 30), (5, "tie one two"), (6, "tie one two"), (6, "tie one two"), (7, "ünï — 漢字 \U0001f600 İ ß")]
        rows = [*odd, *((start + i, t) for i, t in enumerate(texts))]
        wide = [(i, t, None, "s" if i else None, None, "w", "x", "k", "h", "l", "i", "r") for i, t in rows]
        return spark.createDataFrame(wide, SCHEMA)

    return build
