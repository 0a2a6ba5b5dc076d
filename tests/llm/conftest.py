import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def make_texts(n: int, seed: int = 3) -> list[str]:
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdefghiklmnoprstuvé") for _ in range(rng.randint(2, 9))) for _ in range(900)]
    sentence = lambda k: " ".join(rng.choices(vocabulary, k=k)).capitalize() + "."
    texts = ["\n".join(sentence(rng.randint(4, 14)) for _ in range(rng.randint(1, 12))) for _ in range(n)]
    shared = sentence(12)
    for i in range(0, n, 6):
        texts[i] += "\n" + shared
    for i in range(5, n, 9):
        texts[i] = texts[i - 5]  # exact copies
    for i in range(7, n, 11):
        texts[i] = texts[i - 7] + " " + vocabulary[i % 900]  # near copies
    return texts


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty, blank and very long texts, repeated rows, ties."""
    texts = make_texts(60)
    rows = [(i, t, "en", "src0", len(t)) for i, t in enumerate(texts)]
    rows += [(100, None, None, None, None), (101, "", "en", "s", 0), (102, " \n\t ", "en", "s", 4), (103, "word", "en", "s", 4), (104, "Two words", "en", "s", 9)]
    long = "\n".join(texts) * 40
    rows += [(105, long, "en", "s", len(long)), (106, "x" * 200_000, "en", "s", 200_000), (103, "word", "en", "s", 4), (107, "a\n\n  a b \n\nc  d ", "en", "s", 12)]
    rows += [(108, "<|endoftext|> x", "en", "s", 15), (109, "some words<|endoftext|>and more", "en", "s", 31)]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def clashing_docs(odd_docs):
    """Columns named like those that operators make on their way."""
    from pyspark.sql import functions as F

    names = ["fp", "text_hash", "n_lines", "n_dropped", "keep_runs", "line", "pos", "key", "b", "row", "rate", "copies", "x", "score", "id", "start", "length", "file", "n", "words", "label"]
    return odd_docs.select("*", *[F.lit("?").alias(n) for n in names])
