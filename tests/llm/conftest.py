import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, _text string, _gone int, _k string"


def corpus(n=60, seed=1):
    """Rows with nulls, empty and long texts, copies, near copies, shared passages and repeated rows."""
    random.seed(seed)
    vocabulary = ["".join(random.choice("abcdefg") for _ in range(random.randint(1, 6))) for _ in range(300)]
    line = lambda k: " ".join(random.choice(vocabulary) for _ in range(k))
    passage = "\n".join(line(random.randint(3, 20)) for _ in range(6))
    texts = ["\n".join(line(random.randint(1, 25)) for _ in range(random.randint(1, 8))) for _ in range(n)]
    texts[3] = texts[2]
    texts[5] = texts[4] + " extra"
    for k in (10, 20, 30, 31):
        texts[k] = texts[k] + "\n" + passage + "\n\n" + line(5)
    texts[12] = (line(30) + "\n") * 4
    texts[13] = "same same same same same same same same same same same same"
    texts[14], texts[15], texts[16], texts[17] = None, "", " \t\n\x0b ", "one two"
    texts[18] = "One TWO"
    texts[40] = "\n".join(line(12) for _ in range(2000))
    texts[41] = "#$% <b> | " * 30 + "ÀÉ 🙂 漢字"
    rows = [(k, t, "en", "src0", len(t or ""), "own", k, "k") for k, t in enumerate(texts)]
    return [*rows, rows[7], (None, "a null id has words too", "en", "s", 23, None, None, None), (9, "another text of nine", "en", "s", 20, "x", 1, None)]


@pytest.fixture(scope="session")
def rows():
    return corpus()


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS).repartition(5)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOCS)
