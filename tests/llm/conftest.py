import random

import pytest

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, n int, key string, p double, component string"


def corpus(seed=5):
    """Awkward documents: nulls, empties, white space, copies, near copies, shared passages, repeats, one very long text."""
    r = random.Random(seed)
    vocabulary = ["".join(r.choice("abcdeé'") for _ in range(r.randint(1, 6))) for _ in range(300)]
    prose = lambda n: " ".join(r.choice(vocabulary) for _ in range(n))
    shared, base = prose(70), prose(200)
    near = base.split()
    near[100] = "changed"
    texts = [
        None, "", " \n\t ", "one", "Two words", prose(60), shared + " " + prose(30), prose(25) + "\n" + shared, base, base.upper(), base.replace(" ", "  \n"), " ".join(near),
        "same line here\n" * 40, "word " * 120, prose(4000), prose(40) + " " + shared, base, "don't we'll '' 's x's   y 123abc \r\n\r\n…日本 é", "a" * 3000, "tab\tand\x1cother\x0bspace",
    ]
    rows = [(i, x, r.choice(["en", "fr", None]), r.choice(["s0", "s1", None]), None if x is None else len(x)) for i, x in enumerate(texts)]
    rows += [rows[8], rows[8], (None, base, "en", "s0", 1), (None, None, None, None, None), (7, prose(80), "en", "s1", 2)]  # repeated rows, no id, one id twice
    return [(*x, 1, "k", 0.5, "c") for x in rows]


@pytest.fixture(scope="session")
def rows():
    return corpus()


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, COLUMNS).repartition(3)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], COLUMNS)
