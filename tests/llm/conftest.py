import random

import pytest

WORDS = ["ta", "ri", "no", "sel", "um", "ka", "der", "lo", "mi", "ent", "été", "straße", "x1"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp string, id long, anchor string"


def passage(rng, n):
    return " ".join("".join(rng.choice(WORDS) for _ in range(rng.randint(1, 3))) for _ in range(n))


@pytest.fixture(scope="session")
def rows():
    """Nulls, empties, white space, a very long text, ties, copies, near copies, repeated rows and ids."""
    rng = random.Random(4)
    texts = [None, "", "", " \n\t ", "one", "one two", "ONE two", passage(rng, 6000)]
    base = [passage(rng, rng.randint(5, 220)) for _ in range(40)]
    texts += base + base[:6]
    for t in base[6:14]:
        w = t.split()
        w[len(w) // 2] = "edited"
        texts.append(" ".join(w))
    shared = passage(rng, 90)
    texts += [passage(rng, 30) + "\n" + shared + "\n" + passage(rng, 20) for _ in range(4)]
    texts += ["abc " * 300, "z" * 1500]
    out = [(i, t, "en", f"s{i % 3}", len(t or ""), "clash", -i, "clash") for i, t in enumerate(texts)]
    return [*out, out[9], (None, "no id here", None, None, None, None, None, None)]


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
