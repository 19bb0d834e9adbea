import random

import pytest

WORDS = "the of and to in is that for with as was on are by this from or an be at stone river window garden market letter morning engine silver paper travel winter summer doctor forest bridge castle planet pencil".split()


def prose(rnd, n):
    out = []
    while len(out) < n:
        k = min(rnd.randint(5, 14), n - len(out))
        line = [rnd.choice(WORDS) + (str(rnd.randrange(99)) if rnd.random() < 0.25 else "") for _ in range(k)]
        out += line
        out[-1] += "."
    return " ".join(out).replace(". ", ".\n")


@pytest.fixture(scope="session")
def texts():
    """Texts with copies, near copies, shared passages and odd ones."""
    rnd = random.Random(17)
    base = [prose(rnd, rnd.choice([3, 20, 80, 150, 300])) for _ in range(40)]
    passage = prose(rnd, 60)
    near = []
    for b in base[:12]:
        w = b.split(" ")
        for i in rnd.sample(range(len(w)), max(1, len(w) // 60)):
            w[i] = "changed"
        near.append(" ".join(w))
    mixed = [b[: len(b) // 2] + "\n" + passage + "\n" + b[len(b) // 2 :] for b in base[20:28]]
    odd = [None, "", " \n\t ", "one", "two words", "a" * 3000, "ab" * 900, "é" * 400, "x\x0by\x0cz", "word " * 400, "日本語テキスト " * 30, "Ünïcode " * 60]
    return [*base, *base[:6], *near, *mixed, *odd]


@pytest.fixture(scope="session")
def docs(spark, texts):
    """doc_id, text and columns whose names clash with those of results; one row is there twice."""
    rows = [(i, t, "en", f"src{i % 3}", len(t or ""), "x", -1, True) for i, t in enumerate(texts)]
    rows.append(rows[3])
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, spans string, n_tokens int, kept boolean").repartition(3).cache()


@pytest.fixture(scope="session")
def none(docs):
    return docs.limit(0)
