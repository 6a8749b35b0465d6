import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def corpus():
    """(doc_id, text): prose with copies, near copies, shared passages, short and odd texts."""
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(300)] + ["Él", "straße", "naïve", "The", "the,"]
    prose = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    rows = [(i, prose(rng.randint(5, 200))) for i in range(60)]
    base, passage = prose(120).split(" "), prose(40)
    for i in range(60, 100):
        near = list(base)
        for _ in range(rng.randint(0, 6)):
            near[rng.randrange(120)] = rng.choice(vocabulary)
        rows.append((i, " ".join(near)))
    rows += [(i, f"{prose(rng.randint(3, 60))} {passage} {prose(rng.randint(3, 60))}") for i in range(100, 130)]
    rows += [(i, rows[5][1]) for i in range(130, 140)]
    rows += [(140, ""), (141, None), (142, " \n\t"), (143, "one two"), (144, "ONE  two"), (145, "a b c d e"), (146, prose(9000)), (147, "x" * 50_000), (148, "\u00a0\u3000 odd\u2003spaces"), (149, "tail  \n\n")]
    return rows


@pytest.fixture(scope="session")
def documents(spark, corpus):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in corpus], SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def labels(spark, corpus):
    rows = [(i, 0 if i >= 140 else 1, 0) for i, _ in corpus if i % 2 == 0]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


@pytest.fixture(scope="session")
def odd_documents(spark):
    """Nulls in every column, repeated rows, and extra columns whose names operators use inside."""
    rows = [(None, None, None, None, None, 1, 2, b"x", 3.0), (None, "a b c d e f", "en", None, 3, 1, 2, None, None), (7, None, None, "s", None, None, None, b"", 1.0)]
    rows += [(8, " ".join(f"t{i}" for i in range(40)), "en", "s", 9, 1, 1, b"y", 0.0)] * 3
    rows += [(9, " ".join(f"t{i}" for i in range(40)) + " more", "en", "s", 9, 1, 1, b"y", 0.0), (10, "", "en", "s", 0, 0, 0, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, _k1 long, k2 long, _spans binary, key double")
