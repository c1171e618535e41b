import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def make(spark, tmp_path_factory):
    """A documents table, written, from (doc_id, text) pairs."""
    if not spark.conf.get("spark.checkpoint.dir", None):
        spark.conf.set("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))

    def build(pairs, **extra):
        rows = [(i, t, "en", f"src{(i or 0) % 3}", len(t or "")) for i, t in pairs]
        df = spark.createDataFrame(rows, SCHEMA)
        from pyspark.sql import functions as F

        for name, value in extra.items():
            df = df.withColumn(name, F.lit(value))
        return df

    return build


def prose(seed, n, vocabulary=400):
    rnd = random.Random(seed)
    words = [f"w{rnd.randrange(10**6):x}" for _ in range(vocabulary)]
    return [rnd.choice(words) for _ in range(n)]


@pytest.fixture(scope="session")
def corpus():
    """Odd and copied texts: nulls, empty, blank, short, long, repeated, near copies, shared passages."""
    rnd = random.Random(7)
    base = prose(1, 300)
    shared = " ".join(prose(2, 60))
    out = [(1, " ".join(base)), (2, None), (3, ""), (4, " \n\t "), (5, "one"), (6, "one two"), (7, "One two")]
    for i in range(10, 40):
        w = list(base)
        for _ in range(rnd.randrange(0, 30)):
            w[rnd.randrange(len(w))] = f"x{rnd.randrange(10**6)}"
        out.append((i, " ".join(w)))
    for i in range(40, 60):
        own = prose(100 + i, rnd.randrange(20, 200), 900)
        at = rnd.randrange(len(own))
        out.append((i, " ".join(own[:at]) + (" " + shared + "\n" if i % 2 else " ") + " ".join(own[at:])))
    out += [(60, "Und " * 300), (61, "a" * 700), (62, "a" * 99), (63, "aé" * 400), (64, " ".join(prose(3, 6000, 3000)))]
    out += [(70 + i, " ".join(base)) for i in range(5)] + [(64, out[-1][1])]
    return out
