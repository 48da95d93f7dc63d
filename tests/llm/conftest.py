import random
import re

import pytest

#: Columns whose names operators use for their own; they must not get in the way.
CLASHES = "key string, vid string, size string, hash string, copies string, group string, marks string, label string, _row string, _kept string, _copies string, doc string, row string, ids string, print string, part string, n string, `a.b` string"
N_CLASHES = CLASHES.count(",") + 1
SCHEMA = f"doc_id long, text string, lang string, source string, n_chars long, {CLASHES}"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def odd_texts():
    """Null, empty, blank, short, long, repeated, near and partly shared texts."""
    r = random.Random(5)
    pool = ["alpha", "Beta", "gamma", "délta", "ε", "zeta.", "eta,", "theta", "iota", "KAPPA", "Λ", "mu", "nu", "xi"] + [f"w{i}" for i in range(400)]
    prose = lambda n: " ".join(r.choice(pool) for _ in range(n))
    long, passage = prose(3000), prose(60)
    near = long.split()
    texts = [None, "", " \t\n", "one", "one two", "ONE two", "a b c d e", "a b c d e", "x" * 5000, "é" * 300, "\0\x1c\x85 nul", long, long, long.upper(), " ".join(near[:1500] + ["other"] + near[1500:])]
    texts += [prose(80) + " " + passage + " " + prose(80) for _ in range(6)] + [prose(r.randint(1, 200)) for _ in range(40)]
    texts += ["| ".join(pool[:60]), "### ".join(pool[:70]), "\n".join(["All rights reserved."] + [prose(20)] * 4), "same " * 100]
    return texts


@pytest.fixture(scope="session")
def odd(spark):
    rows = [(i * 3, t, "en", [None, "a", "b", "c"][i % 4], len(t or ""), *["z"] * N_CLASHES) for i, t in enumerate(odd_texts())]
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def nulls(spark):
    return spark.createDataFrame([(None,) * (5 + N_CLASHES), *[(i, "text", *[None] * (3 + N_CLASHES)) for i in (None, 4, 4)]], SCHEMA)
