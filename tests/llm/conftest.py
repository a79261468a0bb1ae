import os
import random
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def edge_rows():
    """Nulls, empty and long texts, ties, copies, near copies, shared passages, odd characters."""
    rng = random.Random(5)
    vocabulary = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(1, 7))) for _ in range(400)]
    say = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    passage, base = say(60), say(300)
    texts = [None, "", " ", "\t\n", "a", "A b\tc", "a b c", "A  b c", "12 34", say(20), say(19), say(21), "é ñ 漢字 😀   x", "\x00 z", say(9000)]
    texts += [base] * 6 + [base.upper(), base.replace(" ", "  ")]
    for _ in range(25):
        w = base.split()
        for _ in range(rng.randint(0, 12)):
            w[rng.randrange(len(w))] = rng.choice(vocabulary)
        texts.append(" ".join(w))
    texts += [f"{say(rng.randint(0, 40))} {passage} {say(rng.randint(0, 40))}" for _ in range(12)]
    texts += [f"{passage} {passage}", "x " * 100, "x " * 50, "x y " * 40]
    texts += [say(rng.randint(1, 200)) for _ in range(30)]
    rng.shuffle(texts)
    return [(3 * i + 1, t, None if i % 7 == 0 else ("en", "de")[i % 2], None if i % 11 == 0 else f"s{i % 5}", None) for i, t in enumerate(texts)]


@pytest.fixture(scope="session")
def edge_docs(spark, edge_rows):
    return spark.createDataFrame(edge_rows, SCHEMA).repartition(5).checkpoint()


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def clashing(edge_docs):
    """Extra columns whose names might meet those that operators use."""
    from pyspark.sql import functions as F

    names = ["_id", "_text", "_digest", "size", "kept", "keep_id", "h", "start", "length", "rank", "shard", "target", "page_id", "spans", "text2", "_n"]
    return edge_docs.withColumns({n: F.lit("x") for n in names})


@pytest.fixture(scope="session")
def small(spark, data_dir):
    return spark.read.parquet(f"{data_dir}/documents.parquet")
