import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, slot long, shard string, n_bytes string, rank string, kept string"


def words(seed: int, n: int) -> str:
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 9))) for _ in range(n))


@pytest.fixture(scope="session")
def edge_rows():
    """Nulls, empty and very long texts, copies, near copies, ties, repeated rows, odd characters."""
    base, passage = words(1, 300), words(2, 120)
    near = base.replace(base.split()[100], "changed", 1)
    texts = [
        (1, base), (2, base), (3, near), (4, None), (5, ""), (6, " \n\t "), (7, "one"), (8, words(3, 80) + " " + passage), (9, passage + "\n" + words(4, 90)),
        (10, words(5, 20000)), (11, "x" * 90000), (12, "naïve café 中文 \U0001f600 <|endoftext|> é z"), (13, "line a b c\nline a b c\n" + "spam " * 60), (14, "UP!! " * 40 + "### $$$ %%% " * 20),
        (15, base), (15, words(6, 50)), (15, words(6, 50)), (None, words(7, 40)), (None, None), (16, "the end. " * 3000), (17, words(8, 3)), (18, base.upper()), (19, "a\x0bb\x0cc d\re"),
    ]
    return [(d, t, "en", f"s{(d or 0) % 3}" if d != 7 else None, len(t or ""), 5, "q", "n", "r", "k") for d, t in texts]


@pytest.fixture(scope="session")
def edge(spark, edge_rows):
    return spark.createDataFrame(edge_rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
