import random

import pytest


@pytest.fixture(scope="session")
def documents(spark, sf_dir):
    """The test documents with hard rows beside them, and columns whose names an operator might use."""
    rnd = random.Random(3)
    base = [rnd.choice("abcdefgh") * rnd.randint(1, 3) for _ in range(1500)]
    texts = [
        None, "", " ", "\n\n", "...!", "a  b", "A b", "a B", "don't I'll  it 's\n x", "é☃ 😀<|endoftext|> a　b   c",
        "x" * 9000, "ab " * 200, "ab " * 70, "one two three", "under the MIT license\nunder the mit license",
        "mail a.b+c@mail.example.com or +49 30 123456 7, 10.0.0.1 and 4111 1111 1111 1111",
    ]
    for _ in range(25):
        at = rnd.randint(0, 1300)
        words = base[at : at + rnd.randint(40, 400)]
        for _ in range(rnd.randint(0, 3)):
            words[rnd.randrange(len(words))] = f"zz{rnd.random()}"
        texts.append(" ".join(words))
    whole = [f"w{rnd.randint(0, 10**6)}" for _ in range(200)]
    for _ in range(30):
        words = list(whole)
        for _ in range(rnd.randint(0, 9)):
            words[rnd.randrange(len(words))] = f"q{rnd.random()}"
        texts.append(" ".join(words))
    rows = [(10**6 + i, t, None, 1, "k") for i, t in enumerate(texts)]
    rows += [(2 * 10**6, "repeated row with some words in it", "en", 2, "k")] * 2
    given = spark.read.parquet(f"{sf_dir}/documents.parquet").selectExpr("doc_id", "text", "lang", "1 as words", "'k' as key")
    hard = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, words int, key string")
    return given.unionByName(hard)


@pytest.fixture(scope="session")
def rows(documents):
    return documents.collect()


@pytest.fixture(scope="session")
def nothing(documents):
    return documents.limit(0)
