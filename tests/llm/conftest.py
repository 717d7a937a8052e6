import random

import pytest
from pyspark.sql import types as T

#: Documents with every awkward column: null and repeated ids, null and empty texts, names that clash with inner ones.
SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
    T.StructField("size", T.StringType()), T.StructField("key", T.LongType()), T.StructField("h", T.StringType()),
    T.StructField("bits", T.StringType()), T.StructField("run", T.StringType()), T.StructField("score", T.StringType()),
    T.StructField("spans", T.StringType()), T.StructField("node", T.StringType()), T.StructField("place", T.StringType()),
])


def prose(rng: random.Random, words: int, letters: str = "aeiostrn") -> str:
    return " ".join("".join(rng.choice(letters) for _ in range(rng.randint(2, 8))) for _ in range(words))


def awkward_rows() -> list[tuple]:
    rng = random.Random(4)
    base = [prose(rng, rng.randint(5, 150)) for _ in range(30)]
    passage = prose(rng, 120)
    texts = base + base[:5] + [base[6]] * 6  # exact copies
    for t in base[8:14]:  # near copies: one word replaced
        words = t.split()
        words[len(words) // 2] = "changed"
        texts.append(" ".join(words))
    texts += [f"{t}\n{passage}\n{prose(rng, 9)}" for t in base[14:18]]
    texts += [None, None, "", "", " \n\t ", "x", "A", "a", "é日🙂 ünï", "Ünï <|endoftext|> x", "0" * 900, "ab" * 900,
              "word " * 700, prose(rng, 4000), "one two", "One Two", "tab\tand  spaces\r\n end ", "\x01 \x00 \x1c"]
    rows = [(i, t, ["en", "de", None][i % 3], ["b", "a", None, "Z"][i * i % 4], len(t or "")) for i, t in enumerate(texts)]
    rows += [rows[3], rows[3], (None, base[2], None, None, None), (None, "no id", "en", "a", 5)]
    return [(*r, "s", 7, "h", None, "r", "x", "p", None, "q") for r in rows]


@pytest.fixture(scope="session")
def awkward(spark):
    return spark.createDataFrame(awkward_rows(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def tokenizer():
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")
