import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, doc string, tag string, vs string, size string, h string, ids string, score string"


def odd_rows():
    """Nulls in any column, empty and long texts, ties, repeated rows, odd white space, near and exact copies."""
    rng = random.Random(5)
    vocabulary = ["".join(rng.choice("abcdefghijkl") for _ in range(rng.randint(2, 9))) for _ in range(400)]
    base = [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(30, 120))) for _ in range(40)]
    texts = list(base)
    near = base[0].split()
    near[3] = "changed"
    texts += [" ".join(near), base[1], base[1], base[2] + " " + base[3], None, "", " ", "\t\n", "a", "One two", "é" * 60, "x" * 49, "x" * 50, "y z  w\x1c!", "<|endoftext|> Ab <|", " ".join(base * 30)]
    rows = [(i, t, "en" if i % 3 else None, None if i % 7 == 0 else f"s{i % 4}", None if t is None else len(t)) for i, t in enumerate(texts)]
    rows += [(5, texts[5], "en", "s1", 1), (5, texts[5], "en", "s1", 1), (6, texts[7], "en", "s1", 1), (None, texts[8], None, None, None), (None, None, None, None, None)]
    return [(*r, "d", "t", "v", "z", "h", "i", "s") for r in rows]


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def odd_dir(odd, tmp_path_factory):
    """The odd rows as a documents table beside a labels table."""
    path = tmp_path_factory.mktemp("odd")
    odd.write.parquet(f"{path}/documents.parquet")
    spark = odd.sparkSession
    rows = [(i, i % 3 > 0, 0) for i in range(0, 40)] + [(None, True, 0), (3, None, None), (9999, True, 1)]
    spark.createDataFrame([(a, None if b is None else int(b), c) for a, b, c in rows], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path)


@pytest.fixture(scope="session")
def none_dir(none, tmp_path_factory):
    path = tmp_path_factory.mktemp("none")
    none.write.parquet(f"{path}/documents.parquet")
    none.sparkSession.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    none.sparkSession.createDataFrame([], "vec_id long, embedding array<float>, label int").write.parquet(f"{path}/embeddings.parquet")
    return str(path)
