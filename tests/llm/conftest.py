import random

import pytest


@pytest.fixture(scope="session")
def corpus(spark):
    """Rows (doc_id, text, source, text-like extra columns) with nulls, empty and long texts, ties, repeats and near copies."""
    r = random.Random(5)
    vocabulary = ["".join(r.choice("abcdefgh") for _ in range(r.randint(2, 7))) for _ in range(400)]
    rows = [(k, " ".join(r.choice(vocabulary) for _ in range(r.randint(1, 90))), r.choice(["web", "book", None])) for k in range(120)]
    for k in range(120, 170):  # near copies
        words = rows[k % 25][1].split()
        words[r.randrange(len(words))] = "changed"
        rows.append((k, " ".join(words), "web"))
    rows += [(170, rows[3][1], "book"), (171, rows[3][1], "web"), (3, rows[3][1], "web"), (172, None, "web"), (173, "", None), (174, " .,; ", "web"), (None, "a null identifier", "web"), (None, None, None), (175, "one", "book"), (176, "One", "book")]
    rows += [(177, " ".join(r.choice(vocabulary) for _ in range(30_000)), "web"), (178, "é ü ñ 漢字 don't we'll  \n\n x\t" * 5, "book"), (179, "x" * 5000, "web"), (180, rows[5][1], "web"), (180, rows[6][1], "web")]
    return rows


@pytest.fixture(scope="session")
def docs(spark, corpus, tmp_path_factory):
    """The rows as a table with further columns of clashing names."""
    rows = [(*r, k, f"e{k}", 1.0, k) for k, r in enumerate(corpus)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, n long, key string, size double, rep long").repartition(3)
    df.write.parquet(path := str(tmp_path_factory.mktemp("docs") / "documents.parquet"))
    return spark.read.parquet(path)


@pytest.fixture(scope="session")
def empty(spark, docs, tmp_path_factory):
    docs.limit(0).write.parquet(path := str(tmp_path_factory.mktemp("empty") / "documents.parquet"))
    return spark.read.schema(docs.schema).parquet(path)
