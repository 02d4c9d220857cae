"""The stages in turn over a small corpus, each against a plain version on its own input; and the registered queries."""

from __future__ import annotations

import random
from collections import Counter

import pytest

import corpus_pipeline
from wayfield.llm import bpe, queries

from . import brute

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    r = random.Random(9)
    good, junk = [f"word{k}" for k in range(300)], ["BUY!!!", "$$$", "CLICK", "FREE!!!", "http", "WIN"]
    rows, labels = [], []
    for k in range(400):
        y = int(k % 4 != 0)
        rows.append((k, " ".join(r.choice(good if y else junk) for _ in range(r.randint(20, 60))), "en", r.choice(["web", "book"])))
        labels.append((k, y, 0))
    for k in range(400, 430):  # copies and near copies
        text = rows[(k - 400) * 4 + 1][1]
        rows.append((k, text if k % 2 else text + " more", "en", "web"))
    rows += [(430, None, "en", "web"), (431, "", "en", None), (432, rows[1][1], None, None)]
    out = tmp_path_factory.mktemp("sf")
    spark.createDataFrame([(d, x, lang, s, None if x is None else len(x)) for d, x, lang, s in rows], DOCUMENTS).write.parquet(f"{out}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{out}/labels.parquet")
    return str(out)


def test_stages_in_turn(spark, sf_dir, tmp_path):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality classifier", "exact dedup", "n-gram Jaccard join", "mixing sources", "BPE encoding"]
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    seen = [[tuple(r) for r in docs.collect()]]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        df = stage(spark, docs, sf_dir)
        if k < 4:
            assert df.columns == docs.columns
        df.write.parquet(path := str(tmp_path / str(k)))
        docs = spark.read.parquet(path)
        seen.append([tuple(r) for r in docs.collect()])
    raw, good, distinct, near, mixed, encoded = seen
    assert {r[0] for r in raw if r[0] % 4} - {430, 431} <= {r[0] for r in good} and not {r[0] for r in good} & set(range(0, 400, 4))
    first: dict = {}
    for r in good:
        if r[1] is not None:
            first[r[1]] = min(first.get(r[1], r[0]), r[0])
    assert Counter(r[0] for r in distinct) == Counter(list(first.values()) + [r[0] for r in good if r[1] is None])
    gone = brute.not_least([r[:2] for r in distinct], 0.6)
    assert gone and sorted(r[0] for r in near) == sorted(r[0] for r in distinct if r[0] not in gone)
    # texts without a token, which may be all that their source has, stay too
    assert {r[0] for r in mixed} == {r[0] for r in near} and not Counter(r[0] for r in near) - Counter(r[0] for r in mixed)
    assert Counter(r[0] for r in encoded) == Counter(r[0] for r in mixed)
    back = {r.doc_id: r.text for r in bpe.decode(docs).collect()}
    assert back == {r[0]: r[1] for r in mixed}


def test_run_is_the_stages(spark, sf_dir):
    out = corpus_pipeline.run(spark, sf_dir)
    assert out.columns == ["doc_id", "source", "n_tokens", "tokens"] and out.count() > 200


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query_takes_the_whole_table(spark, sf_dir, name):
    rows = queries.QUERIES[name](spark, sf_dir).collect()
    whole = {"op2_bpe", "op3_token_counts", "op8_lm_scoring"}
    assert not whole & {name} or sorted(r.doc_id for r in rows) == list(range(433))


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_its_sql(spark, name):
    from tests.oracle import TESTDATA, difference

    assert difference(spark, queries.QUERIES[name], queries.SQL[name], f"{TESTDATA}/sf0.001") == ""
