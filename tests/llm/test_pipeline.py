import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tidemark.llm import bpe, lines, mixing, simhash, toxicity

from tests.llm.test_toxicity import made


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("corpus")
    rows = made(500, seed=3)
    rnd = random.Random(4)
    docs = [(i, t.replace(" ", "\n", 3), rnd.choice("abc")) for i, t, *_ in rows]
    docs += [(1000 + i, docs[i][1], "a") for i in range(20)] + [(2000, "", "b"), (2001, None, None)]
    spark.createDataFrame(docs, "doc_id long, text string, source string").select("doc_id", "text", F.lit("en").alias("lang"), "source", F.length("text").cast("long").alias("n_chars")).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, q, t) for i, _, q, t in rows], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path)


def test_stages_do_what_their_operators_say(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, folder).cache()
        seen[name] = (docs, out)
        if name != "bpe":
            assert out.columns == columns and dict(out.dtypes) == dict(docs.dtypes)
        docs = out
    before, after = seen["toxicity"]
    chain = toxicity.train(before, spark.read.parquet(f"{folder}/labels.parquet"))
    keep = {r.doc_id for r in toxicity.score(before, chain).filter("not rejected").collect()}
    assert {r.doc_id for r in after.collect()} == keep and 300 < len(keep) < 450
    before, after = seen["line_dedup"]
    assert after.count() == before.count()
    assert lines.line_classes(after).filter("duplicate").count() == 0
    before, after = seen["near_dedup"]
    groups = simhash.near_duplicates(before, 5).select("component_id").distinct().count()
    assert after.count() == groups
    before, after = seen["mixing"]
    copies = {r.doc_id: r.copies for r in mixing.mix(before).collect()}
    got = [r.doc_id for r in after.collect()]
    assert all(got.count(i) == n for i, n in copies.items())
    before, after = seen["bpe"]
    encoder = bpe.Encoder(bpe.tables(bpe.TOKENIZER))
    texts = {r.doc_id: r.text for r in before.collect()}
    for r in after.collect():
        assert r.ids == encoder.encode(texts[r.doc_id] or "").tolist() and r.n_tokens == len(r.ids)


def test_run_applies_all_stages(spark, folder):
    out = corpus_pipeline.run(spark, folder)
    assert out.columns == ["doc_id", "lang", "source", "n_chars", "n_tokens", "ids", "decoded_sha256"] and out.count() > 100
    assert corpus_pipeline.ORACLE_SQL is None


def test_extra_columns_with_clashing_names_come_through(spark, folder, docs):
    chain = toxicity.train(spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet"))
    df = docs(["one two three four five six", "one two three four five six", "other words stand here in a row"], extra=True)
    steps = [lambda d: toxicity.without_toxic(d, chain), lines.drop_duplicate_lines, simhash.without_near_duplicates, mixing.mixed]
    for step in steps:
        out = step(df)
        assert out.columns == df.columns and {r.gone_id for r in out.collect()} <= {7}
    assert bpe.encode(df).count() == bpe.decode(bpe.encode(df)).count() == 3
