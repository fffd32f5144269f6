import random

import numpy as np
from pyspark.sql import functions as F

from tidemark.llm import toxicity as X

BAD = ["idiot", "scum", "loser"]


def made(n, seed=1):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        words = ["".join(rnd.choice("aeioubcdfg") for _ in range(rnd.randrange(2, 6))) for _ in range(60)]
        toxic, low = rnd.random() < 0.2, rnd.random() < 0.2
        if low:
            words[5:15] = ["CLICK!!"] * 10
        for _ in range(2 * toxic):
            words[rnd.randrange(60)] = rnd.choice(BAD) + rnd.choice(["", ",", "."])
        rows.append((i, " ".join(words), int(not low), int(toxic)))
    return rows


def test_held_out_accuracy(spark):
    rows = made(1500)
    docs = spark.createDataFrame([(i, t, "x") for i, t, *_ in rows], "doc_id long, text string, links string")
    labels = spark.createDataFrame([(i, q, t) for i, _, q, t in rows[:1000]], "doc_id long, quality int, toxic int")
    chain = X.train(docs, labels)
    assert [x.name for x in chain.links] == ["low_quality", "toxic"] and len(chain.links[1].earlier) == 1
    got = {r.doc_id: r for r in X.score(docs, chain).collect()}
    held = rows[1000:]
    assert np.mean([got[i].rejected == bool(t) for i, _, _, t in held]) > 0.99
    assert np.mean([(got[i].p_low_quality > 0.5) == (q == 0) for i, _, q, _ in held]) > 0.97
    again = X.score(docs, X.train(docs, labels)).agg(F.sum("p_toxic")).first()[0]
    assert again == sum(r.p_toxic for r in X.score(docs, chain).collect()) or abs(again - sum(r.p_toxic for r in got.values())) < 1e-9


def test_a_later_link_uses_the_earlier_probability():
    rnd = np.random.default_rng(2)
    rows = [np.array(sorted(rnd.choice(200, 20, replace=False))) for _ in range(1200)]
    first = np.array([int(5 in r or 7 in r) for r in rows])
    labels = np.stack([first, first], axis=1)
    chain = X.fit_chain(["a", "b"], rows, labels, np.arange(1200) % 5)
    assert chain.links[1].earlier[0] > 0.3


def test_bounded_sample_and_no_labels(spark, docs, odd):
    rows = made(400)
    df = spark.createDataFrame([(i, t) for i, t, *_ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, q, t) for i, _, q, t in rows] + [(None, 1, 1), (3, None, 1)], "doc_id long, quality int, toxic int")
    assert len(X.train(df, labels, fit_rows=100).links) == 2
    chain = X.train(df, labels.limit(0))
    got = X.score(docs(odd, extra=True), chain).collect()
    assert len(got) == len(odd) and not any(r.rejected for r in got)
    assert X.score(docs(odd).limit(0), chain).count() == 0

def test_repeated_documents_are_fitted_once(spark):
    rows = made(300)
    df = spark.createDataFrame([(i, t) for i, t, *_ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, q, t) for i, _, q, t in rows], "doc_id long, quality int, toxic int")
    one, many = X.train(df, labels), X.train(df.unionByName(df.filter("doc_id < 50")).unionByName(df.filter("doc_id = 7")), labels)
    for a, b in zip(one.links, many.links):
        assert np.array_equal(a.buckets, b.buckets) and np.allclose(a.weights, b.weights) and a.bias == b.bias
