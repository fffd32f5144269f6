import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tidemark.llm import importance


def words_of(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)


def features(text, longest):
    w = words_of(text)
    return Counter(" ".join(w[i : i + n]) for n in range(1, longest + 1) for i in range(len(w) - n + 1))


def brute(rows, target, longest=1, buckets=10000, percent=10, least_words=20, seed=2024):
    """rows: (doc_id, text). (doc_id, n_features, weight, score, rank) of each, the contract in plain loops."""
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = Counter(), Counter()
    for total, texts in ((s, [x for _, x in rows]), (t, target)):
        for text in texts:
            for f, n in features(text, longest).items():
                total[bucket(f)] += n
    gain = {b: math.floor(1000 * math.log((t[b] + 1.0) * (s.total() + buckets) / ((s[b] + 1.0) * (t.total() + buckets)))) for b in s}
    out = []
    for i, (doc, text) in enumerate(rows):
        own = features(text, longest)
        h = int(hashlib.sha256(f"{seed}:{'' if doc is None else doc}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[bucket(f)] * n for f, n in own.items())
        out.append([doc, own.total(), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(words_of(text)), i])
    eligible = sorted((x for x in out if x[5] >= least_words), key=lambda x: (-x[3], -1 if x[0] is None else x[0]))
    for rank, x in enumerate(eligible[: percent * len(eligible) // 100], 1):
        x[4] = rank
    return Counter(tuple(x[:5]) for x in out)


@pytest.fixture(scope="module")
def corpus(odd):
    rnd = random.Random(5)
    pool = [f"w{i}" for i in range(300)] + ["Ünder", "naïve", "the", "The", "x1", "Σίσυφος"]
    texts = list(odd.values()) + [rnd.choice([" ", "-", ", "]).join(rnd.choices(pool, k=rnd.randrange(60))) for _ in range(300)]
    rows = list(enumerate(texts)) + [(7, texts[20]), (20, texts[20]), (20, texts[20]), (None, texts[21]), (None, None)]
    return rows, [" ".join(rnd.choices(pool[:40], k=30)) for _ in range(20)] + [None, "", "unseen words only"]


def tables(spark, rows, target):
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(3) for c in ("id", "block", "gram", "n", "word", "row", "rank", "score", "bucket", "tuple")})
    return docs, spark.createDataFrame([(i, t) for i, t in enumerate(target)], "item_id long, text string").withColumn("id", F.lit("x"))


def got(df):
    return Counter(tuple(r) for r in df.collect())


@pytest.mark.parametrize("longest,buckets", [(1, 10000), (3, 50)])
def test_weights_and_draws_against_loops(spark, corpus, longest, buckets):
    rows, target = corpus
    docs, wanted = tables(spark, rows, target)
    assert got(importance.resample(docs, wanted, longest, buckets)) == brute(rows, target, longest, buckets)


def test_blocks_of_any_size_give_the_same(spark, corpus, monkeypatch):
    rows, target = corpus
    docs, wanted = tables(spark, rows[10:120], target)
    monkeypatch.setattr(importance, "BLOCK_BYTES", 500)
    assert got(importance.resample(docs, wanted, 2, 100, 37)) == brute(rows[10:120], target, 2, 100, 37)


def test_rows_of_one_doc_id_are_ranked_in_several_ranges(spark):
    rows = [(5, "word " * 25)] * 400 + [(i, "other " * 30) for i in range(100)]
    docs, wanted = tables(spark, rows, ["word"])
    df = importance.resample(docs, wanted)
    assert got(df) == brute(rows, ["word"])
    assert sorted(r.rank for r in df.filter("rank is not null").collect()) == list(range(1, 51))


def test_empty_tables(spark, corpus):
    rows, target = corpus
    docs, wanted = tables(spark, rows[:30], target)
    assert importance.resample(docs.limit(0), wanted).count() == 0
    assert got(importance.resample(docs, wanted.limit(0))) == brute(rows[:30], [])


def test_the_draw_leans_to_the_target(spark):
    rows = [(i, ("a b c " if i % 2 else "d e f ") * 8) for i in range(400)]
    docs, wanted = tables(spark, rows, ["a b c"] * 5)
    drawn = importance.resample(docs, wanted).filter("rank is not null").collect()
    assert len(drawn) == 40 and all(r.doc_id % 2 for r in drawn)
