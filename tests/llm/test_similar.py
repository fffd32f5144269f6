import random

import numpy as np

from tidemark.llm import similar, simhash
from tests.llm.test_simhash import groups


def shingles(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def made(rnd, bases=6, copies=25):
    out = []
    for _ in range(bases):
        base = ["".join(rnd.choice("abcdefgh") for _ in range(5)) for _ in range(rnd.choice([12, 60, 300]))]
        for _ in range(copies):
            words = list(base)
            for at in rnd.sample(range(len(words)), rnd.randrange(max(2, len(words) // 25))):
                words[at] = "".join(rnd.choice("abcdefgh") for _ in range(5))
            out.append(" ".join(words))
    return out


def test_groups_equal_brute_force_similarity(spark, docs, odd, monkeypatch):
    texts = {i: t for i, t in odd.items() if i != 7} | dict(enumerate(made(random.Random(1)), 10))
    sets = {i: shingles(t) for i, t in texts.items()}
    close = [(a, b) for a in sets for b in sets if a < b and jaccard(sets[a], sets[b]) >= 0.8]
    want = groups(close, sets)
    assert any(jaccard(sets[a], sets[b]) < 0.85 for a, b in close)
    df = docs(texts, extra=True)
    assert {r.doc_id: r.component_id for r in similar.near_copies(df).collect()} == want
    assert {r.doc_id for r in simhash.without_near_duplicates(df).collect()} == set(want.values())
    monkeypatch.setattr(similar, "CELL", 4000)  # groups of 300 words become many cells
    assert {r.doc_id: r.component_id for r in similar.near_copies(df).collect()} == want


def test_six_words_replaced_in_three_hundred_is_a_near_copy(docs):
    rnd = random.Random(2)
    words = [f"w{rnd.randrange(10**6)}" for _ in range(300)]
    changed = [f"new{i}" if i % 50 == 20 else w for i, w in enumerate(words)]
    assert 0.8 <= jaccard(shingles(" ".join(words)), shingles(" ".join(changed))) < 0.85
    assert [r.doc_id for r in simhash.without_near_duplicates(docs([" ".join(words), " ".join(changed)])).collect()] == [0]


def test_null_ids_and_repeated_ids(spark):
    rows = [(None, "a b c d e f"), (None, "a b c d e f"), (3, "a b c d e f"), (3, "z y x w v u"), (None, "only here"), (5, None), (4, " ")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r.doc_id, r.component_id) for r in similar.near_copies(df).collect()), key=str)
    assert got == sorted([(None, 3), (None, 3), (3, 3), (3, 3), (None, None), (5, 4), (4, 4)], key=str)
    assert similar.near_copies(df.limit(0)).count() == 0


def test_pairs_of_similarity_just_above_the_threshold_share_a_band():
    rnd = np.random.default_rng(3)
    for _ in range(500):
        both = rnd.integers(0, 1 << 63, 400, np.uint64)
        a, b = (np.unique(np.concatenate([both, rnd.integers(0, 1 << 63, 50, np.uint64)])) for _ in range(2))
        assert (similar.bands_of(a) == similar.bands_of(b)).any()
