import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import decontaminate


def words_of(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)


def brute(docs, items, window=10, shingle=5, share=1.0):
    """Every window against every place of every document."""
    windows = [("" if i is None else str(i), w[a : a + window]) for i, w in ((i, words_of(t)) for i, t in items) for a in range(max(len(w) - window + 1, min(len(w), 1)))]
    out = Counter()
    for doc, text in docs:
        w, hit, found = words_of(text), set(), set()
        for item, win in windows:
            k = min(len(win), shingle)
            places = range(len(win) - k + 1)
            for a in range(len(w) - len(win) + 1):
                there = w[a : a + len(win)]
                if there == win or share < 1 and sum(there[p : p + k] == win[p : p + k] for p in places) >= max(1, math.ceil(len(places) * share)):
                    hit |= set(range(a, a + len(win)))
                    found.add(item)
        out[doc, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)] += 1
    return out


def tables(spark, docs, items):
    more = {c: F.lit(3) for c in ("row", "at", "item", "window", "words", "shingle", "start", "n_hit", "class", "r")}
    return spark.createDataFrame(docs, "doc_id long, text string").withColumns(more), spark.createDataFrame(items, "item_id long, text string").withColumns(more)


def got(df):
    return Counter(tuple(r) for r in df.collect())


@pytest.fixture(scope="module")
def corpus(odd):
    rnd = random.Random(8)
    pool = [f"w{i}" for i in range(8)] + [f"v{i}" for i in range(300)] + ["naïve", "Σίσυφος"]
    say = lambda n, some=pool: " ".join(rnd.choices(some, k=n))
    items = [(i, say(rnd.choice([1, 3, 4, 5, 7, 9, 10, 11, 25, 60]), pool[8:])) for i in range(40)]
    items += [(40, "the same frame stands in front of very many items " + say(12)), (41, "The same frame, stands in front of very many items! " + say(5)), (41, say(30)), (None, say(14)), (None, None), (43, ""), (44, "  \n"), (45, "w1 w1 w1 w1 w1 w1 w1 w1 w1 w1 w1 w1"), (46, "İ")]
    texts = [t for _, t in odd.items() if t is None or len(t) < 1000]
    for i in range(120):
        parts = [say(rnd.randrange(30), pool[:8] if i % 3 else pool)]
        for _ in range(rnd.randrange(3)):
            w = words_of(rnd.choice(items)[1])
            a = rnd.randrange(max(1, len(w) - 8))
            piece = w[a : a + rnd.choice([8, 9, 10, 11, 30, 60])]
            if piece and rnd.random() < 0.3:
                piece[rnd.randrange(len(piece))] = "changed"
            parts += [rnd.choice([" ", ", "]).join(piece).upper() if rnd.random() < 0.2 else " ".join(piece), say(rnd.randrange(5))]
        texts.append(" ".join(parts))
    docs = list(enumerate(texts)) + [(7, texts[20]), (30, texts[30]), (30, texts[30]), (None, texts[31])]
    return docs, items


@pytest.mark.parametrize("window,shingle,share", [(10, 5, 1.0), (10, 3, 1.0), (7, 9, 1.0), (10, 3, 0.6), (12, 1, 0.75)])
def test_hits_against_every_window_at_every_place(spark, corpus, window, shingle, share):
    docs, items = corpus
    want = brute(docs, items, window, shingle, share)
    assert sum(n for row, n in want.items() if row[-1]) > 20 and sum(n for row, n in want.items() if not row[-1]) > 5
    assert got(decontaminate.contamination(*tables(spark, docs, items), window, shingle, share)) == want


def test_a_full_sieve_changes_nothing(spark, corpus, monkeypatch):
    docs, items = corpus
    monkeypatch.setattr(decontaminate, "sieve", lambda shingles: np.full(4096, 255, np.uint8))
    assert got(decontaminate.contamination(*tables(spark, docs[:60], items))) == brute(docs[:60], items)


def test_long_texts_and_many_copies(spark):
    item = " ".join(f"i{i}" for i in range(50))
    long = " ".join(f"x{i % 977}" for i in range(200_000)) + " " + item
    docs = [(i, "before " + item + " after") for i in range(600)] + [(1000, long), (1001, " ".join([item] * 40))]
    rows = {r.doc_id: r for r in decontaminate.contamination(*tables(spark, docs, [(3, item), (4, item)])).collect()}
    assert all(rows[i].n_hit == 50 and rows[i].n_items == 2 for i in [*range(600), 1000])
    assert rows[1001].n_hit == rows[1001].n_words == 2000


def test_empty_tables(spark, corpus):
    docs, items = tables(spark, *corpus)
    assert decontaminate.contamination(docs.limit(0), items).count() == 0
    assert got(decontaminate.contamination(docs, items.limit(0))) == brute(corpus[0], [])
