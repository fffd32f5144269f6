import random
import re

import xxhash

from tidemark.llm import simhash
from tidemark.llm.components import components


def plain(text):
    text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def groups(pairs, nodes):
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_fingerprints_and_groups_equal_brute_force(docs, odd):
    rnd = random.Random(1)
    base = " ".join("".join(rnd.choice("aeioubcd") for _ in range(4)) for _ in range(150)).split()
    texts = dict(odd)
    for i in range(10, 130):
        words = list(base) if i % 3 else [rnd.choice(base) for _ in range(30)]
        for _ in range(rnd.randrange(4)):
            words[rnd.randrange(len(words))] = rnd.choice(["x", "Yy", "zzz"])
        texts[i] = " ".join(words)
    got = {r.doc_id: r for r in simhash.near_duplicates(docs(texts, extra=True)).collect()}
    prints = {i: plain(t) for i, t in texts.items()}
    assert {i: r.fp % 2**64 for i, r in got.items()} == prints
    close = [(a, b) for a in prints for b in prints if a < b and (prints[a] ^ prints[b]).bit_count() <= 4]
    assert {i: r.component_id for i, r in got.items()} == groups(close, prints)


def test_large_buckets_are_split_into_cells(spark, monkeypatch):
    monkeypatch.setattr(simhash, "CELL", 8)
    rnd = random.Random(2)
    base = rnd.getrandbits(63)
    fps = list({base ^ sum(1 << b for b in rnd.sample(range(60), rnd.randrange(5))) for _ in range(300)})
    links = [tuple(r) for r in simhash.near_links(spark.createDataFrame([(f,) for f in fps], "fp long")).collect()]
    assert all((a ^ b).bit_count() <= 4 for a, b in links)
    close = [(a, b) for a in fps for b in fps if a < b and (a ^ b).bit_count() <= 4]
    assert groups(links, fps) == groups(close, fps)
    assert len(set(links)) < len(close)


def test_components_of_a_long_path_and_of_nothing(spark):
    n = 300
    links = spark.createDataFrame([(i, i + 1) for i in range(n)] + [(1000, 1000), (None, 5)], "a long, b long")
    assert {r.node: r.root for r in components(links, "a", "b").collect()} == {i: 0 for i in range(n + 1)}
    assert components(links.limit(0), "a", "b").count() == 0


def test_null_ids_repeated_rows_and_empty_tables(spark, docs):
    df = spark.createDataFrame([(None, "a b c d e"), (3, "a b c d e"), (3, "a b c d e"), (None, "x")], "doc_id long, text string")
    got = sorted(((r.doc_id, r.component_id) for r in simhash.near_duplicates(df).collect()), key=str)
    assert got == sorted([(None, 3), (3, 3), (3, 3), (None, None)], key=str)
    assert simhash.near_duplicates(df.limit(0)).count() == 0
    assert simhash.without_near_duplicates(docs(["a b c d e f"] * 3 + ["z y x w v u"])).count() == 2
