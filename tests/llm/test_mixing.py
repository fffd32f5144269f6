import random

import pytest

from tidemark.llm import mixing


def targets(sizes):
    """Share and reshare by weight, as the contract words it."""
    names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    left, out, open_ = float(sum(sizes.values())), dict.fromkeys(names, 0.0), list(names)
    while open_ and left > 1e-9:
        share = left / sum(weight[s] for s in open_)
        full = [s for s in open_ if out[s] + share * weight[s] >= 3 * sizes[s]]
        if not full:
            for s in open_:
                out[s] += share * weight[s]
            break
        for s in full:
            left -= 3 * sizes[s] - out[s]
            out[s] = 3.0 * sizes[s]
        open_ = [s for s in open_ if s not in full]
    return out


def test_targets_and_words_taken(docs):
    rnd = random.Random(1)
    texts = {i: " ".join("w" * rnd.randrange(1, 4) for _ in range(int(rnd.expovariate(0.02)))) for i in range(3000)}
    sources = {i: rnd.choice(["b", "b", "b", "b", "a", "C", "é", None]) for i in texts}
    sources[0], texts[0] = "tiny", "one two"
    sources[1], texts[1] = "void", ""
    texts[2] = None
    df = docs(texts, sources, extra=True)
    rows = mixing.mix(df).collect()
    assert len(rows) == len(texts)
    sizes = {}
    for i, t in texts.items():
        sizes[sources[i]] = sizes.get(sources[i], 0) + len((t or "").split())
    want, taken = targets(sizes), dict.fromkeys(sizes, 0)
    for r in rows:
        assert r.size == len((texts[r.doc_id] or "").split()) and r.source_size == sizes[r.source]
        assert r.target == pytest.approx(want[r.source])
        assert r.taken == r.copies * r.size and 0 <= r.copies <= 3
        rate = want[r.source] / sizes[r.source] if sizes[r.source] else 0
        assert r.copies in (int(rate), int(rate) + 1)
        taken[r.source] += r.taken
    for s in sizes:
        assert abs(taken[s] - want[s]) <= max(0.02 * want[s], 60), s
    assert sorted(map(tuple, rows), key=str) == sorted(map(tuple, mixing.mix(df).collect()), key=str)


def test_rows_are_repeated_as_often_as_taken(docs):
    texts = {i: f"w{i} x y" for i in range(60)}
    df = docs(texts, {i: "ab"[i > 50] for i in texts})
    copies = {r.doc_id: r.copies for r in mixing.mix(df).collect()}
    got = [r.doc_id for r in mixing.mixed(df).collect()]
    assert {i: got.count(i) for i in texts} == copies
    assert mixing.mixed(df).columns == df.columns


def test_sizes_split_at_ascii_white_space_only(docs):
    got = {r.doc_id: r.size for r in mixing.mix(docs(["a b c", "a\x0bb\x0cc\rd", " ", " ", None])).collect()}
    assert got == {0: 2, 1: 4, 2: 1, 3: 0, 4: 0}


def test_empty_tables_and_repeats(spark, docs):
    assert mixing.mix(docs(["x"]).limit(0)).count() == 0
    df = spark.createDataFrame([(1, "a b", "s"), (1, "a b", "s"), (None, "c", None)], "doc_id long, text string, source string")
    assert len(mixing.mix(df).collect()) == 3
