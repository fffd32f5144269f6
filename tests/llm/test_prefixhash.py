import hashlib
import random

from tidemark.llm import prefixhash as P


def test_spans_and_extensions():
    rnd = random.Random(1)
    powers = P.Powers()
    for _ in range(60):
        a = "".join(rnd.choice("ab😀") for _ in range(rnd.randrange(1, 80)))
        b = "".join(rnd.choice("ab😀") for _ in range(rnd.randrange(1, 80)))
        x, y = P.Prefixes(P._codes(a), powers), P.Prefixes(P._codes(b), powers)
        for _ in range(40):
            i, j = rnd.randrange(len(a)), rnd.randrange(len(b))
            n = rnd.randrange(min(len(a) - i, len(b) - j) + 1)
            assert P.same_span(x, i, y, j, n) == (a[i : i + n] == b[j : j + n])
            m = 0
            while i + m < len(a) and j + m < len(b) and a[i + m] == b[j + m]:
                m += 1
            assert P.common_extension(x, i, y, j) == m
        length = rnd.randrange(1, len(a) + 1)
        assert [int(h) for h in x.all_spans(length)] == [x.span(i, length) for i in range(len(a) - length + 1)]


def test_hashes_are_the_polynomials():
    p = P.Prefixes(P._codes("xabcx"), P.Powers())
    want = 0
    for base in P.BASES:
        want = want << 31 | sum((ord(c) + 1) * pow(base, i, P.PRIME) for i, c in enumerate("abc")) % P.PRIME
    assert p.span(1, 3) == want


def test_every_document_meets_the_next(docs, odd, monkeypatch):
    rnd = random.Random(2)
    texts = dict(odd) | {i: "".join(rnd.choice("abcdefgh ") for _ in range(rnd.randrange(400))) for i in range(10, 90)}
    for rows in (7, 1000):
        got = {r.doc_id: r for r in in_buckets(docs(texts, extra=True), rows, monkeypatch)}
        order = sorted(texts, reverse=True)
        assert set(got) == set(texts)
        for n, i in enumerate(order):
            text, after = texts[i] or "", texts[order[(n + 1) % len(order)]] or ""
            edited = text[: len(text) - len(text) // 2] + after[: len(text) // 2]
            r = got[i]
            assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
            assert (r.fingerprint == r.edited_fingerprint) == (text == edited)
            assert 0 <= r.near_next <= 1 and (text != after or r.near_next == 1)
            if len(text) > 200 and len(after) > 200:
                assert 0.3 < r.near_edited < 0.75
        assert got[3].fingerprint == got[4].fingerprint


def in_buckets(df, rows, monkeypatch):
    plain = P.in_order
    monkeypatch.setattr(P, "in_order", lambda d: plain(d, rows))
    out = P.compare_with_next(df).collect()
    monkeypatch.setattr(P, "in_order", plain)
    return out


def test_likeness_of_equal_halved_and_unrelated_texts():
    rnd = random.Random(3)
    make = P.Fingerprints()
    a, b = ("".join(rnd.choice("abcdefghij ") for _ in range(3000)) for _ in range(2))
    sketch = lambda t: make.of(t)[2]
    assert P.likeness(sketch(a), sketch(a)) == 1
    assert 0.35 < P.likeness(sketch(a), sketch(a[:1500] + b[:1500])) < 0.65
    assert P.likeness(sketch(a), sketch(b)) < 0.05
    assert P.likeness(sketch(""), sketch("")) == 1 and P.likeness(sketch(""), sketch("x")) == 0
    assert (P.parse(make.of(a)[1]) == sketch(a)).all()


def test_null_ids_repeats_and_empty_tables(spark, docs):
    df = spark.createDataFrame([(None, "n"), (1, "a"), (1, "a"), (2, "b")], "doc_id long, text string")
    assert P.compare_with_next(df).count() == 4
    assert P.compare_with_next(df.limit(0)).count() == 0
    assert P.fingerprints(docs({1: "x"})).first().n_chars == 1


def test_likeness_against_the_exact_share_of_spans():
    """The sketch of 64 estimates Dice similarity of the span sets: within 0.25 for each pair here, and within 0.07 on average."""
    rnd = random.Random(11)
    make, errors = P.Fingerprints(), []
    spans = lambda t: {t[i : i + P.SPAN] for i in range(max(1, len(t) - P.SPAN + 1))}
    for _ in range(150):
        a = "".join(rnd.choice("abcdefghij é") for _ in range(rnd.randrange(20, 1500)))
        keep = rnd.randrange(len(a) + 1)
        b = a[:keep] + "".join(rnd.choice("abcdefghij é") for _ in range(rnd.randrange(0, 800)))
        x, y = spans(a), spans(b)
        errors.append(abs(P.likeness(make.of(a)[2], make.of(b)[2]) - 2 * len(x & y) / (len(x) + len(y))))
    assert max(errors) < 0.25 and sum(errors) / len(errors) < 0.07
