import random
import re
from itertools import permutations

from pyspark.sql import functions as F

from tidemark.llm import filteraudit


def brute(rows, labels):
    """rows: (doc_id, text, lang); labels: (doc_id, quality, toxic). The contract in plain loops."""
    flags = []
    for doc, text, lang in rows:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        fails = {
            "A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * len(re.findall("[A-Z]", text)) > 3 * len(text), "D": bool(re.search(r"[#$%&*|]", text)),
            "E": doc is not None and any(d is not None and d < doc and (t or "") == text for d, t, _ in rows),
        }
        own = [x for x in labels if x[0] == doc and doc is not None]
        flags.append((lang or "", {k for k, v in fails.items() if v}, any(x[1] == 1 for x in own), any(x[2] == 1 for x in own)))
    out = {}
    for part in {f[0] for f in flags}:
        for order in map("".join, permutations("ABCDE")):
            for step, letter in enumerate(order, 1):
                n = [0] * 6
                for _, fails, good, toxic in (f for f in flags if f[0] == part):
                    first = next((i for i, x in enumerate(order, 1) if x in fails), 6)
                    n[0] += first > step
                    n[1] += first == step
                    n[2] += letter in fails and first < step
                    n[3] += fails == {letter}
                    n[4] += first == step and good
                    n[5] += first == step and toxic
                out[part, order, step] = n
        for letter in "ABCDE":
            shapley = sum(n[1] for (p, o, s), n in out.items() if p == part and o[s - 1] == letter)
            for (p, o, s), n in out.items():
                if p == part and o[s - 1] == letter:
                    n.append(shapley)
    return out


def made(spark, rows, labels):
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumns({c: F.lit(7) for c in ("part", "flags", "step", "first", "good", "d", "least", "digest", "steps", "labelled", "quality")})
    return docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int").withColumn("part", F.lit("x"))


def got(docs, labels):
    rows = filteraudit.audit(docs, labels).collect()
    found = {(r.part, r.filter_order, r.step): list(r)[3:] for r in rows}
    assert len(found) == len(rows)
    return found


def test_all_orders_against_loops(spark, odd):
    rnd = random.Random(3)
    words = [f"w{i}" for i in range(400)]
    texts = list(odd.values())
    for _ in range(60):
        n = rnd.choice([0, 5, 199, 200, 201, 300])
        pool = words[: rnd.choice([20, 100, 99, 400])]
        w = [rnd.choice(pool) for _ in range(n)]
        if rnd.random() < 0.3:
            w = [x.upper() for x in w]
        texts.append(" ".join(w) + rnd.choice(["", "", " #", " a|b"]))
    texts += [rnd.choice(texts) for _ in range(30)]
    rows = [(i, t, rnd.choice(["en", "de", "", None])) for i, t in enumerate(texts)]
    rows += [(3, "one", "en"), (3, "one", "en"), (None, "one", "en"), (None, None, None)]
    rnd.shuffle(rows)
    labels = [(i, rnd.choice([0, 1, None]), rnd.choice([0, 1, None])) for i in range(0, 80, 2)] + [(4, 1, 1), (4, 0, 0), (None, 1, 1), (9999, 1, 1)]
    assert got(*made(spark, rows, labels)) == brute(rows, labels)


def test_limits_of_each_filter(spark):
    exact = " ".join(f"w{i}" for i in range(100)) + " " + " ".join(["same"] * 100)
    rows = [(0, exact, "a"), (1, exact.replace("w0 ", "same ", 1), "b"), (2, "A" + "b" * 33, "c"), (3, "A" + "b" * 32, "d"), (4, "x " * 300, "e"), (5, "x $", "f")]
    assert got(*made(spark, rows, [])) == brute(rows, [])


def test_empty_tables_and_one_text_for_all(spark):
    docs, labels = made(spark, [(i, "copy", "en") for i in range(500)], [(1, 1, 0)])
    counts = got(docs, labels)
    assert len(counts) == 600 and counts["en", "EABCD", 1][:2] == [1, 499] and counts["en", "ABCDE", 5][:3] == [0, 0, 499]
    assert counts == got(docs, labels)
    assert got(docs.limit(0), labels) == {}
    assert got(docs, labels.limit(0))["en", "ABCDE", 1][4] == 0


def test_a_further_filter_joins_the_orders(spark):
    docs, labels = made(spark, [(0, "fine", "en"), (1, "spam", "en")], [])
    rows = filteraudit.audit(docs, labels, {"F": F.col("text") == "spam"}).filter("filter_order like 'F%' and step = 1").collect()
    assert len(rows) == 120 and {(r.kept, r.removed) for r in rows} == {(1, 1)}
