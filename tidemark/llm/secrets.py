"""Secret scans: fixed patterns and a character Markov model, by DataFrame functions only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import table, text_or_empty

#: The kinds of base spans, in order, with pattern and least length of the group that counts.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
ASSIGN_LEAST = 12
KINDS = ("assign", "access", "hex", "random")
#: What the Markov models judge: runs of these characters of some length.
TOKEN = r"[A-Za-z0-9+/_=-]{16,}"
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-"
#: Rows whose tokens train the models at most, and the log-likelihood ratio by character from which a token is a secret.
SAMPLE_ROWS = 20_000
THRESHOLD = 0.5
#: Observations that a letter's own following letters must outweigh.
BACKOFF = 20.0

_ITEM = "struct<kind:int,from:int,to:int,value:string>"
_SPAN = f"array<{_ITEM}>"
_ORDERED = "struct<from:int,kind:int,to:int,value:string>"


def running(items: Column, zero: Column, step, out, kind: str) -> Column:
    """``out(state, item)`` of each item in order, as an array of ``kind``; ``step(state, item)`` is the state after it.

    Items are taken in blocks of about the square root of their number, so no long array grows item by item.
    """
    size = F.greatest(F.ceil(F.sqrt(F.size(items))).cast("int"), F.lit(1))
    empty = F.array().cast(f"array<{kind}>")
    blocks = F.transform(F.sequence(F.lit(0), F.greatest(F.ceil(F.size(items) / size).cast("int") - 1, F.lit(0))), lambda i: F.slice(items, i * size + 1, size))

    def block(state: Column, own: Column) -> Column:
        return F.aggregate(
            own,
            F.struct(state.alias("state"), empty.alias("made")),
            lambda acc, x: F.struct(step(acc["state"], x).alias("state"), F.concat(acc["made"], F.array(out(acc["state"], x))).alias("made")),
        )

    def joined_to(acc: Column, own: Column) -> Column:
        # Through an array of one, so that a block is gone through once.
        return F.transform(F.array(block(acc["state"], own)), lambda r: F.struct(r["state"].alias("state"), F.concat(acc["made"], F.array(r["made"])).alias("made")))[0]

    return F.flatten(F.aggregate(blocks, F.struct(zero.alias("state"), F.array().cast(f"array<array<{kind}>>").alias("made")), joined_to)["made"])


def found(text: Column, pattern: str, kind: int) -> Column:
    """The leftmost non-overlapping matches of a pattern as spans in code points, end exclusive.

    ``split`` gives what lies between the matches and ``regexp_extract_all`` the matches; their lengths
    added up are the positions.
    """
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    items = F.arrays_zip(F.slice(F.split(text, pattern, -1), 1, F.size(values)).alias("gap"), values.alias("value"))
    begin = lambda at, x: at + F.length(x["gap"])
    end = lambda at, x: begin(at, x) + F.length(x["value"])
    span = lambda at, x: F.struct(F.lit(kind).alias("kind"), begin(at, x).alias("from"), end(at, x).alias("to"), x["value"].alias("value"))
    # Through an array of one, so that the texts are matched once.
    spans = F.transform(F.array(items), lambda i: running(i, F.lit(0), end, span, _ITEM))[0]
    return F.when(text.rlike(pattern), spans).otherwise(F.array().cast(_SPAN))


def untouched(spans: Column) -> Column:
    """Of spans by position, then kind: those of the last kind that overlap none of the other kinds. They don't overlap each other, so
    what may touch one from the right is the next span, and from the left whatever of the other kinds reaches furthest."""
    last = len(KINDS) - 1
    items = F.arrays_zip(spans.alias("own"), F.slice(spans, 2, F.greatest(F.size(spans), F.lit(1))).alias("after"))
    reach = lambda far, x: F.when(x["own"]["kind"] < last, F.greatest(far, x["own"]["to"])).otherwise(far)
    touched = lambda far, x: (far > x["own"]["from"]) | F.coalesce((x["after"]["from"] < x["own"]["to"]) & (x["after"]["kind"] < last), F.lit(False))
    marked = running(items, F.lit(0), reach, lambda far, x: F.struct(x["own"].alias("own"), touched(far, x).alias("touched")), f"struct<own:{_ORDERED},touched:boolean>")
    return F.transform(F.filter(marked, lambda m: (m["own"]["kind"] == last) & ~m["touched"]), lambda m: m["own"])


def base_spans(text: Column) -> list[Column]:
    """Spans of the three base kinds. A match of ``assign`` is the whole match; it counts if its value is long enough."""
    assign = F.filter(found(text, ASSIGN, 0), lambda s: F.length(F.regexp_extract(s["value"], ASSIGN, 2)) >= ASSIGN_LEAST)
    return [assign, found(text, ACCESS, 1), found(text, HEX, 2)]


def _pairs(token: Column) -> Column:
    """The number of each neighbouring pair of characters of a token: first * |ALPHABET| + second."""
    n = len(ALPHABET)
    at = lambda i: F.instr(F.lit(ALPHABET), F.substring(token, i, F.lit(1))) - 1
    return F.transform(F.sequence(F.lit(1), F.length(token) - 1), lambda i: at(i) * n + at(i + 1))


def train(docs: DataFrame, sample_rows: int = SAMPLE_ROWS) -> list[float]:
    """Log-likelihood ratios of character pairs: random strings against ordinary identifiers, from labelled samples.

    Samples: the values that the base patterns find are random strings, runs of letters and
    underscores of 8 characters or more outside of them are ordinary identifiers. They come from about
    ``sample_rows`` documents chosen by a hash of their id (the bound of the fit), and from generated
    random strings over the whole alphabet, hexadecimal digits and letters with digits, which also serve where documents
    have none. The result has one number a pair, whatever the input's size.
    """
    spark = docs.sparkSession
    text = text_or_empty()
    one_in = max(1, -(-docs.count() // sample_rows))
    sample = docs.filter(F.pmod(F.xxhash64("doc_id"), F.lit(one_in)) == 0).select(text.alias("text"))
    secret = F.concat(*(F.transform(s, lambda x: F.regexp_extract(x["value"], r"([A-Za-z0-9+/_=-]+)[^A-Za-z0-9+/_=-]*$", 1)) for s in base_spans(F.col("text"))))
    rest = F.regexp_replace(F.regexp_replace(F.regexp_replace("text", ASSIGN, " "), ACCESS, " "), HEX, " ")
    plain = F.regexp_extract_all(rest, F.lit("[A-Za-z_]{8,}"), F.lit(0))
    kinds = [ALPHABET, "0123456789abcdef", ALPHABET[:62], ALPHABET[26:62], ALPHABET[:26] + ALPHABET[52:62]]

    def drawn(letters: str) -> Column:
        letter = lambda i: F.substring(F.lit(letters), (F.pmod(F.xxhash64("id", i), F.lit(len(letters))) + 1).cast("int"), F.lit(1))
        return F.array_join(F.transform(F.sequence(F.lit(1), F.lit(32)), letter), "")

    made = spark.range(500).select(F.explode(F.array(*map(drawn, kinds))).alias("token"))
    tokens = (
        sample.select(F.lit(1).alias("random"), F.explode(secret).alias("token"))
        .unionByName(sample.select(F.lit(0).alias("random"), F.explode(plain).alias("token")))
        .unionByName(made.select(F.lit(1).alias("random"), "token"))
        .filter(F.length("token") >= 2)
    )
    counts = tokens.select("random", F.explode(_pairs(F.col("token"))).alias("pair")).groupBy("random", "pair").agg(F.count("*").alias("n"))
    n = len(ALPHABET)
    seen = [[[0] * n for _ in range(n)] for _ in range(2)]
    for row in counts.collect():  # at most two numbers a pair of letters
        seen[row["random"]][row["pair"] // n][row["pair"] % n] = row["n"]
    chance = [_conditional(s) for s in seen]
    return [math.log(chance[1][a][b]) - math.log(chance[0][a][b]) for a in range(n) for b in range(n)]


def _conditional(seen: list[list[int]]) -> list[list[float]]:
    """The probability of each letter after each other one; where a letter is rare it leans on how common letters are at all."""
    n = len(seen)
    common = [sum(row[b] for row in seen) + 0.5 for b in range(n)]
    share = [c / sum(common) for c in common]
    return [[(row[b] + BACKOFF * share[b]) / (sum(row) + BACKOFF) for b in range(n)] for row in seen]


def random_spans(text: Column, ratios: list[float], threshold: float = THRESHOLD) -> Column:
    """Tokens whose mean log-likelihood ratio by character pair is over the threshold."""
    weights = F.array(*(F.lit(float(x)) for x in ratios))
    mean = lambda t: F.aggregate(_pairs(t), F.lit(0.0), lambda acc, p: acc + F.get(weights, p)) / (F.length(t) - 1)
    return F.filter(found(text, TOKEN, 3), lambda s: mean(s["value"]) > threshold)


def scan(docs: DataFrame, ratios: list[float] | None = None) -> DataFrame:
    """``docs`` (doc_id, text) -> doc_id, base, spans: arrays of (kind, from, to, value) by position, then kind.

    ``base``: the spans of the fixed patterns. ``spans``: these and the tokens that the Markov models call
    random and that no base span touches. Kinds are numbers in KINDS. Positions count code points in the whole text. Null and empty
    texts have no span; rows stay as they are, repeated or not. ``ratios``: a model from ``train``, trained on
    ``docs`` if none is given.
    """
    ratios = train(docs) if ratios is None else ratios
    base = docs.select("doc_id", text_or_empty().alias("text"))
    base = base.select("doc_id", "text", *(c.alias(f"k{i}") for i, c in enumerate(base_spans(F.col("text")))), random_spans(F.col("text"), ratios).alias("random"))
    ordered = lambda *c: F.array_sort(
        F.transform(F.concat(*c), lambda s: F.struct(s["from"].alias("from"), s["kind"].alias("kind"), s["to"].alias("to"), s["value"].alias("value")))
    )
    base = base.select("doc_id", "k0", "k1", "k2", ordered("k0", "k1", "k2").alias("base"), "random", ordered("k0", "k1", "k2", "random").alias("all"))
    alone = F.when(F.size("random") > 0, untouched(F.col("all"))).otherwise(F.array().cast(f"array<{_ORDERED}>"))
    return base.select("doc_id", "k0", "k1", "k2", "base", F.array_sort(F.concat("base", alone)).alias("spans"))


def joined(spans: str) -> Column:
    """kind:start:end of each span, joined by commas."""
    names = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["from"], s["to"])), ",")


def op9_secrets(spark, sf_dir: str) -> DataFrame:
    sizes = [F.size(f"k{i}").cast("long").alias(f"n_{KINDS[i]}") for i in range(3)]
    return scan(table(spark, sf_dir, "documents")).select("doc_id", *sizes, F.sha2(joined("base").cast("binary"), 256).alias("base_sha256"), joined("spans").alias("spans"))
