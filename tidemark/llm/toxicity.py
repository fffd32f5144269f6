"""Toxicity by a classifier chain of linear models."""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import table

#: Labelled rows that the chain is fitted on at most; features that a link of it keeps; folds.
FIT_ROWS, FEATURES, FOLDS = 6000, 1024, 5
#: Hash buckets of words, and the word beginnings that count as features beside the words.
BUCKETS, PREFIXES = 1 << 20, (5, 7)
#: Words that one Python worker remembers at most.
REMEMBERED = 100_000

_WORD = re.compile(r"[^\W\d_]+")


def chain_of(labels: DataFrame) -> dict[str, Column]:
    """The categories that the table ``labels`` tells, in the order of the chain."""
    return {"low_quality": 1 - F.col("quality"), "toxic": F.col("toxic")}


def buckets_of(word: str) -> list[int]:
    """The hash buckets of a word and of its beginnings."""
    return [zlib.crc32(x.encode()) % BUCKETS for x in (word, *(f"{word[:n]}-" for n in PREFIXES if len(word) >= n))]


def features_of(text: str | None) -> np.ndarray:
    """Hash buckets of the distinct words of a text and of their beginnings."""
    words = set(_WORD.findall((text or "").lower()))
    return np.array(sorted({x for w in words for x in buckets_of(w)}), np.int64)


@dataclass
class Link:
    """One linear model: weights of hash buckets, of the chain's earlier probabilities, and a bias."""

    name: str
    buckets: np.ndarray
    weights: np.ndarray
    earlier: np.ndarray
    bias: float


@dataclass
class Chain:
    links: list[Link] = field(default_factory=list)
    #: Probability of the last link from which a document is toxic: best F1 on out-of-fold probabilities.
    threshold: float = 0.5

    def scorer(self):
        """A function from a text to the probability of each category, in order."""
        at = np.unique(np.concatenate([x.buckets for x in self.links] or [np.empty(0, np.int64)]))
        weights = np.zeros((len(self.links), len(at)))
        for i, x in enumerate(self.links):
            weights[i, np.searchsorted(at, x.buckets)] = x.weights
        place = {int(b): i for i, b in enumerate(at)}
        used: dict[str, tuple[int, ...]] = {}

        def score(text: str | None) -> list[float]:
            hit: set[int] = set()
            for word in set(_WORD.findall((text or "").lower())):
                found = used.get(word)
                if found is None:
                    found = tuple(place[b] for b in buckets_of(word) if b in place)
                    if len(used) >= REMEMBERED:
                        used.clear()
                    if len(word) < 64:
                        used[word] = found
                hit.update(found)
            sums = weights[:, sorted(hit)].sum(axis=1)
            out: list[float] = []
            for i, x in enumerate(self.links):
                out.append(float(_sigmoid(sums[i] + x.bias + np.dot(x.earlier, out[:i]))))
            return out

        return score


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def _fit(x: np.ndarray, y: np.ndarray, penalty: float = 3e-4, rounds: int = 300) -> np.ndarray:
    """Ridge logistic regression by accelerated gradient steps; the last column of x is the bias and isn't penalised."""
    n, width = x.shape
    step = 4 / max(float((x * x).sum(axis=1).mean()) * 0.5, 1.0)
    cost = np.full(width, penalty, np.float32)
    cost[-1] = 0
    w = v = np.zeros(width, np.float32)
    best, least = w, np.inf
    for k in range(rounds):
        z = x @ v
        loss = float(np.mean(np.logaddexp(0, z) - y * z) + 0.5 * (cost * v * v).sum())
        if loss > least * 1.02:  # the step was too long
            step, v, w = step / 2, best, best
            continue
        if loss < least:
            best, least = v, loss
        after = (v - step * (x.T @ (_sigmoid(z) - y).astype(np.float32) / n + cost * v)).astype(np.float32)
        v = (after + (k / (k + 3)) * (after - w)).astype(np.float32)
        w = after
    return best


def _select(rows: list[np.ndarray], y: np.ndarray, features: int) -> np.ndarray:
    """The buckets of largest chi-square against a category, among those in three rows or more."""
    flat = np.concatenate(rows) if rows else np.empty(0, np.int64)
    all_, yes = np.bincount(flat, minlength=BUCKETS), np.bincount(flat, np.repeat(y, [len(r) for r in rows]), minlength=BUCKETS)
    share = y.mean() if len(y) else 0.0
    use = np.flatnonzero((all_ >= 3) & (all_ < len(rows)))
    expected = all_[use] * share
    with np.errstate(divide="ignore", invalid="ignore"):
        chi = (yes[use] - expected) ** 2 / (expected * (1 - share) * (1 - all_[use] / len(rows)))
    return np.sort(use[np.argsort(-np.nan_to_num(chi), kind="stable")[:features]])


def _dense(rows: list[np.ndarray], buckets: np.ndarray) -> np.ndarray:
    x = np.zeros((len(rows), len(buckets)), np.float32)
    for i, r in enumerate(rows):
        at = np.searchsorted(buckets, r)
        at = at[(at < len(buckets))]
        hit = r[: len(at)] if len(buckets) else r[:0]
        x[i, at[buckets[at] == hit]] = 1
    return x


def fit_chain(names: list[str], rows: list[np.ndarray], labels: np.ndarray, folds: np.ndarray) -> Chain:
    """Fit the links in order. A link sees the categories before it as out-of-fold probabilities: each row's come from
    models that were fitted, features selected included, without the row's fold."""
    chain = Chain()
    before = np.zeros((len(rows), 0), np.float32)
    for k, name in enumerate(names):
        y = labels[:, k].astype(np.float32)

        def fitted(train: np.ndarray, rows=rows, before=before, y=y):
            own = [rows[i] for i in train]
            buckets = _select(own, y[train], FEATURES)
            x = np.concatenate([_dense(own, buckets), before[train], np.ones((len(train), 1), np.float32)], axis=1)
            return buckets, _fit(x, y[train])

        out = np.zeros(len(rows), np.float32)
        for fold in range(FOLDS):
            train, test = np.flatnonzero(folds != fold), np.flatnonzero(folds == fold)
            if len(train) and len(test):
                buckets, w = fitted(train)
                x = np.concatenate([_dense([rows[i] for i in test], buckets), before[test], np.ones((len(test), 1), np.float32)], axis=1)
                out[test] = _sigmoid(x @ w)
        buckets, w = fitted(np.arange(len(rows))) if len(rows) else (np.empty(0, np.int64), np.zeros(1 + k, np.float32))
        n = len(buckets)
        chain.links.append(Link(name, buckets, w[:n].astype(float), w[n : n + k].astype(float), float(w[-1]) if len(rows) else -40.0))
        before = np.concatenate([before, out[:, None]], axis=1)
    if len(names):
        chain.threshold = best_threshold(before[:, -1], labels[:, -1])
    return chain


def best_threshold(p: np.ndarray, y: np.ndarray) -> float:
    """The probability that parts rows best by F1: halfway between two neighbouring ones; 0.5 without both labels."""
    if not len(y) or y.min() == y.max():
        return 0.5
    order = np.argsort(-p, kind="stable")
    hits = np.cumsum(y[order])
    f1 = 2 * hits / (np.arange(1, len(y) + 1) + y.sum())
    best = int(np.argmax(f1))
    after = p[order[best + 1]] if best + 1 < len(y) else 0.0
    return float((p[order[best]] + after) / 2)


def train(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> Chain:
    """A chain fitted on at most about ``fit_rows`` labelled documents (the documented bound), chosen by a hash of their id.

    ``labels`` (doc_id, quality, toxic): rows with a null in any of them don't count, the largest of repeated rows does.
    Only hash buckets and labels of those documents come to the driver. Without labelled documents every probability is 0.
    """
    chain = chain_of(labels)
    known = labels.filter("doc_id is not null and quality is not null and toxic is not null").groupBy("doc_id").agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic"))
    one_in = max(1, -(-known.count() // fit_rows))
    picked = known.filter(F.pmod(F.xxhash64("doc_id"), F.lit(one_in)) == 0).select(
        F.col("doc_id").alias("id"), F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(FOLDS)).cast("int").alias("fold"), *(c.cast("int").alias(n) for n, c in chain.items())
    )
    joined = docs.select("doc_id", "text").join(F.broadcast(picked), F.col("doc_id") == F.col("id"))  # fit_rows rows at most
    names = list(chain)

    def run(batches):
        for batch in batches:
            found = pa.array([features_of(x.as_py()).astype(np.int32) for x in batch.column("text")], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("fold"), *(batch.column(n) for n in names), found], ["doc_id", "fold", *names, "buckets"])

    schema = "doc_id long, fold int, " + ", ".join(f"{n} int" for n in names) + ", buckets array<int>"
    # Rows that share a labelled doc_id count as one, so the bound holds whatever the table repeats.
    one = joined.mapInArrow(run, schema).groupBy("doc_id").agg(F.min(F.struct("buckets", "fold", *names)).alias("one"))
    got = one.select("doc_id", "one.*").toArrow().sort_by("doc_id")
    rows = [np.array(r, np.int64) for r in got["buckets"].to_pylist()]
    y = np.stack([got[n].to_numpy() for n in names], axis=1) if len(rows) else np.zeros((0, len(names)))
    return fit_chain(names, rows, y, got["fold"].to_numpy())


def without_toxic(docs: DataFrame, chain: Chain) -> DataFrame:
    """``docs`` with all its columns and only the rows that the chain doesn't reject."""
    whole = F.struct(*docs.columns)
    scored = score(docs.select(F.col("text"), whole.alias("whole")), chain)
    return scored.filter("not rejected").select(*(F.col("whole").getField(c).alias(c) for c in docs.columns))


def score(docs: DataFrame, chain: Chain, threshold: float | None = None) -> DataFrame:
    """``docs`` with p_<category> for each link of the chain and ``rejected``: the last one's is ``threshold`` (the chain's, if none is given) or more.

    Whole texts are read. Null, empty and wordless texts get what the biases give. Rows and their other columns stay as they are; columns of these names that are there already are replaced.
    """
    docs = docs.drop(*(f"p_{x.name}" for x in chain.links), "rejected")
    shared = docs.sparkSession.sparkContext.broadcast(chain)
    names = [x.name for x in chain.links]
    threshold = chain.threshold if threshold is None else threshold

    def run(batches):
        of = shared.value.scorer()
        for batch in batches:
            found = np.array([of(x.as_py()) for x in batch.column("text")]).reshape(-1, len(names))
            columns = [pa.array(found[:, i]) for i in range(len(names))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns, pa.array(found[:, -1] >= threshold)], [*batch.schema.names, *(f"p_{n}" for n in names), "rejected"])

    schema = docs.select("*", *(F.lit(0.0).alias(f"p_{n}") for n in names), F.lit(True).alias("rejected")).schema
    return docs.mapInArrow(run, schema)


def op7_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return score(docs, train(docs, table(spark, sf_dir, "labels"))).drop("text").withColumnRenamed("rejected", "toxic")
