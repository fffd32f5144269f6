"""Document fingerprints from prefix polynomial hashes."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import table

#: Modulus 2^31 - 1 and the two bases of a hash pair.
PRIME = (1 << 31) - 1
BASES = (911_382_323, 1_572_869_297)
_MASK, _SHIFT = np.uint64(PRIME), np.uint64(31)
#: A fingerprint keeps the SKETCH smallest hashes among all spans of SPAN code points.
SPAN, SKETCH = 8, 64
#: Documents of one ordered bucket, on average.
BUCKET_ROWS = 2048
MOST_BUCKETS = 4096


def _fold(x: np.ndarray) -> np.ndarray:
    """Something equal to x modulo PRIME and below 2^34, for any 64-bit x."""
    return (x & _MASK) + (x >> _SHIFT)


def _reduce(x: np.ndarray) -> np.ndarray:
    """x modulo PRIME, for any 64-bit x."""
    x = _fold(_fold(x))
    return np.minimum(x, x - _MASK)  # below PRIME the difference wraps to a larger number


class Powers:
    """Powers of the bases and of their inverses, extended as longer texts come."""

    def __init__(self):
        self.tables = [np.ones((2, 1), np.uint64) for _ in BASES]

    def upto(self, n: int) -> list[np.ndarray]:
        for i, base in enumerate(BASES):
            known = self.tables[i]
            while known.shape[1] <= n:
                size = known.shape[1]
                step = np.array([[pow(base, size, PRIME)], [pow(pow(base, -1, PRIME), size, PRIME)]], np.uint64)
                known = np.concatenate([known, _reduce(known * step)], axis=1)
            self.tables[i] = known
        return self.tables


class Prefixes:
    """Modular prefix arrays of one text: any span's hash from two entries of each."""

    def __init__(self, codes: np.ndarray, powers: Powers):
        self.n = len(codes)
        self.tables = powers.upto(self.n)
        letters = codes.astype(np.uint64) + np.uint64(1)
        self.sums = [np.concatenate([np.zeros(1, np.uint64), _reduce(np.cumsum(_fold(letters * t[0, : self.n])))]) for t in self.tables]

    def all_spans(self, length: int) -> np.ndarray:
        """62-bit hashes of all spans of one length; equal texts hash alike wherever they stand."""
        out = np.zeros(self.n - length + 1, np.uint64)
        for sums, t in zip(self.sums, self.tables):
            part = _reduce((sums[length:] + _MASK - sums[: self.n - length + 1]) * t[1, : self.n - length + 1])
            out = (out << np.uint64(31)) | part
        return out

    def span(self, start: int, length: int) -> int:
        out = 0
        for sums, t in zip(self.sums, self.tables):
            out = out << 31 | (int(sums[start + length]) - int(sums[start])) * int(t[1, start]) % PRIME
        return out


def same_span(a: Prefixes, i: int, b: Prefixes, j: int, length: int) -> bool:
    """Whether two spans are equal (but for a chance of about 2^-62)."""
    return a.span(i, length) == b.span(j, length)


def common_extension(a: Prefixes, i: int, b: Prefixes, j: int) -> int:
    """The length of the longest common text from position i of one and j of the other, by binary search."""
    low, high = 0, min(a.n - i, b.n - j)
    while low < high:
        middle = (low + high + 1) // 2
        if same_span(a, i, b, j, middle):
            low = middle
        else:
            high = middle - 1
    return low


def sketch(prefixes: Prefixes) -> np.ndarray:
    """The SKETCH smallest mixed hashes of all distinct spans of SPAN code points (a shorter text: the whole), ascending."""
    length = min(SPAN, prefixes.n)
    if not length:
        return np.empty(0, np.uint64)
    hashes = prefixes.all_spans(length)
    hashes ^= hashes >> np.uint64(32)
    hashes *= np.uint64(0x9E3779B97F4A7C15)
    hashes ^= hashes >> np.uint64(29)
    keep = 4 * SKETCH
    while len(hashes) > keep:  # repeats of one span may fill the smallest places
        some = np.unique(np.partition(hashes, keep)[:keep])
        if len(some) >= SKETCH or keep * 4 >= len(hashes):
            hashes = some if len(some) >= SKETCH else np.unique(hashes)
            break
        keep *= 4
    return np.unique(hashes)[:SKETCH]


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """The share of common spans (Dice), estimated from two sketches: 1 for equal texts, about 0.5 if half is replaced."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    smallest = np.union1d(a, b)[:SKETCH]
    both = np.isin(smallest, a, assume_unique=True) & np.isin(smallest, b, assume_unique=True)
    jaccard = both.sum() / len(smallest)
    return float(2 * jaccard / (1 + jaccard))


def written(whole: int, part: np.ndarray) -> str:
    """A fingerprint as text: 16 digits of the whole text's hash, then 16 for each sketch entry."""
    return f"{whole:016x}" + part.astype(">u8").tobytes().hex()


def parse(fingerprint: str) -> np.ndarray:
    return np.frombuffer(bytes.fromhex(fingerprint[16:]), ">u8").astype(np.uint64)


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


class Fingerprints:
    """Prefix arrays, fingerprint and sketch of texts; keeps the powers."""

    def __init__(self):
        self.powers = Powers()

    def of(self, text: str) -> tuple[Prefixes, str, np.ndarray]:
        prefixes = Prefixes(_codes(text), self.powers)
        part = sketch(prefixes)
        return prefixes, written(prefixes.span(0, prefixes.n) if prefixes.n else 0, part), part


def fingerprints(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text) -> doc_id, n_chars, fingerprint for every whole text; null and empty texts have n_chars 0."""

    def run(batches):
        make = Fingerprints()
        for batch in batches:
            texts = [x.as_py() or "" for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(t) for t in texts], pa.int64()), pa.array([make.of(t)[1] for t in texts], pa.string())],
                ["doc_id", "n_chars", "fingerprint"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_chars long, fingerprint string")


def in_order(docs: DataFrame, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """``docs`` dealt into buckets of consecutive doc_ids and sorted descending, each bucket closed by a copy of the row after it.

    Adds ``bucket`` and ``closing`` (true for that copy); the last row of all is followed by the first. Bucket bounds are
    approximate quantiles, one for about ``bucket_rows`` rows and MOST_BUCKETS at most (beyond that buckets grow; they are
    read as a stream). A null doc_id sorts last; rows of one doc_id stay in
    one bucket, ordered by text hash.
    """
    ids = docs.select(F.coalesce("doc_id", F.lit(-(1 << 63))).alias("id"))
    n = ids.count()
    docs = docs.withColumn("_id", F.coalesce("doc_id", F.lit(-(1 << 63)))).withColumn("_tie", F.xxhash64("text"))
    parts = min(MOST_BUCKETS, max(1, -(-n // bucket_rows)))
    cuts = ids.approxQuantile("id", [i / parts for i in range(1, parts)], 0.25 / parts) if parts > 1 and n else []
    cuts = np.unique(np.array(cuts, np.float64)).astype(np.int64)

    @F.pandas_udf("int")
    def bucket_of(ids):
        return pd.Series(np.searchsorted(cuts, ids.to_numpy(), side="right").astype(np.int32))

    docs = docs.withColumn("bucket", bucket_of("_id"))
    tops = {
        r["bucket"]: (r["top"]["_id"], r["top"]["_tie"])
        for r in docs.select("bucket", "_id", "_tie").groupBy("bucket").agg(F.max(F.struct("_id", "_tie")).alias("top")).collect()
    }
    filled = sorted(tops)
    above = {b: filled[(i + 1) % len(filled)] for i, b in enumerate(filled)}

    @F.pandas_udf("array<int>")
    def copied_to(buckets, ids, ties):
        """The bucket that a bucket's first row closes."""
        return pd.Series([[above[b]] if tops[b] == (i, t) else [] for b, i, t in zip(buckets, ids, ties)])

    own = F.array(F.struct("bucket", F.lit(False).alias("closing")))
    copies = F.transform(copied_to("bucket", "_id", "_tie"), lambda b: F.struct(b.alias("bucket"), F.lit(True).alias("closing")))
    placed = docs.withColumn("_to", F.explode(F.concat(own, copies))).drop("bucket").select("*", "_to.bucket", "_to.closing").drop("_to")
    placed = placed.repartitionById(len(cuts) + 1, F.col("bucket"))
    return placed.sortWithinPartitions("bucket", "closing", F.desc("_id"), F.desc("_tie")).drop("_id", "_tie")


def compare_with_next(docs: DataFrame) -> DataFrame:
    """One row a document with its fingerprint, its edited text's, and how like they are to each other and to the next one's.

    The edited text has the last floor(n_chars / 2) code points replaced by the first as many (or all) of the next
    document's text, in descending doc_id; the last is followed by the first, a single one by itself. ``common_prefix``
    is the longest common extension of text and edited text from their beginnings. Null texts are empty, and empty
    ones have an empty sketch: likeness 1 to each other, 0 to any other text. Texts shorter than SPAN have one span, the whole.
    """
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "common_prefix"]

    def run(batches):
        make = Fingerprints()
        last = None

        def row(doc_id, text, made, after):
            prefixes, fingerprint, part = made
            n = len(text)
            edited = text[: n - n // 2] + after[0][: n // 2]
            edited_prefixes, edited_fingerprint, edited_part = make.of(edited)
            return (
                doc_id, n, hashlib.sha256(edited.encode()).hexdigest(), fingerprint, edited_fingerprint,
                likeness(part, edited_part), likeness(part, after[1][2]), common_extension(prefixes, 0, edited_prefixes, 0),
            )

        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch, out = whole.slice(at, 256), []
                for doc_id, text, bucket, closing in zip(*(batch.column(i) for i in range(4))):
                    doc_id, text, bucket, closing = doc_id.as_py(), text.as_py() or "", bucket.as_py(), closing.as_py()
                    if closing and last is not None and last[0] == bucket and last[3]:
                        continue  # equal rows at the top of a bucket close it once
                    made = make.of(text)
                    if last is not None and last[0] == bucket and not last[3]:
                        out.append(row(*last[1:3], last[4], (text, made)))
                    last = (bucket, doc_id, text, closing, made)
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out), types)], names)

    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.int64()]
    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, common_prefix long"
    return in_order(docs.select("doc_id", "text")).select("doc_id", "text", "bucket", "closing").mapInArrow(run, schema)


def op8_fingerprints(spark, sf_dir: str) -> DataFrame:
    return compare_with_next(table(spark, sf_dir, "documents"))
