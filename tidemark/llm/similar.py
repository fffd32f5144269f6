"""Near copies by shingle similarity: fingerprints and MinHash bands find candidates, the whole shingle sets decide."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import majority, stored
from tidemark.llm.components import components
from tidemark.llm.substrings import _BASE, _U, Words, _mix

#: Jaccard similarity of two shingle sets from which documents are near copies.
SIMILARITY = 0.8
#: Bands of a MinHash signature and hashes of a band. Two sets of similarity s share no band with probability
#: (1 - s ** ROWS) ** BANDS: 7e-6 at 0.8, 2e-8 at 0.85.
BANDS, ROWS = 30, 5
#: Shingles of the documents that one cell compares; a larger group of candidates is split into pairs of parts.
CELL = 1 << 21

_A = _mix(np.arange(1, BANDS * ROWS + 1, dtype=_U) * _U(_BASE)) | _U(1)
_B = _mix(_A)


def shingles_of(words: np.ndarray, width: int) -> np.ndarray:
    """The distinct 64-bit hashes of all ``width``-word shingles, sorted; with fewer words the whole sequence is the only one."""
    if not len(words):
        return np.empty(0, _U)
    width = min(width, len(words))
    n = len(words) - width + 1
    hashes = np.zeros(n, _U)
    for i in range(width):
        hashes = hashes * _U(_BASE) + words[i : i + n]
    return np.unique(_mix(hashes))


def node_of(shingles: np.ndarray) -> int:
    """One hash of a whole shingle set."""
    places = np.arange(1, len(shingles) + 1, dtype=_U)
    return int(_mix(np.array([(_mix(shingles + places * _U(_BASE))).sum(dtype=_U)], _U)).view(np.int64)[0])


def bands_of(shingles: np.ndarray) -> np.ndarray:
    """One hash for each band of the MinHash signature; none without shingles."""
    if not len(shingles):
        return np.empty(0, np.int64)
    least = np.full(len(_A), np.iinfo(np.uint64).max, _U)
    for at in range(0, len(shingles), 512):
        least = np.minimum(least, (_A[:, None] * shingles[None, at : at + 512] + _B[:, None]).min(axis=1))
    out = np.zeros(BANDS, _U)
    for column in least.reshape(BANDS, ROWS).T:
        out = _mix(out * _U(_BASE) + column)
    return out.view(np.int64)


def _prints(docs: DataFrame, width: int) -> DataFrame:
    """(doc_id, hash, node, size, bands, fp) of every document; hash: of its text; fp: the SimHash of its shingle set."""

    def run(batches):
        words = Words()
        for batch in batches:
            sets = (shingles_of(words.of(x.as_py()), width) for x in batch.column(2))
            found = [(node_of(s), len(s), bands_of(s), np.uint64(majority(s)).view(np.int64)) for s in sets]
            if found:
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(1), pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.int64()), pa.array([x[2] for x in found], pa.list_(pa.int64())), pa.array([x[3] for x in found], pa.int64())],
                    ["doc_id", "hash", "node", "size", "bands", "fp"],
                )

    return docs.select("doc_id", F.xxhash64("text").alias("hash"), "text").mapInArrow(run, "doc_id long, hash long, node long, size long, bands array<long>, fp long")


def _sets(width: int):
    """(root, node, parts, text) -> (root, node, parts, shingles), a node once a task."""

    def run(batches):
        words, seen = Words(), set()
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                keep, found = [], []
                for i, (node, text) in enumerate(zip(part.column(1).to_pylist(), part.column(3))):
                    if node in seen:
                        continue
                    shingles = shingles_of(words.of(text.as_py()), width)
                    if node_of(shingles) == node:
                        seen.add(node)
                        keep.append(i)
                        found.append(shingles.view(np.int64))
                if keep:
                    at = pa.array(keep, pa.int64())
                    yield pa.RecordBatch.from_arrays([*(part.column(c).take(at) for c in range(3)), pa.array(found, pa.list_(pa.int64()))], ["root", "node", "parts", "shingles"])

    return run


def forest(nodes: list[int], sets: list[np.ndarray], similarity: float) -> list[tuple[int, int]]:
    """Links that join the sets of one cell as all pairs of that similarity would: breadth first, a link for each one reached."""
    out = []
    if len(nodes) == 2:
        both = len(np.intersect1d(sets[0], sets[1], assume_unique=True))
        return [(nodes[0], nodes[1])] if both >= similarity * (len(sets[0]) + len(sets[1]) - both) else []
    sizes = np.array([len(s) for s in sets])
    names, flat = np.unique(np.concatenate(sets), return_inverse=True)
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    own = [flat[a:b] for a, b in zip(bounds[:-1], bounds[1:])]
    here = np.zeros(len(names), bool)
    # flat holds the sets of ``held``, of which those in ``left`` aren't reached yet.
    held = np.arange(len(nodes))
    left = np.ones(len(nodes), bool)
    starts = bounds[:-1]
    while left.any():
        first = int(held[np.argmax(left)])
        left[np.argmax(left)] = False
        queue = [first]
        while queue and left.any():
            at = queue.pop()
            if left.sum() * 2 < len(held):
                held, left = held[left], np.ones(int(left.sum()), bool)
                flat = np.concatenate([own[i] for i in held])
                starts = np.concatenate([[0], np.cumsum(sizes[held])])[:-1]
            here[own[at]] = True
            both = np.add.reduceat(here[flat], starts, dtype=np.int64)
            here[own[at]] = False
            near = left & (both >= similarity * (sizes[held] + sizes[at] - both))
            reached = held[near].tolist()
            out += [(nodes[at], nodes[i]) for i in reached]
            queue += reached
            left &= ~near
    return out


def _verify(similarity: float):
    """Rows sorted by (root, cell, node): the links of each cell."""

    def run(batches):
        key, nodes, sets = None, [], []
        for batch in batches:
            out = []
            for root, cell, node, shingles in zip(*(batch.column(c).to_pylist() for c in range(3)), batch.column(3)):
                if (root, cell) != key:
                    out += forest(nodes, sets, similarity) if len(nodes) > 1 else []
                    key, nodes, sets = (root, cell), [], []
                if not nodes or nodes[-1] != node:
                    nodes.append(node)
                    sets.append(shingles.values.to_numpy())
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], ["a", "b"])
        if len(nodes) > 1 and (out := forest(nodes, sets, similarity)):
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], ["a", "b"])

    return run


def near_copies(docs: DataFrame, width: int = 5, similarity: float = SIMILARITY, blocks: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """(doc_id, component_id): each document with the smallest doc_id it is linked to, over any number of links.

    Documents link whose sets of ``width``-word shingles have a Jaccard similarity of ``similarity`` or more; words are as in
    ``fingerprint``, and all texts without words are alike. Documents of one set are one node. Nodes that share
    a MinHash band are candidates, and so are those whose fingerprints ``blocks`` links: it makes (a, b) of distinct fp. In each component of candidates the whole sets are compared, a set shuffled
    once; a component of more than CELL shingles is split into parts by hash and compared part against part. Each
    cell passes on a spanning forest. A null doc_id is never the smallest unless its group has no other.
    """
    prints = stored(_prints(docs, width), "shingle-bands")
    one = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "hash")).alias("one")
    nodes = stored(prints.groupBy("node").agg(one, F.first("size").alias("size"), F.first("bands").alias("bands"), F.first("fp").alias("fp")), "shingle-nodes")
    keyed = nodes.select("node", F.posexplode("bands").alias("band", "key"))
    firsts = keyed.groupBy("band", "key").agg(F.min("node").alias("m"), F.max("node").alias("most")).filter("m != most")
    firsts = firsts.select(F.col("band").alias("b_"), F.col("key").alias("k_"), "m")
    links = keyed.join(firsts, (F.col("band") == F.col("b_")) & (F.col("key") == F.col("k_"))).select(F.col("node").alias("a"), F.col("m").alias("b"))
    if blocks is not None:
        named = nodes.groupBy("fp").agg(F.min("node").alias("m"), F.max("node").alias("most"))
        same = nodes.join(named.filter("m != most").withColumnRenamed("fp", "f_"), F.col("fp") == F.col("f_")).select(F.col("node").alias("a"), F.col("m").alias("b"))
        close = blocks(named.select("fp"))
        for end in ("a", "b"):
            close = close.join(named.select(F.col("fp").alias("f_"), F.col("m").alias(f"{end}_")), F.col(end) == F.col("f_")).drop("f_")
        links = links.unionByName(same).unionByName(close.select(F.col("a_").alias("a"), F.col("b_").alias("b")))
    roots = components(links, "a", "b").withColumnRenamed("node", "n_")
    known = nodes.select("node", "one", "size").join(roots, F.col("node") == F.col("n_")).select("node", "one", "size", "root")
    parts = known.groupBy("root").agg(F.ceil(F.sum("size") * 2 / CELL).cast("long").alias("parts")).withColumnRenamed("root", "r_")
    known = known.join(parts, F.col("root") == F.col("r_")).select("root", "node", "parts", F.col("one.doc_id").alias("id_"), F.col("one.hash").alias("h_"))
    texts = docs.select("doc_id", F.xxhash64("text").alias("hash"), "text")
    texts = texts.join(known, (F.col("hash") == F.col("h_")) & F.col("doc_id").eqNullSafe(F.col("id_"))).select("root", "node", "parts", "text")
    sets = texts.mapInArrow(_sets(width), "root long, node long, parts long, shingles array<long>")
    part = F.pmod(F.xxhash64("node"), F.col("parts"))
    others = F.transform(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1), lambda o: F.least(o, F.col("part")) * F.col("parts") + F.greatest(o, F.col("part")))
    cell = F.explode(F.when(F.col("parts") < 2, F.array(F.lit(0).cast("long"))).otherwise(others)).alias("cell")
    cells = sets.withColumn("part", part).select("root", cell, "node", "shingles")
    close = cells.repartition("root", "cell").sortWithinPartitions("root", "cell", "node").mapInArrow(_verify(similarity), "a long, b long")
    joined = components(close, "a", "b").withColumnRenamed("node", "n_")
    grouped = nodes.join(joined, F.col("node") == F.col("n_"), "left").select("node", F.col("one.doc_id").alias("first"), F.coalesce("root", "node").alias("root"))
    smallest = grouped.groupBy("root").agg(F.min("first").alias("component_id")).withColumnRenamed("root", "r_")
    named = stored(grouped.join(smallest, F.col("root") == F.col("r_")).select(F.col("node").alias("n_"), "component_id"), "shingle-groups")
    return prints.select("doc_id", "node").join(named, F.col("node") == F.col("n_")).select("doc_id", "component_id")
