"""SimHash fingerprints and near-duplicate groups through pigeonhole blocks."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import free_name, majority, stored, table
from tidemark.llm.components import components
from tidemark.llm.similar import near_copies

#: Bits at which fingerprints of near duplicates may differ.
DISTANCE = 4
#: A fingerprint is split into so many blocks; with DISTANCE of them hit at worst, KEPT still agree.
BLOCKS = 6
KEPT = BLOCKS - DISTANCE
#: Fingerprints that one cell compares; a larger bucket is split into pairs of parts of this size.
CELL = 2048


def fingerprint(text: str | None, width: int = 4) -> int:
    """64-bit SimHash of a text over ``width``-word shingles; 0 if it has no word.

    ASCII letters are lowered, words are runs of anything but ASCII white space, a shingle is joined by single
    spaces; with fewer words the whole sequence is the only one. Repeats count. A bit is 1 if it
    is set in over half of the shingles' XXH64 hashes (UTF-8, seed 42).
    """
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    n = max(1, len(words) - width + 1)
    starts = [0, *(ends[: n - 1] + 1).tolist()]
    stops = ends[len(words) - n :].tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(joined[a:b], 42) for a, b in zip(starts, stops)), np.uint64, n)
    return majority(hashes)


def fingerprints(docs: DataFrame, width: int = 4) -> DataFrame:
    """(doc_id, fp): the fingerprint of every document as a signed 64-bit integer."""

    def run(batches):
        for batch in batches:
            values = np.array([fingerprint(x.as_py(), width) for x in batch.column(1)], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values.view(np.int64))], ["doc_id", "fp"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, fp long")


def _keys(fp: Column) -> Column:
    """One key for each choice of KEPT blocks: the choice's number over the bits of those blocks."""
    edges = [64 * i // BLOCKS for i in range(BLOCKS + 1)]
    masks = [((1 << edges[i + 1]) - 1) ^ ((1 << edges[i]) - 1) for i in range(BLOCKS)]
    choices = [sum(masks[i] for i in chosen) for chosen in combinations(range(BLOCKS), KEPT)]
    signed = [m - (1 << 64) if m >> 63 else m for m in choices]
    return F.array(*(F.struct(F.lit(i).alias("choice"), fp.bitwiseAND(F.lit(m)).alias("bits")) for i, m in enumerate(signed)))


def _forest(fps: np.ndarray) -> list[tuple[int, int]]:
    """Links that join the fingerprints of one cell as all close pairs would: breadth first, a link for each one reached."""
    left = np.arange(len(fps))
    out = []
    while len(left) > 1:
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            here = queue.pop()
            near = np.bitwise_count(fps[left] ^ fps[here]) <= DISTANCE
            reached = left[near]
            out += [(int(fps[here]), int(fps[i])) for i in reached]
            queue += reached.tolist()
            left = left[~near]
    return out


def _compare(batches):
    """Rows sorted by (choice, bits, cell): compare the fingerprints of each cell, carrying the last over to the next batch."""
    rest = np.empty((0, 4), np.int64)

    def links(rows):
        if len(rows) < 2:
            return None
        new = np.any(rows[1:, :3] != rows[:-1, :3], axis=1)
        bounds = np.flatnonzero(np.concatenate([[True], new, [True]]))
        sizes = np.diff(bounds)
        fps = rows[:, 3].view(np.uint64) if rows[:, 3].flags.c_contiguous else np.ascontiguousarray(rows[:, 3]).view(np.uint64)
        a, b = [], []
        two = bounds[:-1][sizes == 2]
        close = two[np.bitwise_count(fps[two] ^ fps[two + 1]) <= DISTANCE]
        a.append(fps[close])
        b.append(fps[close + 1])
        for at, size in zip(bounds[:-1][sizes > 2], sizes[sizes > 2]):
            if found := _forest(fps[at : at + size]):
                x = np.array(found, np.uint64)
                a.append(x[:, 0])
                b.append(x[:, 1])
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).view(np.int64)) for x in (a, b)], ["a", "b"])

    for batch in batches:
        rows = np.concatenate([rest, np.stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns], axis=1)])
        if not len(rows):
            continue
        last = np.flatnonzero(np.any(rows[:, :3] != rows[-1, :3], axis=1))
        cut = int(last[-1]) + 1 if len(last) else 0
        rest = rows[cut:]
        if (out := links(rows[:cut])) is not None and out.num_rows:
            yield out
    if (out := links(rest)) is not None and out.num_rows:
        yield out


def near_links(fps: DataFrame) -> DataFrame:
    """(a, b): links between distinct fingerprints of ``fps`` (fp) that connect whatever is DISTANCE bits apart or less.

    Fingerprints that close agree in KEPT of BLOCKS blocks, so each is put in a bucket for every choice of KEPT
    blocks, and only members of one bucket are compared. Buckets of one fingerprint are left out after a
    count. One of more than CELL is split into parts by hash and compared part against part, so no task
    holds a whole bucket; each cell passes on a spanning forest of its close pairs, not all of them.
    """
    keyed = fps.select("fp", F.explode(_keys(F.col("fp"))).alias("key")).select("key.choice", "key.bits", "fp")
    sizes = keyed.groupBy("choice", "bits").agg(F.count("*").alias("n")).filter("n > 1")
    sizes = sizes.select(F.col("choice").alias("c"), F.col("bits").alias("k"), F.ceil(F.col("n") * 2 / CELL).cast("int").alias("parts"))
    shared = keyed.join(sizes, (F.col("choice") == F.col("c")) & (F.col("bits") == F.col("k")))
    part = F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int")
    others = F.transform(
        F.sequence(F.lit(0), F.col("parts") - 1), lambda o: F.least(o, F.col("part")).cast("long") * F.col("parts") + F.greatest(o, F.col("part"))
    )
    cells = shared.withColumn("part", part).select(
        "choice", "bits", F.explode(F.when(F.col("parts") < 2, F.array(F.lit(0).cast("long"))).otherwise(others)).alias("cell"), "fp"
    )
    return cells.repartition("choice", "bits", "cell").sortWithinPartitions("choice", "bits", "cell", "fp").mapInArrow(_compare, "a long, b long")


def near_duplicates(docs: DataFrame, width: int = 4) -> DataFrame:
    """(doc_id, fp, component_id): each document's fingerprint and the smallest doc_id it is linked to, over any number of links.

    Equal fingerprints link, and so do those DISTANCE bits apart or less. Null and empty texts have
    fingerprint 0 and link like any other. Documents of equal fingerprint are one node while links are searched.
    Repeated rows stay repeated; a null doc_id is never the smallest unless its group has no other; an
    empty table gives an empty one.
    """
    fps = stored(fingerprints(docs, width), "fingerprints")
    nodes = stored(fps.groupBy("fp").agg(F.min("doc_id").alias("first")), "fingerprint-nodes")
    roots = components(near_links(nodes.select("fp")), "a", "b")
    grouped = nodes.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    smallest = grouped.groupBy("root").agg(F.min("first").alias("component_id"))
    named = stored(grouped.join(smallest, "root").select(F.col("fp").alias("node"), "component_id"), "fingerprint-groups")
    return fps.join(named, F.col("fp") == F.col("node")).select("doc_id", "fp", "component_id")


def without_near_duplicates(docs: DataFrame, width: int = 5) -> DataFrame:
    """``docs`` with all its columns, of each group of ``near_copies`` only the document with the smallest doc_id.

    Candidates are documents whose SimHash fingerprints are DISTANCE bits apart or less, found by pigeonhole blocks (``near_links``), and,
    as that leaves most copies of similarity 0.8 to 0.95 apart, those that share a MinHash band. Whole shingle sets decide.
    Null texts and texts without words are one group; repeated rows are copies of each other only if their doc_ids differ.
    Rows that share that doc_id all stay; a group without any doc_id stays.
    """
    groups = near_copies(docs, width, blocks=near_links)
    own = free_name(docs.columns, "gone_id")
    gone = groups.filter(~F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias(own)).distinct()
    return docs.join(gone, F.col("doc_id").eqNullSafe(F.col(own)), "left_anti")


def op3_simhash(spark, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
