"""Benchmark decontamination: windows of benchmark items inside documents, by a prefix-filtered set join of word shingles."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import folded_words, stored, table, text_or_empty

#: Words of a window, words of a shingle, and the share of a window's shingles that a document must hold at their places.
WINDOW, SHINGLE, SHARE = 10, 5, 1.0
#: Bits of the sieve of benchmark shingles that tasks read: between these powers of two, so at most 16 MB whatever the benchmark.
LEAST_BITS, MOST_BITS = 20, 27
#: Rows that a task hands on at once.
ROWS = 20_000


def _places(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(zlib.crc32, words), np.int64, len(words))


def _bits(words: np.ndarray, length: int) -> np.ndarray:
    """A number below 2^40 for each run of ``length`` words, from the words' own hashes: equal runs have equal numbers."""
    total = np.zeros(max(len(words) - length + 1, 0), np.int64)
    for i in range(length):
        total += words[i : i + len(total)] * ((i * 2 + 1) * 40503 & 0xFFFFF | 1)
    return total >> 16 & (1 << 40) - 1


def _item_windows(window: int):
    """(item, text) -> (item, window): every run of ``window`` words, or all words of a shorter text that has any."""

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, found = [], []
        pack = lambda: pa.RecordBatch.from_pydict({"item": pa.array(items, pa.string()), "window": pa.array(found, pa.string())})
        for batch in batches:
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                words = [w.decode() for w in folded_words(text.as_py())]
                for i in range(max(len(words) - window + 1, min(len(words), 1))):
                    items.append(item)
                    found.append(" ".join(words[i : i + window]))
                    if len(items) >= ROWS:
                        yield pack()
                        items, found = [], []
        yield pack()

    return windows


def _sieved(shingles: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(shingle, length) -> (bit)."""
    for batch in shingles:
        bits = [int(_bits(_places(s.encode().split()), n)[0]) for s, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
        yield pa.RecordBatch.from_pydict({"bit": pa.array(bits, pa.int64())})


def sieve(shingles: DataFrame) -> np.ndarray:
    """One bit for each shingle of a table (shingle, length), at a place told by its words; several may share one.

    The size follows the number of shingles up to 2^27 bits. Bits are set by Spark, in pieces of 4 kB; beyond the
    bound more places that hold no shingle pass, and the join drops them.
    """
    n = shingles.count()
    power = min(max(LEAST_BITS, (16 * n).bit_length()), MOST_BITS)
    placed = shingles.mapInArrow(_sieved, "bit long").select((F.col("bit").bitwiseAND((1 << power) - 1) + 1).alias("bit"))
    pieces = placed.groupBy(F.bitmap_bucket_number("bit").alias("piece")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("bits"))
    out = np.zeros(1 << power - 3, np.uint8)
    for piece, bits in pieces.collect():  # at most 2^27 bits in all
        out[(piece - 1) * 4096 : piece * 4096] = np.frombuffer(bits, np.uint8)
    return out


def _scan(sieved, lengths: dict[int, int], window: int):
    """Texts -> one row a text (row, doc_id, n_words) and one a place (row, at, shingle, begin, around) that the sieve lets pass.

    lengths: of shingles, each with the number of places next to one another that any window needs. ``around``: the words from ``begin`` on that any window
    with that shingle may cover.
    """

    def runs(on: np.ndarray, least: int) -> np.ndarray:
        """Places of runs of ``least`` or more."""
        if least > 1 and len(on):
            edges = np.flatnonzero(np.diff(np.concatenate([[0], on.view(np.int8), [0]])))
            begins, ends = edges[::2], edges[1::2]
            keep = ends - begins >= least
            on = np.zeros(len(on) + 1, np.int8)
            on[begins[keep]] += 1
            on[ends[keep]] -= 1
            on = np.cumsum(on[:-1])
        return np.flatnonzero(on)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.frombuffer(sieved.value, np.uint8)
        mask, number = len(bits) * 8 - 1, TaskContext.get().partitionId() << 40
        for batch in batches:
            ids, found, sizes, first = batch.column(0), [], [], number

            def pack(rows, ids=ids):
                row, at, shingle, begin, around = zip(*rows) if rows else ((),) * 5
                return pa.RecordBatch.from_pydict({
                    "row": pa.array(row, pa.int64()), "doc_id": pa.nulls(len(row), ids.type), "n_words": pa.nulls(len(row), pa.int64()), "at": pa.array(at, pa.int64()),
                    "shingle": pa.array(shingle, pa.string()), "begin": pa.array(begin, pa.int64()), "around": pa.array(around, pa.list_(pa.string())),
                })

            for text in batch.column(1):
                words = folded_words(text.as_py())
                places = _places(words)
                for length, least in lengths.items():
                    bit = _bits(places, length) & mask
                    for i in runs(bits[bit >> 3] >> (bit & 7).astype(np.uint8) & 1, least):
                        begin = max(0, i - (window - length))
                        found.append((number, i, b" ".join(words[i : i + length]).decode(), begin, [w.decode() for w in words[begin : i + window]]))
                        if len(found) >= ROWS:
                            yield pack(found)
                            found = []
                sizes.append(len(words))
                number += 1
            yield pack(found)
            none = lambda kind, n=len(sizes): pa.nulls(n, kind)
            yield pa.RecordBatch.from_pydict({
                "row": pa.array(np.arange(first, number)), "doc_id": ids, "n_words": pa.array(sizes, pa.int64()), "at": none(pa.int64()), "shingle": none(pa.string()), "begin": none(pa.int64()), "around": none(pa.list_(pa.string())),
            })

    return scan


def _needed(shingles: Column, share: float) -> Column:
    return F.greatest(F.ceil(shingles * share), F.lit(1)).cast("int")


def _from(words: str, begin: Column, length: Column) -> Column:
    return F.slice(words, begin, length)


def occurrences(docs: DataFrame, windows: DataFrame, window: int, shingle: int, share: float) -> tuple[DataFrame, DataFrame]:
    """(doc_id, text) and stored (window_id, words) -> texts (row, doc_id, n_words) and places (row, start, length, window_id) where a window occurs."""
    length = F.least(F.size("words"), F.lit(shingle))
    count = F.size("words") - length + 1
    of_window = windows.withColumns({"length": length, "count": count})
    shingles = of_window.select("window_id", "words", "length", "count", F.explode(F.sequence(F.lit(0), F.col("count") - 1)).alias("offset"))
    shingles = stored(shingles.withColumn("shingle", F.concat_ws(" ", _from("words", F.col("offset") + 1, F.col("length")))), "window-shingles")
    least = of_window.groupBy("length").agg(F.min("count").alias("count")).collect()  # at most a row for each length up to that of a shingle
    bits = sieve(shingles.select("shingle", "length").distinct())
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(bits.tobytes())
    schema = T.StructType(
        [
            T.StructField("row", T.LongType()), docs.schema["doc_id"], T.StructField("n_words", T.LongType()), T.StructField("at", T.LongType()),
            T.StructField("shingle", T.StringType()), T.StructField("begin", T.LongType()), T.StructField("around", T.ArrayType(T.StringType())),
        ]
    )
    lengths = {r["length"]: r["count"] if share == 1 else 1 for r in least}
    bare = docs.select("doc_id", text_or_empty().cast("binary").alias("text"))
    seen = stored(bare.mapInArrow(_scan(sent, lengths, window), schema), "shingle-places")
    places = seen.filter("at is not null").select("row", "at", "shingle", "begin", "around")
    rarity = places.groupBy(F.col("shingle").alias("s")).agg(F.count("*").alias("held"))
    ranked = shingles.join(rarity, F.col("shingle") == F.col("s"), "left").withColumn(
        "nth", F.row_number().over(Window.partitionBy("window_id").orderBy(F.coalesce("held", F.lit(0)), "shingle", "offset"))
    )
    prefix = ranked.filter((F.col("nth") <= F.col("count") - _needed(F.col("count"), share) + 1) & F.col("held").isNotNull())
    prefix = stored(prefix.select("window_id", "words", "count", F.col("length").alias("k"), "offset", F.col("shingle").alias("s")), "window-prefixes")
    met = places.join(prefix, F.col("shingle") == F.col("s")).withColumn("start", F.col("at") - F.col("offset"))
    there = (F.col("start") - F.col("begin") + 1).cast("int")
    size = F.size("words")
    same = F.filter(F.sequence(F.lit(0), F.col("count") - 1), lambda i: _from("around", there + i, F.col("k")) == _from("words", i + 1, F.col("k")))
    fits = (F.col("start") >= F.col("begin")) & (there + size - 1 <= F.size("around"))
    held = F.when(fits, _from("around", there, size) == F.col("words") if share == 1 else F.size(same) >= _needed(F.col("count"), share)).otherwise(False)
    found = met.filter(held).select("row", "start", size.cast("long").alias("length"), "window_id").distinct()
    return seen.filter("n_words is not null").select("row", "doc_id", "n_words"), stored(found, "window-places")


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW, shingle: int = SHINGLE, share: float = SHARE) -> DataFrame:
    """Documents (doc_id, text) and items (item_id, text) -> doc_id, n_words, n_hit, n_items, items_sha256, contaminated: one row a document.

    A window is a run of ``window`` words of an item, or all words of a shorter one. It occurs in a document where at least ``share`` of its
    shingles of ``shingle`` words (all words, if it has fewer) stand, each at its own place; with share 1 that is the window word for word. A word inside any
    occurrence is hit.

    The join: a window's shingles are ordered by how often documents hold them, rarest first, and the first n - ceil(share * n) + 1 of n must
    contain one that any occurrence holds, so only these are joined. Position and length bounds (the window must lie within the text) and the words
    themselves decide. Documents are read once: a sieve of bounded size keeps the places of benchmark shingles, with the words around, and with share 1 only
    those in runs as long as some window needs. Equal windows of several items are one; documents with the same windows share one list
    of items, so a passage that many documents hold is listed once.

    Null, empty and wordless texts have no words, hits or items (as an item: no windows); a null item_id is listed as an empty string, equal item_ids are
    one item with the windows of all its rows. Repeated documents each get their row. Empty tables give an empty table, or no hits. Texts are
    taken whole, however long; a row holds no more words than two windows. Other columns don't matter.
    """
    named = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), text_or_empty().cast("binary").alias("text"))
    of_item = stored(named.mapInArrow(_item_windows(window), "item string, window string").distinct(), "item-windows")
    numbered = of_item.select("window").distinct().select(F.monotonically_increasing_id().alias("window_id"), F.split("window", " ").alias("words"), "window")
    windows = stored(numbered, "windows")
    texts, places = occurrences(docs, windows.select("window_id", "words"), window, shingle, share)

    ends = places.groupBy("row", "start").agg((F.col("start") + F.max("length")).alias("end"))
    covered = F.max("end").over(Window.partitionBy("row").orderBy("start").rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.greatest(F.col("end") - F.greatest("start", F.coalesce(covered, F.lit(0))), F.lit(0))
    hits = ends.withColumn("fresh", fresh).groupBy("row").agg(F.sum("fresh").alias("n_hit"))
    held = places.groupBy("row").agg(F.array_sort(F.collect_set("window_id")).alias("held"))
    held = stored(held.withColumn("class", F.sha2(F.concat_ws(",", F.col("held").cast("array<string>")), 256)), "held-windows")
    classes = held.groupBy("class").agg(F.any_value("held").alias("held")).select("class", F.explode("held").alias("window_id"))
    members = windows.select("window_id", "window").join(of_item, "window").select("window_id", "item")
    listed = classes.join(members, "window_id").select("class", "item").distinct().groupBy("class").agg(F.array_sort(F.collect_list("item")).alias("items"))
    lists = listed.select("class", F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"))
    of_row = hits.join(held.select("row", "class"), "row").join(lists, "class").select(F.col("row").alias("r"), "n_hit", "n_items", "items_sha256")
    zero = F.lit(0).cast("long")
    return texts.join(of_row, F.col("row") == F.col("r"), "left").select(
        "doc_id", "n_words", F.coalesce("n_hit", zero).alias("n_hit"), F.coalesce("n_items", zero).alias("n_items"),
        F.coalesce("items_sha256", F.sha2(F.lit(""), 256)).alias("items_sha256"), F.col("n_hit").isNotNull().alias("contaminated"),
    )


def op13_decontaminate(spark, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP13_SQL = r"""
WITH docs AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), items AS (
  SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), windows AS (
  SELECT DISTINCT item_id, w[i:i + 9] AS win, len(w[i:i + 9]) AS n FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM items WHERE len(w) > 0)
), runs AS (
  SELECT doc_id, i, n, w[i:i + n - 1] AS win FROM (
    SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM docs, (SELECT DISTINCT n FROM windows) AS sizes WHERE len(w) >= n)
), found AS (
  SELECT doc_id, i, runs.n, item_id FROM runs JOIN windows ON runs.n = windows.n AND runs.win = windows.win
), hit AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT doc_id, i, n FROM found)) GROUP BY doc_id
), listed AS (
  SELECT doc_id, count(*) AS n_items, sha256(string_agg(item_id, ',' ORDER BY item_id)) AS items_sha256 FROM (SELECT DISTINCT doc_id, item_id FROM found) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, coalesce(items_sha256, sha256('')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM docs d LEFT JOIN hit ON d.doc_id = hit.doc_id LEFT JOIN listed ON d.doc_id = listed.doc_id
"""
