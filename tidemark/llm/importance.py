"""Importance resampling towards a target distribution, over hashed n-grams told by an integer word dictionary."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import folded_words, small_batches, stored, table, text_or_empty

#: Words in a feature at most, buckets of features, words of a document that may be drawn, percent drawn, and the seed of the noise.
LONGEST, BUCKETS, LEAST_WORDS, PERCENT, SEED = 1, 10000, 20, 10, 2024
#: Bytes of text that share one list of local words: more text starts a new block, so what a task holds is bounded by this or one text.
BLOCK_BYTES = 32 << 20


class _Block:
    """Texts of one block: words and n-grams numbered as they come, and of each text its n-grams with counts."""

    def __init__(self, longest: int):
        self.longest, self.bytes = longest, 0
        self.words: dict[bytes, int] = defaultdict()
        self.words.default_factory = self.words.__len__
        self.texts: list[np.ndarray] = []

    def add(self, text: bytes) -> None:
        words = folded_words(text)
        self.texts.append(np.fromiter(map(self.words.__getitem__, words), np.int32, len(words)))
        self.bytes += len(text) + 64  # texts without words count too

    def grams(self) -> tuple[list[np.ndarray], list[list[int]]]:
        """The features of each text as numbers of n-grams, and the words of the n-grams of two and more; these are numbered on from the words."""
        found, longer = list(self.texts), []
        if self.longest == 1:
            return found, longer
        sizes = np.fromiter(map(len, self.texts), np.int64, len(self.texts))
        word = np.concatenate([*self.texts, np.empty(0, np.int32)])
        end = np.repeat(np.cumsum(sizes), sizes)  # where the text of each word ends
        start, before, first = np.arange(len(word)), word.astype(np.int64), len(self.words)
        for n in range(2, self.longest + 1):
            fits = start + n <= end[start]
            start, before = start[fits], before[fits]
            _, at, number = np.unique(before << 32 | word[start + n - 1], return_index=True, return_inverse=True)
            longer += [word[start[i] : start[i] + n].tolist() for i in at]
            before = number + first
            first += len(at)
            parts = np.split(before.astype(np.int32), np.searchsorted(start, np.cumsum(sizes)[:-1]))
            found = [np.concatenate(x) for x in zip(found, parts)]
        return found, longer


def _numbered(longest: int):
    """Texts -> rows of blocks: a text's n-grams with counts, a word with its count in the block, or a longer n-gram with its."""
    ints = pa.list_(pa.int32())

    def rows(block: _Block, ids: pa.Array, sizes: list[int], number: int) -> Iterator[pa.RecordBatch]:
        kinds = {"block": pa.int64(), "id": ids.type, "n_words": pa.int64(), "grams": ints, "counts": ints, "gram": pa.int32(), "n": pa.int64(), "word": pa.string(), "locals": ints}
        found, longer = block.grams()
        block.texts.clear()
        n_grams = len(block.words) + len(longer)
        in_block, offsets = np.zeros(n_grams, np.int64), np.zeros(len(sizes) + 1, np.int32)
        for i, features in enumerate(found):
            own, many = np.unique(features, return_counts=True)
            in_block[own] += many
            found[i] = own, many.astype(np.int32)
            offsets[i + 1] = offsets[i] + len(own)

        def batch(size: int, **columns) -> pa.RecordBatch:
            columns["block"] = pa.array(np.full(size, number, np.int64))
            return pa.RecordBatch.from_pydict({c: columns[c].cast(kind) if c in columns else pa.nulls(size, kind) for c, kind in kinds.items()})

        for at in range(0, len(sizes), 1000):
            part = found[at : at + 1000]
            grams, many = (pa.ListArray.from_arrays(pa.array(offsets[at : at + len(part) + 1] - offsets[at]), pa.array(np.concatenate([x[k] for x in part]))) for k in (0, 1))
            yield batch(len(part), id=ids.slice(at, len(part)), n_words=pa.array(sizes[at : at + len(part)], pa.int64()), grams=grams, counts=many)
        words = iter(block.words)
        for at in range(0, n_grams, 65536):
            end = min(at + 65536, n_grams)
            named = [w.decode() for w in islice(words, end - at)]
            tuples = [None] * len(named) + longer[max(at - len(block.words), 0) : max(end - len(block.words), 0)]
            yield batch(
                end - at, gram=pa.array(np.arange(at, end, dtype=np.int32)), n=pa.array(in_block[at:end]),
                word=pa.array(named + [None] * (end - at - len(named)), pa.string()), locals=pa.array(tuples, ints),
            )

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, block, ids = TaskContext.get().partitionId() << 32, _Block(longest), []
        for batch in batches:
            begin = 0
            for i, text in enumerate(batch.column(1)):
                block.add(text.as_py())
                if block.bytes >= BLOCK_BYTES:
                    ids.append(batch.column(0).slice(begin, i + 1 - begin))
                    yield from rows(block, pa.concat_arrays(ids), [len(t) for t in block.texts], number)
                    begin, number, block, ids = i + 1, number + 1, _Block(longest), []
            if begin < batch.num_rows:
                ids.append(batch.column(0).slice(begin))
        if ids:
            yield from rows(block, pa.concat_arrays(ids), [len(t) for t in block.texts], number)

    return numbered


def numbered(texts: DataFrame, longest: int, name: str) -> DataFrame:
    """(id, text) -> stored rows of blocks of texts: (block, id, n_words, grams, counts) of each text, (block, gram, n, word) of each word
    of a block, (block, gram, n, locals) of each longer n-gram of a block, its words told by their numbers there."""
    schema = T.StructType(
        [
            T.StructField("block", T.LongType()), T.StructField("id", texts.schema["id"].dataType), T.StructField("n_words", T.LongType()),
            T.StructField("grams", T.ArrayType(T.IntegerType())), T.StructField("counts", T.ArrayType(T.IntegerType())),
            T.StructField("gram", T.IntegerType()), T.StructField("n", T.LongType()), T.StructField("word", T.StringType()), T.StructField("locals", T.ArrayType(T.IntegerType())),
        ]
    )
    bare = texts.select("id", text_or_empty().cast("binary").alias("text"))
    with small_batches(texts.sparkSession):
        return stored(bare.mapInArrow(_numbered(longest), schema), name)


def as_tuples(blocks: DataFrame, dictionary: DataFrame, longest: int) -> DataFrame:
    """(block, gram, tuple, n): the n-grams of all blocks as arrays of ids from the dictionary."""
    ids = blocks.filter("word is not null").select("block", "gram", "n", "word").join(dictionary, "word").select("block", "gram", "id", "n")
    tuples = ids.select("block", "gram", F.array("id").alias("tuple"), "n")
    if longest > 1:
        long = blocks.filter("locals is not null").select("block", "gram", "n", F.posexplode("locals").alias("at", "local"))
        known = ids.select(F.col("block").alias("b"), F.col("gram").alias("g"), "id")
        met = long.join(known, (F.col("block") == F.col("b")) & (F.col("local") == F.col("g")))
        in_order = F.transform(F.array_sort(F.collect_list(F.struct("at", "id"))), lambda x: x["id"])
        tuples = tuples.unionByName(met.groupBy("block", "gram").agg(in_order.alias("tuple"), F.first("n").alias("n")))
    return tuples


def hashed(tuples: DataFrame, dictionary: DataFrame, longest: int, buckets: int) -> DataFrame:
    """Distinct (tuple, ...) -> the same with ``bucket``: the CRC-32 of the words' UTF-8 bytes, joined by one space, modulo ``buckets``."""
    told = tuples
    for i in range(longest):
        word = dictionary.select(F.col("id").alias(f"id{i}"), F.col("word").alias(f"word{i}"))
        told = told.join(word, F.get("tuple", F.lit(i)) == F.col(f"id{i}"), "left" if i else "inner").drop(f"id{i}")
    words = [f"word{i}" for i in range(longest)]
    return told.withColumn("bucket", (F.crc32(F.concat_ws(" ", *words).cast("binary")) % buckets).cast("int")).drop(*words)


def _weights(docs: pa.Table, gains: pa.Table) -> pa.Table:
    """The texts of one block with the sum of the gains of their features."""
    gain = np.zeros(gains.num_rows, np.int64)
    gain[gains.column("gram").to_numpy()] = gains.column("gain").to_numpy()
    docs = docs.combine_chunks()
    grams, counts = (docs.column(c).combine_chunks() if docs.num_rows else pa.array([], pa.list_(pa.int32())) for c in ("grams", "counts"))
    each = gain[grams.flatten().to_numpy()] * counts.flatten().to_numpy()
    sums = np.concatenate([[0], np.cumsum(each)])
    lengths = np.diff(grams.offsets.to_numpy())
    ends = np.cumsum(lengths)
    n_features = np.concatenate([[0], np.cumsum(counts.flatten().to_numpy(), dtype=np.int64)])
    return pa.table({"id": docs.column("id"), "n_words": docs.column("n_words"), "n_features": n_features[ends] - n_features[ends - lengths], "weight": sums[ends] - sums[ends - lengths]})


def weighed(docs: DataFrame, target: DataFrame, longest: int = LONGEST, buckets: int = BUCKETS) -> DataFrame:
    """(doc_id, text) and target (text) -> doc_id, n_words, n_features, weight: one row a document, how much more likely the target makes its features.

    Features are the runs of 1 to ``longest`` words, repeats counted. Words get integer ids in one dictionary of all texts; n-grams are tuples of
    ids, and each distinct tuple's bytes are put together and hashed once. Counts of a bucket over all documents and all of the target, each
    plus one, give its gain in thousandths of a natural logarithm, rounded down; the weight is the sum over a document's features.

    Texts are numbered in blocks of bounded size, so that only the distinct words and n-grams of a block, not their every
    occurrence, are joined with the dictionary and with the gains; a frequent word is one row a block. Null, empty and wordless texts have weight
    0; repeated rows each count and each come back; an empty table of documents gives an empty one, an empty target
    counts nothing. Very long texts are blocks of their own. Other columns don't matter.
    """
    own = numbered(docs.select(F.col("doc_id").alias("id"), "text"), longest, "numbered")
    wanted = numbered(target.select(F.lit(0).alias("id"), "text"), longest, "numbered-target")
    words = own.select("word").unionByName(wanted.select("word")).filter("word is not null").distinct()
    dictionary = stored(words.withColumn("id", F.monotonically_increasing_id()), "dictionary")
    tuples = stored(as_tuples(own, dictionary, longest), "tuples")
    counted = tuples.select("tuple", F.col("n").alias("s"), F.lit(0).cast("long").alias("t"))
    counted = counted.unionByName(as_tuples(wanted, dictionary, longest).select("tuple", F.lit(0).cast("long").alias("s"), F.col("n").alias("t")))
    distinct = counted.groupBy("tuple").agg(F.sum("s").alias("s"), F.sum("t").alias("t"))
    known = stored(hashed(distinct, dictionary, longest, buckets), "hashed")
    in_bucket = known.groupBy("bucket").agg(F.sum("s").cast("double").alias("s"), F.sum("t").cast("double").alias("t"))
    in_all = in_bucket.agg(F.sum("s").alias("all_s"), F.sum("t").alias("all_t"))  # one row a bucket goes in, one comes out
    ratio = (F.col("t") + 1) * (F.col("all_s") + buckets) / ((F.col("s") + 1) * (F.col("all_t") + buckets))
    gain = in_bucket.crossJoin(F.broadcast(in_all)).select("bucket", F.floor(F.ln(ratio) * 1000).alias("gain"))
    of_tuple = known.join(F.broadcast(gain), "bucket").select(F.col("tuple").alias("known"), "gain")  # as many rows as buckets at most
    gains = tuples.join(of_tuple, F.col("tuple") == F.col("known")).select("block", "gram", "gain")
    texts = own.filter("n_words is not null").select("block", "id", "n_words", "grams", "counts")
    schema = T.StructType([texts.schema["id"], *(T.StructField(c, T.LongType()) for c in ("n_words", "n_features", "weight"))])
    return texts.groupBy("block").cogroup(gains.groupBy("block")).applyInArrow(_weights, schema).withColumnRenamed("id", "doc_id")


def draw(weights: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED) -> DataFrame:
    """(doc_id, n_words, n_features, weight) -> doc_id, n_features, weight, score, rank.

    The score is the weight plus Gumbel noise from the doc_id (null: as an empty text), in thousandths, so that the highest scores are a draw without replacement in
    proportion to exp(weight / 1000). Of the N documents with ``least_words`` or more, floor(percent * N / 100) get a rank from 1, by score from
    above, ties to the smaller doc_id (null first; equal rows in any order); the others' is null. Ranks are counted in ranges of the order, so no
    task sorts more than its share, rows of one doc_id included.
    """
    drawn = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(F.ln(-F.ln((drawn + 0.5) / 4294967296.0)) * -1000)
    scored = stored(weights.withColumn("score", F.col("weight") + noise).withColumn("row", F.monotonically_increasing_id()), "scored")
    eligible = scored.filter(F.col("n_words") >= least_words)
    k = percent * eligible.count() // 100
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_first(), F.col("row").asc()]
    parts = int(scored.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = stored(eligible.select("row", "score", "doc_id").repartitionByRange(parts, *order).withColumn("part", F.spark_partition_id()), "ranges")
    sizes = dealt.groupBy("part").agg(F.count("*").alias("size"))
    ahead = F.sum("size").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.select(F.col("part").alias("p"), F.coalesce(ahead, F.lit(0)).alias("start")).filter(F.col("start") < k)
    nth = F.row_number().over(Window.partitionBy("part").orderBy(*order))
    ranks = dealt.join(F.broadcast(starts), F.col("part") == F.col("p")).select(F.col("row").alias("r"), (F.col("start") + nth).alias("rank")).filter(F.col("rank") <= k)
    return scored.join(ranks, F.col("row") == F.col("r"), "left").select("doc_id", "n_features", "weight", "score", "rank")


def resample(docs: DataFrame, target: DataFrame, longest: int = LONGEST, buckets: int = BUCKETS, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED) -> DataFrame:
    """Every document with its weight towards the target, its score and, where it is drawn, its rank: ``draw`` of ``weighed``."""
    return draw(weighed(docs, target, longest, buckets), percent, least_words, seed)


def op12_importance(spark, sf_dir: str) -> DataFrame:
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP12_SQL = r"""
WITH crc AS (
  SELECT list(list_reduce(list_prepend(CAST(b AS BIGINT), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::BIGINT) ELSE c >> 1 END) ORDER BY b) AS crc_table
  FROM range(256) AS r(b)
), texts AS (
  SELECT doc_id, false AS wanted, text FROM documents UNION ALL SELECT item_id, true, text FROM benchmark
), words AS (
  SELECT doc_id, wanted, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS word FROM texts
), counts AS (
  SELECT doc_id, wanted, word, count(*) AS n FROM words GROUP BY ALL
), distinct_words AS (
  SELECT word, hex(encode(word)) AS h FROM counts GROUP BY word
), hashed AS (
  SELECT word, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length(h), 2), lambda i: CAST('0x' || h[i:i + 1] AS BIGINT))),
    lambda c, b: xor(c >> 8, crc_table[(xor(c, b) & 255) + 1])), 4294967295::BIGINT) % 10000 AS bucket
  FROM distinct_words, crc
), buckets AS (
  SELECT bucket, CAST(coalesce(sum(n) FILTER (NOT wanted), 0) AS DOUBLE) AS s, CAST(coalesce(sum(n) FILTER (wanted), 0) AS DOUBLE) AS t FROM counts JOIN hashed USING (word) GROUP BY bucket
), gains AS (
  SELECT bucket, CAST(floor(1000 * ln((t + 1) * (sum(s) OVER () + 10000) / ((s + 1) * (sum(t) OVER () + 10000)))) AS BIGINT) AS gain FROM buckets
), weights AS (
  SELECT doc_id, CAST(sum(n) AS BIGINT) AS n_features, CAST(sum(n * gain) AS BIGINT) AS weight
  FROM counts JOIN hashed USING (word) JOIN gains USING (bucket) WHERE NOT wanted GROUP BY doc_id
), scored AS (
  SELECT d.doc_id, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight, coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln(
    (CAST(CAST('0x' || sha256('2024:' || d.doc_id)[1:8] AS BIGINT) AS DOUBLE) + 0.5) / 4294967296))) AS BIGINT) AS score
  FROM documents d LEFT JOIN weights w ON d.doc_id = w.doc_id
), ranked AS (
  SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, count(*) OVER () AS n FROM scored WHERE n_features >= 20
)
SELECT s.doc_id, n_features, weight, score, rank FROM scored s LEFT JOIN ranked r ON s.doc_id = r.doc_id AND rank <= 10 * n // 100
"""
