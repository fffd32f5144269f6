"""How filters of a corpus interact: every order of the filters replayed over every document's flags."""

from __future__ import annotations

from functools import reduce
from itertools import permutations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import WORD, stored, table, text_or_empty

#: The least number of words (A), least share of distinct words in percent (B), most upper case letters in percent of the code points (C).
LEAST_WORDS, LEAST_DISTINCT, MOST_UPPER = 200, 50, 3
LETTERS = "ABCDE"


def text_failures(text: Column) -> dict[str, Column]:
    """Which of the filters A to D a text that isn't null fails."""
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    return {
        "A": F.regexp_count(text, F.lit(WORD)) < LEAST_WORDS,
        "B": F.size(F.array_distinct(words)) * 100 < F.size(words) * LEAST_DISTINCT,
        "C": F.regexp_count(text, F.lit("[A-Z]")) * 100 > F.length(text) * MOST_UPPER,
        "D": text.rlike(r"[#$%&*|]"),
    }


def orders(spark: SparkSession, letters: str) -> DataFrame:
    """(filter_order, steps): one row a permutation; a step is the letter, its number from 1 and its bit. Bounded by the number of filters, not by data."""
    rows = [("".join(p), [(i, x, 1 << letters.index(x)) for i, x in enumerate(p, 1)]) for p in permutations(letters)]
    return spark.createDataFrame(rows, "filter_order string, steps array<struct<step: int, letter: string, bit: int>>")


def replay(flags: DataFrame, letters: str) -> DataFrame:
    """(part, flags, good, toxic) -> counts of every part, order of the filters and step.

    ``flags`` has bit i where the i-th filter fails. Each row meets all orders, a broadcast table of as many rows as there are permutations;
    its first failing step under an order tells at which steps it is still kept, where it is removed and which later filters
    it fails for nothing. Counts are combined in the task that made the rows, so a shuffle carries one row a task, part, order and step;
    the window over a filter's counts holds one row an order.
    """
    first = F.lit(len(letters) + 1)
    for i in reversed(range(len(letters))):
        first = F.when(F.col("flags").bitwiseAND(F.col("steps")[i]["bit"]) != 0, i + 1).otherwise(first)
    met = flags.crossJoin(F.broadcast(orders(flags.sparkSession, letters))).withColumn("first", first)
    steps = met.select("part", "filter_order", "flags", "good", "toxic", "first", F.inline("steps"))
    fails = F.col("flags").bitwiseAND(F.col("bit")) != 0
    removed = F.col("first") == F.col("step")
    counts = steps.groupBy("part", "filter_order", "step", "letter").agg(
        F.count_if(F.col("first") > F.col("step")).alias("kept"),
        F.count_if(removed).alias("removed"),
        F.count_if(fails & (F.col("first") < F.col("step"))).alias("redundant"),
        F.count_if(F.col("flags") == F.col("bit")).alias("unique_fails"),
        F.count_if(removed & F.col("good")).alias("good_lost"),
        F.count_if(removed & F.col("toxic")).alias("toxic_lost"),
    )
    return counts.withColumn("shapley", F.sum("removed").over(Window.partitionBy("part", "letter"))).drop("letter")


def audit(docs: DataFrame, labels: DataFrame, more: dict[str, Column] | None = None) -> DataFrame:
    """Documents (doc_id, text, lang) and labels (doc_id, quality, toxic) -> part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley.

    The filters are A to D of ``text_failures`` and E: the text is that of a row with a smaller doc_id, anywhere in the table. ``more`` adds filters
    by letter, as columns that are true where a document fails; each one more multiplies the orders. One row for each part (value of lang, null: empty),
    order and step, zeros included; an empty table gives none.

    Null texts are empty ones: they fail A, nothing else but E. Equal rows each count; rows that share a doc_id aren't copies of one
    another, and a null doc_id is neither smaller nor larger than any. A document counts as good or toxic if any of its labels says 1; null
    labels say nothing. Texts are compared by their SHA-256. Very long texts are read a text at a time, in whole; other columns don't matter.
    """
    of_text = text_failures(F.col("text")) | (more or {})
    letters = LETTERS[:4] + "".join(more or {}) + LETTERS[4]
    bare = docs.withColumn("text", text_or_empty())
    bits = reduce(Column.bitwiseOR, (F.when(F.coalesce(c, F.lit(False)), 1 << letters.index(x)).otherwise(0) for x, c in of_text.items()))
    seen = stored(bare.select("doc_id", F.coalesce("lang", F.lit("")).alias("part"), bits.cast("int").alias("flags"), F.sha2("text", 256).alias("digest")), "filter-flags")
    least = seen.groupBy(F.col("digest").alias("d")).agg(F.min("doc_id").alias("least"), F.count("*").alias("copies")).filter("copies > 1").drop("copies")
    least = stored(least, "least-copies")  # read back, both sides of the join are shuffled for it alone, and Spark may split a text of very many copies
    judged = labels.groupBy(F.col("doc_id").alias("labelled")).agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    with_labels = seen.join(judged, F.col("doc_id") == F.col("labelled"), "left").join(least, F.col("digest") == F.col("d"), "left")
    copy = F.coalesce(F.col("doc_id") > F.col("least"), F.lit(False))
    flags = with_labels.select(
        "part",
        F.when(copy, F.col("flags").bitwiseOR(F.lit(1 << letters.index("E")))).otherwise(F.col("flags")).alias("flags"),
        F.coalesce("good", F.lit(False)).alias("good"),
        F.coalesce("toxic", F.lit(False)).alias("toxic"),
    )
    return replay(flags, letters).select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def op11_filter_audit(spark, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


OP11_SQL = r"""
WITH RECURSIVE orders(filter_order) AS (
  SELECT '' UNION ALL SELECT filter_order || l FROM orders, unnest(['A', 'B', 'C', 'D', 'E']) AS u(l) WHERE length(filter_order) < 5 AND NOT contains(filter_order, l)
), texts AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
), flags AS (
  SELECT t.doc_id, part, struct_pack(
    A := len(words) < 200, B := 100 * len(list_distinct(words)) < 50 * len(words),
    C := 100 * len(regexp_extract_all(text, '[A-Z]')) > 3 * length(text), D := regexp_matches(text, '[#$%&*|]'),
    E := coalesce(t.doc_id > min(t.doc_id) OVER (PARTITION BY text), false)) AS f, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic
  FROM texts t LEFT JOIN (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id) l ON t.doc_id = l.doc_id
), failing AS (
  SELECT *, (CASE WHEN f.A THEN 'A' ELSE '' END) || (CASE WHEN f.B THEN 'B' ELSE '' END) || (CASE WHEN f.C THEN 'C' ELSE '' END)
    || (CASE WHEN f.D THEN 'D' ELSE '' END) || (CASE WHEN f.E THEN 'E' ELSE '' END) AS fails FROM flags
), replayed AS (
  SELECT part, filter_order, step, filter_order[step] AS letter, fails, good, toxic,
    coalesce(list_min([i for i in range(1, 6) if contains(fails, filter_order[i])]), 6) AS first
  FROM failing, orders, unnest([1, 2, 3, 4, 5]) AS s(step) WHERE length(filter_order) = 5
), counts AS (
  SELECT part, filter_order, step, letter, count(*) FILTER (first > step) AS kept, count(*) FILTER (first = step) AS removed,
    count(*) FILTER (first < step AND contains(fails, letter)) AS redundant, count(*) FILTER (fails = letter) AS unique_fails,
    count(*) FILTER (first = step AND good) AS good_lost, count(*) FILTER (first = step AND toxic) AS toxic_lost
  FROM replayed GROUP BY ALL
)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
  CAST(sum(removed) OVER (PARTITION BY part, letter) AS BIGINT) AS shapley
FROM counts
"""
