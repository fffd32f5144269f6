import pytest


@pytest.fixture(scope="session")
def docs(spark):
    """Makes a table of documents; extra columns with names that operators use inside."""

    def make(texts, sources=None, extra=False):
        rows = [(i, t, (sources or {}).get(i, "a")) for i, t in (texts.items() if isinstance(texts, dict) else enumerate(texts))]
        df = spark.createDataFrame(rows, "doc_id long, text string, source string")
        if extra:
            from pyspark.sql import functions as F

            for name in ("key", "node", "root", "fp", "s", "first", "seed", "bucket", "at", "copies", "class", "cell", "line", "links", "spans", "n", "id", "ids", "decoded", "rejected", "p_toxic", "gone_id", "cut", "cut_id", "copy", "taken_id", "whole", "size", "target", "taken", "batch", "salt"):
                df = df.withColumn(name, F.lit(7))
        return df

    return make


#: Nulls, empties, blanks, repeats, other scripts, a long one.
ODD = {
    0: None, 1: "", 2: "  \t\n ", 3: "one", 4: "one", 5: "naïve café Σίσυφος İ 😀", 6: "a\x00b \x1c c", 7: "the quick brown fox jumps over the lazy dog " * 4000, 8: "\n\n\n", 9: "<|im_end|>\\<|endoftext|>",
}


@pytest.fixture(scope="session")
def odd():
    return dict(ODD)
