"""Shared pieces of the training-data operators: tables, row identity, salts, long texts.

Arrays that are computed are exploded with explode_outer() and a condition on the result: for explode() the optimizer
adds a filter on the array's size below, which computes the array a second time, with all that it is made of inlined.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logweave.scratch import READ_OPTIONS, scope, written

__all__ = ["LONG_TEXT", "RUN_WORDS", "UPPER", "lower_ascii", "same_rows", "scope", "small_batches", "spread", "table", "word_runs", "written"]

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Texts of more bytes are worked on in runs of RUN_WORDS words, so that arrays of words are bounded whatever the text's length.
LONG_TEXT = 131_072
RUN_WORDS = 16_384
#: Bytes of a batch sent to a Python worker.
BATCH_BYTES = "8m"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.options(**READ_OPTIONS).parquet(f"{sf_dir}/{name}.parquet")


def lower_ascii(text: Column) -> Column:
    """Lower-cases A-Z only. Pure ASCII texts take the fast built-in, others a character map."""
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(
        F.translate(text, UPPER, UPPER.lower())
    )


def same_rows(left: list[Column], right: list[Column]) -> Column:
    """Null-safe equality of two keys."""
    cond = left[0].eqNullSafe(right[0])
    for a, b in zip(left[1:], right[1:], strict=True):
        cond = cond & a.eqNullSafe(b)
    return cond


def spread(rows: int, per_part: int, least: int = 8) -> int:
    """How many salts to deal rows over so that one salt holds about per_part of them."""
    return max(least, -(-rows // per_part))


def word_runs(text: Column, space: str, following: int, *, long_text: int = LONG_TEXT, run_words: int = RUN_WORDS) -> Column:
    """The text as an array of structs (run, next) to explode: one with the whole text, or for a text of more than
    long_text bytes runs of exactly run_words words and a last one of the rest, with the first words of what follows,
    as many as following, in next. No word is cut. space is a character class that separates words, without brackets.
    """
    words = lambda n: f"(?:[{space}]*+[^{space}]++){{1,{n}}}+"

    def one(runs: Column, x: Column, i: Column) -> Column:
        ahead = F.regexp_extract(F.get(runs, i + 1), "^" + words(following), 0)
        return F.struct(x.alias("run"), F.nullif(ahead, F.lit("")).alias("next"))

    whole = F.array(F.struct(text.alias("run"), F.lit(None).cast("string").alias("next")))
    found = F.array(F.regexp_extract_all(text, F.lit(words(run_words)), F.lit(0)))  # bound once
    many = F.get(F.transform(found, lambda runs: F.transform(runs, lambda x, i: one(runs, x, i))), 0)
    return F.when(F.octet_length(text) <= long_text, whole).otherwise(many)


@contextmanager
def small_batches(spark: SparkSession, size: str = BATCH_BYTES) -> Iterator[None]:
    """While tables are written through Python workers: batches of so many bytes, so that the workers' memory and the
    buffers between do not follow the lengths of the rows."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, size)
    try:
        yield
    finally:
        spark.conf.set(key, before)
