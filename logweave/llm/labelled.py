"""Bounded samples of labelled documents to learn from, and the folds that are held out."""

from __future__ import annotations

from collections.abc import Iterable
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logweave.llm.common import written

FOLDS = 5
#: Documents of each label, chosen by a hash of the id. Their texts are read whole, by the executors.
PER_LABEL = 3000
#: Ids are first drawn by comparing their hash's last bits with a bound, for so many more than are wanted.
HASHES, MORE, MARGIN = 1 << 30, 1.1, 200


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % FOLDS == 0, F.lit(False))


def sample(
    docs: DataFrame,
    labels: DataFrame,
    label: str,
    *,
    doc_id: str = "doc_id",
    text: str = "text",
    per_label: int = PER_LABEL,
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """Stored rows (k, y, h, t): the whole texts of somewhat more than per_label documents of each label (0 or 1), their
    hash h, the columns to keep and a number k to order them by; never a document that is held out, nor an empty text. Of several texts
    under one id the one with the least hash is taken. No window and no sort goes over a label.
    """
    known = labels.where(F.col(label).isin(0, 1) & F.col(doc_id).isNotNull() & ~held_out(F.col(doc_id)))
    known = known.select(F.col(doc_id).alias("_id"), F.col(label).cast("int").alias("y")).distinct()
    drawn = F.lit(False)
    for y, n in known.groupBy("y").count().collect():  # two rows
        bound = HASHES if n <= per_label else int(min(1.0, (MORE * per_label + MARGIN) / n) * HASHES)
        drawn = drawn | ((F.col("y") == y) & (F.pmod(F.xxhash64("_id"), F.lit(HASHES)) < bound))
    known = known.where(drawn).select("_id", "y", F.xxhash64("_id").alias("k"))
    texts = docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("t"), F.xxhash64(F.col(text)).alias("h"), *keep).where(F.length("t") > 0)
    found = texts.join(F.broadcast(known), "_id")  # twice per_label rows and a margin
    return written(found.groupBy("_id", "y", "k").agg(F.min_by("t", "h").alias("t"), *[F.min_by(c, "h").alias(c) for c in keep], F.min("h").alias("h")).drop("_id"), "labelled")


def chosen(rows: Iterable[dict[str, Any]], per_label: int = PER_LABEL) -> list[dict[str, Any]]:
    """At most per_label rows of each label, the least by k, equal texts once (the last label counts), in a fixed order."""
    by_text = {}
    for r in sorted(rows, key=lambda r: (r["k"], r["y"], r["h"])):
        by_text[r["h"]] = {**r, "k": by_text.get(r["h"], r)["k"]}
    left, out = {0: per_label, 1: per_label}, []
    for r in sorted(by_text.values(), key=lambda r: (r["k"], r["h"])):
        if left[r["y"]] > 0:
            left[r["y"]] -= 1
            out.append(r)
    return out
