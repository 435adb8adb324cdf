"""Bounded, repeatable samples of labelled rows, the only data a classifier here is fitted on."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import crc_mod

_BUCKETS = 1 << 20


def _rank(column: Column) -> Column:
    """A pseudo-random place in [0, _BUCKETS) for each id."""
    return F.pmod(F.xxhash64(column), F.lit(_BUCKETS)).cast("int")


def training_rows(rows: DataFrame, label: str, mod: int, held_out: int, per_label: int) -> tuple[DataFrame, dict]:
    """About ``per_label`` rows (2 * per_label at the very most) of each label of ``rows`` (doc_id and the label).

    Rows whose crc32(doc_id) mod ``mod`` is ``held_out`` or whose label is null never take part. Rows are taken by a hash of
    their id at a rate that comes from one count, so nothing is sorted and nothing but the sample reaches the driver.
    Returns the rows and the number of labelled rows of each label.
    """
    usable = rows.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & (crc_mod(F.col("doc_id"), mod) != held_out))
    sizes = {r[label]: r["count"] for r in usable.groupBy(label).count().collect()}  # one row a label
    keep = F.lit(False)
    for value, n in sizes.items():
        most = min(_BUCKETS, -(-_BUCKETS * per_label // max(1, n)))
        keep = keep | ((F.col(label) == F.lit(value)) & (_rank(F.col("doc_id")) < most))
    return usable.where(keep), sizes


def labelled_texts(docs: DataFrame, labels: DataFrame, label: str, mod: int, held_out: int, per_label: int, most_chars: int) -> tuple[pa.Table, dict]:
    """The sample's (doc_id, text, label) in the order of doc_id. Texts longer than ``most_chars`` aren't used for fitting.

    An id with several rows of one label counts once; an id with different labels is left out.
    """
    single = labels.where(F.col(label).isNotNull()).groupBy("doc_id").agg(F.min(label).alias(label), F.max(label).alias("other"))
    single = single.where(F.col(label) == F.col("other")).select("doc_id", label)
    chosen, sizes = training_rows(single, label, mod, held_out, per_label)
    chosen = chosen.limit(2 * per_label * max(1, len(sizes)))  # a proven bound for the broadcast
    texts = docs.select("doc_id", "text").where(F.col("text").isNotNull() & (F.length("text") <= most_chars))
    got = texts.join(F.broadcast(chosen), "doc_id").toArrow()
    return got.sort_by([("doc_id", "ascending"), ("text", "ascending")]), sizes
