"""Token ids in ORC files: run-length encoded integers, row indexes and Bloom filters on the document id.

Documents are dealt out by ranges of the id, so that a file covers one range and a stripe a smaller one: minimum and
maximum in the stripe footers and row indexes prune ranges, Bloom filters prune single ids, and readers take stripes in
parallel. A row holds its place inside its file, so that the place in the whole corpus needs the files' totals only.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rackpulse.llm.scope import in_arrow
from rackpulse.llm.wordpiece_ids import default_path, encoder

FILE_SCHEMA = "doc_id long, part int, offset_in_part long, n_tokens int, ids array<int>"
ORC_OPTIONS = {
    "orc.bloom.filter.columns": "doc_id",
    "orc.bloom.filter.fpp": "0.01",
    "orc.create.index": "true",
    "orc.row.index.stride": "2000",
    "orc.stripe.size": str(32 << 20),
    "compression": "zstd",
}


def with_end(sizes: np.ndarray, flat: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and ids of texts after ``end_id`` has been appended to each."""
    offsets = np.concatenate(([0], np.cumsum(sizes + 1)))
    values = np.empty(offsets[-1], np.int32)
    own = np.ones(len(values), bool)
    own[offsets[1:] - 1] = False
    values[own] = flat
    values[~own] = end_id
    return offsets, values


def write_tokens(docs: DataFrame, out: str, end_id: int, path: str | None = None) -> None:
    """Encode ``doc_id``, ``text`` of ``docs`` and write them to the folder ``out`` in ascending ``doc_id`` order.

    A null text has no ids before its end id; a null ``doc_id`` comes first; rows with one ``doc_id`` follow each other in
    the order of a hash of their texts, and many of them are split over files. No rows make no file.
    """
    path = path or default_path()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, part, before = encoder(path), TaskContext.get().partitionId(), 0
        for batch in batches:
            row = 0
            for sizes, flat in words.encode_column(batch.column(1)):
                offsets, values = with_end(sizes, flat, end_id)
                n = len(sizes)
                yield pa.record_batch(
                    [
                        batch.column(0).slice(row, n),
                        pa.array(np.full(n, part, np.int32)),
                        pa.array(before + offsets[:-1]),
                        pa.array(np.diff(offsets).astype(np.int32)),
                        pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values)),
                    ],
                    names=["doc_id", "part", "offset_in_part", "n_tokens", "ids"],
                )
                row += n
                before += int(offsets[-1])

    order = [F.col("doc_id"), F.xxhash64("text")]
    ordered = docs.select("doc_id", "text").repartitionByRange(*order).sortWithinPartitions(*order)
    ordered.mapInArrow(in_arrow(encode), FILE_SCHEMA).write.options(**ORC_OPTIONS).orc(out)


def read_tokens(spark: SparkSession, path: str, doc_ids: Sequence[int] | None = None, between: tuple[int, int] | None = None) -> DataFrame:
    """The stored rows; a list or an inclusive range of ids is pushed down to the files' statistics and Bloom filters."""
    rows = spark.read.schema(FILE_SCHEMA).orc(path)
    if doc_ids is not None:
        rows = rows.filter(F.col("doc_id").isin(list(doc_ids)))
    if between is not None:
        rows = rows.filter(F.col("doc_id").between(*between))
    return rows


def digest_tokens(spark: SparkSession, path: str) -> DataFrame:
    """Per stored document: ``doc_id``, ``start`` (ids of all documents before it), ``n_tokens``, ``ids_crc32``."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("ids")
            offsets = lists.offsets.to_numpy()
            flat = lists.values.to_numpy().astype("<u4")
            sums = [zlib.crc32(flat[a:b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
            yield pa.record_batch(
                [
                    batch.column("doc_id"), batch.column("part"), batch.column("offset_in_part"),
                    pa.array(np.diff(offsets).astype(np.int64)), pa.array(sums, pa.int64()),
                ],
                names=["doc_id", "part", "offset_in_part", "n_tokens", "ids_crc32"],
            )

    rows = read_tokens(spark, path)
    # One row per file: the window is over the files' totals, not over documents.
    totals = rows.groupBy("part").agg(F.sum("n_tokens").alias("size"))
    before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    bases = totals.select("part", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("base"))
    digests = rows.mapInArrow(in_arrow(digest), "doc_id long, part int, offset_in_part long, n_tokens long, ids_crc32 long")
    return digests.join(bases, "part").select(
        "doc_id", (F.col("base") + F.col("offset_in_part")).alias("start"), "n_tokens", "ids_crc32"
    )
