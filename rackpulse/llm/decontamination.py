"""Benchmark passages in training documents, found with one FM-index per shard of documents.

Words that no benchmark item holds cannot be part of a match: a run of them is one separator symbol, as are the
ends of documents. Each shard of about SHARD_WORDS words is indexed in memory, every window of the benchmark is searched
backwards, its occurrences are located, and the covered words are merged into spans.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rackpulse.llm.fm_index import FMIndex
from rackpulse.llm.scope import in_arrow, unused_name
from rackpulse.llm.wordpiece_ids import flat_bytes
from rackpulse.session import materialise

WINDOW = 10
SHARD_WORDS = 1_500_000
#: Most windows that are broadcast at once; a larger benchmark is searched in several passes.
BLOCK_WINDOWS = 250_000

#: Bytes of words (digits, letters, all beyond ASCII), A-Z in lower case, and blanks for the rest.
WORD_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)
#: The same words in a string, to find where they stand.
WORD = re.compile("[0-9A-Za-z\x80-\U0010ffff]+")
FOUND = "n_words long, n_hit long, window_sets array<long>, spans array<struct<start:int,end:int>>"


def words_of(text: str | None) -> list[bytes]:
    return text.encode().translate(WORD_BYTES).split() if text else []


def benchmark_windows(benchmark: DataFrame, window: int = WINDOW, item: str = "item_id", text: str = "text") -> DataFrame:
    """Distinct windows (``window`` words joined by blanks) with the sorted ``items`` that hold them and ``set_id``.

    An item of fewer words is one window; an item without words has none. Null items count as one item.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, rows = batch.column(0).to_pylist(), []
            for name, value in zip(names, batch.column(1).to_pylist(), strict=True):
                words = [w.decode() for w in words_of(value)]
                size = min(window, len(words))
                rows += {(name, " ".join(words[i : i + size])) for i in range(len(words) - size + 1)} if size else set()
            yield pa.record_batch(
                [pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.string())], names=["item", "window"]
            )

    rows = benchmark.select(F.col(item).cast("string").alias("item"), F.col(text).alias("text")).mapInArrow(in_arrow(cut), "item string, window string")
    sets = rows.groupBy("window").agg(F.array_sort(F.collect_set("item")).alias("items"))
    return sets.withColumn("set_id", F.xxhash64("items"))


class Phrases:
    """Windows of one block as symbols; symbol 1 separates, words start at 2."""

    def __init__(self, windows: list[tuple[str, int]]):
        self.symbols: dict[bytes, int] = {}
        by_length: dict[int, tuple[list, list]] = {}
        for text, number in windows:
            words = text.encode().split()
            patterns, numbers = by_length.setdefault(len(words), ([], []))
            patterns.append([self.symbols.setdefault(w, len(self.symbols) + 2) for w in words])
            numbers.append(number)
        self.by_length = [(np.array(p, np.int64), np.array(n, np.int64)) for p, n in by_length.values()]

    def search(self, words: np.ndarray) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
        """Covered places, and pairs (place, set number) of all occurrences in symbols with separators between documents."""
        known = words > 1
        kept = known.copy()
        kept[1:] |= known[:-1]
        places = np.flatnonzero(kept)
        edges = np.zeros(len(words) + 1, np.int32)
        found = []
        if known.any():
            index = FMIndex(words[places], len(self.symbols) + 1)
            for patterns, numbers in self.by_length:
                low, high = index.search(patterns)
                counts = high - low
                hit = np.flatnonzero(counts)
                if not len(hit):
                    continue
                counts = counts[hit]
                first = np.repeat(np.cumsum(counts) - counts, counts)
                rows = np.repeat(low[hit], counts) + np.arange(len(first)) - first
                at = places[index.locate(rows)]
                np.add.at(edges, at, 1)
                np.add.at(edges, at + patterns.shape[1], -1)
                found.append((at, np.repeat(numbers[hit], counts)))
        return np.cumsum(edges[:-1]) > 0, found


def _shards(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple[pa.RecordBatch, list[list[bytes]]]]:
    """Slices of the batches with about SHARD_WORDS words, and their words."""
    for batch in batches:
        texts = pc.fill_null(batch.column(column), "").cast(pa.large_binary())
        raw, bounds = flat_bytes(texts)
        start, size, words = 0, 0, []
        for i, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)):
            words.append(raw[a:b].translate(WORD_BYTES).split())
            size += len(words[-1])
            if size >= SHARD_WORDS:
                yield batch.slice(start, i + 1 - start), words
                start, size, words = i + 1, 0, []
        if words:
            yield batch.slice(start), words


def _spans(text: str, covered: np.ndarray) -> list[tuple[int, int]]:
    """Character spans from the first to the last word of each covered run."""
    places = [(m.start(), m.end()) for m in WORD.finditer(text)]
    edges = np.diff(np.concatenate(([0], covered.astype(np.int8), [0])))
    return [(places[a][0], places[b - 1][1]) for a, b in zip(np.flatnonzero(edges > 0).tolist(), np.flatnonzero(edges < 0).tolist(), strict=True)]


def _search_block(docs: DataFrame, text: str, windows: DataFrame, with_text: bool) -> DataFrame:
    """``docs``, with or without the text, and the columns of FOUND for the windows of one block."""
    block = [(r["window"], r["set_id"]) for r in windows.select("window", "set_id").collect()]
    shared = docs.sparkSession.sparkContext.broadcast(block)
    columns = docs.columns
    at = columns.index(text)
    kept = [i for i in range(len(columns)) if with_text or i != at]
    span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        phrases = Phrases(shared.value)
        symbol = phrases.symbols.get
        for shard, words in _shards(batches, at):
            sizes = np.array([len(w) for w in words], np.int64)
            firsts = np.cumsum(sizes + 1) - sizes - 1
            numbers = np.ones(int((sizes + 1).sum()), np.int32)
            for first, own in zip(firsts.tolist(), words, strict=True):
                if own:
                    numbers[first : first + len(own)] = [symbol(w, 1) for w in own]
            covered, found = phrases.search(numbers)
            hits = np.add.reduceat(covered.astype(np.int64), firsts)
            sets: dict[int, list[int]] = {}
            if found:
                owner = np.searchsorted(firsts, np.concatenate([f[0] for f in found]), side="right") - 1
                pairs = np.unique(np.stack((owner, np.concatenate([f[1] for f in found])), axis=1), axis=0)
                for row, number in pairs.tolist():
                    sets.setdefault(row, []).append(number)
            spans: list[list[dict]] = [[] for _ in words]
            for row in np.flatnonzero(hits).tolist() if with_text else ():
                own = covered[firsts[row] : firsts[row] + sizes[row]]
                spans[row] = [{"start": a, "end": b} for a, b in _spans(shard.column(at)[row].as_py(), own)]
            yield pa.record_batch(
                [
                    *[shard.column(i) for i in kept], pa.array(sizes), pa.array(hits),
                    pa.array([sets.get(i, []) for i in range(len(words))], pa.list_(pa.int64())), pa.array(spans, span),
                ],
                names=[*[columns[i] for i in kept], "n_words", "n_hit", "window_sets", "spans"],
            )

    schema = ", ".join(f"`{docs.schema[i].name}` {docs.schema[i].dataType.simpleString()}" for i in kept)
    return docs.mapInArrow(in_arrow(run), f"{schema}, {FOUND}")


def find_passages(docs: DataFrame, windows: DataFrame, text: str = "text", with_text: bool = True) -> DataFrame:
    """All columns of ``docs`` plus ``n_words``, ``n_hit``, ``window_sets`` and ``spans``.

    ``n_hit`` counts words inside any occurrence of a window; ``spans`` are the merged character ranges of those words;
    ``window_sets`` are the ``set_id`` of the windows that occur. A null text has no words. Columns of the input that
    carry one of the new names are replaced. Repeated rows are all returned. ``windows`` comes from
    :func:`benchmark_windows`; no more than BLOCK_WINDOWS of them are broadcast at a time. Without ``with_text`` the
    text stays behind and ``spans`` are empty.
    """
    new = {"n_words", "n_hit", "window_sets", "spans"}
    docs = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c not in new])
    blocks = -(-windows.count() // BLOCK_WINDOWS) or 1
    if blocks == 1:
        return _search_block(docs, text, windows, with_text)
    row = unused_name("row", docs.columns)
    docs = materialise(docs.withColumn(row, F.monotonically_increasing_id()), "documents")
    number = F.pmod(F.xxhash64("window"), F.lit(blocks))
    passes = [_search_block(docs.select(row, text), text, windows.filter(number == b), True) for b in range(blocks)]
    passes = [p.drop(text) for p in passes]
    found = passes[0]
    for other in passes[1:]:
        found = found.unionByName(other)
    # At most one row per document and pass.
    merged = found.groupBy(row).agg(
        F.max("n_words").alias("n_words"),
        F.array_distinct(F.flatten(F.collect_list("window_sets"))).alias("window_sets"),
        F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"),
    )
    rows = docs.join(merged, row).drop(row)
    columns = rows.columns
    at, spans_at = columns.index(text), columns.index("spans")

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, joined = [], []
            for value, spans in zip(batch.column(at).to_pylist(), batch.column(spans_at).to_pylist(), strict=True):
                runs: list[dict] = []
                places = [(m.start(), m.end()) for m in WORD.finditer(value)] if spans else []
                inside = np.zeros(len(places), bool)
                starts, ends = [p[0] for p in places], [p[1] for p in places]
                for s in spans:
                    inside[np.searchsorted(starts, s["start"]) : np.searchsorted(ends, s["end"], side="right")] = True
                if inside.any():
                    runs = [{"start": a, "end": b} for a, b in _spans(value, inside)]
                counts.append(int(inside.sum()))
                joined.append(runs)
            yield pa.record_batch(
                [pa.array(joined, batch.schema.field(i).type) if i == spans_at else batch.column(i) for i in range(len(columns))] + [pa.array(counts, pa.int64())],
                names=[*columns, "n_hit"],
            )

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    out = rows.mapInArrow(in_arrow(merge), f"{schema}, n_hit long")
    return out if with_text else out.drop(text)


def items_found(found: DataFrame, windows: DataFrame) -> DataFrame:
    """Adds ``n_items`` and ``items_sha256`` (of the sorted item ids, comma-joined) to rows with ``window_sets``."""
    # Documents have few different collections of sets; items are looked up once for each of these.
    several = F.array_sort(F.array_distinct("window_sets"))
    sets = windows.select("set_id", "items").dropDuplicates(["set_id"])
    kinds = found.select(several.alias("own")).filter(F.size("own") > 0).distinct()
    pairs = kinds.select("own", F.explode("own").alias("set_id")).join(sets, "set_id")
    own, names = unused_name("own_sets", found.columns), unused_name("item_names", found.columns)
    named = pairs.select(F.col("own").alias(own), F.explode("items").alias("item")).groupBy(own).agg(F.collect_set("item").alias(names))
    rows = found.withColumn(own, several)
    items = F.coalesce(F.col(names), F.array().cast("array<string>"))
    return (
        rows.join(named, own, "left")
        .withColumn("n_items", F.size(items).cast("long"))
        .withColumn("items_sha256", F.sha2(F.array_join(F.array_sort(items), ","), 256))
        .drop(own, names, "window_sets")
    )


def remove_spans(found: DataFrame, text: str = "text") -> DataFrame:
    """``text`` without its ``spans``; a document without hits keeps its text as it is."""

    def kept(spans, value):
        ends = F.concat(F.array(F.lit(0)), F.transform(spans, lambda s: s["end"]))
        starts = F.concat(F.transform(spans, lambda s: s["start"]), F.array(F.length(value)))
        return F.array_join(F.zip_with(ends, starts, lambda a, b: F.substring(value, a + 1, b - a)), "")

    value = F.col(text)
    return found.withColumn(text, F.when(F.size("spans") > 0, kept(F.col("spans"), value)).otherwise(value))


_WORDS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
ORACLE = f"""
with d as (select row_number() over () as rid, doc_id, coalesce({_WORDS}, []) as w from documents),
b as (select item_id, {_WORDS} as w from benchmark where text is not null),
s as (select item_id, w, least({WINDOW}, len(w)) as m from b where len(w) > 0),
bw as (select distinct item_id, m, array_to_string(w[i:i + m - 1], ' ') as g from s, unnest(range(1, len(w) - m + 2)) t(i)),
lengths as (select distinct m from bw),
dl as (select rid, w, m from d, lengths where len(w) >= m),
dw as (select rid, m, i, array_to_string(w[i:i + m - 1], ' ') as g from dl, unnest(range(1, len(w) - m + 2)) t(i)),
hits as (select distinct rid, dw.m, i, item_id from dw join bw on dw.m = bw.m and dw.g = bw.g),
places as (select rid, count(distinct p) as n_hit from (select rid, unnest(range(i, i + m)) as p from hits) group by rid),
items as (select rid, count(*) as n_items, string_agg(x, ',' order by x) as joined
          from (select distinct rid, cast(item_id as varchar) as x from hits) group by rid)
select doc_id, cast(len(w) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
       sha256(coalesce(joined, '')) as items_sha256, n_hit is not null as contaminated
from d left join places using (rid) left join items using (rid)
"""
