"""Exact Jaccard join of documents over word shingles, as a blocked product of the sparse document-by-shingle matrix.

* Texts with the same shingle set are one node, named by a digest of the set.
* Shingles have one global order: first those that hold a rare word. Two sets as alike as the threshold asks share a
  shingle among the first (1 - t) n + 1 of each; only these entries of the matrix are dealt to column blocks. Passages that
  many documents share have no rare word and come last.
* A column block multiplies its columns: the rows of a column are candidates for each other where their sizes, and what is
  left of both behind the shared shingle, allow the overlap that the threshold asks for.
* Each set has a bitmap of about its own size, the parity of its shingles per bit. Two bitmaps differ in no more
  bits than the sets differ in shingles, so many candidates are discarded before their overlaps are counted.
* To begin with, each row is paired with a few rows of its column only, others in each round. Full overlap counts of
  these pairs settle most components.
* When a round links hardly any of its pairs, all pairs of rows of one column that still lie in different components are
  compared inside the blocks, and each row's most alike partners leave the block to be counted, eight times as many in each
  further round, until no pair is left that has not been counted or joined by other links.

So no link between different components is lost, a large group of near copies costs about one count per member, and the
rows of a round grow with the rows of the columns, not with their pairs. A column of many rows is split into chunks, and each
pair of chunks is a task of its own.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rackpulse.llm.link_components import link_components
from rackpulse.llm.scope import WorkTables, give_back, in_arrow, unused_name
from rackpulse.llm.wordpiece_ids import LOWER, flat_bytes, slices

WORDS, PERCENT = 5, 75
#: Counters of word frequencies and bits of the filter of wanted nodes; both are broadcast and never larger.
COUNTERS, FILTER_BITS = 1 << 18, 1 << 25
BLOCK_ENTRIES = 1_000_000
#: Bytes of text that are hashed at a time.
SLICE = 2 << 20
#: Rows of a column that the others meet in one round, and the share of linked pairs below which rounds end.
HUBS, FRUITFUL = 8, 0.15
#: Partners of a row that are counted in the first round over all pairs, and rows of a column that one task compares.
PARTNERS, CHUNK = 64, 4096
#: Times that the bitmaps for comparisons inside the blocks are wider than those that travel with pairs.
WIDER = 4
#: Pairs that a task holds before it compares their bitmaps, and bytes of bitmaps that it compares at a time.
HELD_PAIRS, COMPARED = 200_000, 16 << 20
#: Entries that a task packs at a time.
PACKED_ENTRIES = 250_000
ENTRY = np.dtype([("shingle", "<u8"), ("node", "<i8"), ("size", "<u4"), ("place", "<u4")])
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
_MULTIPLIERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)

#: Base of the word hashes: odd, and one less than it is not divisible by 4.
_BASE = np.uint64(0x9FB21C651E98DF27)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Shingler:
    """Word hashes and shingle sets of slices of a text column."""

    def __init__(self, words: int):
        self.words = words
        # Fixed odd numbers, one per place in a shingle.
        self.places = np.array([_MULTIPLIERS[i % 5] + np.uint64(2 * (i // 5)) for i in range(words)], np.uint64)
        self.letters = _mix(np.arange(1, 257, dtype=np.uint64))
        self.powers = np.ones(1, np.uint64)

    def word_hashes(self, raw: bytes, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Polynomial hashes of all words, and the number of words before each bound."""
        data = np.frombuffer(raw.translate(LOWER), np.uint8)
        solid = ~_BLANK[data]
        begins = solid.copy()
        begins[1:] &= ~solid[:-1]
        edges = bounds[bounds < len(data)]
        begins[edges] = solid[edges]
        starts = np.flatnonzero(begins)
        if not len(starts):
            return np.zeros(0, np.uint64), np.zeros(len(bounds), np.int64)
        values = self.letters[data[solid]]
        first = np.flatnonzero(begins[solid])
        sizes = np.diff(np.concatenate((first, [len(values)])))
        longest = int(sizes.max())
        if longest > len(self.powers):
            self.powers = np.concatenate(([1], np.multiply.accumulate(np.full(longest, _BASE, np.uint64)))).astype(np.uint64)
        place = np.arange(len(values), dtype=np.int32)
        place -= np.repeat(first.astype(np.int32), sizes)
        values *= self.powers[place]
        return _mix(np.add.reduceat(values, first) + sizes.astype(np.uint64)), np.searchsorted(starts, bounds)

    def column(self, texts: pa.Array, rarity: np.ndarray | None = None) -> Iterator[tuple]:
        """Per text with words: its index, word hashes, sorted distinct shingles, and these from rare to frequent.

        The last one needs the word counters ``rarity`` and is None without them.
        """
        row = 0
        for part in slices(pc.fill_null(texts, "").cast(pa.large_binary()), SLICE):
            raw, bounds = flat_bytes(part)
            if raw:
                words, cuts = self.word_hashes(raw, bounds)
                rolled, least = self._roll(words, rarity)
                for i, (a, b) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)):
                    if a == b:
                        continue
                    if b - a < self.words:
                        # The whole short sequence, told apart from longer ones by its length.
                        total = (words[a:b] * self.places[: b - a]).sum(dtype=np.uint64) + np.uint64(b - a)
                        shingles = _mix(np.array([total], np.uint64))
                        order = shingles if rarity is not None else None
                    else:
                        own = rolled[a : b - self.words + 1]
                        if rarity is None:
                            shingles, order = np.unique(own), None
                        else:
                            shingles, at = np.unique(own, return_index=True)
                            order = shingles[np.argsort(least[a : b - self.words + 1][at], kind="stable")]
                    yield row + i, words[a:b], shingles, order
            row += len(part)

    def _roll(self, words: np.ndarray, rarity: np.ndarray | None) -> tuple[np.ndarray, np.ndarray | None]:
        """Shingle hash at each word, as if texts had no ends, and the frequency of its rarest word."""
        n = max(0, len(words) - self.words + 1)
        total = np.full(n, self.words, np.uint64)
        least = None
        counts = rarity[(words % np.uint64(len(rarity))).astype(np.int64)] if rarity is not None else None
        for place in range(self.words):
            total += words[place : place + n] * self.places[place]
            if counts is not None:
                here = counts[place : place + n]
                least = here.copy() if least is None else np.minimum(least, here)
        return _mix(total), least


def node_of(shingles: np.ndarray) -> int:
    """Name of a shingle set: 64 bits of a digest of its members, and never that of the empty set."""
    return struct.unpack("<q", hashlib.blake2b(shingles.tobytes(), digest_size=8).digest())[0]


def signature_of(shingles: np.ndarray, wider: int = 1) -> bytes:
    """Parity bits of the set: ``wider`` times the next power of two of its size, 64 at least."""
    width = wider << max(6, (len(shingles) - 1).bit_length())
    counts = np.bincount((shingles & np.uint64(width - 1)).astype(np.int64), minlength=width)
    return np.packbits((counts & 1).astype(np.uint8), bitorder="little").tobytes()


def least_difference(left: bytes, right: bytes) -> int:
    """No more than the number of shingles that are in one set only; a longer bitmap is folded to the shorter one."""
    x, y = np.frombuffer(left, np.uint64), np.frombuffer(right, np.uint64)
    while len(x) > len(y):
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    while len(y) > len(x):
        y = y[: len(y) // 2] ^ y[len(y) // 2 :]
    return int(np.bitwise_count(x ^ y).sum())


def _survey(docs: DataFrame, key: str, text: str, words: int) -> DataFrame:
    """Rows of documents (key, n_shingles, node, signature) and, with a block number, rows of partial word counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, counters = Shingler(words), np.zeros(COUNTERS, np.int64)
        schema, names = None, ["key", "n_shingles", "node", "signature", "wide", "block", "counts"]
        for batch in batches:
            n = len(batch)
            sizes, nodes = np.zeros(n, np.int64), np.zeros(n, np.int64)
            signatures: list[bytes | None] = [None] * n
            wide: list[bytes | None] = [None] * n
            for row, own, shingles, _ in shingler.column(batch.column(1)):
                sizes[row], nodes[row], signatures[row] = len(shingles), node_of(shingles), signature_of(shingles)
                wide[row] = signature_of(shingles, WIDER)
                np.add.at(counters, (own % np.uint64(COUNTERS)).astype(np.int64), 1)
            out = [batch.column(0), pa.array(sizes), pa.array(nodes, mask=sizes == 0), pa.array(signatures, pa.binary()), pa.array(wide, pa.binary())]
            out += [pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())]
            schema = schema or [batch.schema.field(0).type]
            yield pa.record_batch(out, names=names)
        if schema:
            blocks = counters.reshape(64, -1)
            yield pa.record_batch(
                [
                    pa.nulls(64, schema[0]), pa.nulls(64, pa.int64()), pa.nulls(64, pa.int64()), pa.nulls(64, pa.binary()), pa.nulls(64, pa.binary()),
                    pa.array(np.arange(64, dtype=np.int32)), pa.array([b.astype("<i8").tobytes() for b in blocks], pa.binary()),
                ],
                names=names,
            )

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(
        in_arrow(run), f"key {kind}, n_shingles long, node long, signature binary, wide binary, block int, counts binary"
    )


def _combined(rows: DataFrame, combine, dtype: str, pieces: int, width: int) -> np.ndarray:
    """Partial vectors of equal length, combined per block; the driver gets one vector of fixed size."""

    def add(key: tuple, block: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(width, dtype)
        for raw in block["counts"]:
            total = combine(total, np.frombuffer(raw, dtype))
        return pd.DataFrame({"block": [key[0]], "counts": [total.tobytes()]})

    out = np.zeros((pieces, width), dtype)
    for row in rows.groupBy("block").applyInPandas(add, "block int, counts binary").collect():
        out[row["block"]] = np.frombuffer(row["counts"], dtype)
    return out.reshape(-1)


def _entries(docs: DataFrame, text: str, words: int, percent: int, rarity: np.ndarray, blocks: int) -> DataFrame:
    """Packed matrix entries per column block; equal sets of one task are sent once.

    ``place`` is the entry's number in the set's order.
    """
    shared = docs.sparkSession.sparkContext.broadcast(rarity)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, sent = Shingler(words), set()
        for batch in batches:
            parts, held = [], 0
            for _, _, shingles, order in shingler.column(batch.column(0), shared.value):
                node = node_of(shingles)
                if node in sent:
                    continue
                sent.add(node)
                n = len(shingles)
                prefix = n - -(-n * percent // 100) + 1
                own = np.empty(prefix, ENTRY)
                own["shingle"], own["node"], own["size"], own["place"] = order[:prefix], node, n, np.arange(prefix)
                parts.append(own)
                held += prefix
                if held >= PACKED_ENTRIES:
                    yield pack(np.concatenate(parts))
                    parts, held = [], 0
            if parts:
                yield pack(np.concatenate(parts))

    def pack(rows: np.ndarray) -> pa.RecordBatch:
        block = (rows["shingle"] % np.uint64(blocks)).astype(np.int64)
        by_block = np.argsort(block, kind="stable")
        rows, block = rows[by_block], block[by_block]
        starts = np.flatnonzero(np.concatenate(([True], block[1:] != block[:-1])))
        ends = [*starts[1:].tolist(), len(rows)]
        packed = [rows[a:b].tobytes() for a, b in zip(starts.tolist(), ends, strict=True)]
        return pa.record_batch([pa.array(block[starts].astype(np.int32)), pa.array(packed, pa.binary())], names=["block", "entries"])

    return docs.select(F.col(text).alias("text")).mapInArrow(in_arrow(run), "block int, entries binary")


def _columns(entries: DataFrame) -> DataFrame:
    """Columns with two or more different rows: (column, node, size, place).

    Columns with the same rows are one, which keeps the first place of each row: that is what allows the most overlap.
    """

    def multiply(key: tuple, block: pa.Table) -> pa.Table:
        rows = np.frombuffer(b"".join(block.column("entries").to_pylist()), ENTRY)
        rows = rows[np.argsort(rows["shingle"], kind="stable")]
        same = rows["shingle"][1:] == rows["shingle"][:-1]
        rows = rows[np.concatenate((same, [False])) | np.concatenate(([False], same))]
        rows = rows[np.lexsort((rows["node"], rows["shingle"]))]
        fresh = np.ones(len(rows), bool)
        fresh[1:] = (rows["shingle"][1:] != rows["shingle"][:-1]) | (rows["node"][1:] != rows["node"][:-1])
        rows = rows[fresh]
        first = np.flatnonzero(np.concatenate(([True], rows["shingle"][1:] != rows["shingle"][:-1]))) if len(rows) else np.zeros(0, np.int64)
        counts = np.diff(np.concatenate((first, [len(rows)])))
        name = np.add.reduceat(_mix(rows["node"].astype(np.uint64)), first).astype(np.int64) if len(first) else np.zeros(0, np.int64)
        name, rows = np.repeat(name, counts)[np.repeat(counts > 1, counts)], rows[np.repeat(counts > 1, counts)]
        order = np.lexsort((rows["place"], rows["node"], name))
        name, rows = name[order], rows[order]
        one = np.ones(len(rows), bool)
        one[1:] = (name[1:] != name[:-1]) | (rows["node"][1:] != rows["node"][:-1])
        name, rows = name[one], rows[one]
        return pa.table(
            {"column": name, "node": rows["node"].copy(), "size": rows["size"].astype(np.int64), "place": rows["place"].astype(np.int64)}
        )

    # A column block is of about BLOCK_ENTRIES entries.
    blocks = entries.groupBy("block").applyInArrow(multiply, "column long, node long, size long, place long")
    return blocks.groupBy("column", "node").agg(F.max("size").alias("size"), F.min("place").alias("place"))


def _may_link(percent: int):
    """What is left of either set from the shared shingle on reaches the overlap that the threshold asks for."""
    asked = F.ceil((F.col("x.size") + F.col("y.size")) * percent / F.lit(100 + percent))
    return (F.col("x.size") - F.col("x.place") >= asked) & (F.col("y.size") - F.col("y.place") >= asked)


def _differences(signatures: list[bytes], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """:func:`least_difference` of many pairs of rows, by widths of the bitmaps."""
    widths = np.array([len(s) for s in signatures], np.int64)
    tables, place = {}, np.zeros(len(signatures), np.int64)
    for width in np.unique(widths).tolist():
        own = np.flatnonzero(widths == width)
        place[own] = np.arange(len(own))
        tables[width] = np.frombuffer(b"".join(signatures[i] for i in own.tolist()), np.uint64).reshape(len(own), -1)
    out = np.zeros(len(left), np.int64)
    pairs = widths[left] * (1 << 32) + widths[right]
    for pair in np.unique(pairs).tolist():
        wide, other = divmod(pair, 1 << 32)
        some = np.flatnonzero(pairs == pair)
        for part in np.array_split(some, len(some) * max(wide, other) // COMPARED + 1):
            x, y = tables[wide][place[left[part]]], tables[other][place[right[part]]]
            while x.shape[1] > y.shape[1]:
                x = x[:, : x.shape[1] // 2] ^ x[:, x.shape[1] // 2 :]
            while y.shape[1] > x.shape[1]:
                y = y[:, : y.shape[1] // 2] ^ y[:, y.shape[1] // 2 :]
            out[part] = np.bitwise_count(x ^ y).sum(axis=1)
    return out


def _best(pairs: np.ndarray, unlike: np.ndarray, partners: int) -> np.ndarray:
    """Numbers of the pairs that are among the ``partners`` most alike ones of either of their rows."""
    chosen = np.zeros(len(pairs), bool)
    for side in (0, 1):
        order = np.lexsort((pairs[:, 1 - side], unlike, pairs[:, side]))
        own = pairs[order, side]
        opens = np.concatenate(([True], own[1:] != own[:-1]))
        rank = np.arange(len(own)) - np.maximum.accumulate(np.where(opens, np.arange(len(own)), 0))
        chosen[order[rank < partners]] = True
    return np.flatnonzero(chosen)


def _diagonals(block: pa.Table, apart: bool, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows of a column in different components that their places allow; ``block`` is in the order of its columns.

    They come diagonal by diagonal, so at most one pair per row at a time.
    """
    column, size, place, component, chunk = (block.column(c).to_numpy() for c in ("column", "size", "place", "component", "chunk"))
    ends = np.searchsorted(column, column, side="right")
    alive, step = np.arange(len(column)), 1
    while True:
        alive = alive[alive + step < ends[alive]]
        if not len(alive):
            return
        a, b = alive, alive + step
        asked = -(-(size[a] + size[b]) * percent // (100 + percent))
        some = (component[a] != component[b]) & (size[a] - place[a] >= asked) & (size[b] - place[b] >= asked)
        if apart:
            some &= chunk[a] != chunk[b]
        yield a[some], b[some]
        step += 1


def _in_order(block: pa.Table) -> pa.Table:
    return block.take(pa.array(np.lexsort((block.column("node").to_numpy(), block.column("column").to_numpy()))))


def _possible(open_: DataFrame, percent: int, blocks: int) -> DataFrame:
    """The open rows that have a partner in their column as far as places tell, by block, with the column's ``lead``.

    The lead is one of the column's nodes, the same one in most columns of a group of similar sets.
    """

    def choose(key: tuple, block: pa.Table) -> pa.Table:
        block = _in_order(block)
        met = np.zeros(len(block), bool)
        for a, b in _diagonals(block, key[1].as_py() != key[2].as_py(), percent):
            met[a] = met[b] = True
            if met.all():
                break
        block = block.filter(pa.array(met))
        column, node = (block.column(c).to_numpy() for c in ("column", "node"))
        lead = np.zeros(len(column), np.int64)
        if len(column):
            first = np.flatnonzero(np.concatenate(([True], column[1:] != column[:-1])))
            least = np.minimum.reduceat(_mix(node.astype(np.uint64)), first).astype(np.int64)
            lead = np.repeat(least, np.diff(np.concatenate((first, [len(column)]))))
        return block.append_column("lead", pa.array(lead))

    chunks = F.ceil(F.col("rows") / F.lit(CHUNK)).cast("int")
    chunk = F.pmod(F.xxhash64("node", F.lit(1)), chunks).cast("int")
    tasks = F.transform(F.sequence(F.lit(0), chunks - 1), lambda j: F.struct(F.least("chunk", j).alias("i"), F.greatest("chunk", j).alias("j")))
    # Blocks of whole columns, and for a long column a block for each pair of its chunks.
    block = F.when(F.col("rows") > CHUNK, F.col("column")).otherwise(F.pmod("column", F.lit(blocks)))
    rows = open_.withColumn("chunk", chunk).withColumn("task", F.explode(tasks)).withColumn("block", block).withColumn("long", F.col("rows") > CHUNK)
    columns = ["block", "task.i", "task.j", "long", "column", "node", "size", "place", "component", "chunk"]
    schema = "block long, i int, j int, long boolean, column long, node long, size long, place long, component long, chunk int, lead long"
    return rows.select(*columns).groupBy("block", "i", "j", "long").applyInArrow(choose, schema)


def _across(work: WorkTables, open_: DataFrame, owners: DataFrame, percent: int, blocks: int, partners: int) -> DataFrame:
    """Pairs (a, b) of a column in different components that neither places nor bitmaps rule out.

    Of each row its ``partners`` most alike ones leave the block. A row of nulls tells that others were left behind. The
    product of a block runs diagonal by diagonal, so a task holds its rows and a bounded number of pairs for each.

    Bitmaps are the bulk of what is exchanged. So places rule rows out before, columns of the same lead meet in the same
    blocks, as many as their rows need, and a node's bitmap is sent once to each of its blocks.
    """

    def multiply(key: tuple, block: pa.Table, bitmaps: pa.Table) -> pa.Table:
        block = _in_order(block)
        node, size = block.column("node").to_numpy(), block.column("size").to_numpy()
        named = bitmaps.column("node").to_numpy()
        by_name = np.argsort(named)
        at = by_name[np.searchsorted(named, node, sorter=by_name)]
        signatures = bitmaps.column("signature").to_pylist()
        names, unlike, held = np.zeros((0, 2), np.int64), np.zeros(0), [np.zeros((0, 2), np.int64)]
        left_behind = False

        def settle() -> None:
            nonlocal names, unlike, left_behind
            pairs = np.concatenate(held)
            held[:] = [np.zeros((0, 2), np.int64)]
            a, b = pairs[:, 0], pairs[:, 1]
            total, differ = size[a] + size[b], _differences(signatures, at[a], at[b])
            kept = 100 * (total - differ) >= percent * (total + differ)
            both = np.concatenate((names, np.stack((node[a[kept]], node[b[kept]]), axis=1)))
            share = np.concatenate((unlike, differ[kept] / total[kept]))
            # The same two rows meet in many columns.
            names, one = np.unique(both, axis=0, return_index=True)
            unlike = share[one]
            best = _best(names, unlike, partners)
            left_behind |= len(best) < len(names)
            names, unlike = names[best], unlike[best]

        waiting = 0
        for a, b in _diagonals(block, key[1].as_py() != key[2].as_py(), percent):
            held.append(np.stack((a, b), axis=1))
            waiting += len(a)
            if waiting > HELD_PAIRS:
                settle()
                waiting = 0
        settle()
        give_back()
        more = [None] if left_behind else []
        return pa.table({"a": pa.array([*names[:, 0].tolist(), *more], pa.int64()), "b": pa.array([*names[:, 1].tolist(), *more], pa.int64())})

    possible = work.write(_possible(open_, percent, blocks), "possible")
    parts = possible.groupBy("lead").agg(F.ceil(F.count("*") / F.lit(CHUNK)).alias("parts"))
    block = F.when(F.col("long"), F.col("block")).otherwise(F.pmod(F.xxhash64("lead", F.pmod("column", "parts")), F.lit(blocks)))
    dealt = possible.join(parts, "lead").withColumn("block", block).drop("lead", "parts")
    key = ["block", "i", "j", "long"]
    # Aliases tell the columns of the two sides apart.
    bitmaps = dealt.select(*[F.col(c).alias(c) for c in (*key, "node")]).distinct().join(owners.select("node", F.col("wide").alias("signature")), "node")
    pairs = dealt.groupBy(*key).cogroup(bitmaps.groupBy(*key)).applyInArrow(multiply, "a long, b long").distinct()
    pairs = work.write(pairs, "across")
    work.drop(possible)
    return pairs


def _alike(pairs: DataFrame, owners: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) whose bitmaps do not rule the threshold out."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total = batch.column(2).to_numpy()
            differ = [least_difference(x, y) for x, y in zip(batch.column(3).to_pylist(), batch.column(4).to_pylist(), strict=True)]
            # overlap = (total - difference) / 2 and union = (total + difference) / 2
            kept = 100 * (total - np.array(differ, np.int64)) >= percent * (total + np.array(differ, np.int64))
            yield batch.select([0, 1]).filter(pa.array(kept, pa.bool_()))

    first = owners.select(F.col("node").alias("a"), F.col("n").alias("n_a"), F.col("signature").alias("left"))
    second = owners.select(F.col("node").alias("b"), F.col("n").alias("n_b"), F.col("signature").alias("right"))
    both = pairs.join(first, "a").join(second, "b")
    return both.select("a", "b", (F.col("n_a") + F.col("n_b")).alias("total"), "left", "right").mapInArrow(in_arrow(compare), "a long, b long")


def _marks(hashes: DataFrame) -> np.ndarray:
    """Bits of the hashes in the only column of ``hashes``, a filter of fixed size."""

    def mark(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bits = np.zeros(FILTER_BITS, bool)
        for batch in batches:
            bits[batch.iloc[:, 0].to_numpy(np.int64).astype(np.uint64) % np.uint64(FILTER_BITS)] = True
        packed = np.packbits(bits).reshape(64, -1)
        some = [i for i in range(64) if packed[i].any()]
        yield pd.DataFrame({"block": np.array(some, np.int32), "counts": [packed[i].tobytes() for i in some]})

    return _combined(hashes.mapInPandas(mark, "block int, counts binary"), np.bitwise_or, "uint8", 64, FILTER_BITS // 512)


def _marked(hashes: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """Which hashes have their bit set: all that were marked, and a few others."""
    at = (hashes.astype(np.uint64) % np.uint64(FILTER_BITS)).astype(np.int64)
    return (bits[at >> 3] >> (7 - (at & 7)) & 1).astype(bool)


def _wanted(work: WorkTables, docs: DataFrame, owners: DataFrame, pairs: DataFrame, key: str, text: str, words: int) -> DataFrame:
    """Shingle sets (node, shingles) of the nodes in ``pairs``, from one document of each.

    A filter of fixed size over the documents' keys keeps most other texts from being hashed again.
    """

    nodes = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    shared = docs.sparkSession.sparkContext.broadcast(_marks(owners.join(nodes, "node", "left_semi").select("owner")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, bits = Shingler(words), shared.value
        for batch in batches:
            marked = batch.column(1).filter(pa.array(_marked(batch.column(0).to_numpy(), bits)))
            names, sets = [], []
            for _, _, shingles, _ in shingler.column(marked):
                names.append(node_of(shingles))
                sets.append(shingles.tobytes())
            yield pa.record_batch([pa.array(names, pa.int64()), pa.array(sets, pa.binary())], names=["node", "shingles"])

    found = docs.select(F.xxhash64(key).alias("owner"), F.col(text).alias("text")).mapInArrow(in_arrow(run), "node long, shingles binary")
    return work.write(found.join(nodes, "node", "left_semi").dropDuplicates(["node"]), "sets")


def _linked(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs whose overlap count reaches the threshold."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = np.zeros(len(batch), bool)
            for i in range(len(batch)):
                x, y = (np.frombuffer(batch.column(c)[i].as_buffer(), "<u8") for c in (2, 3))
                if len(x) > len(y):
                    x, y = y, x
                at = np.searchsorted(y, x)
                common = int((y[np.minimum(at, len(y) - 1)] == x).sum())
                kept[i] = 100 * common >= percent * (len(x) + len(y) - common)
            yield batch.select([0, 1]).filter(pa.array(kept))

    first = sets.select(F.col("node").alias("a"), F.col("shingles").alias("left"))
    second = sets.select(F.col("node").alias("b"), F.col("shingles").alias("right"))
    both = pairs.select("a", "b").join(second, "b").join(first, "a").select("a", "b", "left", "right")
    return both.mapInArrow(in_arrow(count), "a long, b long").distinct()


def shingle_components(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """Rows (``key``, ``n_shingles``, ``component_id``, ``n_linked_sets``), one per row of ``docs``.

    ``component_id`` is the smallest ``key`` reachable by links; ``n_linked_sets`` counts the different sets of the
    component. Documents without words have an empty set, no links and themselves as component, also when their key is
    null. Repeated rows are linked with each other like any copies. Other columns of ``docs`` have no influence.
    """
    with WorkTables(docs.sparkSession) as work:
        labels = _labelled(work, docs, key, text, words, percent)
        work.keep(labels)
    return labels.select(F.col("key").alias(key), "n_shingles", "component_id", "n_linked_sets")


def _open_rows(columns: DataFrame, component: DataFrame | None) -> DataFrame:
    """Rows of columns that several components share, with their component and the column's number of rows."""
    if component is None:
        named = columns.withColumn("component", F.col("node"))
    else:
        named = columns.join(component, "node", "left").withColumn("component", F.coalesce("component", "node"))
    several = named.groupBy("column").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count("*").alias("rows"))
    return named.join(several.filter("low < high").select("column", "rows"), "column")


def _hub_pairs(open_: DataFrame, owners: DataFrame, percent: int, number: int) -> DataFrame:
    """Pairs (a, b) of each row with a few rows of its column, others in each round."""
    rows = open_.select("column", F.struct("node", "size", "place", "component").alias("x"))
    chances = [F.min_by("x", F.xxhash64("x.node", F.lit(HUBS * number + i))) for i in range(HUBS)]
    hubs = rows.groupBy("column").agg(F.array_distinct(F.array(*chances)).alias("hubs"))
    pairs = rows.join(hubs, "column").select("x", F.explode("hubs").alias("y")).filter("x.component <> y.component")
    pairs = pairs.filter(_may_link(percent)).select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b"))
    return _alike(pairs.distinct(), owners, percent)


def _labelled(work: WorkTables, docs: DataFrame, key: str, text: str, words: int, percent: int) -> DataFrame:
    spark = docs.sparkSession
    survey = work.write(_survey(docs, key, text, words), "survey")
    rarity = _combined(survey.filter(F.col("block").isNotNull()).select("block", "counts"), np.add, "<i8", 64, COUNTERS // 64)
    rows = survey.filter(F.col("block").isNull()).select("key", "n_shingles", "node")
    total = rows.agg(F.sum(F.col("n_shingles") * (100 - percent) / 100 + 1)).first()[0] or 0
    blocks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), int(total / BLOCK_ENTRIES) + 1)
    columns = work.write(_columns(_entries(docs, text, words, percent, rarity, blocks)), "columns")
    owners = survey.filter(F.col("node").isNotNull()).groupBy("node").agg(
        F.xxhash64(F.min("key")).alias("owner"), F.max("n_shingles").alias("n"), F.max("signature").alias("signature"), F.max("wide").alias("wide")
    )
    owners = work.write(owners, "owners")
    # The bitmaps are with the owners from here on.
    rows = work.write(rows, "rows")
    work.drop(survey)
    component, tried, number, partners = None, None, 0, 0
    while True:
        open_ = _open_rows(columns, component)
        found = _across(work, open_, owners, percent, blocks, partners) if partners else _hub_pairs(open_, owners, percent, number)
        if tried is not None:
            # Rows of nulls stay.
            found = found.join(tried, ["a", "b"], "left_anti")
        found = work.write(found, f"pairs-{number}")
        pairs = found.filter("a is not null")
        count, linked = pairs.count(), 0
        if count:
            sets = _wanted(work, docs, owners, pairs, key, text, words)
            met = work.write(_linked(pairs, sets, percent), f"links-{number}")
            work.drop(sets)
            linked = met.count()
            tried = pairs if tried is None else tried.unionByName(pairs)
        if linked:
            links = met if component is None else met.unionByName(component.select(F.col("node").alias("a"), F.col("component").alias("b")))
            before, component = component, work.write(link_components(links), "components")
            if before is not None:
                work.drop(before)
        if partners:
            if count == found.count():
                break
            partners *= 8
        elif linked <= FRUITFUL * count:
            partners = PARTNERS
        number += 1
    if component is None:
        named = rows.withColumn("component", F.col("node"))
    else:
        named = rows.join(component, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = named.filter(F.col("component").isNotNull()).groupBy("component").agg(
        F.min("key").alias("component_id"), F.count_distinct("node").alias("n_linked_sets")
    )
    return work.write(
        named.join(least, "component", "left").select(
            "key", "n_shingles", F.coalesce("component_id", "key").alias("component_id"), F.coalesce("n_linked_sets", F.lit(0)).alias("n_linked_sets")
        ),
        "labels",
    )


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one document of each component of near copies, the one with the smallest key; others stay as they are.

    Of repeated rows (same key and text) one stays, unless they have no words. Rows that share a key but not the text
    are different documents. Columns of any name stay as they are.
    """
    name, flag = unused_name("row_key", docs.columns), unused_name("marked", docs.columns)
    tagged = docs.withColumn(name, F.struct(F.col(key).alias("key"), F.xxhash64(text).alias("hash")))
    found = shingle_components(tagged, name, text).withColumnRenamed(name, "row_key")
    with WorkTables(docs.sparkSession) as work:
        verdict = found.groupBy("row_key").agg(F.count("*").alias("rows"), F.min("component_id").alias("first"), F.max("n_shingles").alias("n"))
        verdict = work.write(verdict, "verdict")
        # Written first, so that their size is known and a small table is broadcast without moving the texts.
        dropped = work.write(verdict.filter(F.col("row_key") != F.col("first")).select(F.col("row_key").alias(name)), "dropped")
        repeated = verdict.filter((F.col("row_key") == F.col("first")) & (F.col("rows") > 1) & (F.col("n") > 0)).select(F.col("row_key").alias(name))
        repeated = work.write(repeated, "repeated")
        work.keep(dropped, repeated)
    # Only texts whose key may be among those are moved; a filter of fixed size tells the others.
    shared = docs.sparkSession.sparkContext.broadcast(_marks(dropped.unionByName(repeated).select(F.xxhash64(name))))

    @F.pandas_udf("boolean")
    def marked(hashes: pd.Series) -> pd.Series:
        return pd.Series(_marked(hashes.to_numpy(np.int64), shared.value))

    tagged = tagged.withColumn(flag, marked(F.xxhash64(name)))
    kept = tagged.filter(F.col(flag)).join(dropped, name, "left_anti")
    if not repeated.isEmpty():
        once = kept.join(repeated, name, "left_semi").dropDuplicates([name])
        kept = kept.join(repeated, name, "left_anti").unionByName(once)
    return tagged.filter(~F.col(flag)).unionByName(kept).select(*docs.columns)


_SPLIT = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+')"
ORACLE = f"""
with recursive d as materialized (select doc_id, coalesce({_SPLIT}, []) as w from documents),
s as materialized (
  select distinct doc_id, g from (
    select doc_id, unnest(case when len(w) = 0 then [] when len(w) < {WORDS} then [array_to_string(w, ' ')]
      else list_transform(range(1, len(w) - {WORDS} + 2), lambda i: array_to_string(w[i:i + {WORDS} - 1], ' ')) end) as g from d)
),
n as materialized (select doc_id, count(*) as n from s group by doc_id),
o as materialized (select a.doc_id as x, b.doc_id as y, count(*) as c from s a join s b on a.g = b.g and a.doc_id < b.doc_id group by x, y),
l as materialized (select x, y from o join n p on p.doc_id = x join n q on q.doc_id = y where 100 * c >= {PERCENT} * (p.n + q.n - c)),
e as materialized (select x, y from l union all select y, x from l),
r as (select doc_id as x, doc_id as y from d union select r.x, e.y from r join e on r.y = e.x)
select d.doc_id, coalesce(n.n, 0) as n_shingles, (select min(r.y) from r where r.x = d.doc_id) as component_id
from d left join n using (doc_id)
"""
