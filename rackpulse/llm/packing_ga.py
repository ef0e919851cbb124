"""Packing of token pieces into fixed-length sequences by a grouping genetic algorithm on islands.

Pieces are dealt to shards of bounded size by a hash. Every shard is evolved on several islands, one row each: a
crossover injects whole well-filled sequences of one parent into another, drops the sequences that hold the same pieces,
and puts what they displace back by best fit. Between rounds each island gets the elite of its neighbour. Only lengths
travel; the ids stay in the corpus.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rackpulse.llm.scope import in_arrow, unused_name
from rackpulse.llm.token_orc import with_end
from rackpulse.llm.wordpiece_ids import default_path, encoder
from rackpulse.session import materialise

SHARD_PIECES = 16_384
ISLANDS, ROUNDS, POPULATION, CHILDREN = 3, 3, 4, 6
INJECTED = 0.05


def token_pieces(docs: DataFrame, length: int, end_id: int, path: str | None = None) -> DataFrame:
    """Rows (doc_id, piece, start, length, ids_crc32): each document's ids with the end id, cut at ``length`` ids.

    A null text is its end id alone; repeated rows make repeated pieces.
    """
    path = path or default_path()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = encoder(path)
        for batch in batches:
            row = 0
            for sizes, flat in words.encode_column(batch.column(1)):
                offsets, values = with_end(sizes, flat, end_id)
                total = np.diff(offsets)
                pieces = -(-total // length)
                owner = np.repeat(np.arange(len(total)), pieces)
                number = np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                start = number * length
                size = np.minimum(length, total[owner] - start)
                at = offsets[owner] + start
                ids = values.astype("<u4")
                sums = [zlib.crc32(ids[a : a + n]) for a, n in zip(at.tolist(), size.tolist(), strict=True)]
                yield pa.record_batch(
                    [
                        batch.column(0).slice(row, len(total)).take(pa.array(owner)),
                        pa.array(number.astype(np.int32)), pa.array(start), pa.array(size), pa.array(sums, pa.int64()),
                    ],
                    names=["doc_id", "piece", "start", "length", "ids_crc32"],
                )
                row += len(total)

    return docs.select("doc_id", "text").mapInArrow(
        in_arrow(cut), "doc_id long, piece int, start long, length long, ids_crc32 long"
    )


def best_fit(lengths: np.ndarray, order: np.ndarray, bin_of: np.ndarray, room: list[int], capacity: int) -> None:
    """Put the items ``order``, one after the other, where the least room remains; ``bin_of`` and ``room`` are updated."""
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    present = 0  # bit r: some sequence has exactly r ids of room
    for number, left in enumerate(room):
        if left > 0:
            by_room[left].append(number)
            present |= 1 << left
    for item, size in zip(order.tolist(), lengths[order].tolist(), strict=True):
        above = present >> size
        if above:
            left = size + (above & -above).bit_length() - 1
            number = by_room[left].pop()
            if not by_room[left]:
                present &= ~(1 << left)
        else:
            number, left = len(room), capacity
            room.append(capacity)
        bin_of[item] = number
        left -= size
        room[number] = left
        if left:
            by_room[left].append(number)
            present |= 1 << left


class Shard:
    """Solutions of one shard: the sequence number of every piece."""

    def __init__(self, lengths: np.ndarray, capacity: int, seed: int):
        self.lengths, self.capacity = lengths.astype(np.int64), capacity
        self.random = np.random.default_rng(seed)
        self.least = int(-(-self.lengths.sum() // capacity))

    def room(self, bin_of: np.ndarray) -> np.ndarray:
        return self.capacity - np.bincount(bin_of, self.lengths).astype(np.int64)

    def value(self, bin_of: np.ndarray) -> tuple[int, float]:
        """Number of sequences (fewer is better), then the mean square of what is left open (more is better)."""
        room = self.room(bin_of)
        return len(room), -float((room.astype(float) ** 2).mean()) if len(room) else 0.0

    def greedy(self, noise: float) -> np.ndarray:
        """Best fit in falling order of the lengths, each disturbed by up to ``noise`` of its size."""
        shown = self.lengths * (1 + noise * self.random.random(len(self.lengths)))
        bin_of = np.zeros(len(self.lengths), np.int64)
        best_fit(self.lengths, np.argsort(-shown, kind="stable"), bin_of, [], self.capacity)
        return bin_of

    def _refill(self, bin_of: np.ndarray, dropped: np.ndarray) -> np.ndarray:
        """Drop whole sequences, number the others anew and put the displaced pieces back, the longest first."""
        kept = ~dropped
        number = np.cumsum(kept) - 1
        out = np.where(kept[bin_of], number[bin_of], -1)
        loose = np.flatnonzero(out < 0)
        settled = out >= 0
        room = (self.capacity - np.bincount(out[settled], self.lengths[settled], int(kept.sum()))).astype(int).tolist()
        best_fit(self.lengths, loose[np.argsort(-self.lengths[loose], kind="stable")], out, room, self.capacity)
        return out

    def cross(self, taker: np.ndarray, giver: np.ndarray) -> np.ndarray:
        """Inject some of the fullest sequences of ``giver`` whole into ``taker``."""
        room = self.room(giver)
        count = max(1, int(len(room) * INJECTED))
        full = np.argsort(room, kind="stable")[: 4 * count]
        chosen = np.zeros(len(room), bool)
        chosen[self.random.choice(full, min(count, len(full)), replace=False)] = True
        moved = chosen[giver]
        new = int(taker.max()) + 1
        out = np.where(moved, new + (np.cumsum(chosen) - 1)[giver], taker)
        dropped = np.zeros(new + int(chosen.sum()), bool)
        dropped[taker[moved]] = True  # they held pieces that the injected sequences bring along
        return self._refill(out, dropped)

    def shake(self, bin_of: np.ndarray) -> np.ndarray:
        """Break up some of the emptiest sequences and a few others."""
        room = self.room(bin_of)
        count = max(1, int(len(room) * INJECTED / 2))
        dropped = np.zeros(len(room), bool)
        dropped[np.argsort(-room, kind="stable")[:count]] = True
        dropped[self.random.choice(len(room), min(count, len(room)), replace=False)] = True
        return self._refill(bin_of, dropped)

    def evolve(self, population: list[np.ndarray], immigrants: list[np.ndarray]) -> list[np.ndarray]:
        """One round: children of crossover and mutation replace the worst; ends once no sequence can be saved."""
        if not population:
            population = [self.greedy(noise) for noise in (0.0, 0.02, 0.1, 0.3)[:POPULATION]]
        ranked = sorted([*population, *immigrants], key=lambda s: (self.value(s)[0], -self.value(s)[1]))[:POPULATION]
        for _ in range(CHILDREN):
            if self.value(ranked[0])[0] <= self.least or len(ranked) < 2:
                break
            a, b = self.random.choice(len(ranked), 2, replace=False)
            child = self.cross(ranked[a], ranked[b])
            if self.random.random() < 0.3:
                child = self.shake(child)
            ranked = sorted([*ranked, child], key=lambda s: (self.value(s)[0], -self.value(s)[1]))[:POPULATION]
        return ranked


def _evolved(capacity: int, number: int):
    """A row (shard, island, lengths, population, immigrant) -> its next generation and its elite's value."""

    def step(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for r in batch.itertuples(index=False):
                lengths = np.frombuffer(r.lengths, "<i4")
                shard = Shard(lengths, capacity, hash((r.shard, r.island, number)) % 2**32)
                decode = lambda raw: [s.astype(np.int64) for s in np.frombuffer(raw, "<i4").reshape(-1, len(lengths))] if raw else []  # noqa: E731, B023
                ranked = shard.evolve(decode(r.population), decode(r.immigrant))
                bins, spread = shard.value(ranked[0])
                rows.append((r.shard, r.island, r.lengths, np.array(ranked, "<i4").tobytes(), ranked[0].astype("<i4").tobytes(), bins, spread))
            yield pd.DataFrame(rows, columns=["shard", "island", "lengths", "population", "elite", "bins", "spread"])

    return step


EVOLVED = "shard long, island int, lengths binary, population binary, elite binary, bins long, spread double"


def pack(pieces: DataFrame, capacity: int, keys: list[str], islands: int = ISLANDS, rounds: int = ROUNDS) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to ``pieces``, whose rows have a ``length`` of 1 to ``capacity`` ids.

    ``keys`` order the rows of a shard; repeated rows stay separate pieces. A shard holds about SHARD_PIECES rows
    whatever the table's size, so a task is bounded, and a shard wastes less than one sequence. No rows give no rows.
    """
    pieces = materialise(pieces, "pieces")
    schema = pieces.schema
    shards = max(1, -(-pieces.count() // SHARD_PIECES))
    # Repeated rows would all hash alike; their place in the written table tells them apart.
    shard = unused_name("shard", pieces.columns)
    dealt = pieces.withColumn(shard, F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(shards)))

    def gather(key: tuple, rows: pa.Table) -> pa.Table:
        rows = rows.drop_columns([shard]).sort_by([(k, "ascending") for k in keys])
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, rows.schema) as writer:
            writer.write_table(rows)
        lengths = rows.column("length").to_numpy().astype("<i4").tobytes()
        return pa.table({"shard": [key[0].as_py()], "lengths": pa.array([lengths], pa.binary()), "rows": pa.array([sink.getvalue().to_pybytes()], pa.binary())})

    gathered = materialise(
        dealt.repartition(shards, shard).groupBy(shard).applyInArrow(gather, "shard long, lengths binary, rows binary"), "shards"
    )
    state = gathered.select(
        "shard", F.explode(F.array(*[F.lit(i) for i in range(islands)])).alias("island"), "lengths",
        F.lit(None).cast("binary").alias("population"), F.lit(None).cast("binary").alias("immigrant"),
    )
    for number in range(rounds):
        # One row is a whole shard's work: deal the rows out one by one.
        spread = state.repartition(shards * islands, "shard", "island")
        evolved = materialise(spread.mapInPandas(_evolved(capacity, number), EVOLVED), f"generation-{number}")
        visitors = evolved.select("shard", F.pmod(F.col("island") + 1, F.lit(islands)).cast("int").alias("island"), F.col("elite").alias("immigrant"))
        state = evolved.select("shard", "island", "lengths", "population").join(visitors, ["shard", "island"])
    best = evolved.groupBy("shard").agg(F.min_by("island", F.struct("bins", -F.col("spread"), "island")).alias("island"))
    winners = evolved.select("shard", "island", "elite").join(best, ["shard", "island"]).join(gathered.select("shard", "rows"), "shard")

    def lay_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                rows = pa.ipc.open_stream(r["rows"]).read_all()
                bin_of = np.frombuffer(r["elite"], "<i4").astype(np.int64)
                order = np.argsort(bin_of, kind="stable")
                sizes = rows.column("length").to_numpy()[order]
                ends = np.cumsum(sizes)
                first = np.concatenate(([True], np.diff(bin_of[order]) > 0))
                base = np.maximum.accumulate(np.where(first, ends - sizes, 0))
                rows = rows.take(pa.array(order))
                rows = rows.append_column("sequence_id", pa.array((np.int64(r["shard"]) << 32) + bin_of[order]))
                yield from rows.append_column("offset", pa.array(ends - sizes - base)).combine_chunks().to_batches()

    out = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
    return winners.repartition(shards, "shard").mapInArrow(in_arrow(lay_out), f"{out}, sequence_id long, offset long")
