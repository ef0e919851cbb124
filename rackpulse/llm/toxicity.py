"""Toxicity by a support vector machine on a subsequence string kernel with Nyström landmarks.

A text is a bag of units: words in lower case without ASCII marks inside, so that "i.d-i*ot" is one unit, and runs of single
characters joined, so that "i d i o t" is one too. The kernel of two units counts the triples of characters that they share
in order, gaps allowed, each weighted by DECAY to the power of the span it covers; inserted characters weaken the
likeness instead of ending it. Landmark units span the feature space; the machine is trained on units and labelled texts in
turn: of a toxic text only its most toxic unit must be positive, of a clean text none may be. A text's score is that of its
most toxic unit.

The trained function is linear in the triples, so it is folded into one weight per triple; scoring a new unit is a sum of
table cells, and each distinct unit is scored once per slice or taken from the worker's cache.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rackpulse.llm.labelled import class_sizes, known_labels, labelled_texts
from rackpulse.llm.scope import WorkTables, in_arrow
from rackpulse.llm.wordpiece_ids import LOWER, flat_bytes, slices

DECAY, SPAN = 0.6, 8
#: Longer units are scored by overlapping windows.
LONGEST_UNIT = 24
LANDMARKS, TOXIC_WEIGHT = 600, 2.0
#: Most labelled texts of each class for the fit.
FIT_ROWS_PER_CLASS = 4_000
#: Units whose landmark features are held at a time.
FIT_BLOCK = 2_000
FIT_TURNS, NEGATIVES, COST = 6, 9_000, 100.0
CACHED_UNITS = 400_000
CODES = 64


def _codes() -> np.ndarray:
    """Six bits per byte: letters and digits their own, bytes beyond ASCII folded, everything else 0."""
    codes = np.zeros(256, np.int32)
    codes[ord("a") : ord("z") + 1] = np.arange(1, 27)
    codes[ord("0") : ord("9") + 1] = np.arange(27, 37)
    codes[128:] = 37 + np.arange(128) % 27
    return codes


CODE = _codes()
#: 0 separates units, 1 belongs to a unit, 2 is left out of it.
_KIND = np.full(256, 2, np.uint8)
_KIND[[9, 10, 11, 12, 13, 32]] = 0
_KIND[128:] = 1
_KIND[ord("0") : ord("9") + 1] = 1
_KIND[ord("a") : ord("z") + 1] = 1


@lru_cache(64)
def triples(length: int) -> tuple[np.ndarray, np.ndarray]:
    """Places (i, j, k) of the triples of a unit of this length, and their weights divided by their norm."""
    places = [(i, j, k) for i in range(length) for k in range(i + 2, min(i + SPAN, length)) for j in range(i + 1, k)]
    weights = np.array([DECAY ** (k - i + 1) for i, _, k in places])
    return np.array(places, np.int64).reshape(-1, 3), weights / np.sqrt((weights**2).sum()) if places else weights


def triple_ids(units: list[bytes], length: int) -> np.ndarray:
    """Numbers of all triples of equally long units, one row each."""
    codes = CODE[np.frombuffer(b"".join(units), np.uint8).reshape(len(units), length)]
    places, _ = triples(length)
    return (codes[:, places[:, 0]] * CODES + codes[:, places[:, 1]]) * CODES + codes[:, places[:, 2]]


def by_length(units: list[bytes]) -> dict[int, list[int]]:
    groups: dict[int, list[int]] = {}
    for i, unit in enumerate(units):
        groups.setdefault(len(unit), []).append(i)
    return groups


def unit_table(raw: bytes, bounds: np.ndarray) -> tuple[pa.Array, np.ndarray, list[tuple[int, bytes]]]:
    """Units of texts that lie end to end, the number of units before each bound, and joined runs as (text, unit)."""
    data = np.frombuffer(raw.translate(LOWER), np.uint8)
    capital = np.flatnonzero((data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)) + 1
    if len(capital):
        data = data.copy()
        data[capital] += 0x20
    kind = _KIND[data]
    gaps = np.cumsum(kind == 0, dtype=np.int64)  # which stretch of solid bytes a byte is in
    text_of = np.zeros(len(data), np.int64)
    inner = bounds[1:-1][bounds[1:-1] < len(data)]
    np.add.at(text_of, inner, 1)
    text_of = np.cumsum(text_of)
    own = np.flatnonzero(kind == 1)
    label = gaps[own] + text_of[own]
    first = np.flatnonzero(np.concatenate(([True], label[1:] != label[:-1]))) if len(own) else np.zeros(0, np.int64)
    offsets = np.concatenate((first, [len(own)])).astype(np.int32)
    units = pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(offsets), pa.py_buffer(data[own])])
    starts = own[first]
    cuts = np.searchsorted(starts, bounds)
    sizes = np.diff(offsets)
    single = np.flatnonzero(sizes == 1)
    joined = []
    if len(single) >= 3:
        owner = np.searchsorted(cuts, single, side="right") - 1
        breaks = np.flatnonzero((np.diff(single) != 1) | (np.diff(owner) != 0)) + 1
        for run in np.split(single, breaks):
            if len(run) >= 3:
                text = int(np.searchsorted(cuts, run[0], side="right")) - 1
                joined.append((text, data[own[offsets[run[0]] : offsets[run[-1] + 1]]].tobytes()))
    return units, cuts, joined


def windows_of(unit: bytes) -> list[bytes]:
    """A unit, or the overlapping pieces of a long one."""
    if len(unit) <= LONGEST_UNIT:
        return [unit]
    step = LONGEST_UNIT // 3
    return [unit[i : i + LONGEST_UNIT] for i in range(0, len(unit) - LONGEST_UNIT + step, step)]


@dataclass
class ToxicityModel:
    """Weight per triple, the background of units without triples, and the curve from margins to scores."""

    weights: np.ndarray = field(default_factory=lambda: np.zeros(CODES**3, np.float32))
    bias: float = -1.0
    slope: float = 1.0
    shift: float = 0.0
    known: dict[bytes, float] = field(default_factory=dict, repr=False)

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "known"} | {"known": {}}

    def margins(self, units: list[bytes]) -> np.ndarray:
        """Values of units of at most LONGEST_UNIT bytes."""
        out = np.full(len(units), self.bias)
        for length, rows in by_length(units).items():
            if length < 3:
                continue
            _, weights = triples(length)
            for part in np.array_split(np.array(rows), max(1, len(rows) * len(weights) // 4_000_000)):
                out[part] += self.weights[triple_ids([units[i] for i in part], length)] @ weights.astype(np.float32)
        return out

    def unit_margins(self, units: list[bytes]) -> np.ndarray:
        """Values of any units, each distinct one computed once per worker as long as it is cached."""
        found = [self.known.get(u) for u in units]
        missing = [u for u, v in zip(units, found, strict=True) if v is None]
        if missing:
            short = [u for u in missing if len(u) <= LONGEST_UNIT]
            fresh = dict(zip(short, self.margins(short).tolist(), strict=True))
            for unit in missing:
                if len(unit) > LONGEST_UNIT:
                    pieces = windows_of(unit)
                    fresh[unit] = max(float(self.margins(pieces[i : i + 10_000]).max()) for i in range(0, len(pieces), 10_000))
            if len(self.known) + len(fresh) > CACHED_UNITS:
                self.known = {}
            self.known.update((u, v) for u, v in fresh.items() if len(u) <= LONGEST_UNIT)
            found = [fresh[u] if v is None else v for u, v in zip(units, found, strict=True)]
        return np.array(found, float)

    def column_margins(self, texts: pa.Array) -> np.ndarray:
        """The largest unit value of each text; the background for a text without units."""
        parts = [np.zeros(0)]
        for part in slices(pc.fill_null(texts, "").cast(pa.large_binary())):
            raw, bounds = flat_bytes(part)
            out = np.full(len(part), self.bias)
            if raw:
                units, cuts, joined = unit_table(raw, bounds)
                if len(units):
                    coded = units.dictionary_encode()
                    values = self.unit_margins(coded.dictionary.to_pylist())[coded.indices.to_numpy()]
                    some = np.flatnonzero(np.diff(cuts))
                    out[some] = np.maximum(out[some], np.maximum.reduceat(values, cuts[:-1][some]))
                if joined:
                    extra = self.unit_margins([u for _, u in joined])
                    np.maximum.at(out, np.array([t for t, _ in joined]), extra)
            parts.append(out)
        return np.concatenate(parts)

    def probability(self, margins: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * margins + self.shift, -40, 40)))


def _bags(texts: list[str]) -> tuple[list[bytes], list[np.ndarray]]:
    """Distinct units of all texts, and each text's units by number."""
    number: dict[bytes, int] = {}
    bags: list[np.ndarray] = []
    for part in slices(pa.array(texts, pa.string()).cast(pa.large_binary())):
        raw, bounds = flat_bytes(part)
        units, cuts, joined = unit_table(raw, bounds) if raw else (pa.array([], pa.binary()), np.zeros(len(part) + 1, int), [])
        coded = units.dictionary_encode()
        numbers = [[number.setdefault(w, len(number)) for w in windows_of(u)] for u in coded.dictionary.to_pylist()]
        index = coded.indices.to_pylist()
        own = [sorted({n for i in index[a:b] for n in numbers[i]}) for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]
        for text, unit in joined:
            own[text] += [number.setdefault(w, len(number)) for w in windows_of(unit)]
        bags += [np.array(b, np.int64) for b in own]
    return list(number), bags


def _landmark_space(landmarks: list[bytes]):
    """The triples of the landmarks as rows of a small table, and the whitening of their kernel matrix."""
    index = np.full(CODES**3, -1, np.int32)
    entries: list[tuple[int, int, float]] = []
    for column, unit in enumerate(landmarks):
        _, weights = triples(len(unit))
        for t, w in zip(triple_ids([unit], len(unit))[0].tolist(), weights.tolist(), strict=True):
            entries.append((t, column, w))
    used = np.unique([t for t, _, _ in entries])
    index[used] = np.arange(len(used))
    table = np.zeros((len(used) + 1, len(landmarks)))
    for t, column, w in entries:
        table[index[t], column] += w
    values, vectors = np.linalg.eigh(table.T @ table)
    keep = values > 1e-6 * values.max()
    return index, used, table, vectors[:, keep] / np.sqrt(values[keep])


def _against_landmarks(units: list[bytes], index: np.ndarray, table: np.ndarray) -> np.ndarray:
    out = np.zeros((len(units), table.shape[1]), np.float32)
    for length, rows in by_length(units).items():
        if length < 3:
            continue
        _, weights = triples(length)
        for part in np.array_split(np.array(rows), max(1, len(rows) * len(weights) // 20_000)):
            ids = index[triple_ids([units[i] for i in part], length)]
            out[part] = np.einsum("utm,t->um", table[ids], weights)
    return out


def _squared_hinge(x: np.ndarray, y: np.ndarray, weight: np.ndarray, cost: float) -> np.ndarray:
    """Weights of a linear machine with squared hinge loss, by Newton steps on the rows inside the margin."""
    w = np.zeros(x.shape[1])
    for _ in range(60):
        inside = np.flatnonzero(y * (x @ w) < 1)
        left, right = np.eye(len(w)), np.zeros(len(w))
        for at in range(0, len(inside), FIT_BLOCK):
            part = inside[at : at + FIT_BLOCK]
            rows, scale = x[part], 2 * cost * weight[part]
            left += rows.T @ (rows * scale[:, None])
            right += rows.T @ (scale * y[part])
        new = np.linalg.solve(left, right)
        if np.abs(new - w).max() < 1e-8:
            break
        w = new
    return w


def _curve(margins: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """Logistic curve through the texts' margins, with Platt's smoothed targets."""
    up, down = labels.sum(), (1 - labels).sum()
    target = np.where(labels == 1, (up + 1) / (up + 2), 1 / (down + 2))
    x, w = np.stack((margins, np.ones_like(margins)), axis=1), np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -40, 40)))
        step = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + 1e-6 * np.eye(2), x.T @ (target - p) - 1e-6 * w)
        w = w + np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return float(w[0]), float(w[1])


def fit(texts: list[str], labels: np.ndarray, seed: int = 5) -> ToxicityModel:
    """Train on labelled texts; with one class or no texts every score is that class's smoothed share."""
    units, bags = _bags(texts)
    flat = np.concatenate([*bags, np.zeros(0, np.int64)])
    toxic_row = np.repeat(labels == 1, [len(b) for b in bags])
    return fit_bags(units, bags, np.bincount(flat[toxic_row], minlength=len(units)), np.bincount(flat[~toxic_row], minlength=len(units)), labels, seed)


def fit_bags(units: list[bytes], bags: list[np.ndarray], seen_toxic: np.ndarray, seen_clean: np.ndarray, labels: np.ndarray, seed: int = 5) -> ToxicityModel:
    """Train on bags of units: each text's units by number, and how many toxic and clean texts hold a unit."""
    n = len(labels)
    share = (labels.sum() + 1) / (n + 2)
    if n == 0 or labels.min() == labels.max():
        return ToxicityModel(bias=0.0, slope=0.0, shift=float(np.log(share / (1 - share))))
    positive = np.flatnonzero(labels == 1)
    clean_total = n - len(positive)
    odds = np.log((seen_toxic + 0.5) / (len(positive) + 1)) - np.log((seen_clean + 0.5) / (clean_total + 1))
    long_enough = np.array([len(u) >= 3 for u in units], bool)
    value = np.where(long_enough, odds * np.sqrt(seen_toxic), -np.inf)

    # Only units that toxic texts hold much more often can stand for them; all others of a clean text are negative.
    telling = long_enough & (odds > np.log(4))

    def witnesses() -> np.ndarray:
        """The most toxic telling unit of each toxic text that has one."""
        own = (bags[i][telling[bags[i]]] for i in positive)
        return np.array([b[np.argmax(value[b])] for b in own if len(b)], np.int64)

    random = np.random.default_rng(seed)
    clean_units = np.flatnonzero((seen_clean > 0) & long_enough)
    if not len(clean_units) or not len(witnesses()):
        return ToxicityModel(bias=0.0, slope=0.0, shift=float(np.log(share / (1 - share))))
    # Landmarks: the units that most toxic texts point to, common clean units, and chance ones.
    pointed = np.argsort(-value, kind="stable")[: LANDMARKS // 2]
    common = clean_units[np.argsort(-seen_clean[clean_units], kind="stable")[: LANDMARKS // 4]]
    chance = random.choice(clean_units, min(LANDMARKS // 4, len(clean_units)), replace=False)
    chosen = dict.fromkeys([*pointed.tolist(), *common.tolist(), *chance.tolist()])
    index, used, table, whiten = _landmark_space([units[i] for i in chosen if long_enough[i]])
    model = ToxicityModel()
    downs = random.choice(clean_units, min(NEGATIVES // 2, len(clean_units)), replace=False)
    for _ in range(FIT_TURNS):
        # Units that several toxic texts hold and no clean one does are positive as well.
        ups = np.unique(np.concatenate((witnesses(), np.flatnonzero(telling & (seen_toxic >= 4) & (seen_clean == 0)))))
        worst = clean_units[np.argsort(-value[clean_units], kind="stable")[: NEGATIVES // FIT_TURNS]]
        downs = np.setdiff1d(np.concatenate((downs, worst)), ups)
        if not len(ups) or not len(downs):
            break
        chosen = np.concatenate((ups, downs))
        x = np.ones((len(chosen), whiten.shape[1] + 1), np.float32)
        for at in range(0, len(chosen), FIT_BLOCK):
            x[at : at + FIT_BLOCK, :-1] = _against_landmarks([units[i] for i in chosen[at : at + FIT_BLOCK]], index, table) @ whiten
        y = np.concatenate((np.ones(len(ups)), -np.ones(len(downs))))
        # A unit counts as often as texts of its class hold it, on a dampened scale; toxic units are few and count more.
        weight = (np.concatenate((seen_toxic[ups], seen_clean[downs])) + 1.0) ** 0.7
        weight[: len(ups)] *= TOXIC_WEIGHT
        w = _squared_hinge(x, y, weight, COST)
        model = ToxicityModel(bias=float(w[-1]))
        model.weights[used] = table[:-1] @ (whiten @ w[:-1])
        value = np.where(long_enough, model.margins([u[:LONGEST_UNIT] for u in units]), model.bias)
    value = np.where(long_enough, value, model.bias)
    bag_values = np.array([value[b].max() if len(b) else model.bias for b in bags])
    model.slope, model.shift = _curve(bag_values, labels.astype(float))
    return model


def fit_on(docs: DataFrame, labels: DataFrame, label: str, usable: Column, key: str = "doc_id", text: str = "text") -> ToxicityModel:
    """Fit on labelled rows for which ``usable`` holds: FIT_ROWS_PER_CLASS of each class at most, smallest hashes first.

    Rows with a null key or label are left out, and equal texts of one key are one row; a null text counts as an empty one.
    Texts of any length are cut into units by the executors. The driver gets the distinct units with their counts and, per
    text, 8 bytes for each of its units. The curve is moved back to the classes' shares among all usable labels.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            units, bags = _bags(pc.fill_null(batch.column(3), "").to_pylist())
            held = [[units[i] for i in bag.tolist()] for bag in bags]
            yield pa.record_batch([*batch.columns[:3], pa.array(held, pa.list_(pa.binary()))], names=["key", "hash", "label", "units"])

    known = known_labels(labels, label, usable, key)
    with WorkTables(docs.sparkSession) as work:
        chosen = labelled_texts(docs, known, FIT_ROWS_PER_CLASS, key, text)
        kind = docs.schema[key].dataType.simpleString()
        cut_texts = work.write(chosen.select("key", "hash", "label", "text").mapInArrow(in_arrow(cut), f"key {kind}, hash long, label int, units array<binary>"), "units")
        each = cut_texts.select("label", F.explode("units").alias("unit")).groupBy("unit")
        counts = each.agg(F.sum("label").alias("toxic"), F.sum(1 - F.col("label")).alias("clean")).withColumn("name", F.xxhash64("unit")).toArrow().sort_by("name")
        names = F.transform("units", lambda u: F.xxhash64(u)).alias("names")
        table = cut_texts.select("key", "hash", "label", names).toArrow().sort_by([("key", "ascending"), ("hash", "ascending"), ("label", "ascending")])
    order = counts.column("name").to_numpy()
    held = table.column("names").combine_chunks()
    flat = np.searchsorted(order, held.values.to_numpy()) if len(held) else np.zeros(0, np.int64)
    bags = np.split(flat, held.offsets.to_numpy()[1:-1]) if len(held) else []
    own = table.column("label").to_numpy()
    model = fit_bags(counts.column("unit").to_pylist(), bags, counts.column("toxic").to_numpy(), counts.column("clean").to_numpy(), own)
    sizes = class_sizes(known)
    if min(sizes.get(0, 0), sizes.get(1, 0)) > 0 and len(own):
        model.shift += float(np.log(sizes[1] / max(1, (own == 1).sum())) - np.log(sizes[0] / max(1, (own == 0).sum())))
    return model


def score_documents(docs: DataFrame, model: ToxicityModel, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (``key``, ``score``), one per row of ``docs``; an empty or null text has the score of no toxic unit."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = shared.value.probability(shared.value.column_margins(batch.column(1)))
            yield pa.record_batch([batch.column(0), pa.array(scores, pa.float64())], names=["key", "score"])

    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(in_arrow(run), f"key {kind}, score double")
    return rows.select(F.col("key").alias(key), "score")
