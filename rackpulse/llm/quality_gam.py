"""Document quality by a generalised additive model with pairwise interactions.

Each text becomes a row of surface features. Training visits the features in turn, and grows a tree of a few leaves on
each one's histogram of gradients; the steps add up to a lookup table per feature. Then the pairs of features with the most
left to explain get tables of their own. A score is the sum of one cell per table, through a logistic curve.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rackpulse.llm.labelled import class_sizes, known_labels, labelled_texts
from rackpulse.llm.scope import in_arrow

#: Most labelled rows of each class that a fit uses, chosen by a hash of their id.
FIT_ROWS_PER_CLASS = 15_000
BINS, PAIR_BINS, LEAVES, PAIRS = 48, 12, 4, 8
RATE, MAIN_ROUNDS, PAIR_ROUNDS, PATIENCE = 0.15, 150, 60, 15
RIDGE = 1.0

FEATURES = (
    "log_bytes", "log_words", "word_bytes", "upper", "digit", "blank", "newline", "other_byte", "period", "comma", "bang",
    "question", "pipe", "currency_mark", "bracket", "rare_mark", "distinct_words", "top_word", "short_words", "long_words",
    "line_words", "distinct_lines", "end_marked_lines", "shouted_words", "capital_words", "marked_words",
)
_GROUPS = {
    "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "digit": b"0123456789", "blank": b" \t", "newline": b"\n\r", "period": b".",
    "comma": b",;:", "bang": b"!", "question": b"?", "pipe": b"|", "currency_mark": b"$%&*#@", "bracket": b"()[]{}<>",
    "rare_mark": b"^~`=+_/\\\"'-",
}
_GROUP_SUMS = np.zeros((256, len(_GROUPS) + 1))
for _i, _members in enumerate(_GROUPS.values()):
    _GROUP_SUMS[list(_members), _i] = 1
_GROUP_SUMS[128:, -1] = 1
_MARKED = re.compile(r"[^\w\s.,;:!?'\"()-]{2,}|[!?]{2,}", re.ASCII)


def features_of(text: str | None) -> list[float]:
    """The features of a whole text, in the order of FEATURES; an empty or null text has zeros."""
    raw = (text or "").encode()
    words = (text or "").split()
    if not words:
        return [float(np.log1p(len(raw))), *[0.0] * (len(FEATURES) - 1)]
    n = len(words)
    shares = np.bincount(np.frombuffer(raw, np.uint8), minlength=256) @ _GROUP_SUMS / len(raw)
    named = dict(zip([*_GROUPS, "other_byte"], shares.tolist(), strict=True))
    counts = Counter(words)
    sizes = np.fromiter(map(len, words), np.int64, n)
    lines = [line for line in text.split("\n") if line.strip()]
    named |= {
        "log_bytes": float(np.log1p(len(raw))),
        "log_words": float(np.log(n)),
        "word_bytes": float(sizes.mean()),
        "distinct_words": len(counts) / n,
        "top_word": max(counts.values()) / n,
        "short_words": float((sizes <= 3).mean()),
        "long_words": float((sizes >= 14).mean()),
        "line_words": float(np.log(n / len(lines))),
        "distinct_lines": len(set(lines)) / len(lines),
        "end_marked_lines": sum(line.rstrip().endswith((".", "!", "?")) for line in lines) / len(lines),
        "shouted_words": sum(map(str.isupper, words)) / n,
        "capital_words": sum(w[0].isupper() for w in words) / n,
        "marked_words": len(_MARKED.findall(text)) / n,
    }
    return [named[name] for name in FEATURES]


@dataclass
class GamModel:
    """Lookup tables over binned features; ``tables`` by feature, ``pairs`` by two features on coarser bins."""

    intercept: float = 0.0
    edges: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    coarse: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int, np.ndarray]] = field(default_factory=list)

    def bins(self, rows: np.ndarray) -> list[np.ndarray]:
        return [np.searchsorted(edges, rows[:, i], side="right") for i, edges in enumerate(self.edges)]

    def margin(self, rows: np.ndarray) -> np.ndarray:
        total = np.full(len(rows), self.intercept)
        bins = self.bins(rows) if len(rows) else []
        for table, at in zip(self.tables, bins, strict=False):
            total += table[at]
        for i, j, table in self.pairs if len(rows) else ():
            total += table[self.coarse[i][bins[i]], self.coarse[j][bins[j]]]
        return total

    def probability(self, rows: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(rows), -40, 40)))


def _leaf(gradient: np.ndarray, weight: np.ndarray) -> np.ndarray:
    return gradient / (weight + RIDGE)


def _tree(gradient: np.ndarray, weight: np.ndarray, leaves: int) -> np.ndarray:
    """Step values per bin of a tree with a few leaves, each split the one that gains most."""
    g, h = np.concatenate(([0], np.cumsum(gradient))), np.concatenate(([0], np.cumsum(weight)))

    def gain(a: int, b: int) -> tuple[float, int]:
        if b - a < 2:
            return 0.0, a
        cut = np.arange(a + 1, b)
        left, right = (g[cut] - g[a]) ** 2 / (h[cut] - h[a] + RIDGE), (g[b] - g[cut]) ** 2 / (h[b] - h[cut] + RIDGE)
        best = int(np.argmax(left + right))
        return float((left + right)[best] - (g[b] - g[a]) ** 2 / (h[b] - h[a] + RIDGE)), int(cut[best])

    spans = [(0, len(gradient))]
    while len(spans) < leaves:
        options = [(*gain(a, b), a, b) for a, b in spans]
        best, cut, a, b = max(options)
        if best <= 1e-9:
            break
        spans.remove((a, b))
        spans += [(a, cut), (cut, b)]
    out = np.empty(len(gradient))
    for a, b in spans:
        out[a:b] = _leaf(g[b] - g[a], h[b] - h[a])
    return out


def _quadrants(gradient: np.ndarray, weight: np.ndarray) -> tuple[float, np.ndarray]:
    """Gain and step values of the best tree that cuts both axes of a grid once."""
    g = np.pad(gradient.cumsum(0).cumsum(1), ((1, 0), (1, 0)))
    h = np.pad(weight.cumsum(0).cumsum(1), ((1, 0), (1, 0)))
    cells = []
    for m in (g, h):
        upper = m[1:-1, 1:-1]
        cells.append((upper, m[1:-1, -1:] - upper, m[-1:, 1:-1] - upper, m[-1, -1] - m[1:-1, -1:] - m[-1:, 1:-1] + upper))
    gains = sum(a**2 / (b + RIDGE) for a, b in zip(*cells, strict=True)) - g[-1, -1] ** 2 / (h[-1, -1] + RIDGE)
    at = np.unravel_index(int(np.argmax(gains)), gains.shape)
    out, (x, y) = np.empty_like(gradient), (at[0] + 1, at[1] + 1)
    values = [_leaf(a[at], b[at]) for a, b in zip(*cells, strict=True)]
    out[:x, :y], out[:x, y:], out[x:, :y], out[x:, y:] = values
    return float(gains[at]), out


def fit(rows: np.ndarray, labels: np.ndarray, seed: int = 7) -> GamModel:
    """Cyclic boosting of feature tables, then of pair tables, each until a held-back fifth stops improving.

    Without rows the score is one half everywhere; with one class it is that class's smoothed share.
    """
    n = len(labels)
    share = (labels.sum() + 1) / (n + 2)
    model = GamModel(float(np.log(share / (1 - share))))
    if n == 0 or labels.min() == labels.max():
        return model
    for i in range(rows.shape[1]):
        edges = np.unique(np.quantile(rows[:, i], np.linspace(0, 1, BINS + 1)[1:-1]))
        model.edges.append(edges)
        model.tables.append(np.zeros(len(edges) + 1))
        model.coarse.append((np.arange(len(edges) + 1) * PAIR_BINS // (len(edges) + 1)).astype(np.int64))
    bins = model.bins(rows)
    held = np.random.default_rng(seed).random(n) < 0.2
    train, margin = ~held, np.full(n, model.intercept)

    def loss() -> float:
        m = margin[held] if held.any() else margin
        y = labels[held] if held.any() else labels
        return float(np.logaddexp(0, np.where(y == 1, -m, m)).mean())

    def gradients() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-margin[train]))
        return labels[train] - p, p * (1 - p)

    def cycle(steps, rounds: int, snapshot, restore) -> None:
        best, kept, waited = loss(), snapshot(), 0
        for _ in range(rounds):
            for step in steps:
                step()
            now = loss()
            if now < best - 1e-5:
                best, kept, waited = now, snapshot(), 0
            else:
                waited += 1
                if waited >= PATIENCE:
                    break
        restore(kept)

    def main_step(i: int):
        def step() -> None:
            g, h = gradients()
            size = len(model.tables[i])
            if size < 2:
                return
            change = RATE * _tree(np.bincount(bins[i][train], g, size), np.bincount(bins[i][train], h, size), LEAVES)
            model.tables[i] += change
            margin[:] += change[bins[i]]

        return step

    def restore_main(kept) -> None:
        model.tables = kept[0]
        margin[:] = kept[1]

    cycle([main_step(i) for i in range(rows.shape[1])], MAIN_ROUNDS, lambda: ([t.copy() for t in model.tables], margin.copy()), restore_main)

    coarse = [c[b] for c, b in zip(model.coarse, bins, strict=True)]
    grid = PAIR_BINS * PAIR_BINS

    def on_grid(i: int, j: int, values: np.ndarray) -> np.ndarray:
        return np.bincount(coarse[i][train] * PAIR_BINS + coarse[j][train], values, grid).reshape(PAIR_BINS, PAIR_BINS)

    g, h = gradients()
    ranked = sorted(
        ((_quadrants(on_grid(i, j, g), on_grid(i, j, h))[0], i, j) for i in range(rows.shape[1]) for j in range(i)), reverse=True
    )
    model.pairs = [(i, j, np.zeros((PAIR_BINS, PAIR_BINS))) for _, i, j in ranked[:PAIRS]]

    def pair_step(number: int):
        def step() -> None:
            i, j, values = model.pairs[number]
            g, h = gradients()
            change = RATE * _quadrants(on_grid(i, j, g), on_grid(i, j, h))[1]
            values += change
            margin[:] += change[coarse[i], coarse[j]]

        return step

    def restore_pairs(kept) -> None:
        model.pairs = kept[0]
        margin[:] = kept[1]

    cycle(
        [pair_step(k) for k in range(len(model.pairs))], PAIR_ROUNDS,
        lambda: ([(i, j, t.copy()) for i, j, t in model.pairs], margin.copy()), restore_pairs,
    )
    return model


def fit_on(docs: DataFrame, labels: DataFrame, label: str, usable: Column, key: str = "doc_id", text: str = "text") -> GamModel:
    """Fit on the labelled rows for which ``usable`` holds, at most FIT_ROWS_PER_CLASS of each class.

    Rows with a null key or label are left out, and equal texts of one key are one row. The rows with the smallest hashes are taken, so a fit is repeatable. The
    classes' shares among all usable labels set the intercept.
    """
    known = known_labels(labels, label, usable, key)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [features_of(t) for t in batch.column(2).to_pylist()]
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(rows, pa.list_(pa.float64()))], names=["key", "label", "features"])

    own = labelled_texts(docs, known, FIT_ROWS_PER_CLASS, key, text).select("key", "label", "text")
    kind = docs.schema[key].dataType.simpleString()
    table = own.mapInArrow(in_arrow(run), f"key {kind}, label int, features array<double>").toPandas()
    table = table.assign(order=[tuple(f) for f in table["features"]]).sort_values(["key", "order", "label"], kind="stable")
    rows = np.array(table["features"].tolist()).reshape(len(table), len(FEATURES))
    model = fit(rows, table["label"].to_numpy().astype(float))
    sizes = class_sizes(known)
    if min(sizes.get(0, 0), sizes.get(1, 0)) > 0 and len(table):
        used = table["label"].value_counts()
        model.intercept += float(np.log(sizes[1] / used.get(1, 1)) - np.log(sizes[0] / used.get(0, 1)))
    return model


def score_documents(docs: DataFrame, model: GamModel, text: str = "text", with_text: bool = True) -> DataFrame:
    """All columns of ``docs``, with or without the text, and ``score``; a column of that name is replaced.

    An empty or null text has the features of an empty text. Nothing is exchanged.
    """
    columns = [c for c in docs.columns if c != "score"]
    at = columns.index(text)
    kept = [i for i in range(len(columns)) if with_text or i != at]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = np.array([features_of(t) for t in batch.column(at).to_pylist()]).reshape(-1, len(FEATURES))
            yield pa.record_batch(
                [*[batch.column(i) for i in kept], pa.array(model.probability(rows))], names=[*[columns[i] for i in kept], "score"]
            )

    out = docs.select(*[F.col(f"`{c}`") for c in columns])
    schema = ", ".join(f"`{out.schema[i].name}` {out.schema[i].dataType.simpleString()}" for i in kept)
    return out.mapInArrow(in_arrow(run), f"{schema}, score double")
