"""Token counts of a unigram tokenizer without its tokens.

An Aho-Corasick automaton lists every vocabulary piece that ends at each character. The Viterbi pass keeps three numbers
per character instead of a path: the best score, the number of pieces on that best path, and whether its last piece is
unknown. White space splits a text into words that start with the space mark, so equal words have equal counts and each
distinct word is scored once per worker.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rackpulse.llm.scope import in_arrow
from rackpulse.llm.wordpiece_ids import slices

SPACE_MARK = "▁"
#: An unknown character scores this much less than the worst piece (fixed value of the unigram tokenizers).
UNKNOWN_PENALTY = 10.0
CACHED_WORDS = 500_000
PARTS = re.compile("▁[^▁]*")


def zipf_vocabulary(path: str | None = None) -> list[tuple[str, float]]:
    """(piece, log-probability) of a public vocabulary file.

    The public files hold no unigram model. The pieces of the 32,000-piece file come in order of frequency, and Zipf's
    law turns the rank into a log-probability.
    """
    import public_tokenizers
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path or public_tokenizers.path("piece_bpe_32k.model"))
    size = model.get_piece_size()
    pieces = [model.id_to_piece(i) for i in range(size) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
    total = math.log(sum(1 / (r + 1) for r in range(len(pieces))))
    return [(p, -math.log(r + 1) - total) for r, p in enumerate(pieces)]


class PieceCounter:
    """Number of pieces on the best path of a text."""

    def __init__(self, vocabulary: Sequence[tuple[str, float]]):
        import ahocorasick

        self.pieces = ahocorasick.Automaton()
        for piece, score in vocabulary:
            if piece:
                self.pieces.add_word(piece, (len(piece), score))
        if len(self.pieces):
            self.pieces.make_automaton()
        self.unknown = min((s for _, s in vocabulary), default=0.0) - UNKNOWN_PENALTY
        self.known: dict[str, int] = {}

    def count_part(self, part: str) -> int:
        """Viterbi over one pre-token.

        The rules of the unigram tokenizers: a later start replaces an earlier one only with a strictly better score, so
        the longest piece wins a tie; a character that is no piece by itself may also be unknown; neighbouring unknown
        characters are one piece.
        """
        size = len(part)
        best, count, lost, start_of = [0.0] * (size + 1), [0] * (size + 1), [False] * (size + 1), [-1] * (size + 1)
        ends: list[list[tuple[int, float]]] = [[] for _ in range(size + 1)]
        for last, match in self.pieces.iter(part) if len(self.pieces) else ():
            ends[last + 1].append(match)
        for end in range(1, size + 1):
            single, found = False, False
            for length, score in sorted(ends[end], reverse=True):  # the longest, that is, the earliest start first
                start = end - length
                single |= length == 1
                if start and start_of[start] < 0:
                    continue
                total = score + best[start]
                if not found or total > best[end]:
                    found, best[end], start_of[end] = True, total, start
                    count[end], lost[end] = count[start] + 1, False
            if not single:
                total = self.unknown + best[end - 1]
                if not found or total > best[end]:
                    best[end], start_of[end] = total, end - 1
                    count[end], lost[end] = count[end - 1] + (not lost[end - 1]), True
        return count[size]

    def count_word(self, word: str) -> int:
        if not word:
            return 0
        return sum(self.count_part(p) for p in PARTS.findall(SPACE_MARK + word))

    def count_words(self, words: list[str]) -> np.ndarray:
        if len(self.known) + len(words) > CACHED_WORDS:
            self.known = {}
        known, out = self.known, np.empty(len(words), np.int64)
        for i, word in enumerate(words):
            n = known.get(word)
            if n is None:
                n = known[word] = self.count_word(word)
            out[i] = n
        return out

    def count_column(self, texts: pa.Array) -> Iterator[np.ndarray]:
        for part in slices(pc.fill_null(texts, "").cast(pa.large_string())):
            words = pc.utf8_split_whitespace(part)
            coded = words.flatten().dictionary_encode()
            sizes = self.count_words(coded.dictionary.to_pylist())[coded.indices.to_numpy()]
            offsets = words.offsets.to_numpy()
            totals = np.concatenate(([0], np.cumsum(sizes)))
            yield np.diff(totals[offsets - offsets[0]])


_COUNTERS: dict[str, PieceCounter] = {}


def _counter(path: str) -> PieceCounter:
    if path not in _COUNTERS:
        _COUNTERS[path] = PieceCounter(zipf_vocabulary(path))
    return _COUNTERS[path]


def count_tokens(docs: DataFrame, path: str | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (``key``, ``n_tokens``), one per row of ``docs``, repeated rows included.

    A null or blank text has 0 tokens. Columns other than ``key`` and ``text`` are not read. Rows need no exchange; a
    text is one row of one task, however long it is.
    """
    import public_tokenizers

    path = path or public_tokenizers.path("piece_bpe_32k.model")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(path)
        for batch in batches:
            parts = list(counter.count_column(batch.column(1)))
            sizes = np.concatenate(parts) if parts else np.zeros(0, np.int64)
            yield pa.record_batch([batch.column(0), pa.array(sizes)], names=["key", "n_tokens"])

    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(in_arrow(count), f"key {kind}, n_tokens long")
    return rows.select(F.col("key").alias(key), "n_tokens")
