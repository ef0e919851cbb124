"""Token ids of whole text columns, with each distinct word encoded once.

The ids of a text are the ids of its pieces in a row, as long as no cut falls where the tokenizer's normaliser or
pre-tokenizer could look across. NumPy cuts a slice of a column at such safe places (see ``CUT``), Arrow's dictionary
encoding finds the distinct pieces, the tokenizers library encodes those it has not met, and NumPy gathers the ids.
Tests compare the result with the library on whole texts.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 8 << 20
CACHED_WORDS = 400_000

#: Classes of bytes: white space that always cuts, letters (ASCII and the two-byte letters from À to ÿ), digits, the
#: apostrophe (it starts another rule of the pre-tokenizer), other ASCII marks, and all the rest.
SPACE, LETTER, DIGIT, QUOTE, MARK, OTHER = range(6)
#: Pairs of neighbouring classes between which a cut is safe.
CUT = {
    (LETTER, MARK), (MARK, LETTER), (LETTER, DIGIT), (DIGIT, LETTER), (DIGIT, DIGIT), (DIGIT, MARK), (MARK, DIGIT),
    (LETTER, QUOTE), (DIGIT, QUOTE),
}
WHITE = re.compile("[ \t\n\r]+")


def default_path() -> str:
    """Vocabulary file of the word-level BPE tokenizer that the queries use."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _byte_classes() -> np.ndarray:
    kinds = np.full(256, OTHER, np.uint8)
    kinds[33:127] = MARK
    kinds[[9, 10, 13, 32]] = SPACE
    kinds[ord("0") : ord("9") + 1] = DIGIT
    kinds[ord("a") : ord("z") + 1] = LETTER
    kinds[ord("A") : ord("Z") + 1] = LETTER
    kinds[ord("'")] = QUOTE
    return kinds


def _cut_table() -> np.ndarray:
    table = np.zeros(64, bool)
    for left, right in CUT:
        table[left * 8 + right] = True
    table[SPACE * 8 : SPACE * 8 + 8] = True
    table[SPACE::8] = True
    return table


KINDS, CUTS = _byte_classes(), _cut_table()
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def byte_letters() -> list[str]:
    """The printable letter that a byte-level vocabulary uses for each byte value."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(spare)) for b in range(256)]


def cut_pieces(raw: bytes, bounds: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """Lower-cased pieces of UTF-8 texts that lie end to end in ``raw``, and the number of pieces before each bound."""
    data = np.frombuffer(raw.translate(LOWER), np.uint8)
    kinds = KINDS[data]
    second = np.flatnonzero(data[:-1] == 0xC3) + 1
    second = second[(data[second] != 0x97) & (data[second] != 0xB7)]
    kinds[second], kinds[second - 1] = LETTER, LETTER
    capital = second[data[second] < 0x9F]
    if len(capital):
        data = data.copy()
        data[capital] += 0x20
    starts = np.empty(len(data), bool)
    starts[1:] = CUTS[kinds[:-1] * np.uint8(8) + kinds[1:]]
    starts[bounds[bounds < len(data)]] = True
    solid = kinds != SPACE
    begin = np.flatnonzero(starts & solid)
    before = np.cumsum(solid, dtype=np.int32)
    offsets = np.empty(len(begin) + 1, np.int32)
    offsets[:-1] = before[begin] - 1
    offsets[-1] = before[-1] if len(before) else 0
    pieces = pa.Array.from_buffers(
        pa.binary(), len(begin), [None, pa.py_buffer(offsets), pa.py_buffer(data[solid])]
    )
    return pieces, np.searchsorted(begin, bounds)


class WordEncoder:
    """Encodes text columns with a word-level byte BPE file of the tokenizers library."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, pre_tokenizers

        self.whole = Tokenizer.from_file(path)
        # The same merges over words that are already normalised: no regex and no offsets to follow.
        self.bare = Tokenizer(self.whole.model)
        self.bare.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        self.ends_word = np.zeros(self.whole.get_vocab_size(), bool)
        for piece, number in self.whole.get_vocab(with_added_tokens=False).items():
            self.ends_word[number] = piece.endswith("</w>")
        self.letters = str.maketrans({chr(b): c for b, c in enumerate(byte_letters())})
        self.known: dict[bytes, bytes] = {}

    def _encode(self, text: str) -> bytes:
        return np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _learn(self, pieces: list[bytes]) -> None:
        """Encode new pieces: words of letters only in one call, as every word ends with an id that says so."""
        words = []
        for piece in pieces:
            text = piece.decode()
            # A piece that starts with a letter has letters only, unless a byte of the last class follows.
            if text.isalpha() and max(text) <= "ÿ" and not ({"ª", "µ", "º"} & set(text)):
                words.append(piece)
            else:
                self.known[piece] = self._encode(text)
        mapped = " ".join(w.decode("ascii") if w.isascii() else w.decode("latin-1").translate(self.letters) for w in words)
        ids = np.array(self.bare.encode(mapped, add_special_tokens=False).ids, "<u4")
        ends = np.flatnonzero(self.ends_word[ids]) + 1
        if len(ends) != len(words):
            self.known.update((w, self._encode(w.decode())) for w in words)
            return
        raw, start = ids.tobytes(), 0
        for word, end in zip(words, (ends * 4).tolist(), strict=True):
            self.known[word] = raw[start:end]
            start = end

    def _pool(self, pieces: list[bytes]) -> list[bytes]:
        found = [self.known.get(p) for p in pieces]
        missing = [p for p, ids in zip(pieces, found, strict=True) if ids is None]
        if missing:
            if len(self.known) + len(missing) > CACHED_WORDS:
                self.known = {}
            self._learn(missing)
            found = [self.known[p] if ids is None else ids for p, ids in zip(pieces, found, strict=True)]
        return found

    def _slice(self, raw: bytes, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids per text and all ids of the texts between ``bounds`` of ``raw``."""
        if not raw:
            return np.zeros(len(bounds) - 1, np.int64), np.zeros(0, "<u4")
        pieces, cuts = cut_pieces(raw, bounds)
        coded = pieces.dictionary_encode()
        ids = self._pool(coded.dictionary.to_pylist())
        lengths = np.fromiter(map(len, ids), np.int32, len(ids)) // 4
        starts = np.cumsum(lengths) - lengths
        pool = np.frombuffer(b"".join(ids), "<u4")
        index = coded.indices.to_numpy()
        sizes = lengths[index]
        ends = np.cumsum(sizes, dtype=np.int32)
        total = int(ends[-1]) if len(ends) else 0
        at = np.repeat((starts[index] - (ends - sizes)).astype(np.int32), sizes)
        at += np.arange(total, dtype=np.int32)
        return np.diff(np.concatenate(([0], ends))[cuts]), pool[at]

    def _special(self, text: str) -> np.ndarray:
        return np.frombuffer(b"".join(self._encode(w) for w in WHITE.split(text) if w), "<u4")

    def encode_column(self, texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Yield (ids per text, flat ids) for consecutive slices of a string column; a null text has no ids."""
        for part in slices(pc.fill_null(texts, "").cast(pa.large_binary())):
            raw, bounds = flat_bytes(part)
            # Special tokens are looked for in the text as it stands, whatever surrounds them.
            special = {}
            if b"<|" in raw:
                special = {i: self._special(t.decode()) for i, t in enumerate(part.to_pylist()) if b"<|" in t}
                part = pc.if_else(pa.array([i in special for i in range(len(part))]), b"", part)
                raw, bounds = flat_bytes(part)
            sizes, flat = self._slice(raw, bounds)
            if special:
                rows = np.split(flat, np.cumsum(sizes)[:-1])
                for i, ids in special.items():
                    rows[i] = ids
                sizes, flat = np.array([len(r) for r in rows], np.int64), np.concatenate(rows)
            yield sizes.astype(np.int64), flat


def flat_bytes(texts: pa.Array) -> tuple[bytes, np.ndarray]:
    """The bytes of a large binary column without nulls, and where each text starts and ends in them."""
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    values = texts.buffers()[2]
    raw = values[int(offsets[0]) : int(offsets[-1])].to_pybytes() if values is not None and len(texts) else b""
    return raw, offsets - offsets[0]


def slices(texts: pa.Array, size: int = SLICE_BYTES) -> Iterator[pa.Array]:
    """Consecutive pieces of about ``size`` bytes; a longer text is a piece of its own."""
    sizes = pc.binary_length(texts).to_numpy(zero_copy_only=False)
    group = np.cumsum(sizes) // size
    edges = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(texts)]
    for start, end in zip(edges, edges[1:], strict=False):
        if end > start:
            yield texts.slice(start, end - start)


_ENCODERS: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """One encoder per Python worker and file, kept between tasks."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]
