"""Format-preserving pseudonyms for personal data: keyed permutations inside each value's own format.

Found values are validated first (check digits, calendar, octet ranges). The variable characters of a value become one
number, a keyed Feistel network permutes the numbers below the size of the format, and the result is written back in the
same shape. Equal values get equal pseudonyms in every document under one key, different values different ones, and the
key reverses them. A card or IBAN may be followed by a blank and more digits or capitals: a card ends at the first group
boundary where it is valid, an IBAN where its country's length ends. Only the value's own characters decide, so the
pseudonym ends at the same place.

=============  ================================================  ==============================================
kind           found by                                          kept as it is
=============  ================================================  ==============================================
card           13 to 19 digits that pass the Luhn check          separators; the new check digit is right again
iban           country, length and remainder 97                  country, separators; new check digits are right
phone          plus sign or bracketed area code, 8 to 15 digits  country code, separators
social         3-2-4 digits outside the unassigned ranges        separators; the area is an assigned one
ip             four octets up to 255                             dots; octets stay valid
date           day, month and year in the calendar, 1900 to 2099 order, separators, zero padding
email          address with a dotted host                        length and character classes of the part before the @, the host
key            access keys, hexadecimal secrets, assigned ones,  prefix, length and character classes
               bearer tokens (with a digit or 20 characters, or
               after "Authorization:"); of any length
=============  ================================================  ==============================================
"""

from __future__ import annotations

import datetime
import hashlib
import hmac
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rackpulse.llm.scope import in_arrow

ROUNDS = 10
#: Characters that are permuted as one number: the halves of 64 letters or digits fit into one hash of the network.
BLOCK = 64
DIGITS = "0123456789"
LOWER, UPPER = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

#: IBAN length by country (fixed values of the published registry).
IBAN_LENGTH = {
    "AD": 24, "AE": 23, "AL": 28, "AT": 20, "AZ": 28, "BA": 20, "BE": 16, "BG": 22, "BH": 22, "BI": 27, "BR": 29,
    "BY": 28, "CH": 21, "CR": 22, "CY": 28, "CZ": 24, "DE": 22, "DJ": 27, "DK": 18, "DO": 28, "EE": 20, "EG": 29,
    "ES": 24, "FI": 18, "FK": 18, "FO": 18, "FR": 27, "GB": 22, "GE": 22, "GI": 23, "GL": 18, "GR": 27, "GT": 28,
    "HN": 28, "HR": 21, "HU": 28, "IE": 22, "IL": 23, "IQ": 23, "IS": 26, "IT": 27, "JO": 30, "KW": 30, "KZ": 20,
    "LB": 28, "LC": 32, "LI": 21, "LT": 20, "LU": 20, "LV": 21, "LY": 25, "MC": 27, "MD": 24, "ME": 22, "MK": 19,
    "MN": 20, "MR": 27, "MT": 31, "MU": 30, "NI": 28, "NL": 18, "NO": 15, "OM": 23, "PK": 24, "PL": 28, "PS": 29,
    "PT": 25, "QA": 29, "RO": 24, "RS": 22, "RU": 33, "SA": 24, "SC": 31, "SD": 18, "SE": 24, "SI": 19, "SK": 24,
    "SM": 27, "SO": 23, "ST": 25, "SV": 28, "TL": 23, "TN": 24, "TR": 26, "UA": 29, "VA": 22, "VG": 24, "XK": 20,
    "YE": 30,
}

PATTERNS = {
    "email": r"(?<![\w.+-])[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}@(?:[A-Za-z0-9-]{1,63}\.){1,8}[A-Za-z]{2,24}(?![\w-])",
    "key": r"(?<![A-Za-z0-9])(?:AKIA|ASIA)[A-Z0-9]{16}(?![A-Za-z0-9])"
    r"|(?<![A-Za-z0-9])(?:sk|pk|ghp|gho|xox[abp])[_-][A-Za-z0-9_-]{16,}"
    r"|(?i:(?<=password[=:])|(?<=passwd[=:])|(?<=secret[=:])|(?<=token[=:])|(?<=api_key[=:])|(?<=apikey[=:]))[^\s\"',;]{6,}"
    r"|(?i:(?<=authorization: bearer )|(?<=authorization:bearer ))[\w.~+/-]+=*"
    r"|(?i:(?<=bearer ))(?:(?=[A-Za-z_.~+/-]*[0-9])[\w.~+/-]{6,}|[\w.~+/-]{20,})=*"
    r"|(?<![A-Za-z0-9])(?=[a-f]*[0-9][0-9a-f]*)[0-9a-f]{32,}(?![A-Za-z0-9])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}(?![A-Za-z0-9])",
    "ip": r"(?<![\w.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![\w]|\.[0-9])",
    "date": r"(?<![\w./-])(?:[0-9]{4}[-/.][0-9]{1,2}[-/.][0-9]{1,2}|[0-9]{1,2}[-/.][0-9]{1,2}[-/.][0-9]{4})(?!(?!T[0-9])[\w/-]|\.[0-9])",
    "social": r"(?<![\w-])[0-9]{3}[- ][0-9]{2}[- ][0-9]{4}(?![\w-])",
    "phone": r"(?<![\w+])(?:\+[0-9]{1,3}[ .-]?(?:\([0-9]{1,5}\)[ .-]?)?[0-9]{1,5}(?:[ .-]?[0-9]{1,5}){1,5}"
    r"|\([0-9]{2,5}\)[ .-]?[0-9]{2,5}(?:[ .-][0-9]{2,5}){1,3}"
    r"|[0-9]{3}[.-][0-9]{3}[.-][0-9]{4})(?![\w-])",
    "card": r"(?<![\w.-])[0-9](?:[ -]?[0-9]){12,18}(?![\w]|[.-][0-9])",
}
ANY = re.compile("|".join(f"(?P<{kind}>{pattern})" for kind, pattern in PATTERNS.items()), re.ASCII)


def luhn_digit(body: str) -> str:
    """The check digit behind ``body``."""
    total = 0
    for i, c in enumerate(reversed(body)):
        n = int(c) * (2 if i % 2 == 0 else 1)
        total += n - 9 if n > 9 else n
    return str(-total % 10)


def iban_remainder(value: str) -> int:
    return int("".join(str(int(c, 36)) for c in value[4:] + value[:4])) % 97


class Permuter:
    """Keyed permutations of the numbers below any size."""

    def __init__(self, key: bytes):
        self.key = key

    def _round(self, tweak: bytes, number: int, value: int) -> int:
        raw = value.to_bytes((value.bit_length() + 7) // 8 or 1, "big")
        return int.from_bytes(hmac.new(self.key, tweak + bytes([number]) + raw, hashlib.sha256).digest(), "big")

    def _network(self, value: int, half: int, tweak: bytes, inverse: bool) -> int:
        """Balanced Feistel network over two halves of ``half`` bits."""
        mask = (1 << half) - 1
        left, right = value >> half, value & mask
        for number in reversed(range(ROUNDS)) if inverse else range(ROUNDS):
            if inverse:
                left, right = right ^ (self._round(tweak, number, left) & mask), left
            else:
                left, right = right, left ^ (self._round(tweak, number, right) & mask)
        return left << half | right

    def permute(self, value: int, size: int, tweak: str, inverse: bool = False) -> int:
        """A bijection of range(size): the network works on the next even power of two and is walked until it falls inside."""
        if size <= 1:
            return value
        half = ((size - 1).bit_length() + 1) // 2
        raw = f"{tweak}/{size}".encode()
        while True:
            value = self._network(value, half, raw, inverse)
            if value < size:
                return value


def _permute_digits(text: str, permuter: Permuter, tweak: str, inverse: bool) -> str:
    return str(permuter.permute(int(text), 10 ** len(text), tweak, inverse)).zfill(len(text)) if text else text


def _spread(template: str, digits: str) -> str:
    """``template`` with its digits replaced one by one."""
    source = iter(digits)
    return "".join(next(source) if c in DIGITS else c for c in template)


def _group_starts(value: str) -> list[str]:
    """The starts of ``value`` that end before a blank, shortest first, and all of it."""
    return [value[: m.start()] for m in re.finditer(" |$", value)]


def _card_starts(value: str) -> list[str]:
    """The starts that may be a card; behind a short first group, as of a table row's number, only all of ``value`` is."""
    return _group_starts(value) if re.match("[0-9]{4}", value) else [value]


def _is_card(value: str) -> bool:
    digits = [c for c in value if c in DIGITS]
    return 13 <= len(digits) <= 19 and len(set(digits)) > 1 and luhn_digit("".join(digits[:-1])) == digits[-1]


def _iban_start(value: str) -> str:
    """The start of ``value`` that has the length of its country, if a group ends there; else all of it."""
    length = IBAN_LENGTH.get(value[:2], 0)
    return next((start for start in _group_starts(value) if len(start) - start.count(" ") == length), value)


def _card(value: str, permuter: Permuter, inverse: bool) -> str | None:
    digits = "".join(c for c in value if c in DIGITS)
    if not _is_card(value) or any(map(_is_card, _card_starts(value)[:-1])):
        return None
    while True:  # walk on until no shorter start is a card by chance
        body = _permute_digits(digits[:-1], permuter, "card", inverse)
        digits = body + luhn_digit(body)
        new = _spread(value, digits)
        if _is_card(new) and not any(map(_is_card, _card_starts(new)[:-1])):
            return new


def _permute_classes(text: str, permuter: Permuter, tweak: str, inverse: bool, hexadecimal: bool = False) -> str:
    """Permute letters and digits inside their classes, in blocks of BLOCK characters; other characters stay."""
    if len(text) > BLOCK:
        blocks = [text[i : i + BLOCK] for i in range(0, len(text), BLOCK)]
        return "".join(_permute_classes(b, permuter, f"{tweak}#{i}", inverse, hexadecimal) for i, b in enumerate(blocks))
    classes = (DIGITS, "abcdef", "ABCDEF") if hexadecimal else (DIGITS, LOWER, UPPER)
    found = [(c, next((k for k in classes if c in k), "")) for c in text]
    number, size = 0, 1
    for c, kind in found:
        if kind:
            number, size = number * len(kind) + kind.index(c), size * len(kind)
    shape = "".join("dlu"[classes.index(kind)] if kind else c for c, kind in found)
    number = permuter.permute(number, size, f"{tweak}:{shape}", inverse)
    out = []
    for c, kind in reversed(found):
        if kind:
            number, digit = divmod(number, len(kind))
            c = kind[digit]
        out.append(c)
    return "".join(reversed(out))


def _iban(value: str, permuter: Permuter, inverse: bool) -> str | None:
    solid = value.replace(" ", "")
    if IBAN_LENGTH.get(solid[:2]) != len(solid) or iban_remainder(solid) != 1:
        return None
    body = _permute_classes(solid[4:], permuter, f"iban{solid[:2]}", inverse)
    check = f"{98 - iban_remainder(solid[:2] + '00' + body):02d}"
    source = iter(solid[:2] + check + body)
    return "".join(c if c == " " else next(source) for c in value)


def _ip(value: str, permuter: Permuter, inverse: bool) -> str | None:
    octets = value.split(".")
    if any(int(o) > 255 or (len(o) > 1 and o[0] == "0") for o in octets):
        return None
    number = int.from_bytes(bytes(map(int, octets)), "big")
    return ".".join(map(str, permuter.permute(number, 1 << 32, "ip", inverse).to_bytes(4, "big")))


FIRST_DAY, LAST_DAY = datetime.date(1900, 1, 1).toordinal(), datetime.date(2099, 12, 31).toordinal()


def _parse_date(value: str) -> tuple[tuple[int, int, int], int] | None:
    """Places of (year, month, day) and the day number; day before month unless only month before day is possible."""
    fields, marks = re.split("[-/.]", value), re.findall("[-/.]", value)
    if marks[0] != marks[1]:
        return None
    for order in ((0, 1, 2),) if len(fields[0]) == 4 else ((2, 1, 0), (2, 0, 1)):
        try:
            number = datetime.date(*(int(fields[i]) for i in order)).toordinal()
        except ValueError:
            continue
        return (order, number - FIRST_DAY) if FIRST_DAY <= number <= LAST_DAY else None
    return None


def _date(value: str, permuter: Permuter, inverse: bool) -> str | None:
    parsed = _parse_date(value)
    if parsed is None:
        return None
    order, number = parsed
    fields = re.split("[-/.]", value)
    padded = all(len(f) > 1 for f in fields)
    while True:  # walk on until the date reads the same way in this shape
        number = permuter.permute(number, LAST_DAY - FIRST_DAY + 1, "date", inverse)
        day = datetime.date.fromordinal(FIRST_DAY + number)
        out = [""] * 3
        for i, n in zip(order, (day.year, day.month, day.day), strict=True):
            out[i] = f"{n:02d}" if padded else str(n)
        text = value[len(fields[0])].join(out)
        if [len(f) for f in out] == [len(f) for f in fields] and _parse_date(text) == (order, number):
            return text


def _social(value: str, permuter: Permuter, inverse: bool) -> str | None:
    area, group, serial = int(value[:3]), int(value[4:6]), int(value[7:])
    if area in (0, 666) or area >= 900 or not group or not serial or value[3] != value[6]:
        return None
    area -= 1 + (area > 666)
    number = permuter.permute((area * 99 + group - 1) * 9999 + serial - 1, 898 * 99 * 9999, "social", inverse)
    number, serial = divmod(number, 9999)
    area, group = divmod(number, 99)
    area += 1 + (area >= 665)
    return f"{area:03d}{value[3]}{group + 1:02d}{value[6]}{serial + 1:04d}"


def _phone(value: str, permuter: Permuter, inverse: bool) -> str | None:
    digits = "".join(c for c in value if c in DIGITS)
    if not 8 <= len(digits) <= 15:
        return None
    country = len(re.match(r"\+?([0-9]*)", value)[1]) if value.startswith("+") else 0
    if country > 3:  # written without a gap behind the country code
        country = 1 if digits[0] in "17" else 2
    return _spread(value, digits[:country] + _permute_digits(digits[country:], permuter, f"phone{digits[:country]}", inverse))


def _email(value: str, permuter: Permuter, inverse: bool) -> str:
    name, _, host = value.rpartition("@")
    return f"{_permute_classes(name, permuter, 'email@' + host.lower(), inverse)}@{host}"


def _key(value: str, permuter: Permuter, inverse: bool) -> str:
    prefix = re.match(r"(?:AKIA|ASIA|(?:sk|pk|ghp|gho|xox[abp])[_-])?", value)[0]
    body = value[len(prefix) :]
    return prefix + _permute_classes(body, permuter, f"key{prefix}", inverse, re.fullmatch("[0-9a-f]+", body) is not None)


#: Starts of a match that may be the value, in the order in which they are tried.
STARTS: dict[str, Callable] = {"card": _card_starts, "iban": lambda value: [_iban_start(value)]}
RULES: dict[str, Callable] = {
    "card": _card, "iban": _iban, "ip": _ip, "date": _date, "social": _social, "phone": _phone, "email": _email, "key": _key,
}


class Pseudonymiser:
    """Replaces personal data in texts; ``inverse`` restores them under the same key."""

    def __init__(self, key: str, inverse: bool = False):
        permuter = Permuter(hashlib.sha256(key.encode()).digest())
        self.value = lru_cache(100_000)(lambda kind, value: RULES[kind](value, permuter, inverse))

    def _at(self, text: str, start: int) -> tuple[str, str, str] | None:
        """Kind, value and pseudonym of the valid value that starts here, the kinds in the order of PATTERNS."""
        if not ANY.match(text, start):
            return None
        for kind, pattern in SINGLE.items():
            if found := pattern.match(text, start):
                for value in STARTS[kind](found[0]) if kind in STARTS else (found[0],):
                    new = self.value(kind, value)
                    if new is not None:
                        return kind, value, new
        return None

    def replace(self, text: str) -> tuple[str, list[tuple[str, int, int]]]:
        """The new text and (kind, start, end) of each replaced value in it.

        Every value has a hint character, and starts in the run of solid characters around the first one, or right
        behind an assignment; only those places are tried.
        """
        out, spans, done, size, at = [], [], 0, 0, 0
        while hint := HINT.search(text, at):
            place = hint.start()
            low = max(at, text.rfind(" ", at, place) + 1, text.rfind("\n", at, place) + 1, place - LONGEST_START)
            letters = at + len(text[at:place].rstrip("abcdef"))  # of a hexadecimal secret before its first digit
            starts = range(low, place + 1 + (hint[0] in "=:"))
            for start in starts if letters >= low else (letters, *starts):
                if found := self._at(text, start):
                    kind, value, new = found
                    kept = text[done:start]
                    out += [kept, new]
                    spans.append((kind, size + len(kept), size + len(kept) + len(new)))
                    size += len(kept) + len(new)
                    done = at = start + len(value)
                    break
            else:
                at = place + 1
        out.append(text[done:])
        return "".join(out), spans


#: A value begins at most this many characters before its first digit, at-sign or key prefix, but for hexadecimal letters.
LONGEST_START = 130
SINGLE = {kind: re.compile(pattern, re.ASCII) for kind, pattern in PATTERNS.items()}
HINT = re.compile(r"[0-9@=:]|A[KS]IA|(?<![A-Za-z0-9])(?:sk|pk|ghp|gho|xox[abp])[_-]|(?i:(?<=bearer ))[\w.~+/-]", re.ASCII)
SPANS = "array<struct<kind:string,start:int,end:int>>"


def pseudonymise(docs: DataFrame, key: str, text: str = "text", inverse: bool = False) -> DataFrame:
    """All columns of ``docs`` with ``text`` replaced, and ``pii_spans``: kind and place of each pseudonym in the new text.

    A null text stays null with no spans; rows are independent, so nothing is exchanged. A column of the input that is
    named ``pii_spans`` is replaced.
    """
    columns = [c for c in docs.columns if c != "pii_spans"]
    at = columns.index(text)
    kinds = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker = Pseudonymiser(key, inverse)
        for batch in batches:
            texts, spans = [], []
            for value in batch.column(at).to_pylist():
                new, found = worker.replace(value) if value and HINT.search(value) else (value, [])
                texts.append(new)
                spans.append([{"kind": k, "start": a, "end": b} for k, a, b in found])
            arrays = [pa.array(texts, batch.schema.field(i).type) if i == at else batch.column(i) for i in range(len(columns))]
            yield pa.record_batch([*arrays, pa.array(spans, kinds)], names=[*columns, "pii_spans"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name != "pii_spans")
    return docs.select(*[F.col(f"`{c}`") for c in columns]).mapInArrow(in_arrow(run), f"{schema}, pii_spans {SPANS}")
