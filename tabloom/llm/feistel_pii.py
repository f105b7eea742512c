"""Format-preserving pseudonyms for personal data and secrets.

Values are found by pattern, validated (calendar, Luhn, mod 97, numbering rules, octets), ranked within the set of all valid
values of their format, permuted there by a keyed Feistel network and written back in the same layout. So a pseudonym is
again a valid value of its kind, equal values map to equal pseudonyms in every document, and different values to different
ones. The network is an unbalanced one over Z_a x Z_b with a * b >= N and cycle walking, its round function keyed BLAKE2b;
key, kind and format are its tweak. The key is the caller's secret: who has it can undo the pseudonyms. A value that its permutation leaves in place is exchanged with the pseudonym's next
point, so no value keeps its own text.

Kinds: email, card (13-19 digits, Luhn), iban, phone (+ and 8-15 digits, or ten North American digits), ssn, date (ISO,
slashed, dotted, with month names; 1900-2099), ip (dotted quad, without loopback, 0.0.0.0 and broadcast), key (AKIA and 16
characters) and token (32 or more hexadecimal digits).

Defined results: a null text stays null with no spans; texts without such values are returned as they are; whole texts are
scanned; where patterns overlap, the kind listed first wins; repeated rows are treated alike; other columns pass through,
and a column named `pii` is replaced.
"""

from __future__ import annotations

import datetime
import re
from collections.abc import Callable, Iterator
from functools import lru_cache
from hashlib import blake2b
from math import isqrt

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from tabloom.llm import _core as C

ROUNDS = 8
DIGITS, UPPER, LOWER, HEX, HEX_UPPER, ALNUM_UPPER = "0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789abcdef", "0123456789ABCDEF", "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
#: English month names.
MONTHS = ["January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December"]
FIRST_DAY, LAST_DAY = datetime.date(1900, 1, 1).toordinal(), datetime.date(2099, 12, 31).toordinal()


def feistel(x: int, n: int, key: bytes, tweak: str, back: bool = False) -> int:
    """One pass of the network over 0..n-1, by cycle walking; back: its inverse."""
    a = isqrt(n - 1) + 1
    b = -(-n // a)

    def f(i: int, r: int, m: int) -> int:
        return int.from_bytes(blake2b(f"{tweak}|{n}|{i}|{r}".encode(), key=key[:64], digest_size=16 + (m.bit_length() + 7) // 8).digest(), "big") % m

    while True:
        left, right = divmod(x, b)
        for i in reversed(range(ROUNDS)) if back else range(ROUNDS):
            if i % 2:
                right = (right - f(i, left, b)) % b if back else (right + f(i, left, b)) % b
            else:
                left = (left - f(i, right, a)) % a if back else (left + f(i, right, a)) % a
        x = left * b + right
        if x < n:
            return x


def permute(x: int, n: int, key: bytes, tweak: str) -> int:
    """A keyed permutation of 0..n-1 without fixed points (n > 1): the network E conjugates the step by one, E(E^-1(x) + 1)."""
    if n < 2:
        return x
    return feistel((feistel(x, n, key, tweak, back=True) + 1) % n, n, key, tweak)


def rank(s: str, alphabets: list[str]) -> tuple[int, int]:
    value, n = 0, 1
    for c, a in zip(s, alphabets, strict=True):
        value, n = value * len(a) + a.index(c), n * len(a)
    return value, n


def unrank(x: int, alphabets: list[str]) -> str:
    out = []
    for a in reversed(alphabets):
        x, r = divmod(x, len(a))
        out.append(a[r])
    return "".join(reversed(out))


def swap(s: str, alphabets: list[str], key: bytes, tweak: str, valid: Callable[[str], bool] = lambda s: True) -> str:
    """The string with its characters permuted within their alphabets, walking on to the next valid string."""
    x, n = rank(s, alphabets)
    while True:  # ends at the valid string itself at the latest, where its cycle closes
        x = permute(x, n, key, tweak)
        out = unrank(x, alphabets)
        if valid(out):
            return out


def refill(layout: str, chars: str) -> str:
    """The layout with its digits replaced in order."""
    it = iter(chars)
    return "".join(next(it) if c in DIGITS else c for c in layout)


def kinds_of(s: str) -> list[str]:
    return [DIGITS if c in DIGITS else UPPER if c in UPPER else LOWER if c in LOWER else c for c in s]


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def email(s: str, key: bytes) -> str | None:
    local, domain = s.split("@")
    if rank(local, kinds_of(local))[1] > 1:
        return f"{swap(local, kinds_of(local), key, 'email')}@{domain}"
    if len(local) > 1:  # marks only: permuted among themselves
        return f"_{swap(local[1:], ['._%+-'] * (len(local) - 1), key, 'marks')}@{domain}"
    return f"{local}@{swap(domain, kinds_of(domain), key, 'domain')}"


def card(s: str, key: bytes) -> str | None:
    d = re.sub(r"\D", "", s)
    if not (13 <= len(d) <= 19 and luhn(d)) or len(set(d)) == 1:
        return None
    body = d[0] + swap(d[1:-1], [DIGITS] * (len(d) - 2), key, f"card{d[0]}")
    return refill(s, body + next(c for c in DIGITS if luhn(body + c)))


def mod97(s: str) -> int:
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97


def iban(s: str, key: bytes) -> str | None:
    flat = s.replace(" ", "")
    if not 15 <= len(flat) <= 34 or mod97(flat) != 1:
        return None
    body = swap(flat[4:], kinds_of(flat[4:]), key, f"iban{flat[:2]}")
    new = iter(f"{flat[:2]}{98 - mod97(f'{flat[:2]}00{body}'):02d}{body}")
    return "".join(c if c == " " else next(new) for c in s)


def phone(s: str, key: bytes) -> str | None:
    d = re.sub(r"\D", "", s)
    american = d[-10:] if len(d) == 10 or len(d) == 11 and d[0] == "1" else ""
    high = "23456789"
    if american and (american[0] not in high or american[3] not in high):
        # no number of the plan: with its + it is still a number of that length, permuted among such numbers
        return refill(s, d[:-10] + swap(american, [DIGITS] * 10, key, "phone+", lambda x: x[0] not in high or x[3] not in high)) if s.startswith("+") else None
    if american:
        alphabets = [high if i in (0, 3) else DIGITS for i in range(10)]
        return refill(s, d[:-10] + swap(american, alphabets, key, "phone"))
    if not (s.startswith("+") and 8 <= len(d) <= 15):
        return None
    return refill(s, d[:2] + swap(d[2:], [DIGITS] * (len(d) - 2), key, f"phone{d[:2]}"))


def ssn(s: str, key: bytes) -> str | None:
    ok = lambda d: d[:3] not in ("000", "666") and d[0] != "9" and d[3:5] != "00" and d[5:] != "0000"
    d = s.replace("-", "").replace(" ", "")
    return refill(s, swap(d, [DIGITS] * 9, key, "ssn", ok)) if ok(d) else None


def ip(s: str, key: bytes) -> str | None:
    octets = [int(x) for x in s.split(".")]
    x = int.from_bytes(bytes(octets), "big") if max(octets) < 256 else 0
    outside = lambda x: x in (0, 2**32 - 1) or x >> 24 == 127
    if outside(x) or any(len(o) > 1 and o[0] == "0" for o in s.split(".")):
        return None
    while outside(x := permute(x, 2**32, key, "ip")):
        pass
    return ".".join(map(str, x.to_bytes(4, "big")))


def secret(s: str, key: bytes) -> str | None:
    return "AKIA" + swap(s[4:], [ALNUM_UPPER] * 16, key, "key")


def token(s: str, key: bytes) -> str | None:
    if s.isdigit() or s.isalpha():
        return None
    return swap(s, [HEX if s == s.lower() else HEX_UPPER] * len(s), key, "token")


def other_day(day: datetime.date, key: bytes, tweak: str, valid: Callable[[datetime.date], bool]) -> datetime.date:
    x = day.toordinal() - FIRST_DAY
    while True:
        x = permute(x, LAST_DAY - FIRST_DAY + 1, key, f"date{tweak}")
        if valid(out := datetime.date.fromordinal(FIRST_DAY + x)):
            return out


def date(s: str, key: bytes) -> str | None:
    digits = lambda n: str(len(str(n)))

    def kept(m: str, d: str) -> tuple[str, Callable[[datetime.date], bool]]:
        """(tweak, which dates fit) of a month and a day in digits: with two each any date fits, else those that keep their widths."""
        if len(m) == len(d) == 2:
            return "", lambda x: True
        small = int(m) < 10, int(d) < 10
        return f"{small}{len(m)}{len(d)}", lambda x: (x.month < 10, x.day < 10) == small

    def spelt(name: str, d: str) -> tuple[str, Callable[[datetime.date], bool]]:
        """The same for a month by name: May counts as a short name."""
        long = len(name) > 3
        return f"{'long' if long else 'short'}{len(d)}", lambda x: digits(x.day) == str(len(d)) and not (long and x.month == 5)

    try:
        if m := re.fullmatch(r"([0-9]{4})([-/.])([0-9]{1,2})\2([0-9]{1,2})", s):
            day, sep = datetime.date(int(m[1]), int(m[3]), int(m[4])), m[2]
            new = other_day(day, key, *kept(m[3], m[4]))
            return f"{new.year}{sep}{new.month:0{len(m[3])}d}{sep}{new.day:0{len(m[4])}d}"
        if m := re.fullmatch(r"([0-9]{1,2})([-/.])([0-9]{1,2})\2([0-9]{4})", s):
            first, sep, second, year = int(m[1]), m[2], int(m[3]), int(m[4])
            if sep != "." and first <= 12:  # month first; otherwise day first, where a slashed day must stay above 12
                new = other_day(datetime.date(year, first, second), key, *kept(m[1], m[3]))
                return f"{new.month:0{len(m[1])}d}{sep}{new.day:0{len(m[3])}d}{sep}{new.year}"
            tweak, fits = kept(m[3], m[1])
            new = other_day(datetime.date(year, second, first), key, tweak if sep == "." else f"above12{tweak}", fits if sep == "." else lambda d: d.day > 12 and fits(d))
            return f"{new.day:0{len(m[1])}d}{sep}{new.month:0{len(m[3])}d}{sep}{new.year}"
        if m := re.fullmatch(r"([A-Z][a-z]+)( +)([0-9]{1,2})(,? +)([0-9]{4})", s):
            new = other_day(datetime.date(int(m[5]), month(m[1]), int(m[3])), key, *spelt(m[1], str(int(m[3]))))
            return f"{named(m[1], new)}{m[2]}{new.day:0{len(m[3])}d}{m[4]}{new.year}"
        if m := re.fullmatch(r"([0-9]{1,2})( +)([A-Z][a-z]+)(,? +)([0-9]{4})", s):
            new = other_day(datetime.date(int(m[5]), month(m[3]), int(m[1])), key, *spelt(m[3], str(int(m[1]))))
            return f"{new.day:0{len(m[1])}d}{m[2]}{named(m[3], new)}{m[4]}{new.year}"
    except ValueError:
        return None
    return None


def month(name: str) -> int:
    for i, m in enumerate(MONTHS, 1):
        if name in (m, m[:3]):
            return i
    raise ValueError(name)


def named(like: str, day: datetime.date) -> str:
    full = MONTHS[day.month - 1]
    return full if like in MONTHS and like != "May" else full[:3]


_MONTH = "(?:" + "|".join(f"{m}|{m[:3]}" for m in MONTHS) + ")"
_YEAR = "(?:19|20)[0-9]{2}"
RULES: list[tuple[str, re.Pattern, Callable[[str, bytes], str | None]]] = [
    ("email", re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9_][A-Za-z0-9._%+-]*@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}"), email),
    ("iban", re.compile(r"(?<!\w)[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?!\w)"), iban),
    ("key", re.compile(r"(?<!\w)AKIA[A-Z0-9]{16}(?!\w)"), secret),
    ("token", re.compile(r"(?<!\w)(?:[0-9a-f]{32,}|[0-9A-F]{32,})(?!\w)"), token),
    ("ip", re.compile(r"(?<![\w.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?!\w|\.[0-9])"), ip),
    ("date", re.compile(rf"(?<![\w./-])(?:{_YEAR}([-/.])[0-9]{{1,2}}\1[0-9]{{1,2}}|[0-9]{{1,2}}([-/.])[0-9]{{1,2}}\2{_YEAR}|{_MONTH} +[0-9]{{1,2}},? +{_YEAR}|[0-9]{{1,2}} +{_MONTH},? +{_YEAR})(?![\w/-]|\.[0-9])"), date),
    ("card", re.compile(r"(?<![\w.+-])[0-9](?:[ -]?[0-9]){12,18}(?![\w-]|\.[0-9])"), card),
    ("ssn", re.compile(r"(?<![\w.+-])[0-9]{3}([- ])[0-9]{2}\1[0-9]{4}(?![\w-]|\.[0-9])"), ssn),
    ("phone", re.compile(r"(?<![\w.+-])(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{1,4}\)[ .-]?)?[0-9]{2,4}(?:[ .-]?[0-9]{2,4}){1,4}(?![\w-]|\.[0-9])"), phone),
]


def scan(s: str, key: bytes) -> tuple[str, list[dict]]:
    """The text with its values replaced, and their spans in the original text."""
    found: list[tuple[int, int, str, str]] = []
    for kind, pattern, make in RULES:
        at = 0
        while m := pattern.search(s, at):
            a, z = m.span()
            at = z
            if any(a < y and x < z for x, y, _, _ in found):
                at = max(a + 1, min((y for x, y, _, _ in found if x < z and a < y), default=z))
                continue
            new = cached(kind, m[0], key)
            if new is None:
                # a shorter or later run may still be valid: go on behind the first group of digits
                step = re.match(r"\W*\w+", s[a:z])
                at = a + step.end() if step and step.end() else z
                continue
            found.append((a, z, kind, new))
    found.sort()
    out, at = [], 0
    for a, z, _, new in found:
        out += [s[at:a], new]
        at = z
    return "".join([*out, s[at:]]), [{"start": a, "length": z - a, "kind": k} for a, z, k, _ in found]


@lru_cache(maxsize=200_000)
def cached(kind: str, value: str, key: bytes) -> str | None:
    return next(make for k, _, make in RULES if k == kind)(value, key)


def pseudonymise(docs: DataFrame, key: bytes, text: str = "text") -> DataFrame:
    """docs with the values in `text` replaced, and `pii`: start, length and kind of each in the original text."""
    if not key:
        raise ValueError("pseudonyms need a secret key")
    C.arrow_limits(docs.sparkSession)
    kind = pa.list_(pa.struct([("start", pa.int32()), ("length", pa.int32()), ("kind", pa.string())]))
    schema = docs.drop("pii").withColumn("pii", _EMPTY_SPANS()).schema
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            column = b.column(b.schema.get_field_index(text))
            flags = pc.match_substring_regex(column, "[0-9@]").fill_null(False)
            spans: list[list[dict]] = [[] for _ in range(len(column))]
            rows = np.flatnonzero(flags.to_numpy(zero_copy_only=False))
            new = []
            for i in rows:
                t, spans[i] = scan(column[int(i)].as_py(), key)
                new.append(t)
            changed = pc.replace_with_mask(column, flags, pa.array(new, column.type)) if len(rows) else column
            yield pa.RecordBatch.from_arrays([pa.array(spans, kind) if n == "pii" else changed if n == text else b.column(b.schema.get_field_index(n)) for n in names], names=names)

    return docs.mapInArrow(run, schema)


def _EMPTY_SPANS():
    from pyspark.sql import functions as F

    return F.array().cast("array<struct<start:int,length:int,kind:string>>")
