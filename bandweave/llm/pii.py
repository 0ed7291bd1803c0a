"""Format-preserving pseudonyms for personal data, by a keyed Feistel permutation within each format.

A value is found by its form and validated (Luhn digit, mod-97 digits, octets, area codes, calendar). Its free
part is a number in 0..N-1 where N counts the valid values of its format; that number is permuted and written back
in the same format, check digits made anew. So a card number stays a valid card number of the same length, a date a
date in the same notation, and equal values get equal pseudonyms in every document that shares the key. With the key,
restore() takes them back.

The permutation: an alternating Feistel network over Z_a x Z_b, a * b >= N, keyed rounds by BLAKE2b, cycle-walked
into 0..N-1; P is used as P^-1(P(x) + s), a single cycle of a keyed step, so no value stands for itself.

Formats: e-mail addresses (letters and digits of the local part), telephone numbers (North American ones with valid
area and exchange codes, in tables also those written with +1 whose codes aren't valid, among their like; others with + and
8 to 15 digits, whose country code stays), payment cards (13 to 19 digits,
plain or in groups, Luhn), IPv4 addresses, US social security numbers, IBANs, and dates from 1900 to 2099 as
yyyy-mm-dd, dd.mm.yyyy, mm/dd/yyyy or dd/mm/yyyy (numbers under 10 with a zero before all of them or none; of others
only the day is restored). Other text is left byte for byte.

Cases: a null text stays null, an empty one empty. Rows that repeat are treated alike. An empty table gives
an empty result. pseudonymised() keeps all other columns; its counts replace columns of the same names.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from datetime import date
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bandweave.llm.common import in_arrow, parts

KINDS = ("email", "phone", "card", "ip", "ssn", "iban", "date")
COUNTS = tuple(f"n_{k}" for k in KINDS)
ROUNDS = 10
FIRST_DAY, DAYS = date(1900, 1, 1).toordinal(), (date(2100, 1, 1) - date(1900, 1, 1)).days

#: Only for trials: whoever has the key can take the pseudonyms back, so give one of your own.
TRIAL_KEY = b"trial key"

EMAIL = re.compile(r"(?<![A-Za-z0-9._%+-])([A-Za-z0-9][A-Za-z0-9._%+-]*)@((?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,})(?![A-Za-z0-9])")
NUMBER = re.compile(
    r"""(?<![\w.])(?:
    (?P<date>\d{4}-\d{2}-\d{2}|\d{1,2}\.\d{1,2}\.\d{4}|\d{1,2}/\d{1,2}/\d{4})(?![\w/-])
    |(?P<ssn>\d{3}-\d{2}-\d{4})(?![\w-])
    |(?P<ip>\d{1,3}(?:\.\d{1,3}){3})(?!\w|\.\d)
    |(?P<card>\d{13,19}|\d{4}([ -])\d{4}\5\d{4}\5\d{4}|\d{4}([ -])\d{6}\6\d{5})(?!\w|-\d)
    |(?P<phone>(?:\+?1[ .-]?)?(?:\([2-9]\d\d\)[ .-]?|[2-9]\d\d[ .-])[2-9]\d\d[ .-]\d{4}|\+1(?:[ .-]?\(\d{3}\)[ .-]?|[ .-]\d{3}[ .-]?)\d{3}[ .-]?\d{4}|\+[1-9]\d{0,2}(?:(?:[ -]?\(?\d{1,4}\)?){2,6}|(?:\.\d{1,4}){2,6}))(?!\w)
    |(?P<iban>[A-Z]{2}\d{2}(?:[ ]?[A-Z0-9]{4}){2,7}(?:[ ]?[A-Z0-9]{1,3})?)(?!\w)
    )""",
    re.X,
)


class Permutation:
    """A keyed permutation of 0..n-1 without fixed points (for n > 1); label separates formats."""

    def __init__(self, key: bytes, label: str, n: int):
        self.n, self.a = n, math.isqrt(n - 1) + 1
        self.b = -(-n // self.a)
        name = str(n) if n.bit_length() < 4096 else hex(n)  # Python writes no decimal number of over 4300 digits
        self.key, self.label = hashlib.blake2b(key, digest_size=32).digest(), f"{label}|{name}".encode()
        self.step = 1 + self._f(0xFF, 0) % (n - 1) if n > 1 else 0

    def _f(self, i: int, x: int) -> int:
        """As many bits as a half has, 256 at least; the blocks after the first are digests of it."""
        data = self.label + bytes([i]) + x.to_bytes(max(32, -(-x.bit_length() // 8)), "big")
        out = hashlib.blake2b(data, key=self.key, digest_size=32).digest()
        blocks = -(-self.a.bit_length() // 256)
        if blocks > 1:
            out += b"".join(hashlib.blake2b(out[:32] + k.to_bytes(8, "big"), key=self.key, digest_size=32).digest() for k in range(1, blocks))
        return int.from_bytes(out, "big")

    def _feistel(self, v: int, back: bool) -> int:
        while True:
            left, right = divmod(v, self.b)
            for i in reversed(range(ROUNDS)) if back else range(ROUNDS):
                sign = -1 if back else 1
                if i % 2:
                    right = (right + sign * self._f(i, left)) % self.b
                else:
                    left = (left + sign * self._f(i, right)) % self.a
            v = left * self.b + right
            if v < self.n:
                return v

    def __call__(self, x: int, back: bool = False) -> int:
        return self._feistel((self._feistel(x, False) + (-self.step if back else self.step)) % self.n, True)


def luhn_digit(digits: str) -> str:
    """The digit that makes digits + it valid."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (2 - i % 2)
        total += d - 9 if d > 9 else d
    return str(-total % 10)


def iban_rest(iban: str) -> int:
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97


class Pseudonyms:
    """Replaces values in texts; back=True restores them. any_code: numbers written with +1 are replaced whatever their area
    and exchange codes are."""

    def __init__(self, key: bytes, back: bool = False, any_code: bool = False):
        self.key, self.back, self.any_code = key, back, any_code
        self.permutation = lru_cache(4096)(lambda label, n: Permutation(key, label, n))
        self.value = lru_cache(100_000)(self._value)

    def _number(self, label: str, n: int, x: int) -> int:
        return self.permutation(label, n)(x, self.back) if n > 1 else x

    def _characters(self, label: str, text: str) -> str:
        """Digits, lower-case and upper-case letters stay such; other characters stay."""
        sets = ("0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")
        radix = [(i, s, s.index(c)) for i, c in enumerate(text) for s in sets if c in s]
        x, n = 0, 1
        for _, s, at in radix:
            x, n = x * len(s) + at, n * len(s)
        x, out = self._number(label + "".join(str(len(s)) + "," for _, s, _ in radix), n, x), list(text)
        for i, s, _ in reversed(radix):
            x, at = divmod(x, len(s))
            out[i] = s[at]
        return "".join(out)

    @staticmethod
    def _fill(form: str, digits: str) -> str:
        """form with its digits replaced in turn."""
        left = iter(digits)
        return "".join(next(left) if c.isdigit() else c for c in form)

    def _nanp(self, own: str) -> str:
        """Ten digits of a valid North American number."""
        x = (int(own[:3]) - 200) * 800 + int(own[3:6]) - 200
        x, line = divmod(self._number("nanp", 6_400_000_000, x * 10_000 + int(own[6:])), 10_000)
        area, exchange = divmod(x, 800)
        return f"{area + 200:03}{exchange + 200:03}{line:04}"

    def _written_one(self, v: str, own: str) -> str:
        """A number with +1: valid ones among the valid, those whose area or exchange code begins with 0 or 1 among such."""
        area, exchange = int(own[:3]), int(own[3:6])
        if area >= 200 and exchange >= 200:
            return self._fill(v, "1" + self._nanp(own))
        codes = area * 1000 + exchange if area < 200 else 200_000 + (area - 200) * 200 + exchange
        codes, line = divmod(self._number("nanp rest", 3_600_000_000, codes * 10_000 + int(own[6:])), 10_000)
        area, exchange = divmod(codes, 1000) if codes < 200_000 else divmod(codes, 200)
        return self._fill(v, f"1{area - (0 if codes < 200_000 else 800):03}{exchange:03}{line:04}")

    def _value(self, kind: str, v: str) -> str | None:
        """The pseudonym of a value; None if it isn't valid."""
        digits = "".join(c for c in v if c.isdigit())
        if kind == "email":
            local, _, host = v.partition("@")
            return f"{self._characters('email', local)}@{host}"
        if kind == "card":
            if luhn_digit(digits[:-1]) != digits[-1] or len(set(digits)) == 1:
                return None
            body = digits[0] + str(self._number("card", 10 ** (len(digits) - 2), int(digits[1:-1]))).zfill(len(digits) - 2)
            return self._fill(v, body + luhn_digit(body))
        if kind == "ip":
            octets = [int(x) for x in v.split(".")]
            if max(octets) > 255:
                return None
            x = self._number("ip", 1 << 32, int.from_bytes(bytes(octets), "big"))
            return ".".join(map(str, x.to_bytes(4, "big")))
        if kind == "ssn":
            area, group, serial = map(int, v.split("-"))
            if not (0 < area < 900 and area != 666 and group and serial):
                return None
            area -= 1 + (area > 666)
            x = self._number("ssn", 898 * 99 * 9999, (area * 99 + group - 1) * 9999 + serial - 1)
            x, serial = divmod(x, 9999)
            area, group = divmod(x, 99)
            return f"{area + 1 + (area >= 665):03}-{group + 1:02}-{serial + 1:04}"
        if kind == "phone":
            if re.fullmatch(r"(?:\+?1[ .-]?)?\(?[2-9]\d\d\)?[ .-]?[2-9]\d\d[ .-]\d{4}", v):
                return self._fill(v, digits[:-10] + self._nanp(digits[-10:]))
            country = re.match(r"\+(\d{1,3})(?=[ .(-])|\+(\d{2})", v)
            if not v.startswith("+") or not country or not 8 <= len(digits) <= 15:
                return None
            head = country[1] or country[2]
            if head == "1":
                return self._written_one(v, digits[1:]) if self.any_code and len(digits) == 11 else None
            return self._fill(v, head + str(self._number("phone", 10 ** (len(digits) - len(head)), int(digits[len(head) :]))).zfill(len(digits) - len(head)))
        if kind == "iban":
            plain = v.replace(" ", "")
            if not 15 <= len(plain) <= 34 or iban_rest(plain) != 1:
                return None
            body = self._characters("iban" + plain[:2], plain[4:])
            left = iter(f"{plain[:2]}{98 - iban_rest(plain[:2] + '00' + body):02}{body}")
            return "".join(c if c == " " else next(left) for c in v)
        return self._date(v)

    def _date(self, v: str) -> str | None:
        mark = re.search(r"\D", v)[0]
        fields = v.split(mark)
        for order in {"-": ("ymd",), ".": ("dmy",), "/": ("mdy", "dmy")}[mark]:
            at = dict(zip(order, map(int, fields), strict=True))
            try:
                x = date(at["y"], at["m"], at["d"]).toordinal() - FIRST_DAY
            except ValueError:
                continue
            if not 0 <= x < DAYS:
                return None
            new = self._day(x, mark == "/" and order == "dmy")
            plain = any(len(f) == 1 for f in fields)
            return mark.join(f"{v}" if plain else f"{v:02}" for v in ({"y": new.year, "m": new.month, "d": new.day}[f] for f in order))
        return None

    def _day(self, x: int, day_first: bool) -> date:
        """The permutation of days, walked on to one that reads back as this does: with two digits both in day and month or
        not, and with a day over 12 where month first is tried before day first."""
        kind = lambda d: d.day > 9 and d.month > 9
        was = kind(date.fromordinal(FIRST_DAY + x))
        while True:
            x = self._number("date", DAYS, x)
            new = date.fromordinal(FIRST_DAY + x)
            if kind(new) == was and not (day_first and new.day <= 12):
                return new

    def text(self, text: str, found: Counter) -> str:
        if "@" in text:
            text = self._replaced(EMAIL, text, found)
        return self._replaced(NUMBER, text, found)

    def _replaced(self, form: re.Pattern, text: str, found: Counter) -> str:
        out, done, m = [], 0, form.search(text)
        while m:
            kind = m.lastgroup or "email"
            new = self.value(kind, m[0])
            if new is not None:
                found[kind] += 1
                out += (text[done : m.start()], new)
                done = m.end()
            m = form.search(text, m.start() + 1 if new is None else done)  # what isn't valid may hold what is
        return "".join(out) + text[done:] if out else text


def pseudonymised(docs: DataFrame, key: bytes, back: bool = False, column: str = "text") -> DataFrame:
    """docs with pseudonyms in `column` and the number of values of each kind in COUNTS."""
    kept = docs.drop(*COUNTS)
    schema = T.StructType([*kept.schema.fields, *(T.StructField(c, T.LongType()) for c in COUNTS)])
    names = kept.columns
    at = names.index(column)

    def run(batches):
        make = Pseudonyms(key, back, any_code=True)
        for batch in parts(batches):
            texts, counts = [], [Counter() for _ in range(batch.num_rows)]
            for value, count in zip(batch.column(at), counts, strict=True):
                value = value.as_py()
                texts.append(value if not value else make.text(value, count))
            columns = batch.columns
            columns[at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays([*columns, *(pa.array([c[k] for c in counts], pa.int64()) for k in KINDS)], [*names, *COUNTS])

    return in_arrow(kept, run, schema)


def restore(docs: DataFrame, key: bytes, column: str = "text") -> DataFrame:
    """Takes the pseudonyms in `column` back."""
    return pseudonymised(docs, key, back=True, column=column).drop(*COUNTS)


def stage(docs: DataFrame, key: bytes) -> DataFrame:
    """docs with pseudonymised texts, the same columns, n_chars counted anew."""
    out = pseudonymised(docs, key)
    return out.withColumn("n_chars", F.coalesce(F.char_length("text").cast("long"), "n_chars")).select(*docs.columns)
