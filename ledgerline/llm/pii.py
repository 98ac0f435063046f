"""PII pseudonyms: validated numbers and dates, keyed-permuted inside their own format by a Feistel network."""

from __future__ import annotations

import hashlib
import re
from datetime import date, timedelta

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.llm import kernels as K
from ledgerline.llm.common import arrow_batches

ROUNDS = 10


class Feistel:
    """A keyed permutation of 0 .. n-1, and its inverse; ``kind`` keeps the formats apart."""

    def __init__(self, key: bytes, kind: str, n: int):
        self.n = n
        self.a = max(1, int(n ** 0.5)) if n < 1 << 52 else 1 << (n.bit_length() // 2)
        self.b = -(-n // self.a)
        self.seed = hashlib.blake2b(f"{kind}:{n}".encode(), key=key, digest_size=32).digest()

    def _f(self, r: int, half: int) -> int:
        h = hashlib.blake2b(half.to_bytes(64, "big"), key=self.seed, salt=bytes([r]), digest_size=32)
        return int.from_bytes(h.digest(), "big")

    def _once(self, x: int, way: int) -> int:
        left, right = divmod(x, self.b)
        for r in range(ROUNDS) if way > 0 else reversed(range(ROUNDS)):
            if r % 2:
                right = (right + way * self._f(r, left)) % self.b
            else:
                left = (left + way * self._f(r, right)) % self.a
        return left * self.b + right

    def _walk(self, x: int, way: int) -> int:
        while (x := self._once(x, way)) >= self.n:  # cycle-walking back into the domain
            pass
        return x

    def hide(self, x: int) -> int:
        return self._walk(x, 1)

    def show(self, x: int) -> int:
        return self._walk(x, -1)


def luhn_digit(digits: str) -> str:
    total = sum(sum(divmod(int(d) * (2 if i % 2 == 0 else 1), 10)) for i, d in enumerate(reversed(digits)))
    return str(-total % 10)


def _redraw(shape: str, digits: str) -> str:
    it = iter(digits)
    return "".join(next(it) if c.isdigit() else c for c in shape)


class Pseudonyms:
    """Finds the formats in a text and swaps each valid value for its pseudonym (``way`` -1: back)."""

    #: One group per kind; what a group finds counts only if its rule below holds.
    FIND = re.compile(
        r"(?<![\w.])(?P<iban>[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?)(?!\w)"
        r"|(?<![\w.])(?P<ip>\d{1,3}(?:\.\d{1,3}){3})(?![\w]|\.\d)"
        r"|(?<![\w.-])(?P<iso>\d{4}-\d{2}-\d{2})(?![\w-])"
        r"|(?<![\w.-])(?P<dotted>\d{2}\.\d{2}\.\d{4})(?!\w)"
        r"|(?<![\w./-])(?P<slashed>\d{2}/\d{2}/\d{4})(?![\w/])"
        r"|(?<![\w-])(?P<ssn>\d{3}-\d{2}-\d{4})(?![\w-])"
        r"|(?<![\w.])(?P<card>\d{4}(?:[ -]\d{4}){3}|\d{13,19})(?!\w)"
        r"|(?<!\w)(?P<phone>\+\d{1,3}[ .-]?(?:\(\d{2,4}\)|\d{2,4})(?:[ .-]?\d{2,4}){2,3})(?!\w)")
    #: An e-mail name stands before this and holds only these, from a letter or digit on.
    DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}")
    NAME = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
    ALNUM = re.compile("[A-Za-z0-9]")
    #: Letters and digits of an e-mail name that are permuted together.
    TOGETHER = 64
    FIRST, DAYS = date(1900, 1, 1), (date(2100, 1, 1) - date(1900, 1, 1)).days

    def __init__(self, key: bytes, way: int = 1):
        self.key, self.way, self.nets = key, way, {}

    def _map(self, kind: str, n: int, x: int) -> int:
        net = self.nets.get((kind, n)) or self.nets.setdefault((kind, n), Feistel(self.key, kind, n))
        return net.hide(x) if self.way > 0 else net.show(x)

    def _digits(self, kind: str, digits: str) -> str:
        return str(self._map(kind, 10 ** len(digits), int(digits))).zfill(len(digits)) if digits else digits

    def _day(self, y: str, m: str, d: str) -> date | None:
        try:
            x = (date(int(y), int(m), int(d)) - self.FIRST).days
        except ValueError:
            return None
        return self.FIRST + timedelta(self._map("date", self.DAYS, x)) if 0 <= x < self.DAYS else None

    def email(self, s: str) -> str | None:
        """A long name goes in blocks; each has its own permutation, chosen by what stands before it in the clear name."""
        plain = [c for c in s if c.isalnum()]
        out, before = [], b""
        for i in range(0, len(plain), self.TOGETHER):
            block = plain[i:i + self.TOGETHER]
            new = self._email_block("email" + hashlib.blake2b(before, digest_size=16).hexdigest() * (i > 0), block)
            clear = "".join(block).lower() if self.way > 0 else "".join(new)
            before = hashlib.blake2b(before + clear.encode(), digest_size=16).digest()
            out += new
        it = iter(out)
        return "".join((next(it).upper() if c.isupper() else next(it)) if c.isalnum() else c for c in s)

    def _email_block(self, kind: str, block: list[str]) -> list[str]:
        radix = [26 if c.isalpha() else 10 for c in block]
        x, n = 0, 1
        for c, r in zip(block, radix):
            x, n = x * r + (ord(c.lower()) - 97 if r == 26 else int(c)), n * r
        if kind == "email":
            x = self._map(kind, n, x)
        else:  # used once: not kept
            net = Feistel(self.key, kind, n)
            x = net.hide(x) if self.way > 0 else net.show(x)
        out = []
        for r in reversed(radix):
            x, v = divmod(x, r)
            out.append(chr(97 + v) if r == 26 else str(v))
        return out[::-1]

    def iban(self, s: str) -> str | None:
        flat = s.replace(" ", "")
        value = lambda t: int("".join(str(int(c, 36)) for c in t))
        if not 15 <= len(flat) <= 34 or value(flat[4:] + flat[:4]) % 97 != 1:
            return None
        radix = [10 if c.isdigit() else 26 for c in flat[4:]]
        x, n = 0, 1
        for c, r in zip(flat[4:], radix):
            x, n = x * r + (int(c) if r == 10 else ord(c) - 65), n * r
        x, out = self._map("iban" + flat[:2], n, x), []
        for r in reversed(radix):
            x, v = divmod(x, r)
            out.append(str(v) if r == 10 else chr(65 + v))
        tail = "".join(reversed(out))
        it = iter(flat[:2] + f"{98 - value(tail + flat[:2] + '00') % 97:02d}" + tail)
        return "".join(next(it) if c != " " else c for c in s)

    def ip(self, s: str) -> str | None:
        parts = s.split(".")
        if any(int(p) > 255 or (len(p) > 1 and p[0] == "0") for p in parts) or parts[0] == "0":
            return None
        low = 1 << 24
        x = self._map("ip", 255 * low, int.from_bytes(bytes(map(int, parts)), "big") - low) + low
        return ".".join(map(str, x.to_bytes(4, "big")))

    def iso(self, s: str) -> str | None:
        d = self._day(s[:4], s[5:7], s[8:])
        return d and d.strftime("%Y-%m-%d")

    def dotted(self, s: str) -> str | None:
        d = self._day(s[6:], s[3:5], s[:2])
        return d and d.strftime("%d.%m.%Y")

    def slashed(self, s: str) -> str | None:
        d = self._day(s[6:], s[:2], s[3:5])
        return d and d.strftime("%m/%d/%Y")

    def ssn(self, s: str) -> str | None:
        area, group, serial = int(s[:3]), int(s[4:6]), int(s[7:])
        if area in (0, 666) or area >= 900 or not group or not serial:
            return None
        area -= area > 666
        x = self._map("ssn", 898 * 99 * 9999, ((area - 1) * 99 + group - 1) * 9999 + serial - 1)
        x, serial = divmod(x, 9999)
        area, group = divmod(x, 99)
        return f"{area + 1 + (area + 1 >= 666):03d}-{group + 1:02d}-{serial + 1:04d}"

    def card(self, s: str) -> str | None:
        digits = re.sub(r"\D", "", s)
        if luhn_digit(digits[:-1]) != digits[-1] or not digits.strip("0"):
            return None
        front = self._digits("card", digits[:-1])
        return _redraw(s, front + luhn_digit(front))

    def phone(self, s: str) -> str | None:
        code = re.match(r"\+\d{1,3}(?=[ .(-])|\+\d", s)[0]
        digits = re.sub(r"\D", "", s[len(code):])
        if not 7 <= len(digits) <= 12:
            return None
        return code + _redraw(s[len(code):], self._digits("phone" + code, digits))

    def _found(self, text: str):
        """(kind, start, end) from left to right. Names are read from their @ leftwards, so each character once."""
        at, other = 0, None
        for domain in [*self.DOMAIN.finditer(text), None]:
            end = domain.start() if domain else len(text)
            low = end
            while domain and low > at and text[low - 1] in self.NAME:
                low -= 1
            while True:
                if other is None or other.start() < at:
                    other = self.FIND.search(text, at) or False
                name = self.ALNUM.search(text, max(low, at), end) if domain else None
                if other and other.start() < (name.start() if name else end):
                    yield other.lastgroup, other.start(), other.end()
                    at, other = other.end(), None
                    continue
                if name:
                    yield "email", name.start(), end
                    at = end
                break
            if other is False and domain is None:
                return
            other = other or None

    def apply(self, text: str) -> tuple[str, list[tuple[str, int, int]]]:
        """The new text and (kind, start, end) of each value in the old one."""
        out, spans, at = [], [], 0
        for kind, start, end in self._found(text):
            new = getattr(self, kind)(text[start:end])
            if new is not None:
                out += [text[at:start], new]
                spans.append((kind, start, end))
                at = end
        return ("".join([*out, text[at:]]) if spans else text), spans


SPAN = "array<struct<kind:string,start:int,end:int>>"
_HINT = np.zeros(256, bool)
_HINT[[ord("@"), *range(48, 58)]] = True


def pseudonymise(docs: DataFrame, key: bytes, way: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, ``text`` with pseudonyms, ``spans`` (kind, start, end: characters of the old text) for every row.

    Cards (Luhn), IBANs (mod 97), US social security numbers, IPv4 addresses,
    international phone numbers and calendar dates of 1900-2099 are permuted
    inside their format: length, separators, check digits, country codes and
    validity stay. The local part of an e-mail address is permuted letter by
    letter and digit by digit. Equal values get equal pseudonyms in every
    document and spelling (a card with or without blanks, a date in three
    layouts); ``way`` -1 turns them back. Values that fail their rule stay.

    Edge cases: null stays null with no spans, empty stays empty; repeated rows
    get equal results; other columns are ignored; empty input gives no rows. A
    text is read once, from its first character to its last, whatever its length.
    """
    arrow_batches(docs.sparkSession)

    def swap(batches):
        tool = Pseudonyms(key, way)
        for batch in batches:
            column = batch.column("text")
            data, off = K.text_bytes(column)
            hints = np.concatenate([[0], np.cumsum(_HINT[data])])
            some = hints[off[1:]] > hints[off[:-1]]  # texts with a digit or an @
            texts, spans = column.to_pylist(), [[]] * len(batch)
            for i in np.flatnonzero(some):
                texts[i], found = tool.apply(texts[i])
                spans[i] = [{"kind": k, "start": a, "end": b} for k, a, b in found]
            kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(texts, pa.string()), pa.array(spans, kind)], ["id", "text", "spans"])

    id_kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(swap, f"id {id_kind}, text string, spans {SPAN}").select(F.col("id").alias(id_col), "text", "spans")


def kinds() -> list[str]:
    return ["email", *Pseudonyms.FIND.groupindex]
