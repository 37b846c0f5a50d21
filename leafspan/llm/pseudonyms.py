"""Format-preserving Feistel pseudonyms for personal data.

Numbers and dates are found by pattern, validated (check digits, ranges, the calendar), and permuted by a keyed Feistel network over exactly the
values their format allows: a card number becomes another valid one with its separators and issuer, a date another date written alike; phone numbers that cannot be dialled are permuted among themselves.
Equal values map to equal pseudonyms in every document, whatever stands beside them, different values to different ones, and the key's holder can
invert the map: each row carries the places of its pseudonyms (spans), so that nothing has to be found again in the new text. E-mail addresses, which have
no such domain, get a keyed name at a reserved host and are not inverted. A row depends on its text alone; there is no shuffle.

Short numbers beside a card or IBAN (a security code, an expiry date) do not hide it: every stretch of whole digit groups of an admissible length is
tried, and those valid are chosen that cover most digits. A row of other numbers that holds a valid card by chance is permuted too.
"""

from __future__ import annotations

import datetime
import hashlib
import hmac
import re
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

ROUNDS = 8
#: Fixed value: the first digits of issued card numbers.
ISSUED = re.compile("4|5[1-5]|222[1-9]|22[3-9]|2[3-6]|27[01]|2720|3[04-8]|6011|62|6[45]")
KINDS = ["email", "iban", "phone", "ip", "ssn", "date", "card"]
EMAIL = re.compile(r"[A-Za-z0-9_%+-](?:[A-Za-z0-9._%+-]{0,62}[A-Za-z0-9_%+-])?@(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,24}(?![A-Za-z0-9])")
NUMBER = re.compile(
    r"""(?<![\w.@])(?:
    (?P<iban>[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9]))
    |(?P<phone>(?:\+?1[\x20.-]?)?(?:\([0-9]{3}\)\x20?|[0-9]{3}[\x20.-])[0-9]{3}[\x20.-][0-9]{4}(?![0-9]|[.-][0-9]))
    |(?P<ip>[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9]|\.[0-9]))
    |(?P<ssn>[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9]|-[0-9]))
    |(?P<date>(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}|[0-9]{1,2}\.[0-9]{1,2}\.[0-9]{4})(?![0-9]|[./-][0-9]))
    |(?P<card>[0-9](?:[\x20-]?[0-9]){12,18}(?![0-9]))
    )""",
    re.X,
)
#: Digit groups a card may be written in, and beside, and a group of them.
RUN, DIGITS = re.compile("[0-9](?:[ -]?[0-9])*"), re.compile("[0-9]+")


class Feistel:
    """A keyed permutation of 0 .. size-1: an unbalanced network over two factors of about its root, walked until it lands inside."""

    def __init__(self, key: bytes, label: str, size: int) -> None:
        self.size = size
        self.left = int(size**0.5)
        while self.left * self.left < size:
            self.left += 1
        self.right = -(-size // self.left)
        self.key, self.label = key, label.encode()

    @lru_cache(100_000)  # noqa: B019  permutations live as long as their worker
    def _round(self, k: int, half: int) -> int:
        return int.from_bytes(hmac.digest(self.key, b"%s|%d|%d|%d" % (self.label, self.size, k, half), "sha256")[:16])

    def _once(self, x: int, back: bool) -> int:
        a, b = divmod(x, self.right)
        for k in reversed(range(ROUNDS)) if back else range(ROUNDS):
            sign = -1 if back else 1
            if k % 2:
                b = (b + sign * self._round(k, a)) % self.right
            else:
                a = (a + sign * self._round(k, b)) % self.left
        return a * self.right + b

    def __call__(self, x: int, back: bool = False) -> int:
        if self.size < 2:
            return x
        x = self._once(x, back)
        while x >= self.size:
            x = self._once(x, back)
        return x


def _mixed(value: list[int], sizes: list[int]) -> int:
    x = 0
    for v, n in zip(value, sizes):
        x = x * n + v
    return x


def _unmixed(x: int, sizes: list[int]) -> list[int]:
    out = []
    for n in reversed(sizes):
        x, v = divmod(x, n)
        out.append(v)
    return out[::-1]


def luhn(digits: str) -> int:
    """The check digit that follows these digits."""
    total = sum(int(c) if i % 2 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(digits)))
    return -total % 10


def _refill(old: str, new: str) -> str:
    """The new letters and digits in the old one's places, separators kept."""
    own = iter(new)
    return "".join(next(own) if c.isalnum() else c for c in old)


Spans = list[tuple[int, int, str]]


class Pseudonyms:
    """text → text with pseudonyms, counts by kind, and places and kinds of those that restore() inverts."""

    def __init__(self, key: bytes) -> None:
        self.key, self.back, self.made = key, False, {}

    def permuted(self, label: str, value: list[int], sizes: list[int]) -> list[int]:
        size = 1
        for n in sizes:
            size *= n
        if (label, size) not in self.made:
            self.made[label, size] = Feistel(self.key, label, size)
        return _unmixed(self.made[label, size](_mixed(value, sizes), self.back), sizes)

    def email(self, s: str) -> str | None:
        return f"u{hmac.digest(self.key, b'email|' + s.lower().encode(), 'sha256').hex()[:24]}@mail.invalid"

    @staticmethod
    def is_card(d: str) -> bool:
        return bool(ISSUED.match(d)) and luhn(d[:-1]) == int(d[-1])

    def cards(self, text: str, start: int, end: int) -> list[tuple[int, int]]:
        """Places of the valid cards in a run of digit groups: those that cover most digits, the earlier and longer ones of equals."""
        groups = [m.span() for m in DIGITS.finditer(text, start, end)]
        best, after = [0] * (len(groups) + 1), [0] * len(groups)
        for i in reversed(range(len(groups))):
            best[i], d = best[i + 1], ""
            for j in range(i, len(groups)):
                d += text[slice(*groups[j])] if groups[j][1] - groups[j][0] <= 19 else "0" * 20
                if len(d) > 19:
                    break
                if len(d) >= 13 and len(d) + best[j + 1] >= best[i] and self.is_card(d):
                    best[i], after[i] = len(d) + best[j + 1], j + 1
        out, i = [], 0
        while i < len(groups):
            if after[i]:
                out.append((groups[i][0], groups[after[i] - 1][1]))
            i = after[i] or i + 1
        return out

    def found(self, text: str) -> list[tuple[int, int, str]]:
        """Places and kinds of the valid numbers and dates, in order."""
        out: list[tuple[int, int, str]] = []
        ahead: list[tuple[int, int]] = []
        at = known = 0  # cards before `known` have been looked for: they are in `ahead`, last first
        while True:
            m = NUMBER.search(text, at, ahead[-1][0] if ahead else len(text))
            if m is None:
                if not ahead:
                    return out
                out.append((*ahead.pop(), "card"))
                at = out[-1][1]
                continue
            kind, start = m.lastgroup, m.start()
            ends = [m.end()] if kind != "card" else []
            if kind == "iban":
                ends += [e for e in reversed(range(start + 12, m.end())) if text[e] == " "]
            end = next((e for e in ends if (kind != "iban" or NUMBER.fullmatch(text, start, e)) and getattr(self, kind)(text[start:e]) is not None), None)
            if end is not None:
                out.append((start, end, kind))
                at = end
            elif start >= known and text[start].isdigit():
                run = RUN.match(text, start)
                known = run.end()
                ahead = self.cards(text, start, known)[::-1]
                at = start if ahead else start + 1
            else:
                at = start + 1

    def swapped(self, text: str, places: Spans) -> tuple[str, Spans]:
        """The text with what stands at some places permuted, and the places in the new text."""
        parts, spans, at, size = [], [], 0, 0
        for start, end, kind in places:
            new = getattr(self, kind)(text[start:end])
            parts += [text[at:start], new]
            size += start - at
            spans.append((size, size + len(new), kind))
            size, at = size + len(new), end
        return "".join([*parts, text[at:]]), spans

    def card(self, s: str) -> str | None:
        d = re.sub("[^0-9]", "", s)
        if not self.is_card(d):
            return None
        middle = self.permuted("card", [int(d[4:-1])], [10 ** (len(d) - 5)])[0]
        new = d[:4] + f"{middle:0{len(d) - 5}d}"
        return _refill(s, new + str(luhn(new)))

    def phone(self, s: str) -> str | None:
        d = re.sub("[^0-9]", "", s)
        head, d = d[:-10], d[-10:]
        dialled = lambda x: f"{x:010d}"[0] > "1" and f"{x:010d}"[3] > "1"
        x = new = int(d)
        while True:  # numbers that can be dialled stay so, others too: walking on until the kind is the same keeps the map one to one
            new = self.permuted("phone", [new], [10**10])[0]
            if dialled(new) == dialled(x):
                return _refill(s, f"{head}{new:010d}")

    def ip(self, s: str) -> str | None:
        parts = s.split(".")
        if any(int(p) > 255 or p != str(int(p)) for p in parts):
            return None
        return ".".join(map(str, self.permuted("ip", list(map(int, parts)), [256] * 4)))

    def ssn(self, s: str) -> str | None:
        a, b, c = map(int, s.split("-"))
        if a in (0, 666) or a > 899 or not b or not c:
            return None
        a, b, c = self.permuted("ssn", [a - 1 - (a > 666), b - 1, c - 1], [898, 99, 9999])
        a += 1
        return f"{a + (a >= 666):03d}-{b + 1:02d}-{c + 1:04d}"

    def date(self, s: str) -> str | None:
        mark = next(c for c in s if not c.isdigit())
        parts = s.split(mark)
        order = {"-": (0, 1, 2), "/": (2, 0, 1), ".": (2, 1, 0)}[mark]
        try:
            day = datetime.date(*(int(parts[k]) for k in order))
        except ValueError:
            return None
        first, last = datetime.date(1900, 1, 1).toordinal(), datetime.date(2099, 12, 31).toordinal()
        if not first <= day.toordinal() <= last:
            return None
        # One permutation for all formats, so that a day stays linked however it is written. It walks on to a day whose month and day of the month
        # have one digit where the old ones have, so that each part is written as long as before and the map stays one to one.
        short = lambda d: (d.month < 10, d.day < 10)
        new = day
        while True:
            new = datetime.date.fromordinal(first + self.permuted("date", [new.toordinal() - first], [last - first + 1])[0])
            if short(new) == short(day):
                break
        for k, value in zip(order, (new.year, new.month, new.day)):
            parts[k] = f"{value:0{len(parts[k])}d}"
        return mark.join(parts)

    def iban(self, s: str) -> str | None:
        d = s.replace(" ", "")
        number = lambda x: int("".join(str(int(c, 36)) for c in x))
        if not 15 <= len(d) <= 34 or number(d[4:] + d[:4]) % 97 != 1:
            return None
        sizes = [10 if c.isdigit() else 26 for c in d[4:]]
        value = [int(c) if c.isdigit() else ord(c) - 65 for c in d[4:]]
        body = "".join(str(v) if n == 10 else chr(65 + v) for v, n in zip(self.permuted("iban" + d[:2] + "".join("d" if n == 10 else "a" for n in sizes), value, sizes), sizes))
        return _refill(s, f"{d[:2]}{98 - number(body + d[:2] + '00') % 97:02d}{body}")

    def __call__(self, text: str | None) -> tuple[str | None, dict[str, int], Spans]:
        n = dict.fromkeys(KINDS, 0)
        spans: Spans = []
        if text and any(c in text for c in "0123456789"):
            text, spans = self.swapped(text, self.found(text))
        if text and "@" in text:
            text, spans, n["email"] = self.without_emails(text, spans)
        for *_, kind in spans:
            n[kind] += 1
        return text, n, spans

    def without_emails(self, text: str, spans: Spans) -> tuple[str, Spans, int]:
        """The text with its addresses replaced and the spans moved along; numbers inside an address go with it."""
        parts, kept, at, size, k, n = [], [], 0, 0, 0, 0
        for m in [*EMAIL.finditer(text), None]:
            start, end = m.span() if m else (len(text), len(text))
            while k < len(spans) and spans[k][0] < end:
                if spans[k][1] <= start:
                    kept.append((spans[k][0] - at + size, spans[k][1] - at + size, spans[k][2]))
                k += 1
            parts.append(text[at:start])
            size += start - at
            if m:
                parts.append(self.email(m[0]))
                size += len(parts[-1])
                n += 1
            at = end
        return "".join(parts), kept, n

    def restore(self, text: str | None, spans: Spans | None) -> str | None:
        """The text before its numbers and dates were permuted, for the holder of the key."""
        if not text or not spans:
            return text
        self.back = True
        try:
            return self.swapped(text, spans)[0]
        finally:
            self.back = False


SPANS = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("kind", T.StringType())]))


def pseudonymise(docs: DataFrame, key: bytes, carry: Column | str = "doc_id", text_col: str = "text", name: str = "doc_id") -> DataFrame:
    """One row for each row of docs: carry under name, text with pseudonyms, n_found, a count for each kind (n_email, n_iban, ...), and spans (start, end,
    kind in code points of the new text) of what restore() inverts.

    Whole texts, of which the longest must fit in a worker; null stays null with no counts above 0. What fails validation is left as it is. Repeated
    rows stay repeated; a null id stays null; other columns are not read; an empty table gives an empty one.
    """
    common.ship(docs.sparkSession)
    df = docs.select((F.col(common.quoted(carry)) if isinstance(carry, str) else carry).alias("carry"), docs[text_col].alias("text"))
    kinds = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string())]))

    def swapped(batches):
        make = Pseudonyms(key)
        for batch in batches:
            for part in common.pieces(batch):
                out = [make(t) for t in part.column(1).to_pylist()]
                counts = [pa.array([n[k] for _, n, _ in out], pa.int64()) for k in KINDS]
                spans = pa.array([[dict(zip(("start", "end", "kind"), x)) for x in own] for *_, own in out], kinds)
                yield pa.record_batch([part.column(0), pa.array([t for t, *_ in out], pa.string()), pa.array([sum(n.values()) for _, n, _ in out], pa.int64()), *counts, spans], names=["carry", "text", "n_found", *[f"n_{k}" for k in KINDS], "spans"])

    fields = [df.schema["carry"], T.StructField("text", T.StringType()), *[T.StructField(c, T.LongType()) for c in ("n_found", *(f"n_{k}" for k in KINDS))], T.StructField("spans", SPANS)]
    return df.mapInArrow(swapped, T.StructType(fields)).withColumnRenamed("carry", name)


def restore(pseudonymised: DataFrame, key: bytes, id_col: str = "doc_id", text_col: str = "text", spans_col: str = "spans") -> DataFrame:
    """id, text: the texts of pseudonymise() with their numbers and dates as they were, for the holder of the key. Null texts stay null; a row without
    spans stays as it is."""
    common.ship(pseudonymised.sparkSession)
    p = pseudonymised
    df = p.select(p[id_col].alias("id"), p[text_col].alias("text"), p[spans_col].alias("spans"))

    def restored(batches):
        make = Pseudonyms(key)
        for batch in batches:
            for part in common.pieces(batch):
                texts = [make.restore(t, [(x["start"], x["end"], x["kind"]) for x in own or ()]) for t, own in zip(part.column(1).to_pylist(), part.column(2).to_pylist())]
                yield pa.record_batch([part.column(0), pa.array(texts, pa.string())], names=["id", "text"])

    return df.mapInArrow(restored, T.StructType([df.schema["id"], T.StructField("text", T.StringType())])).withColumnRenamed("id", id_col)
