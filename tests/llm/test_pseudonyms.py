"""Pseudonyms against a finder and a permutation written plainly, and their inversion."""

import datetime
import hmac
import math
import random
import re

from leafspan.llm import pseudonyms
from tests.llm.same import differ

SF = "/root/testdata/sf0.01"
KEY = b"k"


def permute(label, size, x):
    if size < 2:
        return x
    left = math.isqrt(size - 1) + 1
    right = (size + left - 1) // left
    f = lambda k, half: int.from_bytes(hmac.new(KEY, f"{label}|{size}|{k}|{half}".encode(), "sha256").digest()[:16])
    while True:
        a, b = x // right, x % right
        for k in range(0, 8, 2):
            a = (a + f(k, b)) % left
            b = (b + f(k + 1, a)) % right
        x = a * right + b
        if x < size:
            return x


def check_digit(digits):
    for c in range(10):
        total = 0
        for k, d in enumerate(reversed(digits + str(c))):
            d = int(d) * (1 + k % 2)
            total += d // 10 + d % 10
        if total % 10 == 0:
            return str(c)


ISSUED = [str(k) for k in (*range(40, 50), 51, 52, 53, 54, 55, *range(2221, 2230), *range(223, 230), *range(23, 27), 270, 271, 2720, 30, 34, 35, 36, 37, 38, 6011, 62, 64, 65)] + [str(k) for k in range(4, 5)]


def put(old, new):
    new = list(new)
    return "".join(new.pop(0) if c.isalnum() else c for c in old)


def is_card(d):
    return 13 <= len(d) <= 19 and any(d.startswith(p) for p in ISSUED) and d[-1] == check_digit(d[:-1])


def card(s):
    d = re.sub(r"\D", "", s)
    n = len(d) - 5
    new = d[:4] + str(permute("card", 10**n, int(d[4:-1]))).zfill(n)
    return put(s, new + check_digit(new))


def phone(s):
    d = re.sub(r"\D", "", s)
    ok = lambda x: str(x).zfill(10)[0] in "23456789" and str(x).zfill(10)[3] in "23456789"
    x = old = int(d[-10:])
    x = permute("phone", 10**10, x)
    while ok(x) != ok(old):
        x = permute("phone", 10**10, x)
    return put(s, d[:-10] + str(x).zfill(10))


def ip(s):
    p = s.split(".")
    if any(int(x) > 255 or str(int(x)) != x for x in p):
        return None
    x = permute("ip", 256**4, sum(int(v) * 256 ** (3 - k) for k, v in enumerate(p)))
    return ".".join(str(x // 256 ** (3 - k) % 256) for k in range(4))


def ssn(s):
    a, b, c = map(int, s.split("-"))
    areas = [k for k in range(1, 900) if k != 666]
    if a not in areas or b == 0 or c == 0:
        return None
    x = permute("ssn", 898 * 99 * 9999, (areas.index(a) * 99 + b - 1) * 9999 + c - 1)
    return f"{areas[x // 9999 // 99]:03d}-{x // 9999 % 99 + 1:02d}-{x % 9999 + 1:04d}"


def date(s):
    parts = re.split(r"\D", s)
    y, m, d = parts if "-" in s else (parts[2], parts[0], parts[1]) if "/" in s else (parts[2], parts[1], parts[0])
    try:
        day = datetime.date(int(y), int(m), int(d))
    except ValueError:
        return None
    start = datetime.date(1900, 1, 1)
    if not 1900 <= day.year < 2100:
        return None
    x = day
    while True:
        x = start + datetime.timedelta(permute("date", 73049, (x - start).days))
        if (x.month < 10, x.day < 10) == (day.month < 10, day.day < 10):
            break
    new = [str(x.year).zfill(len(y)), str(x.month).zfill(len(m)), str(x.day).zfill(len(d))]
    return "-".join(new) if "-" in s else "/".join([new[1], new[2], new[0]]) if "/" in s else ".".join(new[::-1])


def iban(s):
    d = s.replace(" ", "")
    rest = lambda t: int("".join(str("0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ".index(c)) for c in t[4:] + t[:4])) % 97
    if not 15 <= len(d) <= 34 or rest(d) != 1:
        return None
    shape = "".join("d" if c.isdigit() else "a" for c in d[4:])
    sizes = [10 if c == "d" else 26 for c in shape]
    x, size = 0, 1
    for c, n in zip(d[4:], sizes):
        x, size = x * n + (int(c) if n == 10 else ord(c) - 65), size * n
    x, body = permute(f"iban{d[:2]}{shape}", size, x), ""
    for n in reversed(sizes):
        body = (str(x % 10) if n == 10 else chr(65 + x % 26)) + body
        x //= n
    return put(s, next(d[:2] + f"{k:02d}" + body for k in range(2, 99) if rest(d[:2] + f"{k:02d}" + body) == 1))


def chosen(text, start, end):
    """The cards among the digit groups of a run: most digits, then the longer and earlier."""
    groups = [(m.start(), m.end()) for m in re.finditer("[0-9]+", text[:end]) if m.start() >= start]

    def best(i):
        if i == len(groups):
            return 0, []
        top = best(i + 1)
        for j in range(i, min(len(groups), i + 19)):
            d = "".join(text[a:b] for a, b in groups[i : j + 1])
            if is_card(d):
                n, after = best(j + 1)
                if n + len(d) >= top[0]:
                    top = n + len(d), [(groups[i][0], groups[j][1]), *after]
        return top

    return best(0)[1]


def ends_of(text, i):
    """Where a number or date could end that begins at i, by kind, in the order they are tried."""
    at = lambda p: [m.end() for m in [re.compile(p).match(text, i)] if m]
    whole = at(r"[A-Z]{2}[0-9]{2}( ?[A-Z0-9]{4}){2,7}( ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
    fits = lambda e: re.compile(r"[A-Z]{2}[0-9]{2}( ?[A-Z0-9]{4}){2,7}( ?[A-Z0-9]{1,3})?").fullmatch(text, i, e)
    ibans = [e for e in range(whole[0] if whole else 0, i + 11, -1) if e == whole[0] or text[e] == " " and fits(e)]
    yield iban, "iban", ibans
    yield phone, "phone", [] if whole else at(r"(\+?1[ .-]?)?(\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9]|[.-][0-9])")
    yield ip, "ip", at(r"[0-9]{1,3}(\.[0-9]{1,3}){3}(?![0-9]|\.[0-9])")
    yield ssn, "ssn", at(r"[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9]|-[0-9])")
    yield date, "date", at(r"([0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}|[0-9]{1,2}\.[0-9]{1,2}\.[0-9]{4})(?![0-9]|[./-][0-9])")


def plain(text):
    """The text with pseudonyms, and how many of each kind."""
    n = dict.fromkeys(pseudonyms.KINDS, 0)
    if not text:
        return text, n
    out, i, known, ahead = "", 0, 0, []
    while i < len(text):
        if ahead and i == ahead[0][0]:
            start, i = ahead.pop(0)
            out += card(text[start:i])
            n["card"] += 1
            continue
        head = text[: ahead[0][0]] if ahead else text
        if i and (text[i - 1].isalnum() or text[i - 1] in "_.@") or not (text[i].isdigit() or text[i] in "+(" or text[i].isupper()):
            out, i = out + text[i], i + 1
            continue
        hit = next(((make(text[i:e]), kind, e) for make, kind, ends in ends_of(head, i) for e in ends if make(text[i:e]) is not None), None)
        if hit:
            out, i = out + hit[0], hit[2]
            n[hit[1]] += 1
        elif i >= known and text[i] in "0123456789" and not ahead and (any(ends for *_, ends in ends_of(text, i)) or re.compile(r"[0-9]([ -]?[0-9]){12,18}(?![0-9])").match(text, i)):
            run = re.compile("[0-9]([ -]?[0-9])*").match(text, i)
            known, ahead = run.end(), chosen(text, i, run.end())
            if not ahead:
                out, i = out + text[i], i + 1
        else:
            out, i = out + text[i], i + 1
    for m in reversed([*re.finditer(r"[A-Za-z0-9_%+-]([A-Za-z0-9._%+-]{0,62}[A-Za-z0-9_%+-])?@([A-Za-z0-9-]+\.)+[A-Za-z]{2,24}(?![A-Za-z0-9])", out)]):
        out = f"{out[: m.start()]}u{hmac.new(KEY, b'email|' + m[0].lower().encode(), 'sha256').hexdigest()[:24]}@mail.invalid{out[m.end() :]}"
        n["email"] += 1
    return out, n


def test_against_a_plain_finder(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    odd = [(None, "on 3/9/1999"), (-5, None), (-5, None), (-6, ""), (-7, "ssn 123-45-6789, 666-12-1234; ip 1.2.3.4, 1.2.3.4.5"), (-8, "GB82 WEST 1234 5698 7654 32 and DE89370400440532013000 x"), (-9, "4111 1111 1111 1111 123 / 12 4111-1111-1111-1111"), (-10, "é@x.example.com a.b@x.example.com +1 (743) 555-3824")]
    docs = docs.unionByName(spark.createDataFrame(odd, docs.schema))
    order = lambda r: (r[0] is None, r[0] or 0, r[1] or "")
    rows = docs.collect()
    want = sorted(((r.doc_id, text, sum(n.values()), *(n[k] for k in pseudonyms.KINDS)) for r in rows for text, n in [plain(r.text)]), key=order)
    made = pseudonyms.pseudonymise(docs.repartition(5), KEY)
    got = sorted((tuple(r)[:-1] for r in made.collect()), key=order)
    assert not differ(got, want) and sum(r[2] for r in want) > 80
    # With the spans of each row the holder of the key has the texts back, but for addresses.
    back = sorted((tuple(r) for r in pseudonyms.restore(made.where("n_email = 0"), KEY).collect()), key=order)
    without = {r[:2] for r in want if r[3] == 0}
    assert back == sorted(((r.doc_id, r.text) for r in rows if (r.doc_id, plain(r.text)[0]) in without), key=order)


def digits(rng, k):
    return "".join(rng.choice("0123456789") for _ in range(k))


def some_card(rng):
    d = rng.choice("45") + rng.choice("12345") + digits(rng, rng.choice([11, 13, 13, 13]))
    d += check_digit(d)
    return rng.choice([d, re.sub("(....)(?=.)", r"\1 ", d), re.sub("(....)(?=.)", r"\1-", d)])


def test_values_do_not_depend_on_neighbours():
    make, rng = pseudonyms.Pseudonyms(KEY), random.Random(3)
    other = 0
    for _ in range(400):
        own = "4" + digits(rng, 14)
        own = re.sub("(....)(?=.)", r"\1 ", own + check_digit(own))
        text = f"{digits(rng, 4)} {own} {digits(rng, 3)}"
        out, n, spans = make(text)
        assert make.restore(out, spans) == text
        if [text[a:b] for a, b, _ in make.found(text)] == [own]:
            other += make(own)[0] not in out
    assert other == 0


def test_any_neighbours_invert():
    make, rng = pseudonyms.Pseudonyms(KEY), random.Random(7)
    for _ in range(1500):
        parts = [rng.choice([lambda: some_card(rng), lambda: some_card(rng), lambda: digits(rng, rng.randint(1, 6)), lambda: "4" + digits(rng, 3), lambda: "212-555-0199", lambda: "GB82 WEST 1234 5698 7654 32", lambda: "1.2.3.4", lambda: "2024-02-30", lambda: "EUR"])() for _ in range(rng.randint(1, 6))]
        text = "".join(p + rng.choice([" ", "-", ", ", "  "]) for p in parts)
        out, n, spans = make(text)
        assert make.restore(out, spans) == text and out == plain(text)[0], text
    assert make("12 " * 30_000)[0] == "12 " * 30_000
    text = "mail 10.0.0.1 to a.b@x.example.com by 2024-02-29, or 2024-02-28@x.example.com"
    out, n, spans = make(text)
    assert n["email"] == 2 and n["ip"] == 1 and n["date"] == 1 and make.restore(out, spans).startswith("mail 10.0.0.1 to u") and " by 2024-02-29, or u" in make.restore(out, spans)
