"""Conversation repair against a plain shortest-path search over whole conversations."""

import hashlib
import heapq
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from leafspan.llm import repair
from tests.llm.same import differ

PATTERN = re.compile(r"(s?(ua)+)?")


def cheapest(rows):
    """rows: (role initial, fault, truncated). Least (cost, edits) by Dijkstra over (row, roles so far reduced to what matters)."""
    able = lambda r: any(PATTERN.fullmatch(r + rest) for rest in ("", "a", "ua"))
    reduce = lambda r: r if len(r) < 3 else ("u" if r[-1] == "u" else "ua")
    queue, done = [(0, "", 0, "")], set()
    while queue:
        cost, edits, i, roles = heapq.heappop(queue)
        if (i, roles) in done:
            continue
        done.add((i, roles))
        if i == len(rows) and PATTERN.fullmatch(roles):
            return cost, edits
        steps = [(3, "I", i, c) for c in "ua"]
        if i < len(rows):
            kind, fault, cut = rows[i]
            steps.append((4, "D", i + 1, ""))
            if not fault:
                steps += [(3 * cut, "K", i + 1, kind)] + [(3 + 3 * cut, "R", i + 1, c) for c in "ua"]
        for c, e, k, more in steps:
            to = roles + more
            if able(to):
                heapq.heappush(queue, (cost + c, edits + e, k, reduce(to)))


def brute(rows):
    """conv → result, for rows conv, turn, role, text in any order."""
    by = {}
    for conv, turn, role, text in rows:
        own = by.setdefault(conv, [])
        name = lambda x: " " if x is None else str(x)
        kind = zlib.crc32(f"{name(conv)}:{name(turn)}".encode()) % 20
        role, text = name(role), name(text)
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        own += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    out = {}
    for conv, own in by.items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
        turns = {t for t, _, _ in own if t is not None}
        seen, faults, n = set(), [], [0, 0, 0]
        for _, role, text in own:
            letters = re.sub(r"[\x20\x09-\x0D]", "", text)
            kind = 0 if not letters else 1 if (role, text) in seen else 2 if letters[-1] not in ".!?" else None
            seen.add((role, text))
            if kind is not None:
                n[kind] += 1
            faults.append((role[:1] or " ", kind in (0, 1), kind == 2))
        initials = [f[0] for f in faults]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        cost, edits = cheapest(faults)
        fixed, left, last = [], iter(own), ""
        for e in edits:
            put = "assistant" if last == "u" else "user"
            if e == "D":
                next(left)
                continue
            role, text = next(left)[1:] if e in "KR" else (put, "")
            fixed.append((role if e == "K" else put, text))
            last = fixed[-1][0][:1]
        digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in fixed).encode()).hexdigest()
        out[conv] = (max(turns) - min(turns) + 1 - len(turns) if turns else 0, *n, illegal, cost, edits, digest)
    return out


def made(seed, lengths, odd=True):
    rng, rows = random.Random(seed), []
    for conv, n in enumerate(lengths):
        conv += seed * 1000
        for t in range(n):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", None]) if odd and rng.random() < 0.3 else ("user", "assistant")[t % 2]
            text = rng.choice(["Yes.", "no", "", " \t", None, "Why?  ", "é!\n", f"{t} words."]) if rng.random() < 0.5 else f"Turn {t} of {conv}."
            rows.append((conv, 2 * t + (rng.random() < 0.1), role, text))
    return rows


def check(spark, rows):
    # The order of different rows of one turn is the operator's own, so only the first of them stays.
    seen = set()
    rows = [r for r in rows if not ((r[0], r[1]) in seen or seen.add((r[0], r[1])))]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("conv", F.lit("clash")).withColumn("audit", F.lit(1)).repartition(3)
    key = lambda r: (r[0] is None, r[0] or 0)
    got = sorted((tuple(r) for r in repair.audit(df).collect()), key=key)
    want = sorted(((c, *r) for c, r in brute(rows).items()), key=key)
    assert not differ(got, want)
    return want


ODD = [(None, None, None, None), (None, 1, "user", "Hi."), (-1, None, "user", "Hi."), (-1, 0, "assistant", "Yo."), (-2, 5, "", ""), (-3, 2**40, "system", "x"), (-4, 0, "under", "Kept as a user's."), (-4, 1, "a", "ok!")]


def test_against_brute_force(spark):
    want = check(spark, ODD + made(1, [1, 2, 3, 5, 8, 13, 30] * 12))
    assert {e for r in want for e in r[7]} == set("DIKR")
    assert repair.audit(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


@pytest.mark.parametrize("stretch, block", [(16, 5), (4096, 64)])
def test_long_conversations(spark, monkeypatch, stretch, block):
    for name, value in (("LONG_ROWS", 20), ("STRETCH", stretch), ("BLOCK", block)):
        monkeypatch.setattr(repair, name, value)
    check(spark, ODD + made(2, [3, 25, 300, 21, 19, 90]) + [(None, t, "user", "Hm.") for t in range(2, 40)])


def test_table_data(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.01/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    check(spark, rows)


def test_blocks_give_the_same_path():
    rng = random.Random(7)
    solver = repair.Solver()
    for _ in range(300):
        codes = bytes(rng.randrange(4) | rng.choice([0, 0, 0, 4, 8, 16]) for _ in range(rng.randrange(60)))
        one = repair.search(codes, 0, repair.END) if codes else (0, "", 0)
        rows = [("?sua"[c & 3], bool(c & 12), bool(c & 16)) for c in codes]
        cost, edits = cheapest(rows)
        assert (one[0], one[1] + repair.TAIL[one[2]]) == (cost, edits)
        repair.BLOCK = 4
        try:
            assert repair.Solver().whole(codes) == (cost, edits) and solver.path(codes, 0, repair.END)[0] == cost
        finally:
            repair.BLOCK = 64


def test_search_is_quick_on_long_conversations():
    rng = random.Random(8)
    codes = bytes(rng.choice([2, 3, 2, 3, 1, 0, 6, 11, 18, 19]) for _ in range(20_000))
    assert len(repair.Solver().whole(codes)[1]) >= 20_000
