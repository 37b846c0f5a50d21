"""Conversation structure repair by iterative-deepening A*.

A conversation's rows are edited (kept, given another role, deleted, empty rows put in before them) until the initials of their roles read
`(s?(ua)+)?`. The search goes depth-first through the edits in ASCII order of their initials, under a cost bound that grows to the least cost that
went over it; a table of failed states, (row, state of the pattern) → what finishing from there costs at least, cuts off what fails again. The first
path that ends well is the cheapest, and the least in ASCII among equals.

Conversations of moderate length are repaired where they are grouped, with no further shuffle. A long one is cut into sorted ranges and those into
blocks of rows. A block's costs from each state to each other are found by the same search; least-cost products of them give what finishing costs after
each block. With that the search goes through all blocks at once, from each of the four states, and the right ones are chained. Edits that end a
block never begin another path's, so the least path of the whole is the least one of each block.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Costs of the edits, and the white space of a blank row.
DELETE, INSERT, REROLE, LEFT_TRUNCATED = 4, 3, 3, 3
WHITE = " \t\n\x0b\x0c\r"
#: Rows and bytes beyond which a conversation is cut, rows of a stretch of it, and rows that are searched at once.
LONG_ROWS, LONG_BYTES, STRETCH, BLOCK = 1024, 16 << 20, 4096, 64
#: Code sequences whose repair is remembered in a worker.
REMEMBERED = 50_000

#: Of a row: kind of role (other, s, u, a), and flags.
OTHER, SYSTEM, USER, ASSISTANT = range(4)
BLANK, DUPLICATE, TRUNCATED = 4, 8, 16
#: States of the pattern: nothing yet, then the kind that came last. What may be kept in each, and the one kind that may be put in.
KEEP = {0: (SYSTEM, USER), SYSTEM: (USER,), USER: (ASSISTANT,), ASSISTANT: (USER,)}
PUT = (USER, USER, ASSISTANT, USER)
ROLE = {USER: "user", ASSISTANT: "assistant"}
#: What the end of a conversation still costs in each state, in rows put in.
TAIL = ("", "II", "I", "")
END = tuple(INSERT * len(t) for t in TAIL)
INFINITE = 1 << 60


def search(codes: bytes, entry: int, ends) -> tuple[int, str, int]:
    """(cost, edits, state at the end) of the cheapest way through some rows from a state on, where ending in a state costs what `ends` says; the ASCII-least
    of them. Ends that cannot be reached must cost INFINITE unless another can."""
    n = len(codes)
    least = [0] * n + [min(ends)]
    for i in range(n - 1, -1, -1):
        c = codes[i]
        least[i] = least[i + 1] + (DELETE if c & (BLANK | DUPLICATE) else LEFT_TRUNCATED if c & TRUNCATED else 0)
    failed: dict[int, int] = {}
    edits: list[str] = []
    final = entry

    def go(i: int, state: int, left: int) -> int:
        """0 where the rest can be done within `left`, else more than `left` that it costs at least."""
        nonlocal final
        if i == n:
            if ends[state] <= left:
                final = state
                return 0
            return ends[state]
        at = i * 4 + state
        known = failed.get(at, least[i])
        if known > left:
            return known
        code = codes[i]
        kind = code & 3
        next_bound = INFINITE
        for edit in "DIKR":
            if edit == "D":
                cost, to, row = DELETE, state, i + 1
            elif edit == "I":
                cost, to, row = INSERT, PUT[state], i
            elif code & (BLANK | DUPLICATE):
                break
            elif edit == "K":
                if kind not in KEEP[state]:
                    continue
                cost, to, row = LEFT_TRUNCATED if code & TRUNCATED else 0, kind, i + 1
            else:
                cost, to, row = REROLE + (LEFT_TRUNCATED if code & TRUNCATED else 0), PUT[state], i + 1
            if cost > left:
                next_bound = min(next_bound, cost + least[row])
                continue
            over = go(row, to, left - cost)
            if not over:
                edits.append(edit)
                return 0
            next_bound = min(next_bound, cost + over)
        failed[at] = next_bound
        return next_bound

    bound = least[0]
    while over := go(0, entry, bound):
        if over >= INFINITE:
            raise ValueError("no way through")
        bound = over
    return bound, "".join(reversed(edits)), final


def costs(codes: bytes) -> list[list[int]]:
    """Least cost from each state to each other through a block's rows, INFINITE where there is no way."""
    leads = any(c & 3 == SYSTEM and not c & (BLANK | DUPLICATE) for c in codes)
    possible = lambda a, b: b in (USER, ASSISTANT) or a == b or a == 0 and b == SYSTEM and leads
    one = lambda b: [0 if x == b else INFINITE for x in range(4)]
    return [[search(codes, a, one(b))[0] if possible(a, b) else INFINITE for b in range(4)] for a in range(4)]


def joined(a: list[list[int]], b: list[list[int]]) -> list[list[int]]:
    """Costs through two blocks, one after the other."""
    return [[min(INFINITE, *(x + b[k][j] for k, x in enumerate(row))) for j in range(4)] for row in a]


def before(block: list[list[int]], after) -> list[int]:
    """What finishing costs in each state before a block, given what it costs after it."""
    return [min(c + x for c, x in zip(row, after)) for row in block]


class Solver:
    """Repairs sequences of codes; remembers those it has seen."""

    def __init__(self) -> None:
        self.blocks: dict[bytes, list[list[int]]] = {}
        self.found: dict[bytes, tuple[int, str]] = {}

    def block(self, codes: bytes) -> list[list[int]]:
        if codes not in self.blocks:
            if len(self.blocks) >= REMEMBERED // 10:
                self.blocks.clear()
            self.blocks[codes] = costs(codes)
        return self.blocks[codes]

    def through(self, codes: bytes) -> list[list[int]]:
        """costs() of any number of rows."""
        cuts = [codes[i : i + BLOCK] for i in range(0, len(codes), BLOCK)]
        out = self.block(cuts[0])
        for c in cuts[1:]:
            out = joined(out, self.block(c))
        return out

    def path(self, codes: bytes, entry: int, ends) -> tuple[int, str, int]:
        """As search(), for any number of rows."""
        cuts = [codes[i : i + BLOCK] for i in range(0, len(codes), BLOCK)]
        after = [list(ends)]
        for c in reversed(cuts[1:]):
            after.append(before(self.block(c), after[-1]))
        total, state, edits = None, entry, []
        for c, e in zip(cuts, reversed(after)):
            cost, own, state = search(c, state, e)
            total = cost if total is None else total
            edits.append(own)
        return total or 0, "".join(edits), state

    def whole(self, codes: bytes) -> tuple[int, str]:
        """(cost, edits) of a whole conversation."""
        if codes not in self.found:
            if len(self.found) >= REMEMBERED:
                self.found.clear()
            cost, edits, state = self.path(codes, 0, END)
            self.found[codes] = cost, edits + TAIL[state]
        return self.found[codes]


def kind_of(role: str) -> int:
    return " sua".find(role[0]) if role and role[0] in "sua" else OTHER


def code_of(role: str, text: str, seen: set) -> int:
    """Kind of a row's role and its first fault; `seen` has the rows before it."""
    bare = text.strip(WHITE)
    code = kind_of(role)
    if not bare:
        code |= BLANK
    elif (role, text) in seen:
        code |= DUPLICATE
    elif bare[-1] not in ".!?":
        code |= TRUNCATED
    seen.add((role, text))
    return code


def legal(a: int, b: int) -> bool:
    return (a & 3, b & 3) in ((SYSTEM, USER), (USER, ASSISTANT), (ASSISTANT, USER))


def illegal(codes: bytes) -> int:
    return sum(not legal(a, b) for a, b in zip(codes, codes[1:]))


def applied(edits: str, rows: list[tuple[str, str]], state: int = 0) -> list[tuple[str, str]]:
    """Rows after the edits, which are those of a path from a state on."""
    out, left = [], iter(rows)
    for edit in edits:
        if edit == "D":
            next(left)
            continue
        if edit == "K":
            role, text = next(left)
            state = kind_of(role)
        else:
            state = PUT[state]
            role, text = ROLE[state], next(left)[1] if edit == "R" else ""
        out.append((role, text))
    return out


def damage(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Rows damaged by the CRC-32 of `conversation:turn` modulo 20: 0 is dropped, 1 loses its text, 2 its sentence ends, 3 is repeated, 4 is the user's; nulls
    in role and text, and in the two numbers where they are hashed, are one space. Columns conv, turn, role, text; all expressions, no shuffle."""
    name = lambda c: F.coalesce(turns[c].cast("string"), F.lit(" "))
    kind = F.pmod(F.crc32(F.encode(F.concat(name(conv_col), F.lit(":"), name(turn_col)), "UTF-8")), F.lit(20))
    text, role = name(text_col), name(role_col)
    text = F.when(kind == 1, "").when(kind == 2, F.translate(text, ".!?", "")).otherwise(text)
    rows = turns.select(turns[conv_col].alias("conv"), turns[turn_col].cast("long").alias("turn"), F.when(kind == 4, "user").otherwise(role).alias("role"), text.alias("text"), kind.alias("kind"))
    return rows.where("kind <> 0").withColumn("again", F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))).select("conv", "turn", "role", "text")


REPORT = "struct<gaps: bigint, blank: bigint, duplicate: bigint, truncated: bigint, illegal: bigint, cost: bigint>"
TURNS = "array<struct<role: string, text: string>>"


def _turns(lists: list[list[tuple[str, str]]]) -> pa.Array:
    ends = [0]
    for rows in lists:
        ends.append(ends[-1] + len(rows))
    pair = pa.StructArray.from_arrays([pa.array([r[k] for rows in lists for r in rows], pa.string()) for k in (0, 1)], names=["role", "text"])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pair)


def _report(rows: list[tuple]) -> pa.Array:
    """The report column from tuples, or None where a row has none."""
    names = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    return pa.array([None if r is None else dict(zip(names, r)) for r in rows], pa.struct([(n, pa.int64()) for n in names]))


def gaps(turns: list[int | None]) -> int:
    there = {t for t in turns if t is not None}
    return max(there) - min(there) + 1 - len(there) if there else 0


def counts(codes: bytes) -> tuple[int, int, int]:
    return tuple(sum(bool(c & flag) for c in codes) for flag in (BLANK, DUPLICATE, TRUNCATED))


def _short(rows: DataFrame) -> DataFrame:
    """Conversations that each fit in a worker: one row each."""
    kind = rows.schema["conv"].dataType.simpleString()

    def repaired(batches):
        solver = common.kept("repair", Solver)

        def out(groups, conv_type):
            found = []
            for conv, turn, own in groups:
                seen: set = set()
                codes = bytes(code_of(r, t, seen) for r, t in own)
                cost, edits = solver.whole(codes)
                found.append((conv, edits, applied(edits, own), (gaps(turn), *counts(codes), illegal(codes), cost)))
            conv, edits, turns, report = zip(*found)
            n = len(found)
            return pa.record_batch([pa.array(conv, conv_type), pa.array([0] * n, pa.int64()), pa.array([True] * n), pa.array(edits, pa.string()), _turns(list(turns)), _report(list(report))], names=["conv", "at", "whole", "edits", "turns", "report"])

        groups: list[tuple] = []
        conv_type = None
        for batch in batches:
            conv_type = batch.schema.field(0).type
            for part in common.pieces(batch):
                for conv, turn, role, text in zip(*(c.to_pylist() for c in part.columns)):
                    if not groups or groups[-1][0] != conv:
                        if len(groups) >= 256:
                            yield out(groups, conv_type)
                            groups = []
                        groups.append((conv, [], []))
                    groups[-1][1].append(turn)
                    groups[-1][2].append((role, text))
        if groups:
            yield out(groups, conv_type)

    dealt = rows.repartition("conv").sortWithinPartitions("conv", "turn", "role", F.xxhash64("text"), "text")
    return dealt.mapInArrow(common.thrifty(repaired), f"conv {kind}, at bigint, whole boolean, edits string, turns {TURNS}, report {REPORT}")


def _ranges(rows: DataFrame) -> DataFrame:
    """The rows of long conversations in sorted ranges: at (range and place in it), their code but for duplicates, and a digest of role and text."""
    kind = rows.schema["conv"].dataType.simpleString()

    def placed(batches):
        import xxhash
        from pyspark import TaskContext

        at = TaskContext.get().partitionId() << 40
        for batch in batches:
            for part in common.pieces(batch):
                role, text = part.column(2).to_pylist(), part.column(3).to_pylist()
                codes = [code_of(r, t, set()) for r, t in zip(role, text)]
                digest = [xxhash.xxh3_128_digest(f"{len(r)}:{r}{t}".encode()) for r, t in zip(role, text)]
                yield pa.record_batch([*part.columns, pa.array(range(at, at + len(codes)), pa.int64()), pa.array(codes, pa.int32()), pa.array(digest, pa.binary())], names=["conv", "turn", "role", "text", "at", "code", "digest"])
                at += len(codes)

    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.withColumn("tie", F.xxhash64("text")).repartitionByRange(n, "conv", "turn", "role", "tie").sortWithinPartitions("conv", "turn", "role", "tie", "text")
    out = dealt.select("conv", "turn", "role", "text").mapInArrow(common.thrifty(placed), f"conv {kind}, turn bigint, role string, text string, at bigint, code int, digest binary")
    return common.saved(out, "long-rows")


def _stretches(rows: DataFrame) -> DataFrame:
    """Codes of up to STRETCH neighbouring rows of a conversation: conv, first (place of the first), codes."""
    # The first of equal rows is found by an aggregate, so that no text is hot; the others are duplicates.
    firsts = rows.groupBy("conv", "digest").agg(F.min("at").alias("at")).select("at", F.lit(True).alias("is_first"))
    flag = F.when(F.col("is_first").isNull() & (F.col("code").bitwiseAND(BLANK) == 0), F.col("code").bitwiseAND(3).bitwiseOR(DUPLICATE)).otherwise(F.col("code"))
    coded = rows.select("conv", "at", "code").join(firsts, "at", "left").select("conv", "at", flag.alias("code"))
    slots = coded.groupBy("conv", F.floor(F.col("at") / STRETCH).alias("slot")).agg(F.array_sort(F.collect_list(F.struct("at", "code"))).alias("rows"))
    return common.saved(slots.select("conv", F.col("rows")[0]["at"].alias("first"), F.col("rows.code").cast("array<int>").alias("codes")), "stretches")


def _each(df: DataFrame, make, schema: str) -> DataFrame:
    """One row for each row, made by a plain function of its values."""

    kinds = _arrow_schema(schema)

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                found = [make(*row) for row in zip(*(c.to_pylist() for c in batch.columns))]
                yield pa.record_batch([pa.array(col, f.type) for col, f in zip(zip(*found), kinds)], schema=kinds)

    return df.mapInArrow(common.thrifty(run), schema)


def _arrow_schema(schema: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(schema))


def _long(rows: DataFrame) -> DataFrame:
    """Conversations too long for one worker: one row for each of their rows."""
    kind = rows.schema["conv"].dataType.simpleString()
    rows = _ranges(rows)
    stretches = _stretches(rows)

    def measured(conv, first, codes):
        codes = bytes(codes)
        return conv, first, [x for row in common.kept("repair", Solver).through(codes) for x in row], codes[0] & 3, codes[-1] & 3, [*counts(codes), illegal(codes)]

    measures = common.saved(_each(stretches, measured, f"conv {kind}, first bigint, costs array<bigint>, head int, last int, counts array<bigint>"), "measures")

    def ended(table: pa.Table) -> pa.Table:
        """What finishing costs after each stretch of one conversation, and its counts; a conversation has one for each STRETCH rows."""
        own = sorted(table.to_pylist(), key=lambda r: r["first"])
        after, total = list(END), [0] * 4
        out = []
        for k in range(len(own) - 1, -1, -1):
            r = own[k]
            out.append((r["conv"], r["first"], after, k + 1 == len(own)))
            after = before([r["costs"][i : i + 4] for i in range(0, 16, 4)], after)
            total = [a + b for a, b in zip(total, r["counts"])]
            if k:
                total[3] += not legal(own[k - 1]["last"], r["head"])
        rows = [(*r, [*total, after[0]] if r[1] == own[0]["first"] else None) for r in out]
        return pa.table([pa.array(c, f.type) for c, f in zip(zip(*rows), kinds)], schema=kinds)

    schema = f"conv {kind}, first bigint, after array<bigint>, at_end boolean, totals array<bigint>"
    kinds = _arrow_schema(schema)
    ends = common.saved(measures.groupBy("conv").applyInArrow(ended, schema), "ends")

    def walked(conv, first, codes, after, at_end):
        solver = common.kept("repair", Solver)
        found = [solver.path(bytes(codes), state, after)[1:] for state in range(4)]
        return conv, first, codes, [e + (TAIL[s] if at_end else "") for e, s in found], [s for _, s in found]

    walks = stretches.join(ends.select("first", "after", "at_end"), "first").select("conv", "first", "codes", "after", "at_end")
    walks = common.saved(_each(walks, walked, f"conv {kind}, first bigint, codes array<int>, edits array<string>, exits array<int>"), "walks")

    def chained(table: pa.Table) -> pa.Table:
        own = sorted(zip(table.column("first").to_pylist(), table.column("exits").to_pylist()))
        state, entries = 0, []
        for _, exits in own:
            entries.append(state)
            state = exits[state]
        return pa.table({"first": pa.array([f for f, _ in own], pa.int64()), "entry": pa.array(entries, pa.int32())})

    entries = walks.select("conv", "first", "exits").groupBy("conv").applyInArrow(chained, "first bigint, entry int")
    chosen = walks.join(entries, "first").select("first", "codes", "entry", F.col("edits")[F.col("entry")].alias("edits"))

    def split(batches):
        for batch in batches:
            for first, codes, entry, edits in zip(*(c.to_pylist() for c in batch.columns)):
                states, own = by_row(bytes(codes), entry, edits)
                yield pa.record_batch([pa.array(range(first, first + len(own)), pa.int64()), pa.array(states, pa.int32()), pa.array(own, pa.string())], names=["at", "state", "edits"])

    edits = chosen.mapInArrow(common.thrifty(split), "at bigint, state int, edits string")

    def edited(conv, at, role, text, state, own, totals):
        return conv, at, False, own, applied(own, [(role, text)], state), totals

    totals = ends.where("totals is not null").select(F.col("first").alias("at"), "totals")
    spans = rows.groupBy("conv").agg(F.coalesce(F.max("turn") - F.min("turn") + 1 - F.countDistinct("turn"), F.lit(0)).alias("gaps"), F.min("at").alias("at")).select("at", "gaps")
    totals = totals.join(spans, "at").select("at", F.concat(F.array("gaps"), "totals").alias("totals"))
    out = rows.select("conv", "at", "role", "text").join(edits, "at").join(totals, "at", "left").select("conv", "at", "role", "text", "state", "edits", "totals")
    out = _each(out, edited, f"conv {kind}, at bigint, whole boolean, edits string, turns {TURNS}, totals array<bigint>")
    names = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    report = F.when(F.col("totals").isNotNull(), F.struct(*[F.col("totals")[k].alias(n) for k, n in enumerate(names)]))
    return out.select("conv", "at", "whole", "edits", "turns", report.alias("report"))


def by_row(codes: bytes, state: int, edits: str) -> tuple[list[int], list[str]]:
    """Of edits from a state on: for each row the state before its part and its part, the rows put in before it and its own edit; what is put in after the
    last row is that row's too."""
    states, own = [state], [""]
    for edit in edits:
        done = len(own) - (not own[-1] or own[-1][-1] == "I")
        if own[-1] and own[-1][-1] != "I" and len(own) < len(codes):
            states.append(state)
            own.append("")
        own[-1] += edit
        state = codes[done] & 3 if edit == "K" else state if edit == "D" else PUT[state]
    return states, own


def repair(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Conversations with their faults counted and repaired, as rows conv, at, whole, edits, turns, report.

    A conversation's rows are taken by turn, nulls first, and where turns are equal by role and a hash of the text. A conversation of moderate size is one
    row with `whole` true; a longer one has a row with `whole` false for each of its rows, in order of `at`, and its report (else null) in the first. Edits
    are initials of the cheapest edits, turns the repaired rows. Null roles and texts are one space; a role without letters is like none of the pattern's;
    repeated rows are duplicates; null conversations are one; other columns are not read; an empty table gives an empty one. The longest text must fit in
    a worker, and with it LONG_BYTES.
    """
    short, long = _repaired(turns, conv_col, turn_col, role_col, text_col)
    return short if long is None else short.unionByName(long)


def _repaired(turns: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> tuple[DataFrame, DataFrame | None]:
    """repair() of the conversations of moderate size and of the longer ones, None where there are none."""
    common.ship(turns.sparkSession)
    text = lambda c: F.coalesce(turns[c].cast("string"), F.lit(" "))
    rows = turns.select(turns[conv_col].alias("conv"), turns[turn_col].cast("long").alias("turn"), text(role_col).alias("role"), text(text_col).alias("text"))
    sizes = rows.groupBy("conv").agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("bytes"))
    large = common.saved(sizes.where((F.col("n") > LONG_ROWS) | (F.col("bytes") > LONG_BYTES)).select(F.col("conv").alias("large")), "long-conversations")
    if large.isEmpty():
        return _short(rows), None
    n_bytes = large.agg(F.sum(16 + F.coalesce(F.octet_length(F.col("large").cast("string")), F.lit(0)))).first()[0]
    mark = F.broadcast(large) if n_bytes <= common.SMALL else large
    same = rows["conv"].eqNullSafe(mark["large"])
    return _short(rows.join(mark, same, "left_anti")), _long(rows.join(mark, same, "left_semi"))


def digest(repaired: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    """One row for each conversation of repair(): its report's columns, audit (all edits) and repaired_sha256 (of its `role:text` joined by new lines). Long
    ones are streamed through a digest in order, and so are in one task each but never in memory. An empty table gives an empty one."""
    return _whole_digest(repaired.where("whole"), conv_col).unionByName(_streamed_digest(repaired.where("not whole"), conv_col))


LINE = "transform(turns, t -> concat(t.role, ':', t.text))"


def _whole_digest(repaired: DataFrame, conv_col: str) -> DataFrame:
    sha = F.sha2(F.concat_ws("\n", F.expr(LINE)), 256)
    return repaired.select(F.col("conv").alias(conv_col), "report.*", F.col("edits").alias("audit"), sha.alias("repaired_sha256"))


def _streamed_digest(repaired: DataFrame, conv_col: str) -> DataFrame:
    kind = repaired.schema["conv"].dataType.simpleString()
    schema = _arrow_schema(f"conv {kind}, report {REPORT}, audit string, repaired_sha256 string")

    def streamed(batches):
        import hashlib

        made = lambda s: pa.record_batch([pa.array([x], f.type) for x, f in zip((s[0], s[1], "".join(s[2]), s[3].hexdigest()), schema)], schema=schema)
        state = None
        for batch in batches:
            for part in common.pieces(batch):
                for conv, report, edits, lines in zip(*(c.to_pylist() for c in part.columns)):
                    if state is None or state[0] != conv:
                        if state:
                            yield made(state)
                        state = [conv, None, [], hashlib.sha256(), b""]
                    state[1] = state[1] or report
                    state[2].append(edits)
                    for text in lines:
                        state[3].update(state[4] + text.encode())
                        state[4] = b"\n"
        if state:
            yield made(state)

    rows = repaired.select("conv", "report", "edits", F.expr(LINE).alias("lines"), "at").repartition("conv").sortWithinPartitions("conv", "at").drop("at")
    out = rows.mapInArrow(common.thrifty(streamed), f"conv {kind}, report {REPORT}, audit string, repaired_sha256 string")
    return out.select(F.col("conv").alias(conv_col), "report.*", "audit", "repaired_sha256")


def audit(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """digest() of the repaired damage() of some conversations, with a row for every conversation: where no row is left, zeros, no edits and the digest of
    nothing."""
    short, long = _repaired(damage(conversations, conv_col, turn_col, role_col, text_col), "conv", "turn", "role", "text")
    found = _whole_digest(short, "found")
    if long is not None:
        found = found.unionByName(_streamed_digest(long, "found"))
    ids = conversations.select(conversations[conv_col].alias(conv_col)).distinct()
    out = ids.join(found, ids[conv_col].eqNullSafe(found["found"]), "left")
    numbers = [F.coalesce(n, F.lit(0)).alias(n) for n in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return out.select(conv_col, *numbers, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))
