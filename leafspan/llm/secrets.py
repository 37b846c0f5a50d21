"""Secret scans with multipart credential linking, all in DataFrame functions.

Strong kinds (assign, access, hex) are reported by themselves. Weak candidates — a user or client name, an unlabelled long token, an endpoint —
mean little alone; they are reported only when complementary parts of a credential start within the same scope, `SCOPE` code points either
way: a name needs a secret, a token needs a name or an endpoint, an endpoint needs both. The link is an interval join inside each text: all
spans are sorted by start, and since spans of one kind do not overlap and have a least length, no scope holds more than `BAND` of them, so the
join looks at that many neighbours on either side. The work is linear in the number of spans, with no shuffle and no Python.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

#: Kinds in their order of rank, with their patterns and the least length of a match (of the value for assign).
KINDS = ["assign", "access", "hex", "linked_name", "linked_token", "linked_endpoint"]
ASSIGN = r"""(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]+"""
VALUE = r"""^[A-Za-z_]+["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)$"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{24,}"
NAME = r"""(?:[uU][sS][eE][rR](?:[nN][aA][mM][eE])?|[lL][oO][gG][iI][nN]|[cC][lL][iI][eE][nN][tT]_?[iI][dD]|[aA][cC][cC][oO][uU][nN][tT])["']?\x20*[:=]\x20*["']?[A-Za-z0-9@._-]{4,}"""
TOKEN = r"[A-Za-z0-9+/_=-]{24,}"
ENDPOINT = r"""(?:https?|jdbc:[a-z]+|postgres|mysql|redis|amqps?|s3|ftp)://[A-Za-z0-9._~:/?#@!$&()*+,;=%-]+"""

#: How far apart, in code points, the starts of linked parts may be; and how many spans can start within that on one side: by least lengths of 12, 20, 24, 9, 24 and 6 (s3://a).
SCOPE = 200
BAND = sum(SCOPE // least + 1 for least in (12, 20, 24, 9, 24, 6))

#: Marks the ends of matches inside a text; an equal character of the text itself is swapped for the other one, which no pattern matches either.
MARK, OTHER = "\ue000", "\ue001"
BLOCK = 512


def _parts(text: Column, pattern: str, hint: Column) -> Column:
    """The text cut at the ends of the leftmost non-overlapping matches: every second part is a match. hint is cheap and true wherever there are any."""
    return F.when(hint, F.split(F.regexp_replace(text, pattern, f"{MARK}$0{MARK}"), MARK)).otherwise(F.array(F.lit("")))


def _blocks(parts: Column) -> Column:
    """Lengths summed and matches gathered in blocks of parts, so that the work stays about linear: array of (pos, odd, spans)."""
    none = F.expr("cast(array() as array<struct<start: bigint, end: bigint, match: string>>)")

    def step(acc: Column, part: Column) -> Column:
        end = acc["pos"] + F.length(part)
        found = F.struct(acc["pos"].alias("start"), end.alias("end"), part.alias("match"))
        return F.struct(end.alias("pos"), (1 - acc["odd"]).alias("odd"), F.when(acc["odd"] == 1, F.concat(acc["spans"], F.array(found))).otherwise(acc["spans"]).alias("spans"))

    start = F.struct(F.lit(0).cast("long").alias("pos"), F.lit(0).alias("odd"), none.alias("spans"))
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(parts) - 1) / BLOCK).cast("int")), lambda b: F.aggregate(F.slice(parts, b * BLOCK + 1, BLOCK), start, step))
    return F.when(F.size(parts) > 1, blocks).otherwise(F.expr("cast(array() as array<struct<pos: bigint, odd: int, spans: array<struct<start: bigint, end: bigint, match: string>>>>)"))


def _placed(blocks: Column) -> Column:
    """Spans of all blocks, moved by what the blocks before them hold."""
    first = F.struct(F.lit(0).cast("long").alias("pos"), F.expr("cast(array() as array<bigint>)").alias("at"))
    before = F.aggregate(blocks, first, lambda a, b: F.struct((a["pos"] + b["pos"]).alias("pos"), F.concat(a["at"], F.array(a["pos"])).alias("at")))["at"]
    move = lambda b, at: F.transform(b["spans"], lambda s: F.struct((s["start"] + at).alias("start"), (s["end"] + at).alias("end"), s["match"].alias("match")))
    return F.flatten(F.zip_with(blocks, before, move))


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: id, spans (array of start, rank, end, kind; by start, then kind's rank).

    Whole texts; null is empty and has no spans. Repeated rows stay repeated, a null id stays null, other columns are not read; an empty table gives an
    empty one. A text and its spans are one row, so the longest must fit in a task.
    """
    text = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    df = docs.select(docs[id_col].alias("id"), F.replace(text, F.lit(MARK), F.lit(OTHER)).alias("t"))
    has = lambda x: F.contains("t", F.lit(x))
    patterns = [(ASSIGN, has(":") | has("=")), (ACCESS, has("AKIA")), (HEX, F.lit(True)), (NAME, has(":") | has("=")), (TOKEN, F.lit(True)), (ENDPOINT, has("://"))]
    df = df.select("id", *[_parts(F.col("t"), p, hint).alias(f"p{k}") for k, (p, hint) in enumerate(patterns)])
    df = df.select("id", *[_blocks(F.col(f"p{k}")).alias(f"b{k}") for k in range(len(KINDS))])
    df = df.select("id", *[_placed(F.col(f"b{k}")).alias(f"s{k}") for k in range(len(KINDS))])
    mixed = lambda s: s["match"].rlike("[0-9]") & s["match"].rlike("[A-Za-z]")
    keep = [lambda s: F.length(F.regexp_extract(s["match"], VALUE, 1)) >= 6, lambda s: s["end"] - s["start"] >= 20, lambda s: F.lit(True), lambda s: F.lit(True), mixed, lambda s: F.lit(True)]
    rank = lambda k: lambda s: F.struct(s["start"].alias("start"), F.lit(k).alias("rank"), s["end"].alias("end"))
    ranked = [F.transform(F.filter(F.col(f"s{k}"), keep[k]), rank(k)) for k in range(len(KINDS))]
    df = common.fenced(df.select("id", F.sort_array(F.concat(*ranked)).alias("parts")))
    near = lambda i: F.slice("parts", F.greatest(i - BAND, F.lit(0)) + 1, 2 * BAND + 1)

    def beside(s: Column, i: Column, *ranks: int) -> Column:
        """Another part of one of the ranks starts within the scope; a token that is itself part of a strong match is no part of its own."""
        return F.exists(near(i), lambda p: p["rank"].isin(*ranks) & (F.abs(p["start"] - s["start"]) <= SCOPE) & ((p["end"] <= s["start"]) | (p["start"] >= s["end"])))

    def reported(s: Column, i: Column) -> Column:
        name, secret, endpoint = (1, 3), (0, 2, 4), (5,)
        return F.when(s["rank"] < 3, True).when(s["rank"] == 3, beside(s, i, *secret)).when(s["rank"] == 4, beside(s, i, *name, *endpoint)).otherwise(beside(s, i, *name) & beside(s, i, *secret))

    kind = lambda s: F.element_at(F.array(*map(F.lit, KINDS)), s["rank"] + 1)
    spans = F.transform(F.filter("parts", reported), lambda s: F.struct(s["start"].alias("start"), s["rank"].alias("rank"), s["end"].alias("end"), kind(s).alias("kind")))
    return df.select(F.col("id").alias(id_col), F.when(F.size("parts") > 0, spans).otherwise(F.expr("cast(array() as array<struct<start: bigint, rank: int, end: bigint, kind: string>>)")).alias("spans"))


def joined(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """What op3 returns, from find_secrets()."""
    count = lambda k: F.size(F.filter("spans", lambda s: s["rank"] == k)).cast("long")
    base = F.filter("spans", lambda s: s["rank"] < 3)
    return found.select(id_col, count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def mask_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", mask: str = "[SECRET]", length_col: str | None = None) -> DataFrame:
    """docs, all its columns, with every reported span of the text replaced by mask; overlapping spans become one. A null text stays null. length_col names a column that holds
    the text's length, which then follows where something was masked.

    Spans come from the text itself, so nothing is joined: the row is carried along. Empty texts and an empty table stay as they are; repeated rows
    stay repeated. Columns may have any names, dots too, but none that differ by case only, which Spark itself cannot tell apart.
    """
    row = docs.select(common.whole(docs).alias("row"), docs[text_col].alias("text"))
    found = find_secrets(row, "row", "text")
    zero = F.lit(0).cast("long")
    text = F.col(f"row.{common.quoted(text_col)}")
    merge = F.aggregate(
        "spans",
        F.expr("cast(array() as array<struct<start: bigint, end: bigint>>)"),
        lambda a, s: F.when((F.size(a) > 0) & (F.element_at(a, -1)["end"] > s["start"]), F.concat(F.slice(a, F.lit(1), F.size(a) - 1), F.array(F.struct(F.element_at(a, -1)["start"].alias("start"), F.greatest(F.element_at(a, -1)["end"], s["end"]).alias("end"))))).otherwise(F.concat(a, F.array(F.struct(s["start"].alias("start"), s["end"].alias("end"))))),
    )
    found = found.withColumn("cut", F.when(F.size("spans") > 0, merge).otherwise(F.expr("cast(array() as array<struct<start: bigint, end: bigint>>)")))
    cut = F.col("cut")
    sub = lambda a, b: F.substring(text, (a + 1).cast("int"), (b - a).cast("int"))
    kept = F.transform(F.sequence(F.lit(0), F.size(cut)), lambda i: sub(F.coalesce(F.get(cut, i - 1)["end"], zero), F.coalesce(F.get(cut, i)["start"], F.length(text).cast("long"))))
    masked = F.when(F.size(cut) > 0, F.array_join(kept, mask)).otherwise(text)
    found = found.select("row", masked.alias("masked"), (F.size(cut) > 0).alias("any"))
    own = lambda c: F.col(f"row.{common.quoted(c)}")
    length = lambda c: F.when(F.col("any"), F.length("masked").cast(docs.schema[c].dataType)).otherwise(own(c))
    return found.select(*[(F.col("masked") if c == text_col else length(c) if c == length_col else own(c)).alias(c) for c in docs.columns])
