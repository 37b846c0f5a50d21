"""Paths and field rules. A path is printed as JSONPath-like text; patterns compile to regular expressions over an unambiguous form of it."""

from __future__ import annotations

import json
import math
import re
from collections.abc import Iterable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

_PLAIN = re.compile(r"[A-Za-z_][A-Za-z0-9_-]*")
_STEP = re.compile(r'\[(?P<index>[0-9]+|\*)\]|\[(?P<quoted>"(?:[^"\\]|\\.)*")\]|\.?(?P<key>[^.\[\]]+)')


def printed(steps: Iterable[str | int]) -> str:
    """$ for the root; plain keys after a dot, other keys quoted in brackets, indices in brackets. Printed paths differ where paths differ."""
    out = "$"
    for s in steps:
        out += f"[{s}]" if isinstance(s, int) else f".{s}" if _PLAIN.fullmatch(s) else f"[{json.dumps(s, ensure_ascii=False)}]"
    return out


_ANY_KEY = r'(?:\.[A-Za-z_][A-Za-z0-9_-]*|\["(?:[^"\\]|\\.)*"\])'
_ANY_INDEX = r"\[[0-9]+\]"
_ANY = rf"(?:{_ANY_KEY}|{_ANY_INDEX})"


def _quote(text: str) -> str:
    return re.sub(r"([^A-Za-z0-9_ ])", r"\\\1", text)


def compiled(pattern: str) -> str:
    """A pattern as an anchored regular expression over printed paths: * one key, [*] one index, ** any steps; a bare name at any depth."""
    if not isinstance(pattern, str) or not pattern.strip():
        raise ValueError(f"empty path pattern: {pattern!r}")
    text = pattern.strip()
    out = rf"{_ANY}*" if _PLAIN.fullmatch(text) else ""
    at = 0
    if text in ("$", ""):
        return r"^\$$"
    while at < len(text):
        step = _STEP.match(text, at)
        if not step or step.end() == at:
            raise ValueError(f"cannot read path pattern {pattern!r} at {at}")
        if step["index"]:
            out += _ANY_INDEX if step["index"] == "*" else rf"\[{int(step['index'])}\]"
        elif step["quoted"]:
            out += _quote(printed([json.loads(step["quoted"])])[1:])
        elif step["key"] == "**":
            out += rf"{_ANY}*"
        elif step["key"] == "*":
            out += _ANY_KEY
        else:
            out += _quote(printed([step["key"]])[1:])
        at = step.end()
    return rf"^\${out}$"


def matches(path: Column, pattern: str) -> Column:
    return path.rlike(compiled(pattern))


def below(path: Column, pattern: str) -> Column:
    """The path or one of its ancestors matches."""
    return path.rlike(rf"{compiled(pattern)[:-1]}{_ANY}*$")


@dataclass(frozen=True)
class FieldRules:
    """ignore: patterns of fields to drop; unordered: arrays read as multisets; tolerance: pattern → absolute number or {abs, rel}; the first match holds."""

    ignore: tuple[str, ...] = ()
    unordered: tuple[str, ...] = ()
    tolerance: Mapping[str, float | Mapping[str, float]] = field(default_factory=dict)

    def __post_init__(self) -> None:
        for p in (*self.ignore, *self.unordered, *self.tolerance):
            compiled(p)
        self.limits()

    def limits(self) -> list[tuple[str, float, float]]:
        out = []
        for pattern, spec in self.tolerance.items():
            given = dict(spec) if isinstance(spec, Mapping) else {"abs": spec}
            if unknown := set(given) - {"abs", "rel"}:
                raise ValueError(f"tolerance for {pattern!r}: unknown keys {sorted(unknown)}")
            a, r = float(given.get("abs", 0)), float(given.get("rel", 0))
            if not (math.isfinite(a) and math.isfinite(r)) or a < 0 or r < 0:
                raise ValueError(f"tolerance for {pattern!r} must be finite and not negative")
            out.append((pattern, a, r))
        return out

    def strip(self, doc: Column) -> Column:
        """A document without ignored fields."""
        for p in self.ignore:
            doc = _without(doc, p)
        return doc

    def bag_of(self, path: Column, leaf: Column) -> Column:
        """The outermost unordered array that a terminal lies in (or is, where it is empty), or null."""
        found = []
        for p in self.unordered:
            body = compiled(p)[1:-1].replace(f"{_ANY}*", f"{_ANY}*?")
            inside = F.regexp_extract(path, rf"^({body}){_ANY_INDEX}.*$", 1)
            found.append(F.when(inside != "", inside).when((leaf["vtype"] == "empty_array") & path.rlike(compiled(p)), path))
        shortest = F.array_min(F.transform(F.filter(F.array(*found), lambda x: x.isNotNull()), lambda x: F.struct(F.length(x).alias("n"), x.alias("path"))))
        return shortest["path"]

    def tolerance_at(self, path: Column) -> Column | None:
        out = None
        for p, a, r in self.limits():
            limit = F.struct(F.lit(a).alias("abs"), F.lit(r).alias("rel"))
            out = F.when(matches(path, p), limit) if out is None else out.when(matches(path, p), limit)
        return out


def index_below(path: Column, array: Column) -> Column:
    """The index in an array of the element that a path lies in; null outside it."""
    inside = F.startswith(path, F.concat(array, F.lit("[")))
    return F.when(inside, F.regexp_extract(F.substring(path, F.length(array) + 1, F.length(path)), r"^\[([0-9]+)\]", 1).try_cast("int"))


def _without(doc: Column, pattern: str) -> Column:
    """A document without what matches; where elements of arrays go, those behind them move up."""
    kept = F.map_filter(doc, lambda k, v: ~below(k, pattern))
    body = compiled(pattern)[1:-1]
    if not re.search(r"\\\[(\[0-9\]\+|[0-9]+)\\\]$", body):
        return kept
    lazy = body.replace(f"{_ANY}*", f"{_ANY}*?")
    gone = F.array_distinct(F.transform(F.filter(F.map_keys(doc), lambda k: below(k, pattern)), lambda k: F.regexp_extract(k, rf"^({lazy})", 1)))
    parted = F.transform(gone, lambda e: F.struct(F.regexp_extract(e, r"^(.*)\[[0-9]+\]$", 1).alias("array"), F.regexp_extract(e, r"\[([0-9]+)\]$", 1).cast("int").alias("i")))
    # Inner arrays first, and of one array the last element first, so that paths and indices still hold when their turn comes.
    ordered = F.sort_array(F.transform(parted, lambda d: F.struct(F.length(d["array"]).alias("n"), d["i"].alias("i"), d["array"].alias("array"))), asc=False)

    def moved(key: Column, d: Column) -> Column:
        at = index_below(key, d["array"])
        rest = F.substring(key, F.length(d["array"]) + F.length(at.cast("string")) + 3, F.length(key))
        return F.when(at > d["i"], F.concat(d["array"], F.lit("["), (at - 1).cast("string"), F.lit("]"), rest)).otherwise(key)

    return F.transform_keys(kept, lambda k, v: F.aggregate(ordered, k, moved))
