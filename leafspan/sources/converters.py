"""XML and HTML text as documents: attributes become @name, mixed text #text, repeated tags a list, and name spaces go."""

from __future__ import annotations

import html.parser
import xml.etree.ElementTree as tree
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.leaves import PARSED_DOCUMENT, enriched
from ..functions.shipping import shipped_udf
from .flatten import document_of, in_pieces, parse

#: Elements that never hold others.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}


def _bare(tag: str) -> str:
    return tag.rpartition("}")[2]


def _built(attributes: dict[str, str], children: list[tuple[str, object]], text: str) -> object:
    if not attributes and not children:
        return text or None
    out: dict[str, object] = {f"@{_bare(k)}": v for k, v in attributes.items()}
    for tag, value in children:
        if tag not in out:
            out[tag] = value
        elif isinstance(out[tag], list):
            out[tag].append(value)
        else:
            out[tag] = [out[tag], value]
    if text:
        out["#text"] = text
    return out


def xml_value(text: str) -> object:
    """Entities and document types that a text declares itself are refused."""
    if "<!ENTITY" in text:
        raise ValueError("entity declarations are not read")

    def of(e: tree.Element) -> object:
        own = " ".join(x.strip() for x in [e.text or "", *(c.tail or "" for c in e)] if x.strip())
        return _built(dict(e.attrib), [(_bare(c.tag), of(c)) for c in e], own)

    top = tree.fromstring(text)
    return {_bare(top.tag): of(top)}


class _Page(html.parser.HTMLParser):
    """A stack of open elements; an end tag that closes nothing open is ignored, and void elements close at once."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.stack: list[tuple[str, dict, list, list]] = [("", {}, [], [])]

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self.stack.append((tag, {k: v or "" for k, v in attrs}, [], []))
        if tag in VOID:
            self._close()

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self._close()

    def handle_endtag(self, tag: str) -> None:
        if any(t == tag for t, *_ in self.stack[1:]):
            while self.stack[-1][0] != tag:
                self._close()
            self._close()

    def handle_data(self, data: str) -> None:
        if data.strip():
            self.stack[-1][3].append(data.strip())

    def _close(self) -> None:
        tag, attributes, children, text = self.stack.pop()
        self.stack[-1][2].append((tag, _built(attributes, children, " ".join(text))))

    def value(self) -> object:
        while len(self.stack) > 1:
            self._close()
        return _built({}, self.stack[0][2], " ".join(self.stack[0][3]))


def html_value(text: str) -> object:
    page = _Page()
    page.feed(text)
    page.close()
    return page.value()


def yaml_value(text: str) -> object:
    """A YAML document's value, with dates and other values beyond JSON as their texts."""
    import yaml

    def plain(v: object) -> object:
        if isinstance(v, dict):
            return {str(k): plain(x) for k, x in v.items()}
        if isinstance(v, (list, tuple, set)):
            return [plain(x) for x in v]
        return v if v is None or isinstance(v, (bool, int, float, str)) else str(v)

    try:
        return plain(yaml.safe_load(text))
    except yaml.YAMLError as e:
        raise ValueError(str(e)) from e


def json_value(text: str) -> object:
    ok, value = parse(text)
    if not ok:
        raise ValueError("not JSON")
    return value


READERS = {"json": json_value, "xml": xml_value, "html": html_value, "yaml": yaml_value}


def converted(text: Column, kind: str) -> Column:
    """Documents from text of a kind (json, xml, html or yaml); null where it cannot be read. Void elements do not take in what follows them."""
    return structured(text, F.lit(kind))["doc"]


STRUCTURED = T.StructType([T.StructField("doc", PARSED_DOCUMENT), T.StructField("reason", T.StringType())])


@shipped_udf(STRUCTURED)
def _structured(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
    def of(t: str | None, k: str | None) -> tuple[dict | None, str | None]:
        if t is None:
            return None, "no text"
        read = READERS.get((k or "").lower())
        if read is None:
            return None, f"unsupported kind: {k}"
        try:
            return document_of(read(t)), None
        except ImportError:
            return None, f"no reader of {k} is installed"
        except (ValueError, SyntaxError, RecursionError):
            return None, f"cannot be read as {k}"

    for text, kind in batches:
        for piece in in_pieces(pd.DataFrame({"text": text, "kind": kind})):
            yield pd.DataFrame([of(*row) for row in zip(piece["text"], piece["kind"])], columns=["doc", "reason"])


def structured(text: Column, kind: Column) -> Column:
    """(doc, reason) from text and the kind that each row names: the document, or null and why there is none."""
    out = _structured(text, kind)
    return F.struct(enriched(out["doc"]).alias("doc"), out["reason"].alias("reason"))
