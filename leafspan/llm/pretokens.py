"""Byte-level pre-tokens: the pattern shared by byte-level BPE vocabularies, and a fast way for text of common letters."""

from __future__ import annotations

import re
import unicodedata

import regex

#: The byte-level alphabet's printable bytes, and the pattern of byte-level pre-tokens.
PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def byte_letters() -> list[str]:
    """The letter that stands for each byte: itself where printable, else the next letter from U+0100 on."""
    letters, spare = [], 256
    for b in range(256):
        if b in PRINTABLE:
            letters.append(chr(b))
        else:
            letters.append(chr(spare))
            spare += 1
    return letters


#: For str.translate of bytes read as Latin-1.
LETTERS = dict(enumerate(byte_letters()))


def mapped(piece: str) -> str:
    """The piece's UTF-8 bytes as letters."""
    return piece.encode().decode("latin-1").translate(LETTERS)


def _members(kind: str, below: int) -> str:
    return "".join(rf"\u{i:04x}" for i in range(below) if unicodedata.category(chr(i))[0] == kind)


class Splitter:
    """text → its pre-tokens under a pattern.

    For PATTERN, text below U+0250 (and general punctuation) goes through `re` with those characters' classes spelled out and the commonest
    alternative, letters, first: the alternatives begin with different characters, so their order is free. Other text goes through `regex`.
    """

    def __init__(self, pattern: str = PATTERN) -> None:
        self.any = regex.compile(pattern).findall
        self.plain = None
        if pattern == PATTERN:
            letter, number, space = _members("L", 0x250), _members("N", 0x250), r" \t\n\x0b\x0c\r\x85\xa0"
            self.plain = re.compile(rf" ?[{letter}]+|'(?:[stmd]|re|ve|ll)| ?[{number}]+| ?[^{space}{letter}{number}]+|[{space}]+(?![^{space}])|[{space}]+").findall
            self.odd = re.compile("[^\u0000-ɏ‐-‧‰-⁞]").search

    def __call__(self, text: str) -> list[str]:
        return self.plain(text) if self.plain and not self.odd(text) else self.any(text)
