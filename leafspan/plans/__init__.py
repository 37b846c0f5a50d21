"""The registered queries; see README.md."""

from . import further, more, nested, queries, trees  # noqa: F401
