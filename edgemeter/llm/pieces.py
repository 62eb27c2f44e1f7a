"""Places where a text may be cut without changing how byte-level BPE splits it."""

from __future__ import annotations

import re
import sys

import pyarrow as pa
from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

_SAFE = re.compile(r"(?<=\S) (?=\S)")
_WIDE_SPACE = re.compile(r"[\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
_SPACES = "\t\n\v\f\r\x1c\x1d\x1e\x1f"


def _plain(text: str) -> bool:
    """Whether every space of the text stands alone between other characters."""
    return not (
        text.startswith(" ")
        or text.endswith(" ")
        or "  " in text
        or any(c in text and (c + " " in text or " " + c in text) for c in _SPACES)
        or (not text.isascii() and _WIDE_SPACE.search(text))
    )


def cut(text: str) -> list[str]:
    """The parts between single spaces that stand between two other characters.

    The pattern that precedes the merges never lets a token span such a place:
    the space starts a token. All parts but the first begin with that space,
    which is left off.
    """
    return text.split(" ") if _plain(text) else _SAFE.split(text)


def runs(sizes: list[int], limit: int):
    """(first, last) of runs of rows of about `limit` bytes, at least a row each."""
    first = total = 0
    for i, size in enumerate(sizes):
        if total and total + size > limit:
            yield first, i
            first, total = i, 0
        total += size
    if first < len(sizes):
        yield first, len(sizes)


def texts_of(column: pa.Array) -> list[str]:
    return [text or "" for text in column.to_pylist()]
