"""File names from free names, and blocks cut out of pages: Arrow batches, for what column functions can't express."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql.functions import pandas_udf

# The start and the factor of the hash.
BASIS, PRIME = np.uint64(1469598103934665603), np.uint64(1099511628211)
_DIV = re.compile(r"</?div\b[^>]*>")
_CONTAINER = re.compile(r'<div\b[^>]*\bdata-lyrics-container="true"[^>]*>')


def _hashed(names: pd.Series) -> pd.Series:
    """A step per byte position, over all names of a batch."""
    raw = [None if n is None else n.encode() for n in names]
    sizes = np.array([-1 if r is None else len(r) for r in raw])
    h = np.full(len(raw), BASIS)
    for k in range(int(sizes.max(initial=0))):
        at = np.flatnonzero(sizes > k)
        h[at] = (h[at] ^ np.array([raw[i][k] for i in at], np.uint64)) * PRIME
    return pd.Series([None if r is None else f"{int(v):016x}" for r, v in zip(raw, h)], dtype=object)


def thumb_name(name: str | Column) -> Column:
    """16 hex digits: an FNV-1a hash of a name's UTF-8 bytes."""
    return pandas_udf(_hashed, "string")(name)


def inner_blocks(html: str) -> list[str]:
    """What marked divs hold, nested divs included; one that is never closed reaches to the end."""
    out, depth, begin = [], 0, 0
    for tag in _DIV.finditer(html):
        if depth:
            depth += -1 if tag.group().startswith("</") else 1
            if not depth:
                out.append(html[begin : tag.start()])
        elif _CONTAINER.fullmatch(tag.group()):
            depth, begin = 1, tag.end()
    return [*out, html[begin:]] if depth else out


def _blocks(pages: pd.Series) -> pd.Series:
    return pages.map(lambda p: None if p is None else inner_blocks(p))


def containers(page: str | Column) -> Column:
    """The inner HTML of all marked divs of a page, in order."""
    return pandas_udf(_blocks, "array<string>")(page)
