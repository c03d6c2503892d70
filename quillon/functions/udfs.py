"""What no built-in expression gives: name similarity by matching blocks, nested comments, rendered-code trees.

All are Arrow batches. Each stands behind the narrowest set of rows that needs it.
"""

from __future__ import annotations

import difflib
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_MARK = re.compile(r"/-|-/|--[^\n]*")


def uncommented(source: str) -> str:
    """Without comments (``--`` to the line's end, ``/- -/`` nested; an open one takes the rest), white space collapsed."""
    kept, depth, at, look = [], 0, 0, 0
    while m := _MARK.search(source, look):
        mark = m[0][:2]
        look = m.end()
        if depth == 0:
            if mark == "-/":  # two ordinary signs; the second may begin a mark
                look = m.start() + 1
                continue
            kept.append(source[at : m.start()])
            at = m.end()
            depth = int(mark == "/-")
        elif mark == "--":  # within a block it is text, but may hide the block's marks
            look = m.start() + 1
        else:
            depth += 1 if mark == "/-" else -1
            at = m.end()
    if depth == 0:
        kept.append(source[at:])
    return " ".join("".join(kept).split())


def name_similarity(query: str, name: str) -> float:
    plain = [x.lower().translate(str.maketrans("._", "  ")) for x in (query, name)]
    return difflib.SequenceMatcher(None, *plain).ratio()


class Rendered:
    """Names in a rendered-code tree: nodes text (0), tag (1) and append (2); a const tag (2) carries a name."""

    def __init__(self, blob: bytes) -> None:
        self.blob, self.at = blob, 0

    def byte(self) -> int:
        self.at += 1
        return self.blob[self.at - 1]

    def natural(self) -> int:
        value = shift = 0
        while (b := self.byte()) >= 128:
            value |= (b & 127) << shift
            shift += 7
        return value | b << shift

    def string(self) -> str:
        n = self.natural()
        if self.at + n > len(self.blob):
            raise ValueError("cut off in a string")
        self.at += n
        return self.blob[self.at - n : self.at].decode("utf-8")

    def name(self) -> str:
        """Parts come from the last to the first, each before its own value; the outermost's value is last."""
        kinds = []
        while kind := self.byte():
            if kind > 2:
                raise ValueError(f"name tag {kind}")
            kinds.append(kind)
        out = ""
        for k in reversed(kinds):
            part = self.string() if k == 1 else str(self.natural())
            out = f"{out}.{part}" if out else part
        return out

    def names(self) -> list[str]:
        found: dict[str, None] = {}
        todo = 1  # nodes still to read
        while todo:
            todo -= 1
            kind = self.byte()
            if kind == 0:
                self.string()
            elif kind == 1:
                tag = self.byte()
                if tag > 7:
                    raise ValueError(f"tag {tag}")
                if tag == 2 and (name := self.name()):
                    found.setdefault(name)
                todo += 1
            elif kind == 2:
                todo += self.natural()
            else:
                raise ValueError(f"node {kind}")
        return list(found)


def rendered_names(blob: bytes | None) -> list[str]:
    """Distinct names in order; none from a malformed tree."""
    try:
        return Rendered(bytes(blob)).names() if blob else []
    except (ValueError, IndexError):
        return []


@F.pandas_udf(T.StringType())
def _uncommented(source: pd.Series) -> pd.Series:
    return source.map(lambda s: None if s is None else uncommented(s))


def strip_comments(source: Column) -> Column:
    """Only texts with a block mark go through Python."""
    plain = F.trim(F.regexp_replace(F.regexp_replace(source, r"--[^\n]*", ""), r"(?U)\s+", " "))
    return F.when(source.contains("/-"), _uncommented(F.when(source.contains("/-"), source))).otherwise(plain)


@F.pandas_udf(T.DoubleType())
def fuzzy_name_score(query: pd.Series, name: pd.Series) -> pd.Series:
    return pd.Series([None if q is None or n is None else name_similarity(q, n) for q, n in zip(query, name)], dtype="float64")


@F.pandas_udf(T.ArrayType(T.StringType()))
def names_in_rendered_code(blob: pd.Series) -> pd.Series:
    return blob.map(rendered_names)
