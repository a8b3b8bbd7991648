"""Metaphone codes (the published rules of 1990), word by word, through Arrow."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

_VOWELS = set("AEIOU")


def code(word: str) -> str:
    """The metaphone code of one word; letters outside A-Z are skipped."""
    w = "".join(c for c in word.upper() if "A" <= c <= "Z")
    if w[:2] in ("KN", "GN", "PN", "AE", "WR"):
        w = w[1:]
    elif w[:1] == "X":
        w = "S" + w[1:]
    elif w[:2] == "WH":
        w = "W" + w[2:]
    out, i, n = [], 0, len(w)
    while i < n:
        c, before, after, after2 = w[i], w[i - 1] if i else "", w[i + 1 : i + 2], w[i + 2 : i + 3]
        if c == before and c != "C":
            i += 1
            continue
        front = after in ("I", "E", "Y") and after != ""
        if c in _VOWELS:
            if i == 0:
                out.append(c)
        elif c == "B":
            if not (before == "M" and not after):
                out.append("B")
        elif c == "C":
            if front:
                if after == "I" and after2 == "A":
                    out.append("X")
                elif before != "S":
                    out.append("S")
            elif after == "H":
                out.append("K" if before == "S" or (i == 0 and after2 not in _VOWELS) else "X")
                i += 1
            else:
                out.append("K")
        elif c == "D":
            if after == "G" and after2 in ("E", "I", "Y") and after2:
                out.append("J")
                i += 1
            else:
                out.append("T")
        elif c == "G":
            silent = after == "H" and not (i + 2 >= n or after2 in _VOWELS) or after == "N" and (i + 2 >= n or w[i + 2 :] == "ED")
            if not silent and not (after == "H" and i + 2 >= n):
                out.append("J" if front and before != "G" else "K")
            if after == "H":
                i += 1
        elif c == "H":
            if (not before or before not in "CSPTG") and after in _VOWELS:
                out.append("H")
        elif c == "K":
            if before != "C":
                out.append("K")
        elif c == "P":
            if after == "H":
                out.append("F")
                i += 1
            else:
                out.append("P")
        elif c == "Q":
            out.append("K")
        elif c == "S":
            if after == "H":
                out.append("X")
                i += 1
            elif after == "I" and after2 in ("O", "A") and after2:
                out.append("X")
            else:
                out.append("S")
        elif c == "T":
            if after == "I" and after2 in ("O", "A") and after2:
                out.append("X")
            elif after == "H":
                out.append("0")
                i += 1
            elif not (after == "C" and after2 == "H"):
                out.append("T")
        elif c == "V":
            out.append("F")
        elif c in "WY":
            if after in _VOWELS and after:
                out.append(c)
        elif c == "X":
            out.append("KS")
        elif c == "Z":
            out.append("S")
        elif c in "FJLMNR":
            out.append(c)
        i += 1
    return "".join(out)


@F.pandas_udf(StringType())
def metaphone(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Codes of the space-separated words of each text, joined by spaces; null stays null."""
    known: dict[str, str] = {}
    for texts in batches:
        out = []
        for t in texts:
            if t is None:
                out.append(None)
                continue
            if len(known) > 200_000:
                known.clear()
            out.append(" ".join(known[x] if x in known else known.setdefault(x, code(x)) for x in t.split(" ")))
        yield pd.Series(out, dtype=object)
