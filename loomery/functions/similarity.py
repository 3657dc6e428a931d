"""Similarity kernels that Spark has no function for, as Arrow-batched UDFs.

Apply them to distinct pairs only, after cheap predicates have filtered.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


def lcs(a: str, b: str) -> int:
    """Length of the longest common subsequence, bit-parallel over ``a``."""
    at: dict[str, int] = {}
    for i, ch in enumerate(a):
        at[ch] = at.get(ch, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for ch in b:
        hit = row & at.get(ch, 0)
        row = (row + hit | row - hit) & full
    return len(a) - row.bit_count()


def ratio_of(a: str, b: str) -> float:
    """100 less the share of insertions and deletions; 100 for two empty texts."""
    n = len(a) + len(b)
    return 200.0 * lcs(a, b) / n if n else 100.0


def token_sort_of(a: str, b: str) -> float:
    return ratio_of(" ".join(sorted(a.split())), " ".join(sorted(b.split())))


def jaro_winkler_of(a: str, b: str) -> float:
    """Jaro similarity, raised by a tenth per shared first letter (four at most) above 0.7."""
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    reach = max(max(len(a), len(b)) // 2 - 1, 0)
    taken, matched = [False] * len(b), []
    for i, ch in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not taken[j] and b[j] == ch:
                taken[j] = True
                matched.append(ch)
                break
    m = len(matched)
    if not m:
        return 0.0
    other = [ch for ch, t in zip(b, taken, strict=True) if t]
    moved = sum(x != y for x, y in zip(matched, other, strict=True)) // 2
    jaro = (m / len(a) + m / len(b) + (m - moved) / m) / 3
    prefix = next((k for k in range(min(4, len(a), len(b))) if a[k] != b[k]), min(4, len(a), len(b)))
    return jaro + 0.1 * prefix * (1 - jaro) if jaro > 0.7 else jaro


def fold_of(text: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c))


def _pairwise(kernel):
    @F.pandas_udf(T.DoubleType())
    def apply(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or y is None else kernel(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")

    return apply


ratio, token_sort_ratio, jaro_winkler = _pairwise(ratio_of), _pairwise(token_sort_of), _pairwise(jaro_winkler_of)


@F.pandas_udf(T.StringType())
def fold_accents(s: pd.Series) -> pd.Series:
    """Compatibility decomposition without combining marks."""
    return s.map(lambda x: None if x is None else fold_of(x))


# Casing exceptions.
SMALL_WORDS = frozenset("of the and for in at on to de la le von van und der du des et y e".split())
KEPT_UPPER = frozenset("USA UK EU MIT IBM NASA NIH USDA DNA RNA NMR LLC LLP GMBH AG SE SA BV NV KG PLC II III IV".split())


def title_of(text: str) -> str:
    """Title case for a text in capitals: acronyms without a vowel stay, small words are lower, Mc is kept."""
    if text != text.upper():
        return text
    out = []
    for k, word in enumerate(text.split(" ")):
        core = "".join(c for c in word if c.isalpha())
        if core in KEPT_UPPER or (1 < len(core) <= 4 and not set(core) & set("AEIOUYÄÖÜ")) or any(c.isdigit() for c in word):
            out.append(word)
        elif k and word.lower() in SMALL_WORDS:
            out.append(word.lower())
        else:
            new = "-".join(p[:1].upper() + p[1:].lower() for p in word.split("-"))
            out.append(new[:2] + new[2:3].upper() + new[3:] if new.startswith("Mc") and len(new) > 3 else new)
    return " ".join(out)


@F.pandas_udf(T.StringType())
def smart_title_case(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else title_of(x))
