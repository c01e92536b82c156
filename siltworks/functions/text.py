"""Column expressions over text that many operators share. All stay in the JVM; nulls are read as empty texts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: what Python's str.split() splits at, as the inside of a character class.
SPACE = "\t\n\u000b\u000c\r\u001c\u001d\u001e\u001f \u0085\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
WORD = r"\p{L}\p{N}_"
#: The same white space in a pattern: Unicode's and four separators. A class that lists all of SPACE takes many times as long a character.
U, GAP = "(?U)", r"\s\x1c-\x1f"


def nz(c: Column | str) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def words(c: Column | str) -> Column:
    return F.filter(F.split(nz(c), f"{U}[{GAP}]+"), lambda w: w != "")


def n_words(c: Column | str) -> Column:
    return F.regexp_count(nz(c), F.lit(f"{U}[^{GAP}]+"))


def strip(c: Column | str) -> Column:
    return F.btrim(nz(c), F.lit(SPACE))


def lines(c: Column | str) -> Column:
    """Lines that aren't blank, split at line feeds."""
    return F.filter(F.split(nz(c), "\n"), lambda x: x.rlike(f"{U}[^{GAP}]"))


def count(c: Column | str, pattern: str) -> Column:
    return F.regexp_count(nz(c), F.lit(pattern))


def ratio(a: Column, b: Column) -> Column:
    """a / b, or null where b is 0."""
    return F.when(b > 0, a / b)


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value) with value worked out once: a name inside a lambda would be worked out again wherever it stands."""
    return F.transform(F.array(value), f)[0]


def ngrams(tokens: Column, n: int) -> Column:
    """The runs of n tokens, joined by spaces; none for fewer than n."""
    def runs(t: Column) -> Column:
        last = F.size(t) - (n - 1)
        return F.when(last >= 1, F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda i: F.array_join(F.slice(t, i, n), " "))).otherwise(F.array().cast("array<string>"))

    return let(tokens, runs)


def ngram_hashes(tokens: Column, n: int) -> Column:
    """64-bit hashes of the runs of n tokens."""
    def runs(t: Column) -> Column:
        last = F.size(t) - (n - 1)
        return F.when(last >= 1, F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda i: F.xxhash64(F.slice(t, i, n)))).otherwise(F.array().cast("array<bigint>"))

    return let(tokens, runs)


def share(items: Column, holds: Callable[[Column], Column]) -> Column:
    """Share of the items for which a condition holds; null for none. The items are worked out once."""
    return let(items, lambda a: ratio(F.size(F.filter(a, holds)), F.size(a)))


def char_ngrams(text: Column, n: int) -> Column:
    """The runs of n characters; none for fewer than n."""
    return let(F.split(text, ""), lambda t: F.when(F.length(text) >= n, F.transform(F.sequence(F.lit(1), F.greatest(F.size(t) - (n - 1), F.lit(1))), lambda i: F.array_join(F.slice(t, i, n), ""))).otherwise(F.array().cast("array<string>")))
