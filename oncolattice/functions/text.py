"""Column helpers for text. All stay on the JVM."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

# White space as Unicode text sees it, including the separator controls. Written out, so
# that patterns and trims need no Unicode property lookups.
BLANKS = ("\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006"
          "\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000")
SPACE = r"[\t-\r\x1c- \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
U = "(?U)"


def lits(values: Sequence) -> Column:
    return F.array(*[F.lit(v) for v in values])


def pick(values: Sequence, index: Column) -> Column:
    """values[index mod n], zero based."""
    return F.element_at(lits(values), (F.pmod(index, F.lit(len(values))) + 1).cast("int"))


def strip(col: Column) -> Column:
    """Trim any white space, not only blanks."""
    return F.trim(col, F.lit(BLANKS))


def words(col: Column) -> Column:
    """White-space separated words without empty ones."""
    return F.array_remove(F.split(col, SPACE + "+"), "")


def any_term(text: Column, terms: Sequence[str]) -> Column:
    """True when the text holds any of a fixed list of substrings."""
    found = F.lit(False)
    for term in terms:
        found = found | text.contains(term)
    return found


def found_terms(text: Column, terms: Sequence[str]) -> Column:
    """The listed terms that occur in the text, ignoring case, in list order."""
    low = F.lower(text)
    return F.array_compact(F.array(*[F.when(low.contains(t.lower()), F.lit(t)) for t in terms]))


def default_empty(col: Column) -> Column:
    return F.coalesce(col, F.lit(""))


def empty_to_null(col: Column) -> Column:
    return F.when(col != "", col)


def unnest(df: DataFrame, keep: list, array: Column, item: str, pos: str = "_pos") -> DataFrame:
    """One row per element of a costly array, with its position.

    An outer generate with a filter after it: for an inner one the optimizer adds a size
    check below, and that would compute the array a second time.
    """
    return df.select(*keep, F.posexplode_outer(array).alias(pos, item)).filter(F.col(pos).isNotNull())
