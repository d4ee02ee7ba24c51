"""Text normalisation shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Every code point that Unicode calls white space.
WHITE_SPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005"
    "\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)


def bare(c: Column | str) -> Column:
    """The text without white space around it; null stays null."""
    return F.btrim(F.col(c) if isinstance(c, str) else c, F.lit(WHITE_SPACE))


def folded(c: Column | str) -> Column:
    """Lower case without white space around it: the form in which ids, families, statuses and sources are equal."""
    return F.lower(bare(c))


def present(c: Column | str) -> Column:
    """True where the text is neither null nor blank."""
    return F.coalesce(bare(c) != "", F.lit(False))


def sql_folded(expr: str) -> str:
    """The same as folded() in DuckDB's SQL."""
    chars = " || ".join(f"chr({ord(x)})" for x in WHITE_SPACE)
    return f"lower(trim({expr}, {chars}))"
