"""Column expressions that several families share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DIGITS = 6


def col(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def share(a: str | Column, b: str | Column) -> Column:
    """a / b as a double; 0 where b is 0 or either is null."""
    return F.coalesce(F.try_divide(col(a).cast("double"), col(b).cast("double")), F.lit(0.0))


def clamp(x: str | Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), col(x)))


def rounded(x: str | Column, digits: int = DIGITS) -> Column:
    """Rounded once, at the edge."""
    return F.round(col(x).cast("double"), digits)


def number(x: str | Column) -> Column:
    """A double; 0 for what is missing or no number."""
    return F.coalesce(col(x).try_cast("double"), F.lit(0.0))


def count_if(x: str | Column) -> Column:
    """How many rows hold; 0 for none."""
    return F.coalesce(F.sum(F.when(col(x), 1).otherwise(0)), F.lit(0)).cast("long")


def mean_or_zero(x: str | Column) -> Column:
    return F.coalesce(F.avg(col(x).cast("double")), F.lit(0.0))


def attach(rows: DataFrame, totals: DataFrame, by: list[str]) -> DataFrame:
    """Totals beside each row, by key; without a key, ``totals`` is one row."""
    return rows.join(totals, by, "left") if by else rows.crossJoin(F.broadcast(totals))


def squeeze(x: str | Column) -> Column:
    return F.trim(F.regexp_replace(col(x), r"\s+", " "))


# Words that say nothing about the code they name.
STOP_WORDS = (
    "and", "any", "are", "arg", "args", "assert", "bool", "call", "case", "class", "code", "def", "else", "error",
    "except", "false", "for", "from", "has", "if", "import", "in", "is", "len", "line", "list", "none", "not", "or",
    "pass", "possible", "range", "return", "self", "test", "the", "to", "true", "try", "value", "values", "with")


def tokens(x: str | Column, stop: tuple[str, ...] = STOP_WORDS) -> Column:
    """Distinct lower-case names and numbers of a text, and the parts of names
    between underscores; camelCase is split, one letter and stop words are dropped.
    """
    apart = F.regexp_replace(col(x), "([a-z0-9])([A-Z])", "$1 $2")
    names = F.transform(F.regexp_extract_all(apart, F.lit("[A-Za-z_][A-Za-z0-9_]*|[0-9]+"), F.lit(0)), F.lower)
    parts = F.flatten(F.transform(names, lambda n: F.split(n, "_")))
    kept = F.filter(F.array_distinct(F.concat(names, parts)), lambda w: F.length(w) > 1)
    return F.array_except(kept, F.array(*map(F.lit, stop)))
