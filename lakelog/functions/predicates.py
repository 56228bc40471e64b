"""Type-aware search predicates.

Comparisons keep the column bare (no function around it) wherever the type allows, so Parquet pushdown and
partition pruning stay available. The one exception is the case-insensitive substring test: no data source can
evaluate ``lower(c)``, so that test costs a scan of its column.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Iterable, Sequence

from pyspark.sql import Column, functions as F
from pyspark.sql.types import (
    BooleanType,
    DataType,
    DateType,
    IntegralType,
    NumericType,
    StringType,
    StructField,
    TimestampNTZType,
    TimestampType,
)

from lakelog.functions.terms import Term, as_day

AND, OR = "AND", "OR"

#: Up to so many terms a text is lower-cased for each of them, in generated code; for more it is lower-cased once, by an
#: array function that stands outside generated code. One regular expression for all terms was slower than either.
LOWERED_EACH = 2


def quoted(name: str) -> Column:
    """The top-level column of this exact name, whatever characters the name holds."""
    return F.col("`" + name.replace("`", "``") + "`")


def read_cond(cond: str) -> str:
    """Normalise the fold word; anything but AND or OR is an error, not a silent OR."""
    if cond.upper() not in (AND, OR):
        raise ValueError(f"cond must be AND or OR, got {cond!r}")
    return cond.upper()


_DAYS = (DateType, TimestampType, TimestampNTZType)


def takes(kind: DataType, term: Term) -> bool:
    """A column of this type has a reading of the term. Types outside the four families take no term."""
    return (
        isinstance(kind, StringType)
        or (isinstance(kind, NumericType) and term.number is not None)
        or (isinstance(kind, _DAYS) and term.day is not None)
        or (isinstance(kind, BooleanType) and term.truth is not None)
    )


def _contains(text: Column, terms: Sequence[Term]) -> Column:
    """A lower-cased text holds one of the terms."""
    return _fold([text.contains(t.text.lower()) for t in terms], _OR)


def _holds(column: Column, kind: DataType, terms: Sequence[Term], case_sensitive: bool) -> Column:
    """The column holds one of the terms, all of which its type can read."""
    if isinstance(kind, StringType):
        if case_sensitive:
            return _fold([column.contains(t.text) for t in terms], _OR)
        if len(terms) <= LOWERED_EACH:
            return _contains(F.lower(column), terms)
        # As the one element of an array the text is lower-cased once, and not once per term.
        return F.exists(F.array(F.lower(column)), lambda text: _contains(text, terms))
    if isinstance(kind, _DAYS):
        # Catalyst turns the cast-equality into a half-open range on the bare column.
        return _fold([column.cast("date") == F.lit(t.day) for t in terms], _OR)
    if isinstance(kind, BooleanType):
        return _fold([column == F.lit(t.truth) for t in terms], _OR)
    # One IN for the whole numbers; the others stay single, as IN would bring all to one type.
    whole = [t.number for t in terms if isinstance(t.number, int)] if isinstance(kind, IntegralType) else []
    whole = whole if len(whole) > 1 else []
    single = [column == F.lit(t.number) for t in terms if not (whole and isinstance(t.number, int))]
    return _fold([column.isin(whole), *single] if whole else single, _OR)


def term_predicate(field: StructField, term: Term, case_sensitive: bool = False) -> Column | None:
    """This column holds this term, or None where the column's type has no reading of the term."""
    if not takes(field.dataType, term):
        return None
    return _holds(quoted(field.name), field.dataType, [term], case_sensitive)


_AND = Column.__and__
_OR = Column.__or__


def _fold(parts: Sequence[Column], op: Callable[[Column, Column], Column]) -> Column:
    """Combine pairwise, so a thousand leaves make a tree ten deep and not a chain a thousand deep."""
    while len(parts) > 1:
        parts = [op(*parts[i : i + 2]) if i + 1 < len(parts) else parts[i] for i in range(0, len(parts), 2)]
    return parts[0]


def _any_term(fields: Sequence[StructField], terms: Sequence[Term], case_sensitive: bool) -> Column | None:
    readable = [(f, [t for t in terms if takes(f.dataType, t)]) for f in fields]
    leaves = [_holds(quoted(f.name), f.dataType, some, case_sensitive) for f, some in readable if some]
    return _fold(leaves, _OR) if leaves else None


def _every_term(fields: Sequence[StructField], terms: Sequence[Term], case_sensitive: bool) -> Column | None:
    wanted = [[f for f in fields if takes(f.dataType, t)] for t in terms]
    if not all(wanted):
        return F.lit(False)
    if not wanted:
        return None
    # A conjunct per term: a row that lacks one term is not looked at for the next.
    every = [_fold([_holds(quoted(f.name), f.dataType, [term], case_sensitive) for f in some], _OR) for term, some in zip(terms, wanted)]
    return _fold(every, _AND)


def row_predicate(
    fields: Iterable[StructField], terms: Sequence[Term], cond: str = OR, case_sensitive: bool = False
) -> Column | None:
    """OR: any term in any column. AND: every term somewhere in the row.

    None means no term can match any column, so the table need not be read. AND with a term that no column can
    hold is a constant false, which Catalyst folds to an empty scan.
    """
    combine = _every_term if read_cond(cond) == AND else _any_term
    return combine(list(fields), terms, case_sensitive)


def searchable_columns(fields: Iterable[StructField], terms: Sequence[Term]) -> list[str]:
    """Columns that at least one term could match, in schema order. Looks at types, not at data."""
    return [f.name for f in fields if any(takes(f.dataType, t) for t in terms)]


def _bound(text: str, kind: DataType, name: str) -> Column:
    if isinstance(kind, StringType):
        return F.lit(text)
    if not isinstance(kind, _DAYS):
        raise ValueError(f"column {name!r} of type {kind.simpleString()} cannot carry a date window")
    day = as_day(text)
    if day is not None:
        return F.lit(day).cast(kind)
    try:
        dt.datetime.fromisoformat(text)
    except ValueError:
        raise ValueError(f"bound {text!r} for column {name!r} is not an ISO date or date-time") from None
    return F.lit(text).cast(TimestampNTZType() if isinstance(kind, DateType) else kind)


def window_predicate(
    fields: Iterable[StructField], ingested_col: str, date_range: tuple[str, str]
) -> Column | None:
    """``start <= column < day after end`` on the bare column; either side may be ``""``.

    None when the column is absent or both sides are open.
    """
    kinds = {f.name: f.dataType for f in fields}
    start, end = date_range
    if ingested_col not in kinds or not (start or end):
        return None
    column, kind = quoted(ingested_col), kinds[ingested_col]
    parts = []
    if start:
        parts.append(column >= _bound(start, kind, ingested_col))
    if end:
        last = as_day(end)
        if last is None:
            raise ValueError(f"end of the date window must be YYYY-MM-DD, got {end!r}")
        parts.append(column < _bound((last + dt.timedelta(days=1)).isoformat(), kind, ingested_col))
    return _fold(parts, _AND)
