"""A search term and the typed readings it allows."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass
from decimal import Decimal

_LONG = range(-(2**63), 2**63)
_DECIMAL_DIGITS = 38


def _as_number(text: str) -> int | float | Decimal | None:
    """Python's own number syntax, so ``1_000``, ``" 42 "``, ``1e3`` and ``nan`` count as numbers.

    ``try_cast`` reads fewer of these, which is why a term is read once on the driver.
    """
    for reader in (int, float):
        try:
            value = reader(text)
        except ValueError:
            continue
        if isinstance(value, float) or value in _LONG:
            return value
        # Past 64 bits Spark has no integer literal; past 38 digits it has no number at all.
        return Decimal(value) if len(str(abs(value))) <= _DECIMAL_DIGITS else None
    return None


def as_day(text: str) -> dt.date | None:
    """A calendar day from ``YYYY-MM-DD`` (one-digit month and day allowed), else None."""
    try:
        return dt.datetime.strptime(text, "%Y-%m-%d").date()
    except ValueError:
        return None


@dataclass(frozen=True)
class Term:
    """One search word with its readings; a reading is None where the word has none."""

    text: str
    number: int | float | Decimal | None
    day: dt.date | None
    truth: bool | None

    @classmethod
    def read(cls, text: str) -> Term:
        return cls(text, _as_number(text), as_day(text), {"true": True, "false": False}.get(text.lower()))
