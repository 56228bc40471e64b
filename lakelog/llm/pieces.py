"""Cutting a text at places no byte-level BPE pre-token crosses, and remembering what each cut piece encodes to.

The pre-token pattern lets white space only open a match, never follow other characters in one. So a text may be cut
before every single space that follows a character that is not white space. The pieces repeat far more often than texts
do, which makes a bounded memory of their ids worth having.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable

_SPACE_AFTER_SPACE = re.compile(r"\s ")
_CUT = re.compile(r"(?<=\S) ")

#: Entries of one generation of the memory, and the longest piece that is remembered.
MEMORY = 400_000
LONGEST = 48


def cut(text: str) -> list[str]:
    """The pieces of a text. All but the first stand after one space that is part of the piece but not returned."""
    return _CUT.split(text) if _SPACE_AFTER_SPACE.search(text) else text.split(" ")


class Memory(dict):
    """A function's results by argument, in two generations of bounded size: what is asked for again survives."""

    def __init__(self, function: Callable[[str], bytes] | None = None, entries: int = MEMORY) -> None:
        super().__init__()
        self.function, self.entries, self.older = function, entries, {}

    def __missing__(self, key):
        value = self.older.get(key)
        if value is None:
            value = self.function(key)
        if len(key) <= LONGEST:
            self.keep(key, value)
        return value

    def keep(self, key, value) -> None:
        if len(self) >= self.entries:
            self.older = dict(self)
            self.clear()
        self[key] = value

    def lacking(self, keys: Iterable[str]) -> set[str]:
        return set(keys).difference(self).difference(self.older)
