"""Tables, and where intermediate ones go."""

from __future__ import annotations

from vectide.storage import table, written

__all__ = ["plain", "table", "written"]


def plain(text: str) -> str:
    """A column's name, quoted for use in an expression."""
    return "`" + text.replace("`", "``") + "`"
