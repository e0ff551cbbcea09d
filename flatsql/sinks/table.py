"""Results as a table for terminals."""

from __future__ import annotations

import shutil
from collections.abc import Sequence

#: Corners and rules: top, below the header, between rows, bottom (left, fill, crossing, right), and the upright.
STYLES = {
    "unicode": ("┌─┬┐", "├─┼┤", "├─┼┤", "└─┴┘", "│"),
    "ascii": ("+-++", "+-++", "+-++", "+-++", "|"),
    "minimal": ("    ", " -  ", None, "    ", " "),
    "markdown": (None, "|-||", None, None, "|"),
    "none": (None, None, None, None, " "),
}
LEAST = 4


def _rule(widths: Sequence[int], shape: str | None) -> list[str]:
    if shape is None:
        return []
    left, fill, cross, right = shape
    return [left + cross.join(fill * (w + 2) for w in widths) + right]


def _line(cells: Sequence[str], widths: Sequence[int], upright: str) -> str:
    return upright + upright.join(f" {c}{' ' * (w - len(c))} " for c, w in zip(cells, widths, strict=True)) + upright


def _wrapped(text: str, width: int) -> list[str]:
    return [piece[i : i + width] for piece in text.split("\n") for i in range(0, max(len(piece), 1), width)]


def render_table(columns: Sequence[str], rows: Sequence[Sequence[str]], style: str = "unicode", width: int | None = None, wrap: bool = False) -> str:
    """The table within `width` characters (None: the terminal's).

    Columns that do not fit are left out on the right and counted in a last one; wrap: all columns share the
    width instead, and long values go on in further lines.
    """
    if style not in STYLES:
        raise ValueError(f"unknown style: {style}")
    width = width or shutil.get_terminal_size((120, 40)).columns
    columns = list(columns)
    body = [[cell if wrap else cell.replace("\n", " ") for cell in row] for row in rows]
    widths = [max([len(c), *(max(map(len, r[i].split("\n"))) for r in body)]) for i, c in enumerate(columns)]
    total = lambda ws: sum(ws) + 3 * len(ws) + 1
    if wrap and total(widths) > width:
        room = max(width - 3 * len(widths) - 1, LEAST * len(widths))
        while sum(widths) > room:
            widest = max(range(len(widths)), key=widths.__getitem__)
            widths[widest] -= 1
    elif total(widths) > width and len(columns) > 1:
        keep = len(columns)
        while keep > 1 and total([*widths[:keep], len(f"+{len(columns) - keep}")]) > width:
            keep -= 1
        more = f"+{len(columns) - keep}"
        if keep < len(columns):
            columns, body = [*columns[:keep], more], [[*r[:keep], "…"] for r in body]
            widths = [*widths[:keep], len(more)]
    top, below, between, bottom, upright = STYLES[style]

    def lines(cells: Sequence[str]) -> list[str]:
        split = [_wrapped(c, max(w, 1)) for c, w in zip(cells, widths, strict=True)]
        deep = max(map(len, split), default=1)
        return [_line([s[i] if i < len(s) else "" for s in split], widths, upright) for i in range(deep)]

    out = _rule(widths, top) + lines(columns) + _rule(widths, below)
    for i, row in enumerate(body):
        out += (_rule(widths, between) if i else []) + lines(row)
    return "\n".join(out + _rule(widths, bottom)) + "\n"
