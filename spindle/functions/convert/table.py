"""Markdown tables (MD6)."""

from __future__ import annotations


def markdown_table(rows: list[list[str]]) -> str:
    """The first row is the header. Columns are as wide as their widest cell in bytes, 3 at least; short rows are filled up."""
    columns = max(map(len, rows), default=0)
    if not columns:
        return ""
    cells = [[c.replace("|", "\\|") for c in r] + [""] * (columns - len(r)) for r in rows]
    size = lambda c: len(c.encode())
    widths = [max(3, *(size(r[k]) for r in cells)) for k in range(columns)]
    line = lambda r: "|" + "".join(f" {c}{' ' * (w - size(c))} |" for c, w in zip(r, widths)) + "\n"
    return line(cells[0]) + line(["-" * w for w in widths]) + "".join(map(line, cells[1:]))
