"""Tables of HTML pages as cells: spans, header rows, notes, group labels, constant columns and inner headers."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame

#: Share of the columns that a note spans, its least characters and the most of its label.
NOTE_SHARE, NOTE_CHARS, LABEL_CHARS = 0.55, 20, 12
#: A figure is made of digits and signs; so counts any cell with a digit and a percent sign.
_FIGURE = re.compile(r"(?=.*[0-9０-９])[0-9０-９()%％.,+/ -]+")
_SHARE = re.compile(r"[0-9０-９].*[%％]|[%％].*[0-9０-９]", re.S)


class _Tables(HTMLParser):
    """Rows of (text, rowspan, colspan, is_header) of each table; an inner table is read into its cell."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.tables: list[list[list[list]]] = []
        self.depth = 0

    def handle_starttag(self, tag, attrs):
        if tag == "table":
            self.depth += 1
            if self.depth == 1:
                self.tables.append([])
        elif self.depth == 1 and tag == "tr":
            self.tables[-1].append([])
        elif self.depth == 1 and tag in ("td", "th"):
            if not self.tables[-1]:
                self.tables[-1].append([])
            span = {k: int(v) if (v or "").isdigit() else 1 for k, v in attrs if k in ("rowspan", "colspan")}
            self.tables[-1][-1].append(["", max(1, span.get("rowspan", 1)), max(1, span.get("colspan", 1)), tag == "th"])
        elif self.depth and tag == "br":
            self.handle_data(" ")

    def handle_endtag(self, tag):
        if tag == "table" and self.depth:
            self.depth -= 1

    def handle_data(self, data):
        if self.depth and self.tables[-1] and self.tables[-1][-1]:
            self.tables[-1][-1][-1][0] += data


def grid(rows: list[list[list]]) -> list[list[tuple[str, bool]]]:
    """Cells of the table with spans carried to every place they cover."""
    out: list[dict[int, tuple[str, bool]]] = [{} for _ in rows]
    for r, row in enumerate(rows):
        c = 0
        for text, down, across, head in row:
            while c in out[r]:
                c += 1
            for dr in range(min(down, len(rows) - r)):
                for dc in range(across):
                    out[r + dr].setdefault(c + dc, (" ".join(text.split()), head))
            c += across
    width = max((max(r) + 1 for r in out if r), default=0)
    return [[r.get(c, ("", False)) for c in range(width)] for r in out]


def tidy(text: str) -> str:
    return " ".join(text.split())


def is_note(row: list[list], width: int) -> bool:
    """A lone cell over the whole width, or a later cell over NOTE_SHARE of it, of NOTE_CHARS characters."""
    alone = len(row) == 1 and row[0][2] >= width
    return any((alone or i and cell[2] >= NOTE_SHARE * width) and len(tidy(cell[0])) >= NOTE_CHARS for i, cell in enumerate(row))


def note_parts(row: list[list]) -> tuple[str, str]:
    """Label and body of a note: a short first cell is the label of what follows."""
    first, *rest = (tidy(cell[0]) for cell in row)
    body = " ".join(filter(None, rest))
    return (first, body) if body and len(first) <= LABEL_CHARS else ("", f"{first} {body}".strip())


def header_count(rows: list[list[list]]) -> int:
    """Number of header rows: rows of nothing but th cells, then rows with few figures.

    A row ends the header if half its cells are figures or, where the first row
    has none, if any cell is. At least one row is a header, and at least one is
    not, if there are two.
    """
    marked = next((r for r, row in enumerate(rows) if not all(cell[3] for cell in row)), len(rows))
    figures = [sum(bool(_FIGURE.fullmatch(tidy(cell[0]))) or bool(_SHARE.search(cell[0])) for cell in row) for row in rows]
    ends = (r for r in range(max(1, marked), len(rows)) if 2 * figures[r] >= len(rows[r]) or figures[r] and not figures[0])
    return max(1, min(next(ends, len(rows)), len(rows) - 1))


def headers(cells: list[list[tuple[str, bool]]]) -> list[str]:
    """A distinct name a column from its header cells, top down; empty where none of them has text."""
    names: list[str] = []
    seen: dict[str, int] = {}
    for column in zip(*cells):
        parts = [text for text, _ in column]
        name = " ".join(x for i, x in enumerate(parts) if x and (i == 0 or x != parts[i - 1]))
        seen[name] = seen.get(name, 0) + 1
        names.append(f"{name}_{seen[name]}" if name and seen[name] > 1 else name)
    return names


def aligned(body: list[list[str]]) -> list[list[str]]:
    """Rows under a nameless first column, which holds a label of groups: one that starts with another text lacks the label and moves right."""
    label = max((count := Counter(row[0] for row in body if row[0])), key=count.__getitem__, default="")
    return [row if row[0] in ("", label) else ["", *row[:-1]] for row in body]


def filled(body: list[list[str]]) -> list[list[str]]:
    """Rows with the gaps of a column filled where all its other cells are equal."""
    only = [values.pop() if len(values := set(column) - {""}) == 1 else "" for column in zip(*body)]
    return [[x or y for x, y in zip(row, only)] for row in body]


def inner_header(body: list[list[str]], names: list[str]) -> tuple[int, list[str]] | None:
    """Place and names of a second header of two rows inside the table.

    Its first row repeats the first two names before one label over two or more
    columns; the row after it has a name of its own for each of these.
    """
    if len(names) < 2 or not all(names[:2]) or not body or len(body[0]) < 4:
        return None
    for r, (upper, lower) in enumerate(zip(body, body[1:])):
        spanned = [x for x in upper[2:] if x]
        own = lower[2 : 2 + len(spanned)]
        if upper[:2] == names[:2] and len(spanned) > 1 and len(set(spanned)) == 1 and all(own) and len(set(own)) == len(own):
            return r, names[:2] + own
    return None


def cells_of(html: str | None) -> Iterator[tuple[int, int, int, str, str, bool]]:
    """(table, row, column, header, text, is_note) for every cell below the header rows.

    Columns without a name and blank rows are left out. A note is one cell whose
    header is its label; notes are numbered by themselves.
    """
    parser = _Tables()
    parser.feed(html or "")
    for t, rows in enumerate(r for r in parser.tables if any(r)):
        rows = [r for r in rows if r]
        n = header_count(rows)
        names = headers(grid(rows[:n]))
        notes = [is_note(r, len(names)) for r in rows]
        body = [[text for text, _ in row] for row in grid([r for r, note in zip(rows[n:], notes[n:]) if not note])]
        if body and len(body[0]) < len(names):
            body = [row + [""] * (len(names) - len(row)) for row in body]
        if body and not names[0]:
            body = aligned(body)
        body = filled(body)
        inner = inner_header(body, names)
        at = 0
        for r, row in enumerate(body):
            if inner and r in (inner[0], inner[0] + 1) or not any(row):
                continue
            for c, (name, text) in enumerate(zip(inner[1] if inner and r > inner[0] else names, row)):
                if name:
                    yield t, at, c, name, text, False
            at += 1
        for k, row in enumerate(r for r, note in zip(rows[n:], notes[n:]) if note):
            yield t, k, 0, *note_parts(row), True


def first_tables(cells: DataFrame) -> DataFrame:
    """Cells of each page's first table."""
    return cells.where("table_idx = 0")


def html_tables(pages: DataFrame) -> DataFrame:
    """(page_id, table_idx, row_idx, col_idx, header, val, is_note) of (page_id, html)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["page_id", "table_idx", "row_idx", "col_idx", "header", "val", "is_note"]
        for pdf in batches:
            yield pd.DataFrame([(i, *cell) for i, html in zip(pdf["page_id"], pdf["html"]) for cell in cells_of(html)], columns=names)

    return pages.select("page_id", "html").mapInPandas(run, "page_id long, table_idx int, row_idx int, col_idx int, header string, val string, is_note boolean")
