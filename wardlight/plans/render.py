"""Small reports as text and HTML. Only results of a bounded number of rows come here; every value is put on one line."""

from __future__ import annotations

import html
import re

from pyspark.sql import DataFrame

_BREAKS = re.compile(r"[\x00-\x1f\x7f-\x9f\u2028\u2029\s]+")
MOST_ROWS, MOST_CHARS = 200, 60


def shown(value) -> str:
    """A value in one line, cut where it is long."""
    if value is None:
        return "-"
    if isinstance(value, float):
        return f"{value:.4g}"
    text = ", ".join(map(shown, value)) if isinstance(value, list) else _BREAKS.sub(" ", str(value)).strip()
    return text if len(text) <= MOST_CHARS else text[: MOST_CHARS - 1] + "…"


def table(df: DataFrame, most: int = MOST_ROWS) -> tuple[list[str], list[list[str]], bool]:
    """(columns, rows, more): the first rows as text, and whether there are others."""
    rows = df.limit(most + 1).collect()
    return df.columns, [[shown(v) for v in r] for r in rows[:most]], len(rows) > most


def as_text(title: str, df: DataFrame, most: int = MOST_ROWS) -> str:
    names, rows, more = table(df, most)
    wide = [max(len(n), *(len(r[i]) for r in rows), 0) if rows else len(n) for i, n in enumerate(names)]
    line = lambda cells: "  ".join(c.ljust(w) for c, w in zip(cells, wide, strict=True)).rstrip()
    return "\n".join([title, "=" * len(title), line(names), *map(line, rows), *(["(more rows)"] if more else []), *(["(none)"] if not rows else [])])


def as_html(title: str, df: DataFrame, most: int = MOST_ROWS) -> str:
    names, rows, more = table(df, most)
    cells = lambda tag, values: "".join(f"<{tag}>{html.escape(v)}</{tag}>" for v in values)
    body = "".join(f"<tr>{cells('td', r)}</tr>" for r in rows) + ("<tr><td>(more rows)</td></tr>" if more else "")
    return f"<section><h2>{html.escape(title)}</h2><table><tr>{cells('th', names)}</tr>{body}</table></section>"
