"""Text columns: line cleaning, slugs, plausibility and block checks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from cardmill import fixed

# Line ends and blanks as Python's str methods see them; Java's \s leaves out 0x1C-0x1F.
LINE_END = r"[\n\r\x0B\f\x1C-\x1E\u0085\u2028\u2029]"
BLANK = r"(?U)[\s\x1C-\x1F]"
FIRST_LINE = rf"(?U)^[\s\x1C-\x1F]*([^{LINE_END[1:-1]}]*)"
EDGE_BLANKS = rf"{BLANK}+$|^[\s\x1C-\x1F]+"


def strip(c: Column) -> Column:
    """Trim every Unicode blank from both ends."""
    return F.regexp_replace(c, EDGE_BLANKS, "")


def none_if_empty(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def clean_lines(c: Column) -> Column:
    """Array of the non-empty lines with blanks collapsed."""
    lines = F.transform(
        F.split(c, LINE_END), lambda line: F.trim(F.regexp_replace(line, BLANK + "+", " "))
    )
    return F.filter(lines, lambda line: line != "")


def clean_text(c: Column, single_line: bool = False) -> Column:
    """Collapse blanks, keep the first line or the distinct lines joined by ' | ', drop one leading label.

    The label rule also hits titles ("Team Lead" gives "Lead"); a blank after the label is required.
    """
    if single_line:
        # the first line that is not blank starts at the first character that is not blank
        line = F.regexp_extract(c, FIRST_LINE, 1)
        text = F.trim(F.regexp_replace(line, BLANK + "+", " "))
    else:
        text = F.array_join(F.array_distinct(clean_lines(c)), " | ")
    return none_if_empty(F.trim(F.regexp_replace(text, "(?iU)" + fixed.LABEL_PREFIX, "")))


def slugify(c: Column) -> Column:
    slug = F.btrim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "-"), F.lit("-"))
    return F.coalesce(none_if_empty(slug), F.when(c.isNotNull(), F.lit("company")))


def is_plausible_query(c: Column) -> Column:
    """A search query is one short non-blank line."""
    ok = (strip(c) != "") & (F.length(c) <= fixed.MAX_QUERY_CHARS) & ~F.contains(c, F.lit("\n"))
    return F.coalesce(ok, F.lit(False))


def block_reason(
    html: Column, status: Column | None = None, markers: Sequence[str] = tuple(fixed.CHALLENGE_MARKERS)
) -> Column:
    """Why a page looks like a bot check, else null: first marker anywhere in the page, then the status."""
    head = F.lower(F.coalesce(html, F.lit("")))
    reasons = [F.when(F.contains(head, F.lit(m)), F.lit(f"challenge page ({m})")) for m in markers]
    if status is not None:
        reasons.append(
            F.when(status.isin(fixed.BLOCK_STATUSES), F.concat(F.lit("HTTP "), status.cast("string")))
        )
    return F.coalesce(*reasons, F.lit(None).cast("string"))
