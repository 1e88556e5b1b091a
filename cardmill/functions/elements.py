"""Columns over one element: stability of names, signatures, controls and field vocabularies."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cardmill import fixed
from cardmill.functions.text import strip


def is_stable_class(c: Column) -> Column:
    """Reject state classes, CSS-in-JS prefixes, module hashes and machine-made short names."""
    tail = F.substring_index(c, "__", -1)
    plain = ~F.rlike(c, F.lit("[-_]"))
    has_digit = F.rlike(c, F.lit(r"\d"))
    return (
        (c != "")
        & (F.length(c) <= 40)
        & ~F.rlike(c, F.lit(fixed.STATE_CLASS))
        & ~F.rlike(c, F.lit(fixed.CSS_IN_JS_CLASS))
        & ~(F.rlike(c, F.lit("__[A-Za-z0-9_-]{5,}$")) & F.rlike(tail, F.lit(r"\d")))
        & ~(F.rlike(c, F.lit("(?i)[-_][a-f0-9]{5,}$")) & has_digit)
        & ~(plain & has_digit & F.rlike(c, F.lit("[A-Za-z]")) & (F.length(c) <= 12))
        & ~(plain & (F.length(c) <= 8) & F.rlike(c, F.lit("[A-Z][^A-Z]*[A-Z][^A-Z]*[A-Z]")))
    )


def is_stable_id(c: Column) -> Column:
    usable = (c != "") & (F.length(c) <= 40) & ~F.rlike(c, F.lit(r"\d{3,}|:|^\d"))
    return F.coalesce(usable & is_stable_class(c), F.lit(False))


def stable_classes(classes: Column) -> Column:
    return F.filter(classes, is_stable_class)


def stable_attrs(attrs: Column, for_item: bool = True) -> Column:
    """All stable (key, value) entries of an attribute map, in source order.

    ``for_item`` keeps only attributes that do not carry the text of a single repeated item.
    """

    def keep(a: Column) -> Column:
        item_safe = F.rlike(a.key, F.lit(fixed.ITEM_ATTRS))
        named = item_safe if for_item else item_safe | F.rlike(a.key, F.lit(fixed.SINGLE_ATTRS))
        steady = (
            (a.value != "")
            & (F.length(a.value) <= 40)
            & ~F.rlike(a.value, F.lit(r"\d{3,}"))
            & ~F.rlike(a.value, F.lit("(?i)^[0-9a-f-]{16,}$"))
        )
        if for_item:
            is_data = F.startswith(a.key, F.lit("data-"))
            steady &= ~(is_data & (F.rlike(a.value, F.lit(r"\s|\d")) | (F.length(a.value) > 25)))
        return named & steady

    return F.filter(F.map_entries(attrs), keep)


def css_name(c: Column) -> Column:
    """Escape a class or id for use in a selector."""
    escaped = F.regexp_replace(c, r"([^A-Za-z0-9_\-\x{80}-\x{10FFFF}])", r"\\$1")
    return F.regexp_replace(escaped, r"^(-?)(\d)", r"$1\\3$2 ")


def css_attr(a: Column) -> Column:
    """'[name="value"]' for one attribute entry."""
    value = F.regexp_replace(a.value, r'(["\\])', r"\\$1")
    return F.concat(F.lit("["), a.key, F.lit('="'), value, F.lit('"]'))


def signature(tag: Column, classes: Column, attrs: Column) -> Column:
    """Selector text from a tag, up to three classes and up to three attribute entries."""
    return F.concat(
        tag,
        F.array_join(F.transform(F.slice(classes, 1, 3), lambda c: F.concat(F.lit("."), css_name(c))), ""),
        F.array_join(F.transform(F.slice(attrs, 1, 3), css_attr), ""),
    )


def element_signature(tag: Column, classes: Column, attrs: Column, for_item: bool = True) -> Column:
    return signature(tag, stable_classes(classes), stable_attrs(attrs, for_item))


# --- controls -----------------------------------------------------------------------------------
def control_disabled(classes: Column, attrs: Column) -> Column:
    """Disabled by attribute, by aria state, by class name, or by inline 'pointer-events: none'."""
    style = F.coalesce(F.try_element_at(attrs, F.lit("style")), F.lit(""))
    return (
        F.map_contains_key(attrs, "disabled")
        | (F.coalesce(F.try_element_at(attrs, F.lit("aria-disabled")), F.lit("")) == "true")
        | F.rlike(F.array_join(classes, " "), F.lit(fixed.DISABLED_CLASS))
        | F.rlike(style, F.lit(r"(?i)pointer-events\s*:\s*none"))
    )


def classify_pagination(text: Column, attrs: Column, page_template: Column) -> Column:
    """'page_number', 'load_more' or 'next' for a control that shows more rows."""
    text = strip(F.coalesce(text, F.lit("")))
    words = [F.coalesce(F.try_element_at(attrs, F.lit(a)), F.lit("")) for a in ("aria-label", "class", "rel")]
    blob = F.lower(F.concat_ws(" ", text, *words))
    return (
        F.when(F.rlike(text, F.lit(r"(?U)^\d+$")) & (F.coalesce(page_template, F.lit("")) != ""), "page_number")
        .when(F.rlike(blob, F.lit("(?U)" + fixed.LOAD_MORE)), "load_more")
        .otherwise("next")
    )


def page_number_template(text: Column, sig: Column) -> Column:
    """Selector for 'the control whose text is page n', when the control shows a number."""
    return F.when(F.rlike(strip(text), F.lit(r"^\d+$")), F.concat(sig, F.lit(':text-is("{page}")')))


# --- field vocabularies -------------------------------------------------------------------------
# A word boundary between ASCII word characters only; Java's own depends on its version.
ASCII_BOUNDARY = r"(?:(?<![A-Za-z0-9_])(?=[A-Za-z0-9_])|(?<=[A-Za-z0-9_])(?![A-Za-z0-9_]))"


def _has_word(c: Column, pattern: str) -> Column:
    return F.rlike(c, F.lit(pattern.replace(r"\b", ASCII_BOUNDARY)))


def is_location(c: Column) -> Column:
    """A place word, or ', XX' with any two letters in any case."""
    return _has_word(c, fixed.LOCATION_WORDS)


def is_date(c: Column) -> Column:
    return _has_word(c, fixed.DATE_WORDS)


def is_department(c: Column) -> Column:
    return _has_word(c, fixed.DEPARTMENT_WORDS)


def text_category(c: Column) -> Column:
    """Struct of the three vocabulary flags for a text."""
    return F.struct(
        is_location(c).alias("location"), is_date(c).alias("posted"), is_department(c).alias("department")
    )
