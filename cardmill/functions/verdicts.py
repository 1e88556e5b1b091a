"""Prompt text and reply parsing for the model that rates jobs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cardmill import fixed
from cardmill.functions.common import let
from cardmill.functions.text import strip


def build_prompt(
    title: Column, company: Column, location: Column, department: Column, profile: str = fixed.CANDIDATE_PROFILE
) -> Column:
    """The prompt for one job; a missing value reads 'None'."""
    holes = {"title": title, "company": company, "location": location, "department": department}
    pattern = fixed.PROMPT.format(profile=profile.replace("%", "%%"), **{name: "%s" for name in holes})
    return F.format_string(pattern, *[F.coalesce(c.cast("string"), F.lit("None")) for c in holes.values()])


def parse_verdict(reply: Column) -> Column:
    """Struct (fit, score, reason) from a reply, null when the reply is not a valid verdict.

    The JSON object runs from the first '{' to the last '}'. The score is the first run of digits
    clamped to 0..10, so '-5' reads 5 and '7.9' reads 7; a score without digits reads 0.
    """
    found = F.nullif(F.regexp_extract(reply, r"(?s)(\{.*\})", 1), F.lit(""))

    def verdict(x: Column) -> Column:
        fit = strip(F.try_variant_get(x.doc, "$.fit", "string"))
        fit = F.concat(F.upper(F.substring(fit, 1, 1)), F.lower(F.substring(fit, 2, 1 << 30)))
        # the score is read from the text, which keeps numbers of any length
        text = F.coalesce(F.get_json_object(x.found, "$.score"), F.lit(""))
        digits = F.regexp_replace(F.regexp_extract(text, r"(\d+)", 1), "^0+", "")
        score = F.when(digits == "", 0).when(F.length(digits) > 2, 10).otherwise(F.least(digits.cast("int"), F.lit(10)))
        reason = F.try_variant_get(x.doc, "$.reason", "variant")
        valid = (
            fit.isin(fixed.FITS)
            & F.try_variant_get(x.doc, "$.score", "variant").isNotNull()
            & (F.schema_of_variant(reason) == "STRING")
        )
        return F.when(
            valid,
            F.struct(
                fit.alias("fit"),
                score.cast("int").alias("score"),
                F.try_variant_get(x.doc, "$.reason", "string").alias("reason"),
            ),
        )

    return let(let(found, lambda t: F.struct(t.alias("found"), F.try_parse_json(t).alias("doc"))), verdict)


def verdict_error(reply: Column) -> Column:
    """Why a reply gave no verdict."""
    has_object = F.rlike(F.coalesce(reply, F.lit("")), F.lit(r"(?s)\{.*\}"))
    return F.when(has_object, "reply is not a valid verdict").otherwise("no JSON object in reply")
