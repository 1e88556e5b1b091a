"""Rating jobs with a model supplied by the user."""

from __future__ import annotations

import math
import queue
import threading
import time
from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cardmill import fixed
from cardmill.functions.verdicts import build_prompt, parse_verdict, verdict_error
from cardmill.operators.jobs import ai_rank, numbered
from cardmill.session import materialize

Scorer = Callable[[list[str]], Sequence[str | None]]
_REPLY = T.StructType([T.StructField("reply", T.StringType()), T.StructField("error", T.StringType())])


Answer = tuple[str | None, str | None]  # a reply, or why there is none


def in_flight(scorer: Scorer, prompts: list[str], at_once: int, timeout: float | None) -> list[Answer]:
    """The answers of a scorer that is asked for one prompt at a time, ``at_once`` of them in flight. A prompt that fails, or
    takes longer than ``timeout`` seconds, fails alone; the late reply is not waited for."""
    done: queue.Queue[tuple[int, Answer]] = queue.Queue()

    def ask(i: int) -> None:
        try:
            (reply,) = scorer([prompts[i]])
            done.put((i, (reply, None)))
        except Exception as e:
            done.put((i, (None, str(e))))

    out: list[Answer | None] = [None] * len(prompts)
    running: dict[int, float] = {}  # prompts in flight, and until when
    following = 0
    while following < len(prompts) or running:
        while following < len(prompts) and len(running) < at_once:
            running[following] = time.monotonic() + timeout if timeout else math.inf
            threading.Thread(target=ask, args=(following,), daemon=True).start()
            following += 1
        first = min(running.values())
        try:
            i, answer = done.get(timeout=None if first == math.inf else max(0.0, first - time.monotonic()))
            if running.pop(i, None) is not None:
                out[i] = answer
        except queue.Empty:
            for i in [i for i, until in running.items() if until <= time.monotonic()]:
                del running[i]
                out[i] = (None, f"no reply within {timeout:g} s")
    return out


def _ask(scorer: Scorer, at_once: int | None, timeout: float | None):
    """A column function that sends the non-null prompts of a batch to the scorer; if that fails, one prompt at a time."""

    def answers(prompts: list[str]) -> list[Answer]:
        if at_once or timeout:
            return in_flight(scorer, prompts, at_once or 1, timeout)
        try:
            replies = list(scorer(prompts))
            if len(replies) != len(prompts):
                raise ValueError(f"{len(replies)} replies to {len(prompts)} prompts")
            return [(r, None) for r in replies]
        except Exception as e:
            return [(None, str(e))] if len(prompts) == 1 else [a for p in prompts for a in answers([p])]

    @F.pandas_udf(_REPLY)
    def ask(prompts: pd.Series) -> pd.DataFrame:
        out = pd.DataFrame({"reply": None, "error": None}, index=prompts.index, dtype=object)
        asked = prompts.notna()
        if asked.any():
            out.loc[asked, ["reply", "error"]] = answers(prompts[asked].tolist())
        return out

    return ask.asNondeterministic()


def first_rows(jobs: DataFrame, limit: int, order: Sequence[str | Column], key: str) -> DataFrame:
    """Flag the rows with the keys of the first ``limit`` rows in ``_chosen``. Rows are numbered in ranges, so that no task
    holds the first ones however many they are."""
    chosen = numbered(jobs.withColumn("_key", F.col(key)), [*order, "_key"], "_place").where(F.col("_place") < limit)
    chosen = materialize(chosen.select(F.col("_key").alias(key)).distinct()).withColumn("_chosen", F.lit(True))
    return jobs.join(chosen, key, "left").withColumn("_chosen", F.coalesce("_chosen", F.lit(False)))


def evaluate_jobs(
    jobs: DataFrame,
    scorer: Scorer | None,
    limit: int | None = None,
    order: Sequence[str | Column] = ("ord",),
    key: str = "ord",
    partitions: int | None = None,
    profile: str = fixed.CANDIDATE_PROFILE,
    at_once: int | None = None,
    timeout: float | None = None,
) -> DataFrame:
    """Add ai_fit, ai_score and ai_reason, best rows first.

    Only the first ``limit`` rows in ``order`` are rated, all rows are returned. A reply that is no
    verdict is asked for once more; a second failure gives fit 'Unknown' and score 0. Without a scorer
    the rows come back as they are. ``partitions`` sets how many batches are rated at a time. By
    default a batch of prompts is one call of the scorer; with ``at_once`` or ``timeout`` (seconds) every prompt is a call, so
    many of them in flight in a task, and one that is too late is a failure of that prompt only.
    """
    if scorer is None:
        return jobs
    flagged = first_rows(jobs, limit, order, key) if limit else jobs.withColumn("_chosen", F.lit(True))
    if partitions:
        flagged = flagged.repartition(partitions, key)
    names = ("title", "company", "location", "department")
    columns = [F.col(c) if c in jobs.columns else F.lit(None).cast("string") for c in names]
    ask = _ask(scorer, at_once, timeout)
    tried = (
        flagged.withColumn("_prompt", F.when(F.col("_chosen"), build_prompt(*columns, profile=profile)))
        .withColumn("_one", ask("_prompt"))
        .withColumn("_verdict", parse_verdict(F.col("_one.reply")))
        .withColumn("_two", ask(F.when(F.col("_verdict").isNull(), F.col("_prompt"))))
        .withColumn("_verdict", F.coalesce("_verdict", parse_verdict(F.col("_two.reply"))))
    )
    error = F.coalesce(F.col("_two.error"), verdict_error(F.col("_two.reply")))
    failed = F.concat(F.lit("evaluation failed: "), error)
    rated = tried.select(
        *jobs.columns,
        F.when(F.col("_chosen"), F.coalesce("_verdict.fit", F.lit("Unknown"))).alias("ai_fit"),
        F.when(F.col("_chosen"), F.coalesce("_verdict.score", F.lit(0))).alias("ai_score"),
        F.when(F.col("_chosen"), F.coalesce("_verdict.reason", failed)).alias("ai_reason"),
    )
    return ai_rank(rated, order)
