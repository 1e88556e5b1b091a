"""Line-first cleaning: lines that fail a rule are removed, then documents that lost too much text are rejected.

A line fails if it has words but no sentence end and is short, if runs of marks follow more than a quarter of its words, if
bars or arrows part it like a menu, or if it is not long and holds a boilerplate phrase as words of its own. Before that a document has to pass base rules: enough words, and not too many of them in repeated
three-word windows. Everything is built from DataFrame functions over the row's own arrays: nothing is shuffled, and the
work on a text grows as n log n.

Defined results: a null or empty text has no words, fails the base rules and is not kept. Rows are judged one by one, so
ties and repeated rows change nothing. Input columns of the same names as the result's are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cardmill.llm.tables import replace_columns

MIN_WORDS = 50
MAX_REPEATED = 50  # per cent of a text's words
MIN_KEPT = 50  # per cent of a text's word characters
SHORT_LINE = 8  # words
PHRASE_LINE = 15  # words of the longest line that goes for a phrase
MENU_PARTS = 3
GAP = r"[\x20\x09-\x0D]+"
SENTENCE_END = r"[.!?:;…\"”»)]$"
MARKS = r"[!?#*$%&]{2,}"
MENU = r"[|»›•·→]"
# fixed values: phrases of navigation and notices, in lower case
BOILERPLATE = [
    "accept cookies", "all rights reserved", "back to top", "click here", "cookie policy", "enable javascript", "log in", "lorem ipsum",
    "privacy policy", "read more", "share this", "sign up", "skip to content", "subscribe to", "terms of use", "use of cookies",
]
PHRASE = r"(?:^|[^\p{L}\p{N}])(?:" + "|".join(BOILERPLATE) + r")(?:$|[^\p{L}\p{N}])"
ADDED = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "lines", "kept_text", "kept_chars", "kept")


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, GAP), lambda w: w != "")


def repeated_words(words: Column) -> Column:
    """Words in three-word windows that occur twice or more: equal windows are neighbours once sorted by hash and place."""
    n = F.size(words)
    windows = F.when(n >= 3, F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.struct(
        F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)).alias("h"), i.alias("i"))))
    return windows


def covered(places: Column) -> Column:
    """Words covered by windows of three at the sorted places."""
    gaps = F.transform(places, lambda p, k: F.least(F.lit(3), F.coalesce(F.get(places, k + 1) - p, F.lit(3))))
    return F.coalesce(F.aggregate(gaps, F.lit(0).cast("long"), lambda a, x: a + x), F.lit(0).cast("long"))


def line_fails(line: Column) -> Column:
    """Whether a line (without outer blanks, not empty) goes."""
    n_words = F.size(F.split(line, GAP))
    unfinished = (n_words < SHORT_LINE) & ~line.rlike(SENTENCE_END)
    marked = F.size(F.regexp_extract_all(line, F.lit(MARKS), F.lit(0))) * 4 > n_words
    menu = F.length(line) - F.length(F.regexp_replace(line, MENU, "")) >= MENU_PARTS
    boilerplate = (n_words <= PHRASE_LINE) & F.lower(line).rlike(PHRASE)
    return unfinished | marked | menu | boilerplate


def clean(docs: DataFrame, text: str = "text") -> DataFrame:
    """The documents with the base counts, ``kept_text`` (the lines that stay) and the verdict ``kept``."""
    docs = replace_columns(docs, *ADDED)
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    kept_columns = [F.col(f"`{c}`") for c in docs.columns]
    step = docs.select(*kept_columns, words_of(body).alias("__words"), F.filter(F.split(body, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("lines"))
    step = step.select(
        *kept_columns, "lines", F.size("__words").cast("long").alias("n_words"),
        F.length(F.array_join("__words", "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace(body, r"[^#*$%&|<>]", "")).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.sort_array(repeated_words(F.col("__words"))).alias("__windows"),
        F.filter(F.transform("lines", lambda x: F.regexp_replace(x, r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "")), lambda x: ~line_fails(x)).alias("__good"),
    )
    windows = F.col("__windows")
    twice = F.filter(windows, lambda w, k: (w.h == F.get(windows, k - 1).h) | (w.h == F.get(windows, k + 1).h))
    step = step.select(*kept_columns, *ADDED[:4], "__good", F.sort_array(F.transform(twice, lambda w: w.i)).alias("__places"))
    step = step.select(*kept_columns, *ADDED[:4], covered(F.col("__places")).alias("n_repeat_words"), F.array_join("__good", "\n").alias("kept_text"))
    step = step.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MAX_REPEATED))
    step = step.withColumn("kept_chars", F.length(F.regexp_replace("kept_text", GAP, "")).cast("long"))
    return step.withColumn("kept", ~F.col("base_failed") & (F.col("kept_chars") * 100 >= F.col("word_chars") * MIN_KEPT))


def oracle(table: str = "documents") -> str:
    """The same columns in DuckDB SQL."""
    end, menu, gap = SENTENCE_END.replace("\\\"", '"'), MENU, GAP
    return f"""
WITH a AS (
  SELECT doc_id, coalesce(text, '') AS body FROM {table}
), b AS (
  SELECT doc_id, body, list_filter(regexp_split_to_array(body, '{gap}'), lambda x: x <> '') AS words,
    list_filter(string_split(body, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines FROM a
), w AS (
  SELECT doc_id, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS g
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 1)) AS i FROM b WHERE len(words) >= 3)
), r AS (
  SELECT doc_id, count(DISTINCT p) AS n FROM (
    SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM w) WHERE c > 1
  ) GROUP BY doc_id
), c AS (
  SELECT b.doc_id, len(words) AS n_words, length(array_to_string(words, '')) AS word_chars,
    length(regexp_replace(body, '[^#*$%&|<>]', '', 'g')) AS n_symbols, len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words,
    list_filter(list_transform(lines, lambda x: regexp_replace(x, '^[\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+$', '', 'g')), lambda x: NOT (
      (len(regexp_split_to_array(x, '{gap}')) < {SHORT_LINE} AND NOT regexp_matches(x, '{end}'))
      OR len(regexp_extract_all(x, '{MARKS}')) * 4 > len(regexp_split_to_array(x, '{gap}'))
      OR length(x) - length(regexp_replace(x, '{menu}', '', 'g')) >= {MENU_PARTS}
      OR (len(regexp_split_to_array(x, '{gap}')) <= {PHRASE_LINE} AND regexp_matches(lower(x), '{PHRASE}')))) AS good
  FROM b LEFT JOIN r USING (doc_id)
), d AS (
  SELECT *, n_words < {MIN_WORDS} OR n_repeat_words * 100 > n_words * {MAX_REPEATED} AS base_failed,
    length(regexp_replace(array_to_string(good, ' '), '{gap}', '', 'g')) AS kept_chars FROM c
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND kept_chars * 100 >= word_chars * {MIN_KEPT} AS kept, kept_chars FROM d
"""
