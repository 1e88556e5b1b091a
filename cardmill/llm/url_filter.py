"""URL filter: exact allow and block rules first, and for urls without a rule a logistic regression on hashed character
n-grams of host and path, trained from a small labelled table of urls.

Rules are `host/path`: one fits its host and all subdomains where the url's path starts with its path; the longest wins.

Defined results: a null url, or one without ``://``, has an empty host and path and goes to the model like others. Without
labelled urls of both kinds the model allows all. Repeated urls are judged alike. Input columns of the same names as the
result's are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cardmill.llm.arrow_text import byte_column, chunks
from cardmill.llm.tables import replace_columns

BUCKETS = 1 << 16
ORDERS = (3, 4, 5)
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def fitting_rule(host: Column, path: Column, rules: dict[str, str]) -> Column:
    """The longest rule that fits, else null; of equally long ones the first by name."""
    found = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r), [-ord(c) for c in r])):
        name, slash, rest = rule.partition("/")
        fits = ((host == name) | host.endswith(f".{name}")) & path.startswith(slash + rest)
        found = F.when(fits, rule).otherwise(found)
    return found


def features(urls: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(row, bucket) of the distinct hashed n-grams of the bytes of every text."""
    data, offsets = byte_column(urls)
    row = np.searchsorted(offsets, np.arange(len(data)), "right") - 1
    end = offsets[row + 1] if len(data) else row
    code, found = np.zeros(len(data), np.uint64), []
    for n in range(1, max(ORDERS) + 1):
        at = np.arange(len(data)) + n - 1
        code = (code + data[np.minimum(at, max(0, len(data) - 1))].astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        if n in ORDERS:
            keep = at < end
            found.append(row[keep] * BUCKETS + ((code[keep] * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(48)).astype(np.int64))
    cells = np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)
    return cells // BUCKETS, cells % BUCKETS


@dataclass(frozen=True)
class Model:
    weights: np.ndarray
    bias: float

    def probability(self, urls: pa.Array) -> np.ndarray:
        row, bucket = features(urls)
        return 1 / (1 + np.exp(-(self.bias + np.bincount(row, self.weights[bucket], minlength=len(urls)))))


def fit(urls: list[str], labels: np.ndarray, rounds: int = 200, rate: float = 0.5, penalty: float = 1e-4) -> Model:
    """Gradient descent with a step per weight that follows its past gradients; labels are 1 for block."""
    weights, bias = np.zeros(BUCKETS), 0.0
    if not len(labels) or labels.min() == labels.max():
        return Model(weights, -10.0)
    row, bucket = features(pa.array(urls, pa.string()))
    past, past_bias = np.full(BUCKETS, 1e-8), 1e-8
    for _ in range(rounds):
        off = 1 / (1 + np.exp(-(bias + np.bincount(row, weights[bucket], minlength=len(urls))))) - labels
        gradient = np.bincount(bucket, off[row], minlength=BUCKETS) / len(urls) + penalty * weights
        past, past_bias = past + gradient**2, past_bias + off.mean() ** 2
        weights, bias = weights - rate * gradient / np.sqrt(past), bias - rate * off.mean() / np.sqrt(past_bias)
    return Model(weights, float(bias))


def train(labelled: DataFrame, max_rows: int = 4_000) -> Model:
    """Fit on (key, url, block): all different rows, or ``max_rows`` of them, half of either kind, those with the smallest
    hashes of key and url."""
    rows = []
    for block in (False, True):
        kind = labelled.where(F.col("block") == block).select("key", "url", "block").distinct()
        kind = kind.withColumn("place", F.xxhash64(F.coalesce(F.col("key").cast("string"), F.lit("")), "url"))
        rows += kind.orderBy("place", "key", "url").limit(max_rows // 2).collect()
    rows.sort(key=lambda r: (str(r.key), r.url or ""))
    return fit([r.url or "" for r in rows], np.array([float(r.block) for r in rows]))


# fixed values: words of hosts and paths that are blocked, and of such that are allowed
BLOCKED_WORDS = [
    "casino", "poker", "jackpot", "betting", "slots", "roulette", "pills", "viagra", "cialis", "steroids", "porn", "xxx", "sexcam", "escort", "nude",
    "torrent", "warez", "keygen", "cracked", "payday", "loans", "replica", "clickbait", "adserver",
]
ALLOWED_WORDS = [
    "news", "docs", "library", "museum", "university", "school", "weather", "recipes", "garden", "history", "science", "travel", "music", "journal", "health",
    "archive", "forum", "blog", "maps", "sports", "council", "theatre", "books", "photos",
]
# fixed values: ends of hosts and shapes of urls that both kinds have alike
LABELLED_ENDS = ["com", "org", "de", "fr", "info"]
LABELLED_SHAPES = ["{w}.{d}/", "{w}-online.{d}/{n}?page={k}", "www.my{w}.{d}/en/{n}", "host{n}.{d}/{w}/{k}", "the{w}site.{d}/fr/{n}?ref=x"]


def labelled_urls(spark: SparkSession) -> DataFrame:
    """A small labelled table (key, url, block) to train from: every word in every shape, in turn under every end, so that
    neither the end nor the shape tells the label."""
    rows = []
    for block, words in ((True, BLOCKED_WORDS), (False, ALLOWED_WORDS)):
        for i, word in enumerate(words):
            for j, shape in enumerate(LABELLED_SHAPES):
                url = shape.format(w=word, d=LABELLED_ENDS[(i + j) % len(LABELLED_ENDS)], n=(7 * i + 31 * j) % 97, k=(i + j) % 9)
                rows.append((len(rows), url, block))
    return spark.createDataFrame(rows, "key long, url string, block boolean")


def judge(pages: DataFrame, rules: dict[str, str], model: Model, url: str = "url") -> DataFrame:
    """The pages with host, path, rule, verdict and the model's probability to block. One pass, no shuffle."""
    pages = replace_columns(pages, "host", "path", "rule", "verdict", "block_score")
    names = [*pages.columns, "host", "path"]
    judged = pages.withColumns({"host": host_of(F.col(f"`{url}`")), "path": path_of(F.col(f"`{url}`"))}).select(*[F.col(f"`{c}`") for c in names], F.concat("host", "path").alias("__url"))
    shared = pages.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for part, _, _ in chunks(batches, "__url"):
            score = shared.value.probability(part.column(len(names)))
            yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(score)], names=[*names, "block_score"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in judged.drop("__url").schema)
    judged = judged.mapInArrow(run, f"{schema}, block_score double")
    judged = judged.withColumn("rule", fitting_rule(F.col("host"), F.col("path"), rules))
    action = F.create_map(*[F.lit(x) for pair in rules.items() for x in pair])
    return judged.withColumn("verdict", F.when(F.col("rule").isNotNull(), action[F.col("rule")]).when(F.col("block_score") >= 0.5, "block").otherwise("allow"))
