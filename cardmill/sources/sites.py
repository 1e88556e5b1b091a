"""Site configs: one JSON document per site that says where cards, fields and paging controls are."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cardmill import fixed
from cardmill.functions.text import slugify

_SELECTOR = (
    "STRUCT<candidates: ARRAY<STRING>, fingerprint: STRUCT<tag: STRING, text: STRING, attrs: MAP<STRING, STRING>, "
    "rect: STRUCT<x: DOUBLE, y: DOUBLE, width: DOUBLE, height: DOUBLE>>>"
)
SITE_SCHEMA = f"""
    schema_version INT, name STRING, slug STRING, start_url STRING, frame_url_contains STRING,
    dom STRUCT<card: {_SELECTOR},
               fields: MAP<STRING, STRUCT<selectors: ARRAY<STRING>, attr: STRING, closest: BOOLEAN>>,
               apply_url_template: STRING>,
    popups ARRAY<{_SELECTOR}>,
    search STRUCT<query: STRING, input: {_SELECTOR}, submit: STRING, submit_button: {_SELECTOR},
                  results_url: STRING>,
    pagination STRUCT<type: STRING, control: {_SELECTOR}, page_number_template: STRING, url_template: STRING,
                      max_pages: INT>,
    onboarded_at STRING, onboarded_job_count INT, notes ARRAY<STRING>
"""


def _reject_reason() -> Column:
    def missing(path: str) -> Column:
        return F.when(F.col(path).isNull(), F.lit(f"{path} is missing"))

    def not_in(path: str, allowed: list[str]) -> Column:
        return F.when(~F.col(path).isin(allowed), F.lit(f"{path} is not one of {', '.join(allowed)}"))

    # a selector that is given must list its candidates
    def no_candidates(path: str) -> Column:
        return F.when(F.col(path).isNotNull() & F.col(f"{path}.candidates").isNull(), F.lit(f"{path}.candidates is missing"))

    return F.coalesce(
        F.when(F.col("_corrupt").isNotNull(), F.lit("not a valid document")),
        *[missing(p) for p in ("name", "slug", "start_url", "dom.card.candidates", "dom.fields")],
        F.when(F.col("search").isNotNull() & F.col("search.query").isNull(), F.lit("search.query is missing")),
        not_in("search.submit", fixed.SUBMIT_KINDS),
        not_in("pagination.type", fixed.PAGINATION_KINDS),
        *[no_candidates(p) for p in ("search.input", "search.submit_button", "pagination.control")],
        F.when(F.exists("popups", lambda p: p.candidates.isNull()), F.lit("popups.candidates is missing")),
    )


def with_defaults(sites: DataFrame) -> DataFrame:
    """Fill the optional parts of site configs with their defaults."""
    p = F.col("pagination")
    paging = F.struct(
        F.coalesce(p.type, F.lit("none")).alias("type"),
        p.control.alias("control"),
        p.page_number_template.alias("page_number_template"),
        p.url_template.alias("url_template"),
        F.coalesce(p.max_pages, F.lit(fixed.DEFAULT_MAX_PAGES)).alias("max_pages"),
    )
    search = F.when(
        F.col("search").isNotNull(),
        F.col("search").withField("submit", F.coalesce("search.submit", F.lit("enter"))),
    )
    empty_popups = F.from_json(F.lit("[]"), sites.schema["popups"].dataType)
    return sites.withColumns(
        {
            "schema_version": F.coalesce("schema_version", F.lit(fixed.SCHEMA_VERSION)),
            "pagination": paging,
            "search": search,
            "popups": F.coalesce("popups", empty_popups),
            "onboarded_at": F.coalesce("onboarded_at", F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss")),
            "onboarded_job_count": F.coalesce("onboarded_job_count", F.lit(0)),
            "notes": F.coalesce("notes", F.array().cast("array<string>")),
        }
    )


def scan_site_configs(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """All documents of a folder with their file ``stem`` and, for unusable ones, a ``reject_reason``.

    A file is one document; with ``lines`` (as ``write_site_configs`` writes them) it has a document on each line, whose
    slug stands for the stem. The schema version is not compared; only a document that does not fit is rejected.
    """
    raw = (
        spark.read.schema(SITE_SCHEMA + ", _corrupt STRING")
        .option("multiLine", not lines)
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", "_corrupt")
        .option("pathGlobFilter", "*.json")
        .json(path)
        .withColumn("stem", F.col("slug") if lines else F.regexp_replace(F.col("_metadata.file_name"), r"\.json$", ""))
    )
    return raw.withColumn("reject_reason", _reject_reason())


def read_site_configs(spark: SparkSession, path: str, names: Iterable[str] | None = None, lines: bool = False) -> DataFrame:
    """Valid site configs in file-name order with defaults filled; unusable documents are left out."""
    found = filter_sites(scan_site_configs(spark, path, lines), names)
    found = found.filter(F.col("reject_reason").isNull()).drop("_corrupt", "reject_reason")
    if not lines:  # a sort reads its input twice; so it is a shuffle that it reads, and the many files are opened once
        found = found.repartition("stem")
    return with_defaults(found).orderBy("stem")


def rejected_site_configs(spark: SparkSession, path: str) -> DataFrame:
    """Documents that ``read_site_configs`` leaves out, and why."""
    return scan_site_configs(spark, path).filter(F.col("reject_reason").isNotNull()).select("stem", "reject_reason")


def filter_sites(sites: DataFrame, names: Iterable[str] | None, stem: str = "stem") -> DataFrame:
    """Keep the configs whose file stem is the slug of a requested name; no names keep all."""
    names = list(names or [])
    if not names:
        return sites
    return sites.filter(F.col(stem).isin([slugify(F.lit(n)) for n in names]))


def upsert_site_configs(existing: DataFrame, new: DataFrame, force: bool = False) -> tuple[DataFrame, DataFrame]:
    """(merged, refused): a new config for an existing slug is refused unless ``force`` replaces it."""
    known = existing.select("slug")
    if force:
        kept = existing.join(new.select("slug"), "slug", "left_anti")
        return kept.unionByName(new, allowMissingColumns=True), new.limit(0)
    refused = new.join(known, "slug", "left_semi")
    return existing.unionByName(new.join(known, "slug", "left_anti"), allowMissingColumns=True), refused


def sites_to_json(sites: DataFrame) -> DataFrame:
    """(slug, document): configs as JSON with absent options left out."""
    fields = [c for c in sites.columns if c != "stem"]
    return sites.select("slug", F.to_json(F.struct(*fields), {"ignoreNullFields": "true"}).alias("document"))


def write_site_configs(sites: DataFrame, path: str) -> None:
    """Write configs as a new folder of JSON lines, absent options left out; read back with ``lines``."""
    sites.drop("stem").write.option("ignoreNullFields", True).json(path)
