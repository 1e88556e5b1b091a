"""CSS selectors as data: steps of tags and atoms, matched against element rows.

Supported: tag, ``*``, ``.class``, ``#id``, ``[attr]``, ``[attr="v"]``, ``:nth-of-type(n)``, a final
``:text-is("…")``, a leading ``:scope``, the descendant and ``>`` combinators, CSS escapes, and absolute
``xpath=/html[1]/…`` chains. Anything else counts as an invalid selector and is skipped.

A step fits an element that has its tag and all its atoms. Elements and steps meet by tag (steps without one by an atom), so
an element is compared with few steps. A selector of one step, or of a child of a parent, is decided on the element's row,
which knows its parent's atoms. Longer chains keep the candidates of every step, and one pass over them in document order
finds the chains.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass, field, replace
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from cardmill.functions.elements import control_disabled
from cardmill.session import grown, materialize

# Compiled selectors of more sites are joined by shuffle; of fewer they are some megabytes.
BROADCAST_SPECS = 10_000

# Node columns that matching reads.
MATCH_COLUMNS = ["node_id", "parent_id", "subtree_end", "depth", "tag", "atoms", "parent_tag", "parent_atoms"]

_NAME = r"(?:[\w-]|[^\x00-\x7F]|\\[0-9a-fA-F]{1,6}\s?|\\[^0-9a-fA-F\n])+"
_TOKEN = re.compile(
    rf"(?P<gap>\s*>\s*|\s+)|(?P<scope>:scope)|(?P<tag>\*|{_NAME})|\.(?P<cls>{_NAME})|\#(?P<id>{_NAME})"
    rf"|\[\s*(?P<attr>{_NAME})\s*(?:=\s*(?:\"(?P<dq>(?:[^\"\\]|\\.)*)\"|'(?P<sq>(?:[^'\\]|\\.)*)'|(?P<bare>{_NAME})))?\s*\]"
    r"|:nth-of-type\(\s*(?P<nth>\d+)\s*\)|:text-is\(\"(?P<text>(?:[^\"\\]|\\.)*)\"\)"
)
_XPATH = re.compile(r"^xpath=((?:/[\w-]+\[\d+\])+)$")


def _unescape(name: str) -> str:
    name = re.sub(r"\\([0-9a-fA-F]{1,6})\s?", lambda m: chr(int(m.group(1), 16)), name)
    return re.sub(r"\\(.)", r"\1", name)


def _compiled(steps: list[dict], scoped: bool, rooted: bool, text: str | None, attrs: list[str]) -> dict:
    deep = len(steps) > 2 or any(not s["near"] for s in steps[1:]) or (rooted and len(steps) > 1)
    return {"steps": steps, "deep": deep, "scoped": scoped, "rooted": rooted, "text": text, "attrs": attrs}


@lru_cache(maxsize=100_000)
def compile_selector(selector: str | None) -> dict | None:
    """The steps of a selector, from the outermost: their tags and atoms, and whether each is a child of the one before
    (the first: of the scope or the page). None when invalid."""
    selector = (selector or "").strip()
    xpath = _XPATH.match(selector)
    if xpath:
        steps = re.findall(r"/([\w-]+)\[(\d+)\]", xpath.group(1))
        return _compiled([{"near": True, "tag": tag.lower(), "atoms": [f":{int(n)}"]} for tag, n in steps], False, True, None, [])
    steps, near, tag, atoms, text, scoped, at, attrs = [], None, None, [], None, False, 0, []
    fresh = True  # no simple selector seen since the last combinator
    while at < len(selector):
        m = _TOKEN.match(selector, at)
        if not m or text is not None:
            return None
        kind, at = m.lastgroup, m.end()
        if m["gap"] is not None:
            if fresh and not (scoped and not steps and near is None):
                return None
            if not fresh:
                steps.append({"near": scoped if near is None else near, "tag": tag, "atoms": atoms})
            near, tag, atoms, fresh = ">" in m["gap"], None, [], True
            continue
        if m["scope"]:
            if at != len(":scope"):
                return None
            scoped = True
            continue
        if m["tag"]:
            if not fresh:
                return None
            tag = None if m["tag"] == "*" else _unescape(m["tag"]).lower()
        elif m["cls"]:
            atoms.append("." + _unescape(m["cls"]))
        elif m["id"]:
            atoms.append("#" + _unescape(m["id"]))
        elif m["attr"]:
            attrs.append(_unescape(m["attr"]).lower())
            value = next((m[g] for g in ("dq", "sq", "bare") if m[g] is not None), None)
            atoms.append(f"[{attrs[-1]}]" if value is None else f"[{attrs[-1]}={_unescape(value)}]")
        elif m["nth"]:
            atoms.append(f":{int(m['nth'])}")
        elif kind == "text":
            text = _unescape(m["text"])
        fresh = False
    if fresh:
        return None
    steps.append({"near": scoped if near is None else near, "tag": tag, "atoms": atoms})
    return _compiled(steps, scoped, False, text, attrs)


STEPS = "array<struct<near:boolean,tag:string,atoms:array<string>>>"
COMPILED = {
    "steps": ("steps", STEPS), "deep": ("deep", "boolean"), "scoped": ("scoped", "boolean"), "rooted": ("rooted", "boolean"),
    "text": ("spec_text", "string"), "attrs": ("spec_attrs", "array<string>"),
}


def compiled_schema(specs: DataFrame) -> T.StructType:
    added = T._parse_datatype_string(", ".join(f"{name} {kind}" for name, kind in COMPILED.values()))
    return T.StructType([*specs.schema.fields, *added.fields])


def compile_rows(rows: Iterable[dict]) -> Iterator[dict]:
    """Rows with a valid ``selector``, with its compiled parts added."""
    for row in rows:
        compiled = compile_selector(row["selector"])
        if compiled:
            yield row | {COMPILED[k][0]: v for k, v in compiled.items()}


def compile_selectors(specs: DataFrame) -> DataFrame:
    """Add steps, deep, scoped, rooted, spec_text and spec_attrs for ``selector``; invalid selectors are dropped."""
    schema = compiled_schema(specs)
    arrow = to_arrow_schema(schema)

    def compile_batches(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pylist(list(compile_rows(batch.to_pylist())), schema=arrow)

    return specs.mapInArrow(compile_batches, schema)


@dataclass(frozen=True)
class Specs:
    """Compiled selectors of all sites, and the names that occur in them."""

    table: DataFrame
    kinds: set[str] = field(default_factory=set)  # values of ``kind``
    attrs: set[str] = field(default_factory=set)  # attribute names
    tags: set[str] = field(default_factory=set)  # tags of the elements that matching looks at, '*' for any
    has_text: bool = False  # whether some ask for an element's text
    deep: bool = False  # whether some are chains of more than a parent and a child
    large: bool = False  # whether they are too many to be broadcast

    @staticmethod
    def of(specs: DataFrame) -> Specs:
        """Compile the selectors once, into the work folder, and count them to know whether they can be broadcast.

        Only the distinct names come to the driver, however many selectors there are.
        """
        table = materialize(compile_selectors(specs))
        kinds = F.collect_set("kind") if "kind" in specs.columns else F.array().cast("array<string>")
        looked = F.transform(F.when(F.col("deep"), F.col("steps")).otherwise(F.slice("steps", -1, 1)), lambda s: F.coalesce(s.tag, F.lit("*")))
        names = table.agg(
            kinds.alias("kinds"),
            F.array_distinct(F.flatten(F.collect_set("spec_attrs"))).alias("attrs"),
            F.array_distinct(F.flatten(F.collect_set(looked))).alias("tags"),
            F.coalesce(F.max(F.col("spec_text").isNotNull()), F.lit(False)).alias("has_text"),
            F.coalesce(F.max("deep"), F.lit(False)).alias("deep"),
            F.count("*").alias("n"),
        ).first()
        return Specs(table, set(names.kinds), set(names.attrs), set(names.tags), names.has_text, names.deep, names.n > BROADCAST_SPECS)

    def may_have(self, kind: str) -> bool:
        return kind in self.kinds


def needed(*specs: Specs) -> dict[str, set[str] | None]:
    """What ``flatten_dom`` must emit for these selectors: ``atom_attrs``, and ``tags`` (None for all)."""
    tags = set().union(*[s.tags for s in specs])
    return {"atom_attrs": set().union(*[s.attrs for s in specs]), "tags": None if "*" in tags else tags}


def _fits(step: Column, tag: Column, atoms: Column) -> Column:
    """Whether an element has the tag and all atoms of a step."""
    return (step.tag.isNull() | (step.tag == tag)) & (F.size(F.array_except(step.atoms, F.coalesce(atoms, F.array().cast("array<string>")))) == 0)


def match_selectors(nodes: DataFrame, specs: Specs, on: Sequence[str] = ("slug",)) -> DataFrame:
    """Every (element, selector) match: the node columns plus those of ``specs``, ``scoped`` and ``tops``, the elements (id,
    depth) that the first step may stand for.

    A small table of specs is broadcast by Spark, so that matching is one pass over the elements without a shuffle; a
    ``large`` one is joined by site. Elements need their ``text`` when a selector asks for it.
    """
    if specs.has_text and "text" not in nodes.columns:
        raise ValueError("a selector asks for :text-is, so the elements need their text")
    table = specs.table
    n = F.size("steps")
    steps = table.select(*table.columns, F.posexplode("steps").alias("step_no", "step"))
    steps = steps.where(F.col("deep") | (F.col("step_no") == n - 1))
    # a step without a tag is looked up by an atom, one without either by a star
    steps = steps.withColumn("__key", F.coalesce("step.tag", F.get("step.atoms", F.lit(0)), F.lit("*")))
    if "*" in specs.tags:
        nodes = nodes.withColumn("__key", F.explode(F.array_union(F.array(F.col("tag"), F.lit("*")), "atoms")))
    else:
        nodes = nodes.withColumn("__key", F.col("tag"))
    last = F.col("step_no") == n - 1
    before = F.get("steps", F.col("step_no") - 1)
    hit = _fits(F.col("step"), F.col("tag"), F.col("atoms"))
    hit &= (F.col("step_no") == 0) | ~F.col("step.near") | _fits(before, F.col("parent_tag"), F.col("parent_atoms"))
    hit &= ~F.col("rooted") | (F.col("step_no") > 0) | F.col("parent_id").isNull()
    if "text" in nodes.columns:
        shown = F.trim(F.regexp_replace("text", r"(?U)\s+", " "))
        hit &= ~last | F.col("spec_text").isNull() | (shown == F.col("spec_text"))
    found = nodes.join(grown(steps) if specs.large else steps, [*on, "__key"]).where(hit)
    top = F.when(n == 1, F.struct(F.col("node_id").alias("id"), F.col("depth").alias("depth"))).otherwise(
        F.struct(F.col("parent_id").alias("id"), (F.col("depth") - 1).alias("depth")))
    near = F.get("steps", F.lit(0)).near
    told = ["__key", "steps", "step", "step_no", "spec_text", "spec_attrs", "deep", "rooted"]
    if "depth" not in nodes.columns:
        return found.drop(*told)
    found = found.withColumns({"scope_near": near, "tops": F.array(top)})
    if not specs.deep:
        return found.drop(*told)
    found = materialize(found.withColumn("n_steps", n).withColumn("near", F.col("step.near")).drop("__key", "steps", "step", "spec_text", "spec_attrs"))
    chains = chain_matches(found.where("deep").select("page_id", "selector", "node_id", "step_no", "n_steps", "near", "parent_id", "subtree_end", "depth", "scoped", "scope_near"))
    rest = found.where("not deep")
    deep = found.where("deep and step_no = n_steps - 1").drop("tops").join(grown(chains), ["page_id", "selector", "node_id"])
    return rest.unionByName(deep).drop("step_no", "n_steps", "near", "deep", "rooted")


def chain_matches(candidates: DataFrame) -> DataFrame:
    """(page_id, selector, node_id, tops): elements that end a chain of steps, from the elements that fit each step alone.

    Candidates are taken in document order; of each step only the open elements that a chain has reached are held. Only scoped
    selectors have ``tops``: the innermost one, or all where the first step must be a child of the scope.
    """
    page = candidates.schema["page_id"].dataType.simpleString()
    schema = f"page_id {page}, selector string, node_id int, tops array<struct<id:int,depth:int>>"
    arrow = to_arrow_schema(T._parse_datatype_string(schema))

    def run(batches):
        group, open_ = None, []
        for batch in batches:
            out = []
            for page_id, selector, node, step, n, near, parent, end, depth, scoped, scope_near in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (page_id, selector) != group:
                    group, open_ = (page_id, selector), [[] for _ in range(n)]
                reached, tops = True, {(node, depth)} if scoped else set()
                if step:
                    above = open_[step - 1]
                    while above and above[-1][1] < node:
                        above.pop()
                    # the innermost holder, which is not the element itself
                    k = len(above) - 1 if above and above[-1][0] != node else len(above) - 2
                    reached = k >= 0 and (not near or above[k][0] == parent)
                    if reached and scoped:
                        tops = above[k][2] if near else set().union(*(a[2] for a in above[: k + 1])) if scope_near else max((a[2] for a in above[: k + 1]), key=max)
                if reached and step == n - 1:
                    out.append({"page_id": page_id, "selector": selector, "node_id": node, "tops": [{"id": i, "depth": d} for i, d in sorted(tops)]})
                elif reached:
                    mine = open_[step]
                    while mine and mine[-1][1] < node:
                        mine.pop()
                    mine.append((node, end, tops))
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=arrow)

    once = candidates.dropDuplicates(["page_id", "selector", "node_id", "step_no"])
    ordered = once.repartition("page_id", "selector").sortWithinPartitions("page_id", "selector", "node_id", "step_no")
    return ordered.mapInArrow(run, schema)


def in_scope(card: Column, card_depth: Column) -> Column:
    """Whether a match lies as its selector's ``:scope`` wants it: its first step inside the card, or a child of it."""
    return ~F.col("scoped") | F.exists("tops", lambda t: (t.id > card) & (~F.col("scope_near") | (t.depth == card_depth + 1)))


def first_candidates(
    matches: DataFrame, by: Sequence[str] = ("page_id",), min_count: int = 1, rank: str = "rank"
) -> DataFrame:
    """Matches of the first candidate that has at least ``min_count`` matches on the page."""
    by = list(by)
    counts = matches.groupBy(*by, rank).count().filter(F.col("count") >= min_count)
    winners = counts.groupBy(*by).agg(F.min(rank).alias(rank))
    return matches.join(grown(winners), [*by, rank])


def control_specs(sites: DataFrame) -> Specs:
    """Compiled selectors (slug, page_no, rank) of the control that leads from a page to the next one."""
    p = F.col("pagination")
    pages = F.explode(F.sequence(F.lit(1), F.greatest(p.max_pages, F.lit(1)))).alias("page_no")
    numbered = F.replace(p.page_number_template, F.lit("{page}"), (F.col("page_no") + 1).cast("string"))
    listed = sites.filter(p.type.isin("next", "load_more", "page_number")).select("slug", "pagination", pages)
    selectors = F.when(p.type == "page_number", F.array_compact(F.array(numbered))).otherwise(p.control.candidates)
    return Specs.of(listed.select("slug", "page_no", F.posexplode(selectors).alias("rank", "selector")))


def next_control(nodes: DataFrame, specs: Specs) -> DataFrame:
    """The usable next-page control of each page: (page_id, node_id). Pages without one are absent.

    Only the first element of the first matching candidate counts; it must be visible and enabled.
    """
    hits = first_candidates(match_selectors(nodes, specs, on=("slug", "page_no")))
    usable = F.col("visible") & ~control_disabled(F.col("classes"), F.col("attrs"))
    first = hits.groupBy("page_id").agg(F.min(F.struct("node_id", usable.alias("usable"))).alias("_first"))
    return first.filter("_first.usable").select("page_id", F.col("_first.node_id").alias("node_id"))


def selector_report(
    nodes: DataFrame, pages: DataFrame, specs: Specs, max_selectors: int | None = None, max_chars: int | None = None
) -> DataFrame:
    """Why a control was not found: per page, what each selector matches, as one text.

    ``max_selectors`` and ``max_chars`` shorten a report for display to the first selectors and characters of each; by
    default nothing is cut. ``pages`` has the (page_id, slug, page_no) to report on, also those without any match.
    """
    on = ["slug", "page_no"]
    few = replace(specs, table=specs.table.filter(F.col("rank") < max_selectors)) if max_selectors else specs
    stats = (
        match_selectors(nodes, few, on)
        .groupBy("page_id", "rank")
        .agg(
            F.count("*").alias("n"),
            F.min(
                F.struct("node_id", "visible", control_disabled(F.col("classes"), F.col("attrs")).alias("disabled"))
            ).alias("first"),
        )
    )
    asked = pages.select("page_id", *on).join(few.table.select(*on, "rank", "selector"), on, "left")
    rows = asked.join(stats, ["page_id", "rank"], "left")
    n = F.coalesce("n", F.lit(0))
    detail = F.concat(
        F.substring("selector", 1, max_chars) if max_chars else F.col("selector"),
        F.lit(" → "),
        n.cast("string"),
        F.when(n == 1, " match").otherwise(" matches"),
        F.when(n > 0, F.when(F.col("first.visible"), ", visible").otherwise(", hidden")).otherwise(""),
        F.when(F.col("first.disabled"), ", disabled").otherwise(""),
    )
    parts = F.transform(
        F.array_sort(F.collect_list(F.when(F.col("rank").isNotNull(), F.struct("rank", detail.alias("detail"))))),
        lambda r: r.detail,
    )
    return rows.groupBy("page_id").agg(
        F.coalesce(F.nullif(F.array_join(parts, "; "), F.lit("")), F.lit("no selectors recorded")).alias("report")
    )


def has_next(pages: DataFrame, controls: DataFrame, url_template: Column) -> DataFrame:
    """Add ``can_continue``: a usable control, or a recorded url pattern with '{page}' to fall back on."""
    found = controls.select("page_id", F.lit(True).alias("_control"))
    templated = F.coalesce(F.contains(url_template, F.lit("{page}")), F.lit(False))
    return pages.join(grown(found), "page_id", "left").withColumn(
        "can_continue", F.coalesce("_control", F.lit(False)) | templated
    ).drop("_control")
