"""Learning a site config from repeated structure: cards, their fields and the selectors that find them.

Input is the prepared element table of the pages and a table of targets, one element per row that lies in
a card (a job title, as a rule). Elements are numbered in document order, so "inside" is a range of ids (see ``inside``), and
no table grows with the depth of a page but where a path itself is asked for. Learned selectors are steps from the start, and
are matched as those of configs are, without being written and compiled in between. Shares are taken over all cards, all
elements of a card and all levels; ``sample`` limits them to the first cards where a caller wants that.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cardmill import fixed
from cardmill.functions.elements import (
    css_attr,
    css_name,
    is_date,
    is_department,
    is_location,
    stable_attrs,
    stable_classes,
)
from cardmill.operators.dom import NEVER_LEAF, flatten_dom, visible_text
from cardmill.operators.inside import inside
from cardmill.operators.selectors import Specs, in_scope, match_selectors
from cardmill.session import grown, materialize

NODE_COLUMNS = [
    "node_id", "parent_id", "grand_id", "depth", "subtree_end", "tag", "classes", "attrs", "own_text", "text", "nth_of_type", "parent_tag",
    "parent_classes", "parent_attrs", "n_leaves", "visible", "icon_id", "link_id", "inner_link", "prominence", "shape",
]
KEY = ["page_id", "target_id"]
FIELD_SPEC = "struct<selectors: array<string>, attr: string, closest: boolean>"


def _class_part(classes: Column) -> Column:
    return F.array_join(F.transform(F.slice(classes, 1, 3), lambda c: F.concat(F.lit("."), css_name(c))), "")


def _attr_part(attrs: Column) -> Column:
    return F.array_join(F.slice(attrs, 1, 3), "")


def _dotted(classes: Column) -> Column:
    return F.transform(classes, lambda c: F.concat(F.lit("."), c))


def _first_names(classes: Column, attrs: Column) -> Column:
    """The names that a signature tells: of stable classes and attributes the first three each."""
    return F.concat(F.slice(_dotted(classes), 1, 3), F.slice(attrs, 1, 3))


def prepare_nodes(pages: DataFrame) -> DataFrame:
    """Element table with signatures, written to the work folder, in buckets of pages, because every step below reads it.

    ``atoms`` are the stable names of an element and its place among its kind, ``names`` those that its signature ``sig``
    tells; the parent's are carried along.
    """
    nodes = flatten_dom(pages, NODE_COLUMNS)
    classes = lambda c: stable_classes(F.coalesce(c, F.array().cast("array<string>")))
    attrs = lambda a: F.transform(stable_attrs(F.coalesce(a, F.create_map().cast("map<string,string>"))), css_attr)
    nodes = nodes.withColumns({
        "sclasses": classes(F.col("classes")), "sattrs": attrs(F.col("attrs")),
        "pclasses": classes(F.col("parent_classes")), "pattrs": attrs(F.col("parent_attrs")),
    })
    place = F.array(F.concat(F.lit(":"), F.col("nth_of_type").cast("string")))
    prepared = (
        nodes.select(
            "page_id", "node_id", "parent_id", "grand_id", "depth", "subtree_end", "tag", "attrs", "nth_of_type", "parent_tag",
            "n_leaves", "shape", "visible", "icon_id", "link_id", "prominence", "sclasses", "sattrs",
            visible_text(F.col("text")).alias("text"),
            (F.col("own_text") != "").alias("own"),
            (F.col("link_id").isNotNull() | F.col("inner_link").isNotNull()).alias("has_link"),
            ((F.col("own_text") != "") & F.col("visible") & ~F.col("tag").isin(*NEVER_LEAF)).alias("leaf"),
            F.concat(_dotted(F.col("sclasses")), "sattrs", place).alias("atoms"),
            F.concat(_dotted(F.col("pclasses")), "pattrs").alias("parent_atoms"),
            _first_names(F.col("sclasses"), F.col("sattrs")).alias("names"),
            _first_names(F.col("pclasses"), F.col("pattrs")).alias("parent_names"),
            F.concat("tag", _class_part(F.col("sclasses")), _attr_part(F.col("sattrs"))).alias("sig"),
            F.concat("parent_tag", _class_part(F.col("pclasses")), _attr_part(F.col("pattrs"))).alias("parent_sig"),
        )
    )
    return materialize(prepared, by="page_id")


def ranges(nodes: DataFrame, *columns: str) -> DataFrame:
    """Elements as ranges of ids: (page_id, out_id, out_end and ``columns``)."""
    return nodes.select("page_id", F.col("node_id").alias("out_id"), F.col("subtree_end").alias("out_end"), *columns)


def text_leaves(nodes: DataFrame, outer: DataFrame, start: str, end: str, *columns: str) -> DataFrame:
    """The rows of ``outer`` (ranges of ids) with each element in them that draws text of its own; icon text does not count."""
    leaves = nodes.filter("leaf").select("page_id", "node_id", "icon_id", *columns)
    found = inside(outer, leaves, "node_id", start, end, own=True)
    return found.filter(F.col("icon_id").isNull() | (F.col("icon_id") < F.col(start))).drop("icon_id")


# --- selectors as steps ---------------------------------------------------------------------------
def step(near: bool, tag: Column, atoms: Column) -> Column:
    return F.struct(F.lit(near).alias("near"), tag.alias("tag"), atoms.alias("atoms"))


def relative_steps(child: Column, tag: Column, names: Column, parent_tag: Column, parent_names: Column) -> Column:
    """The steps of ``relative_selector``: a child of the card itself, or of an element like its own parent."""
    return F.when(child, F.array(step(True, tag, names))).otherwise(F.array(step(False, parent_tag, parent_names), step(True, tag, names)))


def match_on_pages(nodes: DataFrame, specs: DataFrame, deep: bool = False) -> DataFrame:
    """Elements matched by selectors that belong to one page each (``specs``: page_id, selector, steps, …; ``scoped`` where
    they start at a card). ``deep``: some are chains of more than a parent and a child."""
    if "scoped" not in specs.columns:
        specs = specs.withColumn("scoped", F.lit(False))
    chain = (F.size("steps") > 2) | F.exists(F.slice("steps", 2, 1), lambda s: ~s.near)
    table = specs.withColumns({"deep": chain if deep else F.lit(False), "rooted": F.lit(False), "spec_text": F.lit(None).cast("string"), "spec_attrs": F.array().cast("array<string>")})
    return match_selectors(nodes, Specs(table, deep=deep, large=True), on=("page_id",))


# --- signatures ---------------------------------------------------------------------------------
def shared_signatures(nodes: DataFrame, wanted: DataFrame | None = None) -> DataFrame:
    """(page_id, node_id, shared_sig, shared_names): signature with only what 60 % of the same-tag siblings share.

    With fewer than two other siblings everything is kept. ``wanted`` (page_id, node_id) limits the work.
    """
    group = ["page_id", "parent_id", "tag"]
    mine = nodes if wanted is None else nodes.join(grown(wanted.select("page_id", "node_id").distinct()), ["page_id", "node_id"], "left_semi")
    siblings = nodes.filter(F.col("parent_id").isNotNull()).select(*group, "sclasses", "sattrs")
    if wanted is not None:
        siblings = siblings.join(grown(mine.select(*group).distinct()), group, "left_semi")
    dotted = F.transform("sclasses", lambda c: F.concat(F.lit("."), c))
    totals = siblings.groupBy(*group).agg((F.count("*") - 1).alias("others"))
    atoms = siblings.select(*group, F.explode(F.concat(dotted, "sattrs")).alias("atom"))
    shared = (
        atoms.groupBy(*group, "atom")
        .agg((F.count("*") - 1).alias("with_it"))
        .join(grown(totals), group)
        .filter(F.col("with_it") >= F.col("others") * 0.6)
        .groupBy(*group)
        .agg(F.collect_list("atom").alias("shared"))
    )
    few = F.coalesce("others", F.lit(0)) < 2
    common = F.coalesce("shared", F.array().cast("array<string>"))
    classes = F.filter("sclasses", lambda c: few | F.array_contains(common, F.concat(F.lit("."), c)))
    attrs = F.filter(F.slice("sattrs", 1, 3), lambda a: few | F.array_contains(common, a))
    return (
        mine.join(grown(totals), group, "left")
        .join(grown(shared), group, "left")
        .select(
            "page_id", "node_id", F.concat("tag", _class_part(classes), _attr_part(attrs)).alias("shared_sig"),
            F.concat(F.slice(_dotted(classes), 1, 3), attrs).alias("shared_names"),
        )
    )


def path_steps(nodes: DataFrame, wanted: DataFrame) -> DataFrame:
    """(page_id, node_id, step, tag, atoms): signature, with ':nth-of-type(n)' only where a sibling matches it too.

    Siblings are compared by their distinct sets of stable names, and only those that have the rarest
    name of a signature are looked at, so a long list of equal items costs one comparison.
    """
    group = ["page_id", "parent_id", "tag"]
    mine = nodes.join(grown(wanted.select("page_id", "node_id").distinct()), ["page_id", "node_id"], "left_semi")
    dotted = F.transform("sclasses", lambda c: F.concat(F.lit("."), c))
    every = F.array_sort(F.array_distinct(F.concat(dotted, "sattrs")))
    named = F.array_sort(F.array_distinct(F.concat(F.slice(dotted, 1, 3), F.slice("sattrs", 1, 3))))
    mine = mine.select(*group, "node_id", "nth_of_type", "sig", F.col("names").alias("told"), named.alias("names"))
    sets = (
        nodes.join(grown(mine.select(*group).distinct()), group, "left_semi")
        .groupBy(*group, every.alias("all_names"))
        .agg(F.count("*").alias("n"))
    )
    asked = mine.select(*group, "names").distinct()
    plain = asked.filter(F.size("names") == 0).join(grown(sets.groupBy(*group).agg(F.sum("n").alias("alike"))), group)
    frequency = sets.select(*group, "n", F.explode("all_names").alias("name")).groupBy(*group, "name").agg(F.sum("n").alias("n"))
    rarest = (
        asked.select(*group, "names", F.explode("names").alias("name"))
        .join(grown(frequency), [*group, "name"])
        .groupBy(*group, "names")
        .agg(F.min(F.struct("n", "name")).alias("rare"))
        .select(*group, "names", "rare.*")
    )
    settled = rarest.filter((F.col("n") == 1) | (F.size("names") == 1)).select(*group, "names", F.col("n").alias("alike"))
    holders = sets.select(*group, "all_names", F.col("n").alias("held"), F.explode("all_names").alias("name"))
    compared = (
        rarest.filter((F.col("n") > 1) & (F.size("names") > 1))
        .join(grown(holders), [*group, "name"])
        .filter(F.size(F.array_except("names", "all_names")) == 0)
        .groupBy(*group, "names")
        .agg(F.sum("held").alias("alike"))
    )
    alike = plain.unionByName(settled).unionByName(compared)
    step = F.when(F.col("alike") > 1, F.concat("sig", F.lit(":nth-of-type("), "nth_of_type", F.lit(")"))).otherwise(F.col("sig"))
    place = F.concat(F.lit(":"), F.col("nth_of_type").cast("string"))
    atoms = F.when(F.col("alike") > 1, F.array_append("told", place)).otherwise(F.col("told"))
    return mine.join(grown(alike), [*group, "names"]).select("page_id", "node_id", step.alias("step"), "tag", atoms.alias("atoms"))


def path_selectors(nodes: DataFrame, pairs: DataFrame, steps: DataFrame | None = None) -> DataFrame:
    """(…pair columns, path_key, path_steps): exact path from ``card_id`` down to ``leaf_id``; ':self' for the card itself.

    ``steps`` are the ``path_steps`` of all elements in between, where they are known.
    """
    pairs = pairs.select("page_id", "card_id", "leaf_id").distinct()
    lines = inside(ranges(nodes), pairs, "leaf_id", "out_id", "out_end", own=True).filter("out_id > card_id")
    lines = lines.select("page_id", "card_id", "leaf_id", F.col("out_id").alias("node_id"))
    steps = path_steps(nodes, lines) if steps is None else steps
    parts = F.array_sort(F.collect_list(F.struct("node_id", "step", "tag", "atoms")))
    found = lines.join(grown(steps), ["page_id", "node_id"]).groupBy("page_id", "card_id", "leaf_id").agg(parts.alias("parts"))
    joined = F.array_join(F.transform("parts", lambda p: p.step), " > ")
    return pairs.join(grown(found), ["page_id", "card_id", "leaf_id"], "left").select(
        "page_id", "card_id", "leaf_id",
        F.when(F.col("parts").isNull(), ":self").otherwise(F.concat(F.lit(":scope > "), joined)).alias("path_key"),
        F.transform("parts", lambda p: step(True, p.tag, p.atoms)).alias("path_steps"),
    )


def relative_selector(el_parent: Column, card: Column, sig: Column, parent_sig: Column) -> Column:
    """Short selector of an element inside a card: below the card itself, or below its own parent."""
    return F.when(el_parent == card, F.concat(F.lit(":scope > "), sig)).otherwise(F.concat(parent_sig, F.lit(" > "), sig))


# --- cards --------------------------------------------------------------------------------------
def default_targets(nodes: DataFrame) -> DataFrame:
    """One target per repeated group of a page: the first link with text of each distinct link position.

    Positions are alike when the links and all elements around them have the same tags, ids and classes, which ``shape`` tells.
    """
    links = nodes.filter((F.col("link_id") == F.col("node_id")) & F.col("visible") & (F.col("text") != ""))
    return links.groupBy("page_id", "shape").agg(F.min("node_id").alias("node_id"), F.count("*").alias("n")).filter(
        "n > 1"
    ).select("page_id", F.col("node_id").alias("target_id"), "node_id")


def _levels(nodes: DataFrame, targets: DataFrame) -> DataFrame:
    """Ancestor levels of each target that could be a card, with the selector of their group."""
    around = ranges(
        nodes, "parent_id", "grand_id", "depth", "tag", "sig", "parent_sig", "names", "parent_tag", "parent_names", (F.col("text") != "").alias("reads")
    ).filter(~F.col("tag").isin("html", "body"))
    lines = inside(around, targets.select(*KEY, "node_id"), "node_id", "out_id", "out_end", own=True)
    # the innermost element around the target that has text
    el = lines.filter("reads").groupBy(*KEY).agg(F.max(F.struct(
        F.col("out_id").alias("el_id"), F.col("out_end").alias("el_end"), F.col("depth").alias("el_depth"), F.col("sig").alias("el_sig"), F.col("parent_sig").alias("el_parent_sig"),
        F.col("tag").alias("el_tag"), F.col("names").alias("el_names"), F.col("parent_tag").alias("el_parent_tag"), F.col("parent_names").alias("el_parent_names"),
    )).alias("el")).select(*KEY, "el.*").filter("el_parent_tag is not null")
    lvl = F.col("el_depth") - F.col("depth")
    levels = lines.drop("node_id", "reads").filter("parent_id is not null").join(grown(el), KEY).filter("out_id <= el_id")
    levels = levels.withColumnsRenamed({"out_id": "card_id", "out_end": "card_end"})
    shared = shared_signatures(nodes, levels.withColumnRenamed("card_id", "node_id")).withColumnRenamed("node_id", "card_id")
    kind = F.when(lvl == 0, "none").when(lvl == 1, "scope").otherwise("chain")
    return levels.join(grown(shared), ["page_id", "card_id"]).select(
        *KEY, lvl.alias("lvl"), "el_id", "el_end", "el_sig", "el_parent_sig", "el_tag", "el_names", "el_parent_tag", "el_parent_names",
        "card_id", "card_end", "grand_id",
        F.col("shared_sig").alias("loose"),
        F.array(step(False, F.col("tag"), F.col("shared_names"))).alias("loose_steps"),
        F.concat("parent_sig", F.lit(" > "), "shared_sig").alias("selector"),
        F.array(step(False, F.col("parent_tag"), F.col("parent_names")), step(True, F.col("tag"), F.col("shared_names"))).alias("steps"),
        kind.alias("rs_kind"),
    )


def infer_cards(nodes: DataFrame, targets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(cards, members): the repeated card around each target, and all cards of its group.

    ``cards`` has page_id, target_id, el_id, card_id, count, candidates. ``members`` has page_id,
    target_id, member_id, member_end and idx, the position in the group. Targets without a card are absent.
    """
    levels = materialize(_levels(nodes, targets), by="page_id")
    at = [*KEY, "lvl"]
    specs = levels.select(*at, "card_id", "rs_kind", "selector", "steps")
    found = match_on_pages(nodes, specs).filter("visible").select(
        *at, "card_id", "rs_kind", F.col("node_id").alias("member_id"), F.col("subtree_end").alias("member_end"), "has_link", F.col("n_leaves").alias("leaves")
    )
    groups = (
        found.groupBy(*at)
        .agg(F.count("*").alias("n"), F.max(F.col("member_id") == F.col("card_id")).alias("has_card"))
        .filter(F.col("has_card") & (F.col("n") >= 2))
        .select(*at, "n")
    )
    follows = F.lead("member_id").over(Window.partitionBy(*at).orderBy("member_id"))
    members = found.join(grown(groups), at).withColumn("nests", F.coalesce(follows <= F.col("member_end"), F.lit(False)))
    members = materialize(members, by="page_id")

    # how often the target's own selector hits in each member
    own = levels.filter("rs_kind <> 'none'").select(
        *KEY, "rs_kind",
        F.when(F.col("rs_kind") == "scope", F.col("el_sig")).otherwise(F.concat("el_parent_sig", F.lit(" > "), "el_sig")).alias("selector"),
        F.when(F.col("rs_kind") == "scope", F.array(step(False, F.col("el_tag"), F.col("el_names")))).otherwise(
            F.array(step(False, F.col("el_parent_tag"), F.col("el_parent_names")), step(True, F.col("el_tag"), F.col("el_names")))).alias("steps"),
    ).distinct()
    hits = match_on_pages(nodes, own).select(*KEY, "rs_kind", "node_id", "parent_id")
    keys = members.select(*at, "rs_kind", "member_id", "member_end")
    chained = inside(keys.filter("rs_kind = 'chain'").drop("rs_kind"), hits.filter("rs_kind = 'chain'").drop("rs_kind", "parent_id"), "node_id", "member_id", "member_end", on=KEY)
    children = keys.filter("rs_kind = 'scope'").join(grown(hits.filter("rs_kind = 'scope'").select(*KEY, F.col("parent_id").alias("member_id"))), [*KEY, "member_id"])
    base = members.select(*at, "member_id", F.when(F.col("rs_kind") == "none", 1).otherwise(0).alias("k"))
    one = [*at, "member_id", F.lit(1).alias("k")]
    counts = base.unionByName(chained.select(*one)).unionByName(children.select(*one)).groupBy(*at, "member_id").agg(F.sum("k").alias("k"))
    told = members.join(grown(counts), [*at, "member_id"])
    picked = told.filter("member_id = card_id").select(
        *at, F.col("k").alias("k0"), F.col("leaves").alias("leaves0"), F.col("has_link").alias("link0")
    )
    alike = (F.abs(F.col("leaves") - F.col("leaves0")) <= F.greatest(F.lit(1), F.col("leaves0") * 0.5)) & (
        F.col("has_link") == F.col("link0")
    )
    good = (
        told.join(grown(picked), at)
        .groupBy(*at, "card_id", "n")
        .agg(
            F.avg((F.col("k") == F.col("k0")).cast("int")).alias("frac"),
            F.avg(alike.cast("int")).alias("sim"),
            F.max("k0").alias("k0"),
            F.max("nests").alias("nests"),
        )
        .filter("k0 between 1 and 3 and frac >= 0.8 and sim >= 0.6 and not nests")
    )
    largest = good.groupBy(*KEY).agg(F.max("n").alias("max_n"))
    best = good.join(grown(largest), KEY).filter("n >= 0.9 * max_n").groupBy(*KEY).agg(F.max("lvl").alias("lvl"))
    chosen = materialize(best.join(grown(levels), at))
    order = Window.partitionBy(*KEY).orderBy("member_id")
    group = materialize(
        members.join(grown(chosen.select(*at)), at).select(*KEY, "member_id", "member_end", F.row_number().over(order).alias("idx"))
    )

    sizes = group.groupBy(*KEY).agg(F.count("*").cast("int").alias("count"))
    loose = match_on_pages(nodes, chosen.select(*KEY, F.col("loose").alias("selector"), F.col("loose_steps").alias("steps")))
    loose = loose.groupBy(*KEY).agg(F.count("*").alias("loose_n"))
    grand = nodes.select("page_id", F.col("node_id").alias("grand_id"), F.col("sig").alias("grand_sig"))
    candidates = F.array_compact(
        F.array(
            F.col("selector"),
            F.when(F.col("loose_n") == F.col("count"), F.col("loose")),
            F.concat("grand_sig", F.lit(" "), "selector"),
        )
    )
    cards = (
        chosen.join(grown(sizes), KEY)
        .join(grown(loose), KEY, "left")
        .join(grown(grand), ["page_id", "grand_id"], "left")
        .select(*KEY, "el_id", "el_end", "card_id", "card_end", "count", candidates.alias("candidates"))
    )
    return materialize(cards), group


def first_cards(members: DataFrame, sample: int | None) -> DataFrame:
    """All cards of each group, or the first ``sample``."""
    return members if sample is None else members.filter(F.col("idx") <= sample)


# --- fields -------------------------------------------------------------------------------------
def field_selectors(
    nodes: DataFrame, members: DataFrame, wanted: DataFrame, sample: int | None = None, steps: DataFrame | None = None
) -> DataFrame:
    """(page_id, target_id, field, selectors): selectors that find an element in its card and its group.

    ``wanted`` has page_id, target_id, field, card_id, el_id, need_text. The signature and the relative
    selector must also hit, with text if needed, in 60 % of the cards; the exact path need not.
    Each must select exactly the wanted element in the picked card.
    """
    el = nodes.select(
        "page_id", F.col("node_id").alias("el_id"), "parent_id", "tag", "sig", "names", "parent_tag", "parent_sig", "parent_names"
    ).filter("parent_id is not null")
    paths = path_selectors(nodes, wanted.withColumnRenamed("el_id", "leaf_id"), steps).withColumnRenamed("leaf_id", "el_id")
    child = F.col("parent_id") == F.col("card_id")
    option = lambda selector, steps, scoped: F.struct(selector.alias("selector"), steps.alias("steps"), scoped.alias("scoped"))
    options = F.array(
        option(F.col("sig"), F.array(step(False, F.col("tag"), F.col("names"))), F.lit(False)),
        option(
            relative_selector(F.col("parent_id"), F.col("card_id"), F.col("sig"), F.col("parent_sig")),
            relative_steps(child, F.col("tag"), F.col("names"), F.col("parent_tag"), F.col("parent_names")), child,
        ),
        option(F.col("path_key"), F.col("path_steps"), F.lit(True)),
    )
    of = [*KEY, "field"]
    specs = (
        wanted.join(grown(el), ["page_id", "el_id"])
        .join(grown(paths), ["page_id", "card_id", "el_id"])
        .select(*of, "card_id", "el_id", "need_text", F.posexplode(options).alias("rank", "option"))
        .select(*of, "card_id", "el_id", "need_text", "rank", "option.*")
    )
    specs = materialize(specs, by="page_id")
    cards = first_cards(members, sample).select(*KEY, "member_id", F.lit(True).alias("sampled"))
    sizes = cards.groupBy(*KEY).agg(F.count("*").alias("sample_size"))
    looked = cards.unionByName(
        wanted.select(*KEY, F.col("card_id").alias("member_id"), F.lit(False).alias("sampled")).distinct()
    )
    looked = looked.groupBy(*KEY, "member_id").agg(F.max("sampled").alias("sampled"))
    bounds = nodes.select("page_id", F.col("node_id").alias("member_id"), F.col("subtree_end").alias("member_end"), F.col("depth").alias("member_depth"))
    looked = looked.join(grown(bounds), ["page_id", "member_id"])
    hits = match_on_pages(nodes, specs, deep=True).select(
        *of, "card_id", "el_id", "need_text", "rank", "selector", "node_id", "scoped", "scope_near", "tops", (F.col("text") != "").alias("has_text")
    )
    first = (
        inside(looked, hits, "node_id", "member_id", "member_end", on=KEY)
        .filter(in_scope(F.col("member_id"), F.col("member_depth")))
        .groupBy(*of, "rank", "selector", "card_id", "el_id", "need_text", "member_id", "sampled")
        .agg(F.min(F.struct("node_id", "has_text")).alias("hit"))
    )
    usable = F.col("hit.has_text") | ~F.col("need_text")
    judged = first.groupBy(*of, "rank", "selector").agg(
        F.max((F.col("member_id") == F.col("card_id")) & (F.col("hit.node_id") == F.col("el_id"))).alias("exact"),
        F.sum((F.col("sampled") & usable).cast("int")).alias("hits"),
    )
    kept = (
        judged.join(grown(sizes), KEY)
        .filter(F.col("exact") & ((F.col("rank") == 2) | (F.col("hits") >= F.col("sample_size") * 0.6)))
        .groupBy(*of, "selector")
        .agg(F.min("rank").alias("rank"))
    )
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("rank", "selector"))), lambda s: s.selector)
    # a wanted element that no selector finds keeps an empty list
    return specs.select(*of).distinct().join(grown(kept), of, "left").groupBy(*of).agg(
        F.filter(ordered, lambda s: s.isNotNull()).alias("selectors")
    )


def promoted_leaves(nodes: DataFrame, leaves: DataFrame) -> DataFrame:
    """Add ``leaf_id`` to (page_id, card_id, node_id): an inline wrapper of several inline pieces, else the leaf.

    'Sunnyvale, CA' and '; Atlanta, GA' in sibling spans are one value, that of the span around them.
    """
    inline = F.col("tag").isin(fixed.INLINE_TAGS)
    own = nodes.select("page_id", "node_id", "parent_id", inline.alias("inline"))
    wrapped = leaves.join(grown(own), ["page_id", "node_id"])
    family = own.filter(F.col("parent_id").isNotNull()).join(
        grown(wrapped.select("page_id", "parent_id").distinct()), ["page_id", "parent_id"], "left_semi"
    )
    family = family.groupBy("page_id", "parent_id").agg(F.count("*").alias("n"), F.min("inline").alias("all_inline"))
    parents = nodes.filter(inline & ~F.col("own")).select("page_id", F.col("node_id").alias("parent_id"))
    wrappers = family.join(grown(parents), ["page_id", "parent_id"]).filter("all_inline").select(
        "page_id", "parent_id", F.lit(True).alias("wraps")
    )
    up = F.col("wraps") & F.col("inline") & (F.col("parent_id") > F.col("card_id"))
    return wrapped.join(grown(wrappers), ["page_id", "parent_id"], "left").select(
        *leaves.columns, F.when(up, F.col("parent_id")).otherwise(F.col("node_id")).alias("leaf_id")
    )


def infer_title_link(nodes: DataFrame, cards: DataFrame) -> DataFrame:
    """(page_id, target_id, card_id, title_id, link_id, link_kind): title element and link of each card.

    The title is the target, or the most prominent text inside it when it holds several. The link is the
    one around the title ('inner', 'self' or, around the whole card, 'closest'), else the card's first
    real link.
    """
    within = text_leaves(nodes, cards.select(*KEY, "el_id", "el_end"), "el_id", "el_end", "prominence")
    texts = within.groupBy(*KEY).agg(
        F.count("*").alias("n_leaves"), F.min(F.struct(-F.col("prominence"), "node_id")).node_id.alias("big_id")
    )
    own = nodes.select("page_id", F.col("node_id").alias("el_id"), "own")
    n = F.coalesce("n_leaves", F.lit(0))
    inner = (F.col("el_id") == F.col("card_id")) | (n > 1) | (~F.col("own") & (n == 1))
    titles = cards.join(grown(texts), KEY, "left").join(grown(own), ["page_id", "el_id"]).select(
        *KEY, "card_id", "card_end", F.when(inner, F.coalesce("big_id", "el_id")).otherwise(F.col("el_id")).alias("title_id")
    )
    around = nodes.select("page_id", F.col("node_id").alias("title_id"), F.col("link_id").alias("around_id"))
    real = nodes.filter(F.col("link_id") == F.col("node_id")).filter(
        ~F.rlike(F.try_element_at("attrs", F.lit("href")), F.lit("(?i)^(#|javascript:)"))
    )
    first = inside(cards.select(*KEY, "card_id", "card_end"), real.select("page_id", "node_id"), "node_id", "card_id", "card_end")
    first = first.groupBy(*KEY).agg(F.min("node_id").alias("first_id"))
    kind = (
        F.when(F.col("around_id") == F.col("card_id"), "self")
        .when(F.col("around_id").between(F.col("card_id"), F.col("card_end")), "inner")
        .when(F.col("around_id").isNotNull(), "closest")
        .when(F.col("first_id").isNotNull(), "inner")
    )
    joined = titles.join(grown(around), ["page_id", "title_id"]).join(grown(first), KEY, "left")
    return joined.select(*KEY, "card_id", "title_id", F.coalesce("around_id", "first_id").alias("link_id"), kind.alias("link_kind"))


def infer_text_fields(
    nodes: DataFrame, members: DataFrame, titles: DataFrame, sample: int | None = None, steps: DataFrame | None = None
) -> DataFrame:
    """(page_id, target_id, field, el_id): which text position holds location, posted and department.

    Texts at the same path are compared over the cards. A position counts when the picked card and half
    of the cards have it. Each position is used once; the later one wins a tie.
    """
    looked = first_cards(members, sample).select(*KEY, F.col("member_id").alias("card_id"), F.col("member_end").alias("card_end"), "idx")
    sizes = looked.groupBy(*KEY).agg(F.count("*").alias("sample_size"))
    leaves = materialize(promoted_leaves(nodes, text_leaves(nodes, looked, "card_id", "card_end").drop("card_end")), by="page_id")
    title_pairs = titles.select("page_id", "card_id", F.col("title_id").alias("leaf_id"))
    keys = path_selectors(nodes, leaves.select("page_id", "card_id", "leaf_id").unionByName(title_pairs), steps)
    keys = materialize(keys.drop("path_steps"), by="page_id")
    title_keys = titles.join(
        grown(keys.withColumnsRenamed({"leaf_id": "title_id", "path_key": "title_key"})), ["page_id", "card_id", "title_id"]
    ).select(*KEY, F.col("card_id").alias("picked_id"), "title_id", "title_key")
    spans = nodes.select("page_id", F.col("node_id").alias("leaf_id"), "subtree_end", "text")
    title_ends = nodes.select("page_id", F.col("node_id").alias("title_id"), F.col("subtree_end").alias("title_end"))
    overlaps = F.col("leaf_id").between(F.col("title_id"), F.col("title_end")) | F.col("title_id").between(
        F.col("leaf_id"), F.col("subtree_end")
    )
    is_picked = F.col("card_id") == F.col("picked_id")
    values = (
        leaves.join(grown(keys), ["page_id", "card_id", "leaf_id"])
        .join(grown(title_keys), KEY)
        .join(grown(spans), ["page_id", "leaf_id"])
        .join(grown(title_ends), ["page_id", "title_id"])
        .filter((F.col("path_key") != F.col("title_key")) & ~(is_picked & overlaps))
        .groupBy(*KEY, "picked_id", "card_id", "idx", "path_key")
        .agg(F.min(F.struct("node_id", "leaf_id", "text")).alias("v"))
    )
    text = F.col("v.text")
    share = lambda flag: F.avg(flag.cast("int"))
    pool = (
        values.groupBy(*KEY, "path_key")
        .agg(
            F.count("*").alias("n"),
            F.max(F.when(F.col("card_id") == F.col("picked_id"), F.col("v.leaf_id"))).alias("el_id"),
            F.min(F.struct("idx", "v.node_id")).alias("seen"),
            share(is_location(text)).alias("location"),
            share(is_date(text)).alias("posted"),
            share(is_department(text)).alias("vocabulary"),
            F.avg(F.length(text)).alias("length"),
            F.countDistinct(text).alias("kinds"),
        )
        .join(grown(sizes), KEY)
        .filter(F.col("el_id").isNotNull() & (F.col("n") >= F.greatest(F.lit(1), F.col("sample_size") * 0.5)))
    )
    department = (
        F.when(F.col("length") > 60, 0.0)
        .when(F.col("vocabulary") >= 0.4, 1 + F.col("vocabulary"))
        .when((F.col("kinds") >= 2) & (F.col("kinds") / F.col("n") <= 0.6), 0.5)
        .otherwise(0.0)
    )
    pool = materialize(pool.withColumn("department", department).select(*KEY, "path_key", "el_id", "seen", "location", "posted", "department"))
    taken = []
    for field in ("location", "posted", "department"):
        best = (
            pool.filter(F.col(field) >= 0.5)
            .groupBy(*KEY)
            .agg(F.max(F.struct(field, "seen", "path_key", "el_id")).alias("b"))
            .select(*KEY, "b.path_key", "b.el_id")
        )
        taken.append(best.select(*KEY, F.lit(field).alias("field"), "el_id"))
        pool = pool.join(grown(best.select(*KEY, "path_key")), [*KEY, "path_key"], "left_anti")
    return taken[0].unionByName(taken[1]).unionByName(taken[2])


def _card_nodes(nodes: DataFrame, cards: DataFrame) -> DataFrame:
    """The elements of each picked card, with their relative selector and its steps (null for the card)."""
    near = inside(
        cards.select(*KEY, "card_id", "card_end"),
        nodes.select("page_id", "node_id", "attrs", "parent_id", "tag", "sig", "names", "parent_tag", "parent_sig", "parent_names"),
        "node_id", "card_id", "card_end", own=True,
    )
    below, child = F.col("node_id") != F.col("card_id"), F.col("parent_id") == F.col("card_id")
    return near.withColumns({
        "selector": F.when(below, relative_selector(F.col("parent_id"), F.col("card_id"), F.col("sig"), F.col("parent_sig"))),
        "steps": F.when(below, relative_steps(child, F.col("tag"), F.col("names"), F.col("parent_tag"), F.col("parent_names"))),
        "scoped": child,
    })


def infer_id_attribute(nodes: DataFrame, cards: DataFrame, members: DataFrame, sample: int | None = None) -> DataFrame:
    """(page_id, target_id, selectors, attr): the attribute that identifies a card.

    Of the cards 80 % must have a value, and all values must differ. A telling name and a
    place on the card itself count for an attribute; the first best wins.
    """
    listed = _card_nodes(nodes, cards).select(
        *KEY, "card_id", "node_id", "selector", "steps", "scoped", F.posexplode(F.map_entries("attrs")).alias("pos", "a")
    )
    usable = (
        ~F.rlike(F.col("a.key"), F.lit(fixed.ID_ATTR_SKIP))
        & F.rlike(F.col("a.value"), F.lit(fixed.ID_ATTR_VALUE))
        & F.rlike(F.col("a.value"), F.lit(r"\d"))
    )
    options = materialize(
        listed.filter(usable).select(*KEY, "card_id", "node_id", "selector", "steps", "scoped", "pos", F.col("a.key").alias("attr"))
    )
    looked = first_cards(members, sample).select(*KEY, "member_id", "member_end")
    sizes = looked.groupBy(*KEY).agg(F.count("*").alias("sample_size"))
    specs = options.filter(F.col("selector").isNotNull()).select(*KEY, "selector", "steps", "scoped").distinct()
    hits = match_on_pages(nodes, specs).select(*KEY, "selector", "scoped", "node_id", "parent_id", "attrs")
    options = options.drop("steps", "scoped")
    inner = (
        inside(looked, hits, "node_id", "member_id", "member_end", on=KEY)
        .filter(~F.col("scoped") | (F.col("parent_id") == F.col("member_id")))
        .groupBy(*KEY, "selector", "member_id")
        .agg(F.min_by("attrs", "node_id").alias("attrs"))
    )
    own = nodes.select("page_id", F.col("node_id").alias("member_id"), "attrs")
    found = options.filter(F.col("selector").isNotNull()).join(grown(inner), [*KEY, "selector"])
    found = found.unionByName(options.filter(F.col("selector").isNull()).join(grown(looked.drop("member_end")), KEY).join(grown(own), ["page_id", "member_id"]))
    value = F.nullif(F.try_element_at(F.col("attrs"), F.col("attr")), F.lit(""))
    score = F.when(F.rlike("attr", F.lit(fixed.ID_ATTR_NAME)), 2).otherwise(0) + F.when(F.col("selector").isNull(), 1).otherwise(0)
    judged = (
        found.withColumn("value", value)
        .groupBy(*KEY, "node_id", "pos", "attr", "selector")
        .agg(F.count("value").alias("n"), F.countDistinct("value").alias("kinds"))
        .join(grown(sizes), KEY)
        .filter("n >= sample_size * 0.8 and kinds = n")
    )
    best = judged.groupBy(*KEY).agg(F.min(F.struct((-score).alias("s"), "node_id", "pos", "attr", "selector")).alias("b"))
    return best.select(*KEY, F.array_compact(F.array("b.selector")).alias("selectors"), F.col("b.attr").alias("attr"))


def card_attributes(nodes: DataFrame, cards: DataFrame) -> DataFrame:
    """(page_id, target_id, ord, selectors, attr, value): attributes of the elements of a card."""
    listed = _card_nodes(nodes, cards).select(
        *KEY, "node_id", "selector", F.posexplode(F.map_entries("attrs")).alias("pos", "a")
    )
    kept = listed.filter(
        ~F.rlike(F.col("a.key"), F.lit(fixed.CARD_ATTR_SKIP)) & (F.col("a.value") != "")
    )
    return kept.select(
        *KEY,
        F.struct("node_id", "pos").alias("ord"),
        F.array_compact(F.array("selector")).alias("selectors"),
        F.col("a.key").alias("attr"),
        F.col("a.value").alias("value"),
    )


def infer_fields(nodes: DataFrame, cards: DataFrame, members: DataFrame) -> DataFrame:
    """(page_id, target_id, fields): all field specs of each inferred card, keyed by field name."""
    titles = materialize(infer_title_link(nodes, cards))
    # what paths inside cards are made of, once for all that ask for paths
    within = inside(members.select(*KEY, "member_id", "member_end"), nodes.select("page_id", "node_id"), "node_id", "member_id", "member_end")
    steps = materialize(path_steps(nodes, within), by="page_id")
    texts = infer_text_fields(nodes, members, titles, steps=steps)
    el = titles.select(*KEY, "card_id", F.lit("title").alias("field"), F.col("title_id").alias("el_id"), F.lit(True).alias("need_text"))
    links = titles.filter("link_kind = 'inner'").select(
        *KEY, "card_id", F.lit("apply_url").alias("field"), F.col("link_id").alias("el_id"), F.lit(False).alias("need_text")
    )
    rest = texts.join(grown(titles.select(*KEY, "card_id")), KEY).select(*KEY, "card_id", "field", "el_id", F.lit(True).alias("need_text"))
    wanted = materialize(el.unionByName(links).unionByName(rest))
    spec = lambda selectors, attr, closest: F.struct(
        selectors.alias("selectors"), attr.alias("attr"), F.lit(closest).alias("closest")
    ).cast(FIELD_SPEC).alias("spec")
    none = F.array().cast("array<string>")
    attr = F.when(F.col("field") == "apply_url", "href")
    found = field_selectors(nodes, members, wanted.filter("el_id <> card_id"), steps=steps).select(*KEY, "field", spec(F.col("selectors"), attr, False))
    direct = wanted.filter("el_id = card_id").select(*KEY, "field", spec(none, attr, False))
    url = F.lit("apply_url").alias("field")
    own_link = titles.filter("link_kind = 'self'").select(*KEY, url, spec(none, F.lit("href"), False))
    around = titles.filter("link_kind = 'closest'").select(*KEY, url, spec(F.array(F.lit("a[href]")), F.lit("href"), True))
    ids = infer_id_attribute(nodes, cards, members).select(
        *KEY, F.lit("job_id").alias("field"), spec(F.col("selectors"), F.col("attr"), False)
    )
    rows = found.unionByName(direct).unionByName(own_link).unionByName(around).unionByName(ids)
    return rows.groupBy(*KEY).agg(F.map_from_entries(F.collect_list(F.struct("field", "spec"))).alias("fields"))


def infer_field(nodes: DataFrame, members: DataFrame, picks: DataFrame) -> DataFrame:
    """(page_id, target_id, field, selectors): field spec for a chosen element of a known card group.

    ``picks`` has page_id, target_id, field, node_id. An icon stands for the element around it, a wrapper
    of one text for that text, a piece of several inline pieces for their wrapper. A pick outside any
    card is absent; the card itself gives an empty list.
    """
    of = [*KEY, "field"]
    picked = picks.select(*of, "node_id").join(grown(nodes.select("page_id", "node_id", "icon_id")), ["page_id", "node_id"])
    owner = inside(members.select(*KEY, "member_id", "member_end"), picked, "node_id", "member_id", "member_end", on=KEY, own=True)
    owner = owner.groupBy(*of, "node_id", "icon_id").agg(F.min("member_id").alias("card_id"))
    icon = nodes.select("page_id", F.col("node_id").alias("icon_id"), F.col("parent_id").alias("icon_parent"))
    is_icon = F.col("icon_id") >= F.col("card_id")
    start = owner.join(grown(icon), ["page_id", "icon_id"], "left").select(
        *of, "card_id", F.when(is_icon, F.col("icon_parent")).otherwise(F.col("node_id")).alias("start_id")
    )
    own = nodes.select("page_id", F.col("node_id").alias("start_id"), "own", F.col("subtree_end").alias("start_end"))
    start = start.join(grown(own), ["page_id", "start_id"])
    inner = text_leaves(nodes, start, "start_id", "start_end").groupBy(*of).agg(F.count("*").alias("n"), F.min("node_id").alias("only_id"))
    leaf = F.when(~F.col("own") & (F.col("n") == 1), F.col("only_id")).otherwise(F.col("start_id"))
    leaves = start.join(grown(inner), of, "left").select(*of, "card_id", leaf.alias("node_id"))
    final = materialize(promoted_leaves(nodes, leaves).select(*of, "card_id", F.col("leaf_id").alias("el_id"), F.lit(True).alias("need_text")))
    selectors = field_selectors(nodes, members, final.filter("el_id <> card_id"))
    return selectors.unionByName(
        final.filter("el_id = card_id").select(*of, F.array().cast("array<string>").alias("selectors"))
    )


def infer_configs(pages: DataFrame, targets: DataFrame | None = None) -> DataFrame:
    """(page_id, target_id, count, candidates, fields): a card config per target of the pages."""
    nodes = prepare_nodes(pages)
    targets = materialize(default_targets(nodes) if targets is None else targets)
    cards, members = infer_cards(nodes, targets)
    fields = infer_fields(nodes, cards, members)
    return cards.join(grown(fields), KEY).select(*KEY, "card_id", "count", "candidates", "fields")
