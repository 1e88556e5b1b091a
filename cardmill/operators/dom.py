"""Pages to elements: one row per HTML element, in document order.

Tokenizing HTML is the one step that needs Python. It runs in ``mapInArrow``, without a shuffle, and
emits only the columns asked for, since Spark cannot prune the output of a Python step. Write the
result to Parquet when several jobs read it.

Each row carries the element's own ``atoms`` (id, classes, attributes, place among its kind) and those of its
parent, and the range of ids that its subtree has. So the output grows with the page, however deep it is:
a step of a selector is a test of one row, and "inside a card" is a test of ranges (see ``inside``).

There is no layout offline. An element counts as hidden when it or an ancestor has the ``hidden``
attribute, an inline ``display:none`` or ``visibility:hidden``, a class that a ``<style>`` of the page
hides with a plain ``.class {display:none}`` rule, or a tag that is never drawn.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator, Sequence
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cardmill.session import bounded_batches

NODE_COLUMNS = {
    "node_id": "int",
    "parent_id": "int",
    "depth": "int",
    "subtree_end": "int",
    "grand_id": "int",
    "tag": "string",
    "id": "string",
    "classes": "array<string>",
    "attrs": "map<string,string>",
    "own_text": "string",
    "text": "string",
    "nth_of_type": "int",
    "atoms": "array<string>",
    "parent_tag": "string",
    "parent_atoms": "array<string>",
    "parent_classes": "array<string>",
    "parent_attrs": "map<string,string>",
    "n_leaves": "int",
    "shape": "long",
    "visible": "boolean",
    "icon_id": "int",
    "prominence": "double",
    "link": "string",
    "link_id": "int",
    "inner_link": "string",
    "base_href": "string",
    "error": "string",
}
_ARROW = {
    "int": pa.int32(),
    "long": pa.int64(),
    "double": pa.float64(),
    "string": pa.string(),
    "boolean": pa.bool_(),
    "array<string>": pa.list_(pa.string()),
    "map<string,string>": pa.map_(pa.string(), pa.string()),
}
OUTPUT_ROWS = 20_000
OUTPUT_CHARS = 16 << 20  # of texts in one batch

# HTML tag groups.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
NEVER_LEAF = set("script style noscript template svg".split())
NEVER_DRAWN = set("head title script style noscript template meta link base".split())
BLOCK = set(
    "address article aside blockquote body details div dl dt dd fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr"
    " html li main nav ol p pre section table tbody thead tfoot tr ul summary".split()
)
# A start tag closes these open tags, up to the nearest boundary tag.
CLOSES_P = BLOCK - {"body", "html", "li", "dt", "dd", "tbody", "thead", "tfoot", "tr"} | {"center", "menu", "dir"}
CLOSED_BY = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}),
    "thead": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}),
    "tfoot": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}),
    "option": ({"option"}, {"select", "datalist"}),
    "optgroup": ({"option", "optgroup"}, {"select"}),
}
# Default text sizes of a browser, times 1.3 where bold.
TEXT_SIZE = 16.0
TEXT_SIZES = {
    "h1": 32 * 1.3, "h2": 24 * 1.3, "h3": 18.72 * 1.3, "h4": 16 * 1.3, "h5": 13.28 * 1.3, "h6": 10.72 * 1.3,
    "b": 16 * 1.3, "strong": 16 * 1.3, "th": 16 * 1.3,
}
HIDDEN_STYLE = re.compile(r"(display\s*:\s*none|visibility\s*:\s*hidden)", re.I)
HIDDEN_RULE = re.compile(r"\.([\w-]+)\s*\{[^}]*display\s*:\s*none", re.I)
ICON_CLASS = re.compile(r"material-icons|material-symbols")
ICON_I_CLASS = re.compile(r"icon|fa-")
BLANKS = re.compile(r"[\t\r\n\f][ \t\r\n\f]*| [ \t\r\n\f]+")
SPACES = re.compile(r"  +")
BREAKS = re.compile(r"[ \t]*\n[ \t\n]*")


class _Walker(HTMLParser):
    """Collects the elements of one page; text runs are shared and addressed by range."""

    def __init__(self, atom_attrs: set[str] | None, shapes: bool):
        super().__init__(convert_charrefs=True)
        self.shapes = shapes  # whether to tell the shape of the line from the root to each element
        self.error = None
        self.atom_attrs = atom_attrs
        self.nodes: list[dict] = []
        self.open: list[dict] = []
        self.tally: dict[str, int] = {}  # open elements of each tag
        self.runs: list[tuple[str, bool, int, bool]] = []  # text, is a break, icon id, drawn
        self.hidden_classes: set[str] = set()
        self.base_href = None

    def parse_marked_section(self, i, report=1):
        """Any '<![…' is a comment up to the next '>', as in a browser."""
        end = self.rawdata.find(">", i + 3)
        return end + 1 if end >= 0 else -1

    def handle_startendtag(self, tag, attrs):
        """The '/' of '<div/>' means nothing but inside drawings and formulas."""
        self.handle_starttag(tag, attrs)
        if tag not in VOID and (self.tally.get("svg") or self.tally.get("math")):
            self.handle_endtag(tag)

    def handle_starttag(self, tag, attrs):
        if tag in ("html", "body") and self.tally.get(tag):
            return
        if tag in CLOSES_P:
            self._close({"p"}, {"button", "td", "th", "caption", "object"})
        if tag in CLOSED_BY:
            self._close(*CLOSED_BY[tag])
        within = self.open[-1]["tag"] if self.open else None
        if tag == "tr" and within == "table":
            self.handle_starttag("tbody", [])
        elif tag in ("td", "th") and within in ("table", "tbody", "thead", "tfoot"):
            self.handle_starttag("tr", [])
        named = {}
        for name, value in attrs:
            named.setdefault(name, value or "")
        parent = self.open[-1] if self.open else None
        classes = list(dict.fromkeys(named.get("class", "").split()))
        node_id = len(self.nodes)
        is_icon = (
            tag == "svg"
            or named.get("aria-hidden") == "true"
            or bool(ICON_CLASS.search(named.get("class", "")))
            or (tag == "i" and bool(ICON_I_CLASS.search(named.get("class", ""))))
        )
        hidden = (
            tag in NEVER_DRAWN
            or "hidden" in named
            or (tag == "input" and named.get("type") == "hidden")
            or bool(HIDDEN_STYLE.search(named.get("style", "")))
            or not self.hidden_classes.isdisjoint(classes)
        )
        nth = 1
        if parent is not None:
            nth = parent["kinds"][tag] = parent["kinds"].get(tag, 0) + 1
        is_link = tag == "a" and "href" in named
        node = {
            "node_id": node_id,
            "parent_id": parent["node_id"] if parent else None,
            "depth": parent["depth"] + 1 if parent else 0,
            "subtree_end": node_id,
            "grand_id": parent["parent_id"] if parent else None,
            "parent": parent,
            "tag": tag,
            "id": named.get("id"),
            "classes": classes,
            "attrs": list(named.items()),
            "nth_of_type": nth,
            "atoms": self._atoms(named, classes, nth),
            "visible": not hidden and (parent is None or parent["visible"]),
            "icon_id": node_id if is_icon else parent["icon_id"] if parent else None,
            "prominence": TEXT_SIZES.get(tag) or (parent["prominence"] if parent else TEXT_SIZE),
            "link": named["href"] if is_link else parent["link"] if parent else None,
            "link_id": node_id if is_link else parent["link_id"] if parent else None,
            "inner_link": None,
            "kinds": {},
            "own": [],
            "n_leaves": 0,
            "first_run": len(self.runs),
            "is_link": is_link,
            "is_icon": is_icon,
            "has_icon": False,
        }
        if tag == "base" and self.base_href is None:
            self.base_href = named.get("href")
        if self.shapes:
            line = f"{parent['shape'] if parent else ''}\x01{tag}\x02{node['id'] or ''}\x02" + "\x02".join(classes)
            node["shape"] = int.from_bytes(hashlib.blake2b(line.encode("utf-8", "replace"), digest_size=8).digest(), "big", signed=True)
        self.nodes.append(node)
        self.open.append(node)
        self.tally[tag] = self.tally.get(tag, 0) + 1
        self._break(node)
        if tag in VOID:
            self._end(self.open.pop())

    def _atoms(self, named, classes, nth):
        """What simple selectors test: ``#id``, ``.class``, ``[attr]``, ``[attr=value]`` and ``:place``."""
        atoms = [f"#{named['id']}"] if named.get("id") else []
        atoms += [f".{c}" for c in classes]
        for name, value in named.items():
            if self.atom_attrs is None or name in self.atom_attrs:
                atoms += [f"[{name}]", f"[{name}={value}]"]
        return [*atoms, f":{nth}"]

    def _break(self, node):
        tag = node["tag"]
        if tag == "br" or tag in BLOCK or tag in ("td", "th"):
            mark = "\t" if tag in ("td", "th") else "\n"
            self.runs.append((mark, True, -1, node["visible"]))

    def _end(self, node):
        """An element is closed: what it has inside is told to its parent."""
        node["subtree_end"] = len(self.nodes) - 1
        if node["tag"] in BLOCK:
            self._break(node)
        node["last_run"] = len(self.runs)
        self.tally[node["tag"]] -= 1
        if node["visible"] and node["tag"] not in NEVER_LEAF and any(t.strip() for t in node["own"]):
            node["n_leaves"] += 1
        if node["is_icon"]:
            node["n_leaves"] = 0  # what an icon draws is no text
        parent = node["parent"]
        if parent is not None:
            parent["n_leaves"] += node["n_leaves"]
            parent["has_icon"] |= node["has_icon"] or node["is_icon"]
            if parent["inner_link"] is None:
                parent["inner_link"] = node["link"] if node["is_link"] else node["inner_link"]

    def _close(self, tags, stops):
        """Pop up to and including the outermost open element in ``tags`` above the nearest stop."""
        if not any(self.tally.get(t) for t in tags):
            return
        for at in range(len(self.open) - 1, -1, -1):
            if self.open[at]["tag"] in stops:
                break
            if self.open[at]["tag"] in tags:
                self._pop_to(at)

    def _pop_to(self, at):
        while len(self.open) > at:
            self._end(self.open.pop())

    def handle_endtag(self, tag):
        if not self.tally.get(tag):
            return None
        for at in range(len(self.open) - 1, -1, -1):
            if self.open[at]["tag"] == tag:
                return self._pop_to(at)

    def handle_data(self, data):
        if not self.open:
            return
        node = self.open[-1]
        if node["tag"] == "style":
            self.hidden_classes.update(HIDDEN_RULE.findall(data))
        node["own"].append(data)
        icon = -1 if node["icon_id"] is None else node["icon_id"]
        self.runs.append((data, False, icon, node["visible"]))

    def finish(self):
        self.close()
        self._pop_to(0)

    def text(self, node):
        """Drawn text with line breaks at blocks; with icons inside, the other text runs as they stand."""
        runs = self.runs[node["first_run"] : node["last_run"]]
        if node["has_icon"]:
            at = node["node_id"]
            out = "".join(t for t, is_break, icon, drawn in runs if not is_break and drawn and icon < at)
        elif not node["visible"]:
            out = "".join(t for t, is_break, _, _ in runs if not is_break)
        else:
            out = "".join(t if is_break else BLANKS.sub(" ", t) for t, is_break, _, drawn in runs if drawn)
            if "  " in out:
                out = SPACES.sub(" ", out)
            return BREAKS.sub("\n", out).strip() if "\n" in out else out.strip()
        return re.sub(r"\s+\n", "\n", out).strip()


def _flatten(
    html: str, atom_attrs: set[str] | None, columns: Sequence[str], tags: set[str] | None = None
) -> Iterator[list]:
    walker = _Walker(atom_attrs, "shape" in columns)
    try:
        walker.feed(html)
        walker.finish()
    except Exception as e:  # the elements up to there stand
        walker.error = f"{type(e).__name__}: {e}"
        walker._pop_to(0)
    for node in walker.nodes:
        if tags is not None and node["tag"] not in tags:
            continue
        above = node["parent"] or {}
        node = node | {
            "error": walker.error, "base_href": walker.base_href,
            "parent_tag": above.get("tag"), "parent_atoms": above.get("atoms"), "parent_classes": above.get("classes"), "parent_attrs": above.get("attrs"),
        }
        if "text" in columns:
            node["text"] = walker.text(node)
        if "own_text" in columns:
            node["own_text"] = " ".join("".join(node["own"]).split())
        yield [node[c] for c in columns]


def flatten_dom(
    pages: DataFrame,
    columns: Sequence[str] | None = None,
    atom_attrs: Iterable[str] | None = None,
    carry: Sequence[str] = ("page_id",),
    tags: Iterable[str] | None = None,
) -> DataFrame:
    """One row per element of every page: the ``carry`` columns of the page and the wanted node columns.

    ``atom_attrs`` limits the attributes among the ``atoms`` to those the selectors name; by default all
    are kept. ``tags`` limits the rows to elements of these tags. What the parser can't go on with ends the page there: its elements have the reason
    in ``error``.
    """
    columns = list(columns or NODE_COLUMNS)
    wanted = None if atom_attrs is None else set(atom_attrs)
    emitted = None if tags is None else set(tags)
    source = bounded_batches(pages).select(*carry, "html")
    carried = [f for f in source.schema.fields if f.name != "html"]
    schema = ", ".join(
        [f"`{f.name}` {f.dataType.simpleString()}" for f in carried]
        + [f"`{c}` {NODE_COLUMNS[c]}" for c in columns]
    )

    def parse(batches):
        for batch in batches:
            rows, owners, chars = [], [], 0
            texts = [i for i, c in enumerate(columns) if c in ("text", "own_text")]

            def flush():
                taken = batch.select([f.name for f in carried]).take(pa.array(owners, pa.int32()))
                arrays = [
                    pa.array([r[i] for r in rows], _ARROW[NODE_COLUMNS[c]]) for i, c in enumerate(columns)
                ]
                return pa.RecordBatch.from_arrays(
                    taken.columns + arrays, names=[f.name for f in carried] + columns
                )

            for at, html in enumerate(batch.column("html")):
                for row in _flatten(html.as_py() or "", wanted, columns, emitted):
                    rows.append(row)
                    owners.append(at)
                    chars += sum(len(row[i]) for i in texts)
                    if len(rows) >= OUTPUT_ROWS or chars >= OUTPUT_CHARS:
                        yield flush()
                        rows, owners, chars = [], [], 0
            if rows:
                yield flush()

    return source.mapInArrow(parse, schema)


def visible_text(text) -> F.Column:
    """Text of an element on one line, as shown to a reader."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))
