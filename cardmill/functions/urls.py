"""URL columns: canonical form, resolution against a base, and url templates.

URLs are cut with the RFC 3986 appendix B pattern; ``parse_url`` is not used because it raises on
URLs that must pass through unchanged.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cardmill import fixed
from cardmill.functions.common import let
from cardmill.functions.text import is_plausible_query, none_if_empty, strip

URL_PARTS = r"(?s)^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?"
# Schemes written with '//' even when the authority is empty, and schemes whose last
# path segment may carry ';params'.
NETLOC_SCHEMES = ["http", "https", "ftp", "file", "ws", "wss", "sftp", "ssh", "git", "svn", "nfs"]
PARAM_SCHEMES = ["", "http", "https", "ftp", "rtsp", "sip", "sips", "sftp", "tel"]
# Characters a browser percent-encodes, as regex class bodies.
PATH_UNSAFE = r"""\x00-\x20\x7F-\x{10FFFF}"<>^`{}"""
QUERY_UNSAFE = r"""\x00-\x20\x7F-\x{10FFFF}"<>'"""
FRAGMENT_UNSAFE = r"""\x00-\x20\x7F-\x{10FFFF}"<>`"""
# Shapes that a rule leaves as they are, tested first because they are by far the most common.
ALREADY_CANONICAL = r"^https?://[A-Za-z0-9.:\-]+/[A-Za-z0-9_.~%+,/\-]*[A-Za-z0-9_.~%+,\-]\z"
PLAIN_BASE = r"^(https?://[a-z0-9.\-]+)([/?#].*)?\z"
PLAIN_ABSOLUTE = r"^(?!.*/\.)https?://[a-z0-9.\-]+/[A-Za-z0-9_.~+,/\-]*\z"
PLAIN_ROOTED = r"^(?!.*/\.)/(?!/)[A-Za-z0-9_.~+,/\-]*(\?[A-Za-z0-9_.~%+,=&\-]*)?\z"


def quote_plus(c: Column) -> Column:
    """Form encoding that keeps '~' and encodes '*'."""
    return F.replace(F.replace(F.url_encode(c), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def unquote_plus(c: Column) -> Column:
    """Form decoding; a '%' that starts no escape stays as it is."""
    return F.url_decode(F.regexp_replace(c, "%(?![0-9A-Fa-f]{2})", "%25"))


def unquote(c: Column) -> Column:
    """Percent decoding that leaves '+' alone."""
    return unquote_plus(F.replace(c, F.lit("+"), F.lit("%2B")))


def url_parts(c: Column) -> Column:
    """Struct (scheme, authority, path, params, query); missing parts are '', the fragment is left out."""
    split_params = r"(?s)^((?:.*/)?[^/;]*)(?:;(.*))?$"

    def parts(url: Column) -> Column:
        scheme = F.lower(F.regexp_extract(url, URL_PARTS, 1))
        path = F.regexp_extract(url, URL_PARTS, 3)
        has_params = F.contains(path, F.lit(";")) & scheme.isin(PARAM_SCHEMES)
        return F.struct(
            scheme.alias("scheme"),
            F.regexp_extract(url, URL_PARTS, 2).alias("authority"),
            F.when(has_params, F.regexp_extract(path, split_params, 1)).otherwise(path).alias("path"),
            F.when(has_params, F.regexp_extract(path, split_params, 2)).otherwise("").alias("params"),
            F.regexp_extract(url, URL_PARTS, 4).alias("query"),
        )

    return let(F.regexp_replace(c, r"^[\x00-\x20]+|[\t\r\n]", ""), parts)


def url_text(u: Column, path: Column | None = None, query: Column | None = None) -> Column:
    """Put the parts of a URL together again, with another path or query if given."""

    def text(path: Column) -> Column:
        rooted = F.startswith(path, F.lit("/"))
        empty_host = F.startswith(path, F.lit("//")) | (u.scheme.isin(NETLOC_SCHEMES) & rooted)
        return F.concat(
            F.when(u.scheme != "", F.concat(u.scheme, F.lit(":"))).otherwise(""),
            F.when(u.authority != "", F.concat(F.lit("//"), u.authority)).when(empty_host, "//").otherwise(""),
            F.when((u.authority != "") & (path != "") & ~rooted, "/").otherwise(""),
            path,
            F.when(u.params != "", F.concat(F.lit(";"), u.params)).otherwise(""),
        )

    query = let(u.query if query is None else query, lambda q: F.when(q != "", F.concat(F.lit("?"), q)).otherwise(""))
    return F.concat(let(u.path if path is None else path, text), query)


def query_pairs(query: Column) -> Column:
    """Array of decoded (k, v) pairs in order; a name without '=' has the value ''."""
    parts = F.filter(F.split(query, "&"), lambda p: p != "")
    return F.transform(
        parts,
        lambda p: F.struct(
            unquote_plus(F.substring_index(p, "=", 1)).alias("k"),
            unquote_plus(F.regexp_extract(p, "(?s)^[^=]*=(.*)$", 1)).alias("v"),
        ),
    )


def join_pairs(pairs: Column) -> Column:
    return F.array_join(F.transform(pairs, lambda p: F.concat(quote_plus(p.k), F.lit("="), quote_plus(p.v))), "&")


def join_pairs_with_hole(pairs: Column, hole: Column, placeholder: Column) -> Column:
    """Encode the pairs, with the value at index ``hole`` replaced by a literal placeholder."""
    return F.array_join(
        F.transform(
            pairs,
            lambda p, i: F.concat(quote_plus(p.k), F.lit("="), F.when(i == hole, placeholder).otherwise(quote_plus(p.v))),
        ),
        "&",
    )


def first_index(flags: Column) -> Column:
    """0-based index of the first true element, null if there is none."""
    return F.nullif(F.array_position(flags, F.lit(True)), F.lit(0)).cast("int") - 1


def canonical_url(c: Column) -> Column:
    """Drop tracking parameters, the fragment and trailing slashes; a URL without scheme stays as it is."""

    def canonical(url: Column) -> Column:
        def text(u: Column) -> Column:
            kept = F.filter(query_pairs(u.query), lambda p: ~F.rlike(p.k, F.lit("(?i)" + fixed.TRACKING_PARAMS)))
            path = F.coalesce(none_if_empty(F.regexp_replace(u.path, "/+$", "")), F.lit("/"))
            return F.when(u.scheme == "", url).otherwise(url_text(u, path, join_pairs(kept)))

        return let(url_parts(url), text)

    return F.when(F.rlike(c, F.lit(ALREADY_CANONICAL)), c).when(c != "", let(strip(c), canonical))


# --- resolution ---------------------------------------------------------------------------------
def _percent_encode(c: Column, unsafe: str) -> Column:
    """Percent-encode the characters of an ``unsafe`` class, leaving everything else alone."""

    def run(r: Column) -> Column:
        quoted = F.replace(F.url_encode(r), F.lit("+"), F.lit("%20"))
        return F.when(F.rlike(r, F.lit(f"^[{unsafe}]")), quoted).otherwise(r)

    def encode(text: Column) -> Column:
        runs = F.regexp_extract_all(text, F.lit(rf"(?s)[{unsafe}]+|[^{unsafe}]+"), F.lit(0))
        return F.when(F.rlike(text, F.lit(f"[{unsafe}]")), F.array_join(F.transform(runs, run), "")).otherwise(text)

    return let(c, encode)


def _drop_dots(path: Column) -> Column:
    """Resolve '.' and '..' segments of an absolute path."""

    def step(done: Column, segment: Column) -> Column:
        up = F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0)))
        return (
            F.when(F.rlike(segment, F.lit(r"(?i)^(\.|%2e){2}$")), up)
            .when(F.rlike(segment, F.lit(r"(?i)^(\.|%2e)$")), done)
            .otherwise(F.array_append(done, segment))
        )

    def resolve(path: Column) -> Column:
        # a path that ends in dots names a folder: resolve it as if a '/' followed
        ends_in_dots = F.rlike(path, F.lit(r"(?i)/(\.|%2e){1,2}$"))
        whole = F.when(ends_in_dots, F.concat(path, F.lit("/"))).otherwise(path)
        segments = F.split(F.regexp_replace(whole, "^/", ""), "/")
        kept = F.aggregate(segments, F.array().cast("array<string>"), step)
        return F.when(F.rlike(path, F.lit(r"(?i)/(\.|%2e)")), F.concat(F.lit("/"), F.array_join(kept, "/"))).otherwise(path)

    return let(path, resolve)


def absolute_url(href: Column, base: Column) -> Column:
    """Resolve ``href`` against ``base`` the way a browser does; null and '' give null.

    Host and scheme are lower-cased, default ports dropped, dot segments resolved, blanks and
    non-ASCII characters percent-encoded. Schemes without '//' pass through.
    """
    raw = F.regexp_replace(href, r"^[\x00-\x20]+|[\x00-\x20]+$|[\t\r\n]", "")
    scheme = r"^[A-Za-z][A-Za-z0-9+.\-]*:"

    def cut(raw: Column) -> Column:
        rest = F.regexp_replace(raw, scheme, F.lit(""))
        address = F.regexp_extract(rest, r"(?s)^([^?#]*)", 1)
        return F.struct(
            raw.alias("raw"),
            F.lower(F.regexp_extract(raw, r"^([A-Za-z][A-Za-z0-9+.\-]*):", 1)).alias("scheme"),
            rest.alias("rest"),
            F.replace(address, F.lit("\\"), F.lit("/")).alias("address"),
            F.regexp_extract(rest, r"(?s)^[^?#]*(\?[^#]*)", 1).alias("query"),
            F.regexp_extract(rest, r"(?s)^[^#]*(#.*)$", 1).alias("fragment"),
        )

    def host(h: Column, scheme: Column) -> Column:
        port = F.when(scheme == "https", ":(443)?$").otherwise(":(80)?$")
        user = F.regexp_extract(h, "^(.*@)?", 1)
        return F.concat(user, F.regexp_replace(F.lower(F.regexp_extract(h, "^(?:.*@)?(.*)$", 1)), port, F.lit("")))

    def resolve(x: Column) -> Column:
        h, b = x.h, x.b
        has_host = F.startswith(h.address, F.lit("//"))
        own_path = F.regexp_replace(h.address, "^//[^/]*", "")
        folder = F.regexp_replace(b.path, "(?s)[^/]*$", "")
        path = (
            F.when(has_host | F.startswith(own_path, F.lit("/")), own_path)
            .when(own_path == "", b.path)
            .when(F.startswith(folder, F.lit("/")), F.concat(folder, own_path))
            .otherwise(F.concat(F.lit("/"), own_path))
        )
        base_query = F.when(b.query != "", F.concat(F.lit("?"), b.query)).otherwise("")
        query = F.when((h.address == "") & (h.query == ""), base_query).otherwise(h.query)
        scheme = F.coalesce(none_if_empty(h.scheme), b.scheme)
        authority = F.when(has_host, F.regexp_extract(h.address, "^//([^/]*)", 1)).otherwise(b.authority)
        resolved = F.concat(
            scheme,
            F.lit("://"),
            let(scheme, lambda s: host(authority, s)),
            _percent_encode(_drop_dots(F.coalesce(none_if_empty(path), F.lit("/"))), PATH_UNSAFE),
            _percent_encode(query, QUERY_UNSAFE),
            _percent_encode(h.fragment, FRAGMENT_UNSAFE),
        )
        return (
            F.when(~h.scheme.isin("", "http", "https", "ftp", "ws", "wss"), F.concat(h.scheme, F.lit(":"), h.rest))
            .when((h.scheme != "") & ~has_host, h.raw)
            .when((h.scheme == "") & (b.scheme == ""), href)
            .otherwise(resolved)
        )

    both = F.struct(let(raw, cut).alias("h"), url_parts(F.coalesce(base, F.lit(""))).alias("b"))
    # most links are plain: they are resolved without taking them apart
    tidy = F.rlike(base, F.lit(PLAIN_BASE))
    return (
        F.when(F.rlike(href, F.lit(PLAIN_ABSOLUTE)), href)
        .when(tidy & F.rlike(href, F.lit(PLAIN_ROOTED)), F.concat(F.regexp_extract(base, PLAIN_BASE, 1), href))
        .when(href != "", let(both, resolve))
    )


# --- templates ----------------------------------------------------------------------------------
def fill_template(template: Column, row: Column) -> Column:
    """Fill '{name}' holes from a string map; null when any named value is missing or empty."""
    names = F.regexp_extract_all(template, F.lit(r"(?U)\{(\w+)\}"), F.lit(1))
    pieces = F.split(template, r"(?U)\{\w+\}")
    filled = F.zip_with(
        pieces, names, lambda piece, name: F.concat(piece, F.coalesce(F.try_element_at(row, name), F.lit("")))
    )
    complete = F.forall(names, lambda n: F.coalesce(F.try_element_at(row, n), F.lit("")) != "")
    return F.when(complete, F.array_join(filled, ""))


def search_url(query: Column, results_url: Column) -> Column:
    """The results page of a saved search, when the query is plausible and lives in the URL."""
    return F.when(
        is_plausible_query(query) & (results_url != ""),
        F.replace(results_url, F.lit("{query}"), quote_plus(query)),
    )


def query_url_template(url: Column, query: Column) -> Column:
    """Put '{query}' where a results URL holds the searched text: a parameter value, else the path."""

    def in_path(u: Column, needle: Column) -> Column:
        def opened(n: Column) -> Column:
            at = F.instr(F.lower(u.path), F.lower(n))
            return F.when((n != "") & (at > 0), url_text(u, F.overlay(u.path, F.lit("{query}"), at, F.length(n))))

        return let(needle, opened)

    def template(x: Column) -> Column:
        u, wanted = x.u, x.wanted
        pairs = query_pairs(u.query)
        hit = first_index(F.transform(pairs, lambda p: F.lower(strip(p.v)) == F.lower(wanted)))
        return F.coalesce(
            let(hit, lambda i: F.when(i.isNotNull(), url_text(u, query=join_pairs_with_hole(pairs, i, F.lit("{query}"))))),
            in_path(u, quote_plus(wanted)),
            in_path(u, F.replace(wanted, F.lit(" "), F.lit("-"))),
        )

    return F.when(query != "", let(F.struct(url_parts(url).alias("u"), strip(query).alias("wanted")), template))


def page_url_template(before: Column, after: Column) -> Column:
    """Find the page number (or offset) that changed between two listing URLs."""
    digits = F.lit(r"(?U)^\d+$")

    def template(x: Column) -> Column:
        a, b, a_pairs, b_pairs = x.a, x.b, x.a_pairs, x.b_pairs

        def changed(p: Column) -> Column:
            old = F.try_element_at(F.filter(b_pairs, lambda q: q.k == p.k), F.lit(-1)).v
            return F.rlike(p.v, digits) & ~p.v.eqNullSafe(old)

        def in_query(i: Column) -> Column:
            placeholder = F.when(F.get(a_pairs, i).v == "2", "{page}").otherwise("{offset}")
            return F.when(i.isNotNull(), url_text(a, query=join_pairs_with_hole(a_pairs, i, placeholder)))

        def in_path(segments: Column) -> Column:
            old = F.split(F.regexp_replace(b.path, "/+$", ""), "/")
            at = first_index(F.transform(segments, lambda s, i: F.rlike(s, digits) & ~s.eqNullSafe(F.get(old, i))))

            def opened(at: Column) -> Column:
                path = F.array_join(F.transform(segments, lambda s, i: F.when(i == at, "{page}").otherwise(s)), "/")
                return F.when(at.isNotNull(), url_text(a, path))

            return let(at, opened)

        found = F.coalesce(
            let(first_index(F.transform(a_pairs, changed)), in_query),
            let(F.split(F.regexp_replace(a.path, "/+$", ""), "/"), in_path),
        )
        return F.when(a.authority == b.authority, found)

    def with_pairs(x: Column) -> Column:
        return F.struct(
            x.a.alias("a"),
            x.b.alias("b"),
            query_pairs(x.a.query).alias("a_pairs"),
            query_pairs(x.b.query).alias("b_pairs"),
        )

    both = F.struct(url_parts(after).alias("a"), url_parts(before).alias("b"))
    usable = (before != "") & (after != "") & (before != after)
    return F.when(usable, let(let(both, with_pairs), template))


def url_tokens(url: Column) -> Column:
    """Decoded path segments and parameter values of a URL."""

    def tokens(u: Column) -> Column:
        segments = F.transform(F.filter(F.split(u.path, "/"), lambda s: s != ""), unquote)
        values = F.transform(F.filter(query_pairs(u.query), lambda p: p.v != ""), lambda p: unquote_plus(p.v))
        return F.array_union(segments, values)

    return let(url_parts(url), tokens)


def without_fragment(url: Column) -> Column:
    return let(url_parts(url), url_text)
