"""Exact Jaccard self-join of documents on word shingles with a token-group matrix, and the classes that its links form.

1. A document's set holds the hashes of its distinct 5-word shingles. Documents with equal sets form a class; the class's
   smallest document stands for it.
2. Tokens are ordered by how common their hash bucket is in the corpus (a sketch of fixed size), then by hash. Sets with a
   similarity of t share a token among the first n - ceil(t n) + 1 in this order, their prefix, so only prefixes are
   indexed. Any fixed order is exact; this one puts common lines and passages last.
3. Similar documents are partitioned into groups: each one is compared with the leader that shares most of its prefix; the
   leader of a token is the document with that token whose prefix is shared most. Verified links make up the groups. That
   is done in a few rounds, the later ones with leaders of other groups, so a document is in few pairs however large its
   family is.
4. The matrix holds, for every group, the union of its members' prefix tokens, and the range of their sizes. A document of
   another group is a query: its overlap with the union bounds the overlap with any member. Only groups that reach what
   the sizes demand are opened, and only members that reach it themselves are compared, by their whole sets.

Pairs within a group are never enumerated, and a group is one row per token however many copies it has. Of the pairs of two
groups one is verified first, the others only if that leaves the groups apart.

Defined results: a null text or one without words has an empty set, is linked with nothing and stands for itself; a text
with fewer words than a shingle has one token, the whole sequence. Rows that repeat a doc_id are documents with one id:
their links are the id's links. A null doc_id gets no component. Extra columns are ignored.
"""

from __future__ import annotations


import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cardmill.llm.arrow_text import U64, frame, list_rows, mix, per_chunk, run_hashes, word_hashes, word_spans
from cardmill.llm.components import components
from cardmill.llm.tables import bounded_batches, join_ids, materialize

SKETCH_BITS = 18  # of a count per bucket of token hashes, 2 MB broadcast whatever the corpus
TOKEN_SHIFT = 16  # prefix tokens keep 48 bits: they only find candidates
ROUNDS = 2  # of links with leaders; what they leave is found by the matrix
HOT_TOKENS = 20_000  # occurrences in a bucket, beside twice the mean, beyond which its tokens are not counted one by one


def sets(data: np.ndarray, offsets: np.ndarray, width: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of every text."""
    starts, ends, first = word_spans(data, offsets)
    words = word_hashes(data, starts, ends, lower=True)
    runs = run_hashes(words, width)
    out = []
    for a, z in zip(first[:-1], first[1:], strict=True):
        if z - a >= width:
            out.append(np.unique(runs[a : z - width + 1]))
        else:
            out.append(run_hashes(words[a:z], z - a) if z > a else words[:0])
    return out


def needed(n: Column, threshold: int) -> Column:
    return F.ceil(n * threshold / 100)


def sketch(docs: DataFrame, width: int) -> np.ndarray:
    """How often tokens of each hash bucket occur in the corpus (doc, text)."""
    size = 1 << SKETCH_BITS

    def run(batches):
        total = np.zeros(size, np.int64)

        def add(rows, data, offsets):
            starts, ends, first = word_spans(data, offsets)
            runs = run_hashes(word_hashes(data, starts, ends, lower=True), width)
            at = np.arange(len(runs))
            whole = at + width <= first[1:][np.searchsorted(first, at, "right") - 1] if len(runs) else np.zeros(0, bool)
            total[:] += np.bincount((runs[whole] >> U64(64 - SKETCH_BITS)).astype(np.int64), minlength=size)
            return ()

        for _ in per_chunk(add, "text")(batches):
            pass
        at = np.flatnonzero(total)
        yield pa.record_batch([pa.array(at), pa.array(total[at])], names=["bucket", "n"])

    rows = docs.select("text").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(size, np.int64)
    out[rows["bucket"].to_numpy(np.int64)] = rows["n"]
    return out


def set_keys(found: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """128 bits that stand for a set."""
    k1 = np.array([mix(s).sum(dtype=U64) for s in found], U64).view(np.int64)
    k2 = np.array([mix(s ^ U64(0xA5A5A5A5A5A5A5A5)).sum(dtype=U64) for s in found], U64).view(np.int64)
    return k1, k2


def keyed(docs: DataFrame, width: int) -> DataFrame:
    """(doc, n, k1, k2): size and key of every document's (doc, text) set."""
    schema = pa.schema([("doc", pa.int64()), ("n", pa.int64()), ("k1", pa.int64()), ("k2", pa.int64())])

    def function(rows, data, offsets):
        found = sets(data, offsets, width)
        yield frame(schema, rows.column(0), np.array([len(s) for s in found], np.int64), *set_keys(found))

    return docs.mapInArrow(per_chunk(function, "text"), "doc long, n long, k1 long, k2 long")


def prefixes(docs: DataFrame, width: int, threshold: int, counts: np.ndarray) -> DataFrame:
    """(doc, token, hot) for the prefix tokens of documents (doc, text). A token that is not hot occurs in a bounded number
    of places, as its whole bucket does."""
    limit = HOT_TOKENS + 2 * int(counts.mean())
    shared = docs.sparkSession.sparkContext.broadcast(counts)
    schema = pa.schema([("doc", pa.int64()), ("token", pa.int64()), ("hot", pa.bool_())])

    def function(rows, data, offsets):
        heads, often = [np.zeros(0, U64)], [np.zeros(0, np.int64)]
        for s in sets(data, offsets, width):
            n = len(s)
            count = shared.value[(s >> U64(64 - SKETCH_BITS)).astype(np.int64)]
            order = np.argsort(count, kind="stable")[: n + 1 + (-n * threshold // 100) if n else 0]
            heads.append(s[order] >> U64(TOKEN_SHIFT))
            often.append(count[order])
        size = np.array([len(h) for h in heads[1:]], np.int64)
        yield frame(schema, np.repeat(rows.column(0).to_numpy(), size), np.concatenate(heads).view(np.int64), np.concatenate(often) > limit)

    return docs.mapInArrow(per_chunk(function, "text"), "doc long, token long, hot boolean")


def shared_tokens(docs: DataFrame, width: int, threshold: int, counts: np.ndarray) -> DataFrame:
    """(doc, token): the prefix tokens that more than one prefix has. Hot tokens are taken to be among them."""
    tokens = prefixes(docs, width, threshold, counts)
    cold = tokens.where("not hot").select("doc", "token").withColumn("df", F.count("*").over(Window.partitionBy("token"))).where("df > 1")
    return cold.select("doc", "token").union(tokens.where("hot").select("doc", "token")).distinct()


def least_overlap(n: Column, m: Column, threshold: int) -> Column:
    """The fewest prefix tokens that sets of ``n`` and ``m`` tokens share if they are similar enough."""
    both = F.ceil((n + m) * threshold / (100 + threshold))
    return both - F.greatest(needed(n, threshold), needed(m, threshold)) + 1


def least_demand(n: Column, near: Column, far: Column, threshold: int) -> Column:
    """No more than the least overlap of ``n`` with any size from ``near`` to ``far``: it rises up to n and falls from there
    on, but for steps of one that rounding makes."""
    return F.least(least_overlap(n, near, threshold), least_overlap(n, far, threshold) - 1)


def similar_sizes(n: Column, m: Column, threshold: int) -> Column:
    return (n * 100 >= m * threshold) & (m * 100 >= n * threshold)


def verified(pairs: DataFrame, whole: DataFrame, threshold: int, *carried: str) -> DataFrame:
    """The pairs (a, b) whose whole sets are similar enough."""
    meet, both = F.size(F.array_intersect("x", "y")), F.size("x") + F.size("y")
    return (
        pairs.join(whole.select(F.col("doc").alias("a"), F.col("tokens").alias("x")), "a")
        .join(whole.select(F.col("doc").alias("b"), F.col("tokens").alias("y")), "b")
        .where(meet * 100 >= (both - meet) * threshold).select("a", "b", *carried)
    )


def whole_sets(docs: DataFrame, width: int, pairs: DataFrame) -> DataFrame:
    """(doc, tokens): the whole sets of the documents in pairs (a, b)."""
    schema = pa.schema([("doc", pa.int64()), ("tokens", pa.list_(pa.int64()))])

    def function(rows, data, offsets):
        found = sets(data, offsets, width)
        first = np.concatenate(([0], np.cumsum([len(s) for s in found])))
        yield frame(schema, rows.column(0), list_rows(np.concatenate(found).view(np.int64), first))

    wanted = pairs.select(F.col("a").alias("doc")).union(pairs.select("b")).distinct()
    return join_ids(docs, wanted, ["doc"], "left_semi").mapInArrow(per_chunk(function, "text"), "doc long, tokens array<long>")


def links(docs: DataFrame, sized: DataFrame, width: int = 5, threshold: int = 75) -> DataFrame:
    """Links (a, b) between documents (doc, text) with different sets: enough of them to connect all that chains of similar
    documents connect. ``sized`` are their sizes and keys."""
    # written, so that both sides of the join are shuffles whose hot classes Spark can split
    classes = materialize(sized.where("n > 0").groupBy("k1", "k2").agg(F.min("doc").alias("rep")))
    copies = sized.join(classes, ["k1", "k2"]).groupBy("doc").agg(F.max(F.col("doc") == F.col("rep")).alias("stands"))
    alone = join_ids(docs, copies.where("not stands").select("doc"), ["doc"], "left_anti")
    tokens = materialize(shared_tokens(alone, width, threshold, sketch(docs, width)))
    # shared: how many of a document's prefix tokens another prefix has; it must be what the nearest size demands
    sizes = sized.where("n > 0").select("doc", "n").distinct()
    low, high = needed(F.col("n"), threshold), F.floor(F.col("n") * 100 / threshold)
    shared = tokens.groupBy("doc").agg(F.count("*").alias("shared")).join(sizes, "doc")
    shared = materialize(shared.where(F.col("shared") >= least_demand(F.col("n"), low, high, threshold)))
    tokens = materialize(tokens.join(shared, "doc"))

    similar = lambda pairs, *carried: verified(pairs, whole_sets(docs, width, pairs), threshold, *carried)
    # groups grow in rounds: each document is compared with one leader of another group, and verified links join the groups
    members = tokens.withColumn("grp", F.col("doc"))
    found, tried = None, None
    for _ in range(ROUNDS):
        stars = materialize(star_links(members, tried, threshold))
        new = materialize(similar(stars))
        if not new.take(1):
            break
        found, tried = (new, stars) if found is None else (found.union(new), tried.union(stars))
        members = materialize(regrouped(members, new))

    # the token-group matrix, and queries from groups with larger names
    matrix = materialize(members.groupBy("token", "grp").agg(F.min("n").alias("least"), F.max("n").alias("most"), F.max("shared").alias("top"), F.count("*").alias("held")))
    q, g = members.alias("q"), matrix.alias("g")
    near = F.greatest(F.col("g.least"), needed(F.col("q.n"), threshold))
    far = F.least(F.col("g.most"), F.floor(F.col("q.n") * 100 / threshold))
    demand = least_demand(F.col("q.n"), near, far, threshold)
    met = q.join(g, (F.col("q.token") == F.col("g.token")) & (F.col("q.grp") > F.col("g.grp")) & (near <= far) & (demand <= F.least("q.shared", "g.top")))
    opened = met.select(F.col("q.doc").alias("doc"), F.col("g.grp").alias("grp"), demand.alias("demand"))
    opened = opened.groupBy("doc", "grp").agg(F.count("*").alias("overlap"), F.min("demand").alias("demand")).where("overlap >= demand").drop("overlap")
    opened = materialize(opened)
    # a similar member has at least the demanded number of the tokens that a query shares with its group, so it has one of any
    # but that number, and one more, of them: those that fewest members have
    asked = members.withColumnRenamed("grp", "own").join(opened, "doc").join(matrix.select("token", "grp", "held"), ["token", "grp"])
    both = Window.partitionBy("doc", "grp")
    asked = asked.withColumns({"rank": F.row_number().over(both.orderBy("held", "token")), "all": F.count("*").over(both)})
    asked = asked.where(F.col("rank") <= F.col("all") - F.greatest(F.col("demand"), F.lit(1)) + 1)
    query = asked.select("token", "grp", "own", F.col("doc").alias("a"), F.col("n").alias("na"), F.col("shared").alias("sa"))
    member = members.join(opened.select("grp").distinct(), "grp", "left_semi").select("token", "grp", F.col("doc").alias("b"), F.col("n").alias("nb"), F.col("shared").alias("sb"))
    demand = least_overlap(F.col("na"), F.col("nb"), threshold)
    close = similar_sizes(F.col("na"), F.col("nb"), threshold) & (demand <= F.least("sa", "sb"))
    pairs = query.join(member, ["token", "grp"]).where(close).select("a", "b", "own", "grp", demand.alias("demand")).distinct()
    heads = materialize(tokens.groupBy("doc").agg(F.collect_set("token").alias("head")))
    pairs = pairs.join(heads.withColumnsRenamed({"doc": "a", "head": "x"}), "a").join(heads.withColumnsRenamed({"doc": "b", "head": "y"}), "b")
    pairs = pairs.withColumn("overlap", F.size(F.array_intersect("x", "y"))).where(F.col("overlap") >= F.col("demand"))
    pairs = materialize(pairs.select("a", "b", "own", "grp", "overlap").distinct())
    # first one pair of any two groups, then the pairs of groups that are still apart
    best = materialize(pairs.groupBy("own", "grp").agg(F.max(F.struct("overlap", "a", "b")).alias("x")).select("x.a", "x.b", "own", "grp"))
    sure = materialize(similar(best, "own", "grp"))
    found = sure.select("a", "b") if found is None else found.union(sure.select("a", "b"))
    rest = pairs.select("a", "b", "own", "grp")
    if sure.take(1):
        joined = materialize(components(sure.select(F.col("own").alias("a"), F.col("grp").alias("b"))))
        for side in ("own", "grp"):
            rest = rest.join(joined.withColumnsRenamed({"node": side, "component": f"{side}_now"}), side, "left")
        rest = rest.where(~F.coalesce("own_now", "own").eqNullSafe(F.coalesce("grp_now", "grp")))
    return found.union(similar(materialize(rest.select("a", "b").distinct())))


def star_links(members: DataFrame, tried: DataFrame | None, threshold: int) -> DataFrame:
    """(a, b): for every document that leader of another group which shares most of its prefix, if it shares enough. The
    leaders of a token are the documents with that token whose prefix is shared most, in two groups."""
    lead = members.groupBy("token", "grp").agg(F.max(F.struct(F.col("shared") / F.col("n"), -F.col("doc"), F.col("n"))).alias("x"))
    first = F.row_number().over(Window.partitionBy("token").orderBy(F.desc("x"), "grp"))
    lead = lead.withColumn("place", first).where("place <= 2")
    leader = F.struct("grp", (-F.col("x.col2")).alias("doc"), F.col("x.n").alias("n"))
    # written, so that the join has no aggregate on its key below it and Spark can split a hot token
    lead = materialize(lead.groupBy("token").agg(F.max(F.when(F.col("place") == 1, leader)).alias("l1"), F.max(F.when(F.col("place") == 2, leader)).alias("l2")))
    other = F.when(F.col("grp") != F.col("l1.grp"), F.col("l1")).otherwise(F.col("l2"))
    votes = members.join(lead, "token").select("doc", "n", other.alias("l")).where("l is not null")
    votes = votes.groupBy("doc", "n", F.col("l.doc").alias("leader"), F.col("l.n").alias("m")).agg(F.count("*").alias("votes"))
    votes = votes.where(similar_sizes(F.col("n"), F.col("m"), threshold) & (F.col("votes") >= least_overlap(F.col("n"), F.col("m"), threshold)))
    if tried is not None:
        votes = votes.join(tried.toDF("doc", "leader"), ["doc", "leader"], "left_anti")
    return votes.groupBy("doc").agg(F.max(F.struct("votes", "leader")).alias("x")).select(F.col("doc").alias("a"), F.col("x.leader").alias("b"))


def regrouped(members: DataFrame, new: DataFrame) -> DataFrame:
    """The members with the groups that new links (a, b) between documents join."""
    home = members.select("doc", "grp").distinct()
    ends = new.join(home.toDF("a", "u"), "a").join(home.toDF("b", "v"), "b").select("u", "v")
    names = materialize(components(ends.toDF("a", "b"))).toDF("grp", "now")
    return members.join(names, "grp", "left").withColumn("grp", F.coalesce("now", "grp")).drop("now")


def links_of_ids(sized: DataFrame) -> DataFrame:
    """Links (a, b) between the classes that a repeated id is in, each named by its smallest document."""
    classes = materialize(sized.where("n > 0").groupBy("k1", "k2").agg(F.min("doc").alias("rep")))
    held = sized.join(classes, ["k1", "k2"]).select("doc", "rep")
    ids = held.groupBy("doc").agg(F.min("rep").alias("least"), F.max("rep").alias("most")).where("least < most").select("doc", "least")
    ids = materialize(ids)
    if not ids.take(1):
        return ids.toDF("a", "b")
    held = materialize(join_ids(held, ids.select("doc"), ["doc"], "left_semi").distinct())
    return held.join(ids, "doc").where("rep != least").select(F.col("rep").alias("a"), F.col("least").alias("b")).distinct()


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 5, threshold: int = 75) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row."""
    plain = bounded_batches(docs).select(F.col(key).cast("long").alias("doc"), F.col(text).alias("text"))
    sized = materialize(keyed(plain, width))
    named = sized.where("doc is not null")
    found = components(links(plain.where("doc is not null"), named, width, threshold).union(links_of_ids(named)))
    # a class that has a document in a component is in it as a whole: its smallest document stands for it
    classes = named.where("n > 0").groupBy("k1", "k2").agg(F.min("doc").alias("rep"))
    classes = classes.join(found.select(F.col("node").alias("rep"), "component"), "rep", "left")
    classes = materialize(classes.select("k1", "k2", F.coalesce("component", "rep").alias("component")))
    return sized.join(classes, ["k1", "k2"], "left").select(
        F.col("doc").alias("doc_id"), F.col("n").alias("n_shingles"), F.when((F.col("n") > 0) & F.col("doc").isNotNull(), F.col("component")).otherwise(F.col("doc")).alias("component_id"),
    )
