"""A Merkle manifest of a dataset: every row's leaf, its group's subroot, the root, and its proof.

Leaves of a group are numbered in order of a column. A level is one window: partitioned by group and
parent index and ordered by index, its full-frame collect_list is at once the parent's preimage and
every node's list of siblings. Parents are then kept once (the row of the first child) and are the nodes
of the next level, until each group has one node left, its subroot. The subroots, in order of
their groups, are the leaves of a further tree of the same kind, whose top is the root.

Proofs run the other way: from the top down a node's proof is its own siblings before its
parent's proof, so each level joins the nodes of two levels and all levels together some two rows a leaf
(at arity 2). No task holds more than a run of ``arity`` nodes or a range of leaves; the number of a leaf is
its place in a range plus the rows of the ranges before. Levels are stored, so a lost executor costs one.

A field is ``-`` if null, else its UTF-8 bytes, ``:`` and itself. Leaves are in order of the order column
(nulls first), then of the leaf; rows alike in both are alike in everything and take any order among
themselves, so they have different proofs of the same digests. A null group is a group, the first; groups go in
bytewise order. Repeated rows have a leaf each. A group of one row has that leaf as its subroot, without a
further hash, and a single subroot is the root. An empty table gives an empty result. Columns other than those
named take no part, whatever they are called.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from filterlab.llm.common import forget, ranked, stored

#: Joins between two stored tables of proofs.
JOINS_AT_ONCE = 6
_STEPS = "array<struct<pos:int,others:array<binary>>>"


def field(value: Column) -> Column:
    said = value.cast("string")
    return F.when(value.isNull(), "-").otherwise(F.concat(F.octet_length(said).cast("string"), F.lit(":"), said))


def leaf(*values: Column) -> Column:
    """The digest of a row, in hex."""
    return F.sha2(F.concat(*map(field, values)).cast("binary"), 256)


def _hex(digest: Column) -> Column:
    return F.lower(F.hex(digest))


def _text(digests: Column) -> Column:
    return F.array_join(F.transform(digests, _hex), "")


def _parent(run: Column) -> Column:
    return F.unhex(F.sha2(_text(run).cast("binary"), 256))


def levels(nodes: DataFrame, arity: int) -> tuple[list[DataFrame], DataFrame]:
    """The stored levels (g, idx, n, run) of the groups' trees over nodes (g, idx, n, digest), n being the
    nodes of the group, and the groups' tops (g, digest)."""
    found: list[DataFrame] = []
    most = nodes.agg(F.max("n")).first()[0] or 0
    tops = nodes.where("n = 1").select("g", "digest")
    run = W.partitionBy("g", "parent").orderBy("idx").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    while most > 1:
        dealt = nodes.where("n > 1").withColumn("parent", F.floor(F.col("idx") / arity).cast("long"))
        level = stored(dealt.select("g", "idx", "n", F.collect_list("digest").over(run).alias("run")), "merkle-level")
        found.append(level)
        first = level.where(F.col("idx") % arity == 0)  # a parent once
        nodes = first.select("g", F.floor(F.col("idx") / arity).cast("long").alias("idx"), F.ceil(F.col("n") / arity).cast("long").alias("n"), _parent(F.col("run")).alias("digest"))
        tops = tops.unionAll(nodes.where("n = 1").select("g", "digest"))
        most = -(-most // arity)
    return found, tops


def paths(found: list[DataFrame], arity: int) -> DataFrame | None:
    """(g, idx, path) of the nodes of the lowest level: from there up, the place in the run and the others of
    the run. Groups of one node are left out; None if there is no level."""
    above, waiting = None, []
    for k in range(len(found) - 1, -1, -1):
        pos = (F.col("idx") % arity).cast("int")
        others = F.concat(F.slice("run", F.lit(1), pos), F.slice("run", pos + 2, F.lit(arity)))
        own = found[k].select("g", "idx", F.array(F.struct(pos.alias("pos"), others.alias("others"))).cast(_STEPS).alias("path"))
        if above is None:
            above = own
            continue
        up = above.select(F.col("g").alias("up_g"), F.col("idx").alias("up_idx"), F.col("path").alias("rest"))
        joined = own.join(up, (F.col("g") == F.col("up_g")) & (F.floor(F.col("idx") / arity).cast("long") == F.col("up_idx")), "left")
        above = joined.select("g", "idx", F.concat("path", F.coalesce("rest", F.array().cast(_STEPS))).alias("path"))
        if k % JOINS_AT_ONCE == 0:
            above = stored(above, "merkle-paths")
            forget(*waiting)
            waiting = [above] if k else []
    return above


def manifest(rows: DataFrame, leaf: Column, group: Column, order: Column, arity: int = 2, keep: dict[str, Column] | None = None) -> DataFrame:
    """The columns keep of every row, leaf, subroot and root (hex), and path: the row's proof."""
    if arity < 2:
        raise ValueError("a run has two nodes at least")
    kept = list(keep or {})
    key = F.when(group.isNull(), "n").otherwise(F.concat(F.lit("v"), group.cast("string")))  # null first
    made = stored(rows.select(key.alias("g"), order.alias("at"), F.unhex(leaf).alias("digest"), F.rand(11).alias("lot"), *((keep or {})[c].alias(f"keep_{c}") for c in kept)), "merkle-leaves")
    numbered = ranked(made, [F.col("at").asc_nulls_first(), F.col("digest"), F.col("lot")], "g")
    forget(made)
    lower, tops = levels(numbered.select("g", "idx", "n", "digest"), arity)
    subroots = stored(tops.select(F.lit("").alias("g"), F.col("g").alias("name"), "digest"), "merkle-subroots")
    summits = ranked(subroots, [F.col("name")], "g")
    upper, root = levels(summits.select("g", "idx", "n", "digest"), arity)
    below, beyond = paths(lower, arity), paths(upper, arity)
    none = F.array().cast(_STEPS)
    top = summits.select(F.col("name").alias("top_g"), F.col("idx").alias("top_idx"), F.col("digest").alias("subroot"))
    if beyond is not None:
        top = top.join(beyond.select("idx", F.col("path").alias("rest")), F.col("top_idx") == F.col("idx"), "left")
    else:
        top = top.withColumn("rest", none)
    whole = root.first()  # one digest
    # one row for each group; how it meets the leaves is left to its size
    top = stored(top.select("top_g", "subroot", F.lit(whole.digest if whole else None).cast("binary").alias("root"), F.coalesce("rest", none).alias("rest")), "merkle-tops")
    if below is not None:
        numbered = numbered.join(below.select(F.col("g").alias("low_g"), F.col("idx").alias("low_idx"), "path"), (F.col("g") == F.col("low_g")) & (F.col("idx") == F.col("low_idx")), "left")
    else:
        numbered = numbered.withColumn("path", none)
    forget(subroots, summits, *lower[1:], *upper)
    joined = numbered.join(top, F.col("g") == F.col("top_g"))
    path = F.concat(F.coalesce("path", none), "rest")
    return joined.select(*(F.col(f"keep_{c}").alias(c) for c in kept), _hex(F.col("digest")).alias("leaf"), _hex(F.col("subroot")).alias("subroot"), _hex(F.col("root")).alias("root"), path.alias("path"))


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf (hex) comes to by a path."""
    def step(own: Column, at: Column) -> Column:
        left, right = F.slice(at["others"], F.lit(1), at["pos"]), F.slice(at["others"], at["pos"] + 1, F.greatest(F.size(at["others"]), F.lit(1)))
        return F.sha2(F.concat(_text(left), own, _text(right)).cast("binary"), 256)

    return F.aggregate(path, leaf, step)


def proof_digest(path: Column) -> Column:
    """The digest of all siblings of a path, from the leaf up."""
    return F.sha2(_text(F.flatten(F.transform(path, lambda x: x["others"]))).cast("binary"), 256)
