"""A manifest of a dataset as a tree of digests, and the proof of each row, by pointer jumping.

Rows are leaves.  Those of a group (a language) ascend by id; every eight consecutive nodes become one until one is
left, the group's subroot, and the subroots become the root likewise.  A node's *segment* towards an ancestor holds the
siblings on that way: for each level the digests left and right of the node.  At first each node points to its parent
with a segment of one level.  A self-join takes every node's ancestor's segment behind the node's own and points it to
the ancestor's ancestor, so the distance doubles and all nodes reach the root after a logarithm of the height in rounds.

Leaves of one run of eight share all of their way but its first level, so they travel as one row; only the nodes above
them, a seventh as many, are joined with themselves.  Positions are numbered by range: rows are dealt by sampled bounds
of (group, id, leaf), counted in each part, and offset by the counts before, so a group may hold all rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayer.llm.shared import Scratch, numbered
from assayer.operators.joins import small

#: Consecutive nodes that become one.
RUN = 8
#: Nodes that are broadcast at most: each holds a segment of a few kilobytes.
FEW_NODES = 10_000
_BYTES = 32
_SEGMENT = "array<struct<left:binary,right:binary>>"


def digest(*parts: Column) -> Column:
    """Lowercase hexadecimal SHA-256 of the parts one after another."""
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def field(value: Column) -> Column:
    """``-`` for null, else the number of UTF-8 bytes, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(*fields: Column) -> Column:
    return digest(*map(field, fields))


def fold(start: Column, proof: Column) -> Column:
    """The root that a leaf and its proof lead to."""
    return F.aggregate(proof, start, lambda h, s: digest(s["left"], h, s["right"]))


def siblings(proof: Column) -> Column:
    """All siblings of a proof one after another, from left to right and level by level."""
    return F.array_join(F.transform(proof, lambda s: F.concat(s["left"], s["right"])), "")


def _runs(nodes: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """A row for each run: ``tree``, ``k`` (of the parent), ``n`` (nodes at this level) and ``whole``, all digests in a row.

    ``carry``: columns of the nodes that are kept in ``members``, at most eight of them.
    """
    found = nodes.groupBy("tree", F.floor(F.col("k") / RUN).alias("run")).agg(F.first("n").alias("n"), F.sort_array(F.collect_list(F.struct("k", "d", *carry))).alias("members"))
    whole = F.unhex(F.array_join(F.transform("members", lambda m: F.hex(m["d"])), ""))
    return found.select("tree", F.col("run").alias("k"), "n", whole.alias("whole"), *(["members"] if carry else []))


def _own(whole: Column, at: Column) -> Column:
    """The digests left and right of one in a run."""
    return F.struct(F.substring(whole, F.lit(1), at * _BYTES).alias("left"), F.substring(whole, (at + 1) * _BYTES + 1, F.lit(RUN * _BYTES)).alias("right"))


def _parents(runs: DataFrame) -> DataFrame:
    """The nodes that runs become; a lone node stays what it is."""
    d = F.when(F.col("n") > 1, F.unhex(digest(F.lower(F.hex("whole"))))).otherwise(F.col("whole"))
    return runs.select("tree", "k", F.ceil(F.col("n") / RUN).alias("n"), d.alias("d"))


def _links(runs: DataFrame, level: int) -> DataFrame:
    """From each node of the runs to its parent, with the segment between them."""
    one = runs.where("n > 1").select("tree", "k", "whole", F.explode(F.sequence(F.lit(0), F.floor(F.length("whole") / _BYTES).cast("int") - 1)).alias("at"))
    node = F.struct(F.col("tree"), F.lit(level).alias("level"), (F.col("k") * RUN + F.col("at")).alias("k"))
    return one.select(node.alias("node"), F.struct(F.col("tree"), F.lit(level + 1).alias("level"), F.col("k")).alias("up"), F.array(_own(F.col("whole"), F.col("at"))).cast(_SEGMENT).alias("segment"))


@dataclass
class _Trees:
    """The runs of each level, ``tops`` (tree, level, d: the node that each tree ends in), and the links above the lowest runs."""

    first: DataFrame
    tops: DataFrame
    links: DataFrame | None
    height: int


def _grow(scratch: Scratch, nodes: DataFrame, carry: tuple[str, ...]) -> _Trees:
    """Builds all trees level by level; a level is a written table with a node for each run of the one below."""
    first = runs = scratch.write(_runs(nodes, carry))
    most, level, links = runs.agg(F.max("n")).first()[0], 0, None
    tops = runs.where("n = 1").select("tree", F.lit(0).alias("level"), F.col("whole").alias("d"))
    while most > 1:
        above, most, level = _parents(runs.where("n > 1")), -(-most // RUN), level + 1
        tops = tops.unionByName(above.where("n = 1").select("tree", F.lit(level).alias("level"), "d"))
        if most > 1:
            runs = scratch.write(_runs(above.where("n > 1")))
            links = _links(runs, level) if links is None else links.unionByName(_links(runs, level))
    return _Trees(first, tops, links, level)


def _jump(scratch: Scratch, links: DataFrame, height: int) -> DataFrame:
    """Joins the nodes to their ancestors until each holds its segment up to the root."""
    now, distance = scratch.write(links), 1
    while distance < height:
        ahead = now.where((F.col("node.tree") < 0) | (F.col("node.level") > distance)).select(
            F.col("node").alias("up"), F.col("up").alias("above"), F.col("segment").alias("more")
        )  # a node that others have at this distance stands above that level, or in the tree of subroots
        met = now.join(small(ahead, FEW_NODES), "up", "left")
        new = met.select("node", F.coalesce("above", "up").alias("up"), F.when(F.col("more").isNull(), F.col("segment")).otherwise(F.concat("segment", "more")).alias("segment"))
        now, distance = scratch.write(new), distance * 2
    return now.select("node", "segment")


def prove(docs: DataFrame, fields: tuple[str, ...], id: str = "doc_id", group: str = "lang", carry: dict[str, Column] | None = None) -> DataFrame:
    """The id, ``leaf``, ``subroot``, ``root`` and ``proof`` of every row, and the columns to carry along.

    ``fields`` are digested into the leaf in this order; ``proof`` has left and right siblings for each level up to the root.
    ``carry`` names expressions over the rows that travel with them; they must follow from the fields.

    A null field is ``-``, also in the id and the group: rows without a group are one, the first.  Leaves with equal ids
    ascend by their digest; rows that repeat in every field are leaves of their own, whose proofs go to them in any order.
    An empty table has no rows and no root.  Columns that are neither named nor carried are not read, whatever their names.
    """
    carry = carry or {}
    scratch = Scratch(docs.sparkSession)
    kept = [e.alias(f"carry_{j}") for j, e in enumerate(carry.values())]
    names = tuple(f"carry_{j}" for j in range(len(kept)))
    rows = scratch.write(docs.select(F.col(group).alias("grp"), F.col(id).alias("id"), F.unhex(leaf(*map(F.col, fields))).alias("d"), *kept))
    placed = numbered(scratch, rows, ["grp", "id", "d"])
    groups = scratch.write(placed.groupBy("grp").agg(F.min("place").alias("tree"), F.count(F.lit(1)).alias("n")))
    kinds = [f"id {dict(rows.dtypes)['id']}", "leaf string", "subroot string", "root string", "proof array<struct<left:string,right:string>>", *(f"{c} {dict(rows.dtypes)[c]}" for c in names)]
    out = [F.col("id").alias(id), "leaf", "subroot", "root", "proof", *(F.col(c).alias(k) for c, k in zip(names, carry))]
    if groups.isEmpty():
        return docs.sparkSession.createDataFrame([], ", ".join(kinds)).select(*out)

    at = placed.alias("p").join(small(groups).alias("g"), F.col("p.grp").eqNullSafe(F.col("g.grp")))
    leaves = at.select("tree", (F.col("place") - F.col("tree")).alias("k"), "n", "d", "id", *names)
    low = _grow(scratch, leaves, ("id", *names))
    tops = scratch.write(low.tops)
    ordered = numbered(scratch, tops, ["tree"])
    n = tops.count()
    high = _grow(scratch, ordered.select(F.lit(-1).cast("long").alias("tree"), F.col("place").alias("k"), F.lit(n).cast("long").alias("n"), "d", F.col("tree").alias("of"), "level"), ("of", "level"))
    root = high.tops.select(F.lower(F.hex("d"))).first()[0]

    subs = high.first.where("n > 1").select("k", "whole", F.posexplode("members").alias("at", "m"))
    links = subs.select(
        F.struct(F.col("m.of").alias("tree"), F.col("m.level").alias("level"), F.lit(0).cast("long").alias("k")).alias("node"),
        F.struct(F.lit(-1).cast("long").alias("tree"), F.lit(1).alias("level"), F.col("k")).alias("up"),
        F.array(_own(F.col("whole"), F.col("at"))).cast(_SEGMENT).alias("segment"),
    )
    for more in (low.links, high.links):
        links = links if more is None else links.unionByName(more)
    ways = _jump(scratch, links, max(low.height - 1, 0) + high.height)

    node = F.struct(F.col("tree"), F.when(F.col("n") > 1, 1).otherwise(0).alias("level"), F.col("k"))
    runs = low.first.withColumn("node", node).join(ways, "node", "left").join(small(tops.select("tree", F.lower(F.hex("d")).alias("subroot"))), "tree")
    each = runs.select("subroot", "n", "whole", "segment", F.posexplode("members").alias("at", "m"))
    own = F.when(F.col("n") > 1, F.array(_own(F.col("whole"), F.col("at")))).otherwise(F.array()).cast(_SEGMENT)
    proof = F.transform(F.concat(own, F.coalesce("segment", F.array().cast(_SEGMENT))), lambda s: F.struct(F.lower(F.hex(s["left"])).alias("left"), F.lower(F.hex(s["right"])).alias("right")))
    return each.select(F.col("m.id").alias("id"), F.lower(F.hex("m.d")).alias("leaf"), "subroot", F.lit(root).alias("root"), proof.alias("proof"), *(F.col(f"m.{c}").alias(c) for c in names)).select(*out)
