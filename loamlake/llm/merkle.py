"""Merkle manifest of a data set: a root for all rows and, for every row, the proof that ties it to that root.

Rows are leaves, ordered by key within their group. While a group has several
nodes, every ``FAN`` consecutive ones become the digest of their hex digests in a row; the
group roots, ordered by group, become one root in the same way.

Levels are strings. An aligned block of ``BLOCK`` nodes holds a level as the hex
digests of its nodes, one after another: the next level is the hash of each
fixed-width substring, the siblings of a node are the substrings on both sides of
it. A block's own root is a node of the next tier, where the same happens to the
blocks of the group; a group that is one node is carried up as it is. A tier has a
``BLOCK``-th of the rows of the one below, and what a row needs from above
reaches it by one join of blocks, so neither a group of any size nor a path meets in one place.

Cases: null fields count as absent, which differs from empty; a null group is a group of its own,
the first; null keys come first; rows with equal keys are ordered by their leaf, so equal rows are
interchangeable; a group of one row is its own root; texts of any length are hashed where they are read
and never move; an empty table gives an empty result; columns that are not named as fields change nothing.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loamlake.operators.running import row_number, running_sum
from loamlake.runtime import cut_lineage

FAN, HEX, TIERS = 8, 64, 3
BLOCK = FAN**TIERS
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
PATH = "array<struct<left:string,right:string>>"


def digest(text: Column) -> Column:
    """Lowercase hex SHA-256 of a string's UTF-8 bytes."""
    return F.sha2(text.cast("binary"), 256)


def leaf(fields: Sequence[Column]) -> Column:
    """Digest of all fields in order, each with its size in bytes before it, a dash where it is null."""
    texts = [f.cast("string") for f in fields]
    return digest(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]))


def proof(path: Column) -> Column:
    """Digest of all siblings, level by level, left to right."""
    return digest(F.array_join(F.transform(path, lambda s: F.concat(s["left"], s["right"])), ""))


def fold(path: Column, start: Column) -> Column:
    """The root that follows from a leaf and its siblings."""
    return F.aggregate(path, start, lambda at, s: digest(F.concat(s["left"], at, s["right"])))


def _parents(level: str) -> Column:
    """The level above a level, both as strings of digests."""
    step = FAN * HEX
    runs = f"sequence(0, cast(ceil(length({level}) / {step}) AS int) - 1)"
    return F.expr(f"array_join(transform({runs}, i -> sha2(cast(substring({level}, i * {step} + 1, {step}) AS binary), 256)), '')")


def _blocks(nodes: DataFrame) -> DataFrame:
    """group, block, size, members, levels, height, top of nodes (group, position, size, digest, item)."""
    at = F.floor(F.col("position") / BLOCK)
    held = F.array_sort(F.collect_list(F.struct("position", "digest", "item")))  # at most BLOCK
    made = nodes.groupBy("group", at.alias("block")).agg(F.first("size").alias("size"), held.alias("members"))
    made = made.withColumn("height", F.expr(f"CASE WHEN size > {FAN**2} THEN 3 WHEN size > {FAN} THEN 2 WHEN size > 1 THEN 1 ELSE 0 END"))
    made = made.withColumn("level0", F.array_join("members.digest", ""))
    for k in range(TIERS):
        made = made.withColumn(f"level{k + 1}", F.when(F.col("height") > k, _parents(f"level{k}")))
    names = [f"level{k}" for k in range(TIERS + 1)]
    return made.select("group", "block", "size", "members", "height", F.array(*names[:-1]).alias("levels"), F.coalesce(*names[::-1]).alias("top"))


def _paths(blocks: DataFrame, above: DataFrame) -> DataFrame:
    """group, position, digest, item, path, subroot, root of the members of ``blocks``; ``above`` has the same of the blocks themselves."""
    q = f"shiftright(cast(m.position % {BLOCK} AS int), 3 * k)"
    left = f"substring(level, ({q} - {q} % {FAN}) * {HEX} + 1, {q} % {FAN} * {HEX})"
    right = f"substring(level, ({q} + 1) * {HEX} + 1, ({FAN - 1} - {q} % {FAN}) * {HEX})"
    path = f"transform(slice(levels, 1, height), (level, k) -> struct({left} AS left, {right} AS right))"
    rows = blocks.select("group", "block", F.expr(f"transform(members, m -> struct(m.position, m.digest, m.item, {path} AS path))").alias("rows"))
    met = rows.join(above.select("group", F.col("position").alias("block"), F.col("path").alias("_above"), "subroot", "root"), ["group", "block"])
    each = met.select("group", "_above", "subroot", "root", F.explode("rows").alias("r"))
    return each.select("group", "r.position", "r.digest", "r.item", F.concat("r.path", "_above").alias("path"), "subroot", "root")


def _climb(nodes: DataFrame, most: int, ending) -> DataFrame:
    """Paths of ``nodes``, of which a group has ``most`` at most; ``ending`` gives those of whole groups from (group, top)."""
    blocks = cut_lineage(_blocks(nodes), "level")
    if most <= BLOCK:
        above = ending(blocks.select("group", "top"))
    else:
        upper = blocks.select("group", F.col("block").alias("position"), F.ceil(F.col("size") / BLOCK).alias("size"), F.col("top").alias("digest"), F.lit(None).cast("string").alias("item"))
        above = _climb(upper, -(-most // BLOCK), ending)
    return _paths(blocks, above)


def tree(rows: DataFrame) -> DataFrame:
    """key, leaf, seen, path, subroot, root of ``rows`` (group, key, leaf, seen).

    ``path`` has the digests on both sides at every level from the leaf to the root. ``seen`` is any string that goes with the row, such as
    its digest at another time, to be folded along the path.
    """
    # A prefix keeps the order of groups and makes null a value, the least one.
    named = rows.select(F.coalesce(F.concat(F.lit("="), F.col("group").cast("string")), F.lit("")).alias("group"), "key", "leaf", "seen")
    placed = cut_lineage(running_sum(named, F.lit(1), ["key", "leaf", "seen"], ["group"]), "places")
    sizes = cut_lineage(placed.groupBy("group").agg(F.count("*").alias("size")), "sizes")
    most = sizes.agg(F.max("size"), F.count("*")).first()
    item = F.struct("key", "seen")
    nodes = placed.join(sizes, "group").select("group", F.col("before").alias("position"), "size", F.col("leaf").alias("digest"), item.alias("item"))

    def roots(tops: DataFrame) -> DataFrame:
        numbered = row_number(tops, ["group", "top"]).select("group", "top", (F.col("position") - 1).alias("position"))
        nodes = numbered.select(F.lit("").alias("group"), "position", F.lit(most[1]).cast("bigint").alias("size"), F.col("top").alias("digest"), F.struct("group", "top").alias("item"))
        whole = lambda top: top.select("group", F.lit(0).cast("bigint").alias("position"), F.array().cast(PATH).alias("path"), F.col("top").alias("subroot"), F.col("top").alias("root"))
        made = _climb(nodes, most[1], whole)
        return made.select(F.col("item.group").alias("group"), F.lit(0).cast("bigint").alias("position"), "path", F.col("item.top").alias("subroot"), "root")

    made = _climb(nodes, most[0] or 0, roots)
    return made.select("item.key", F.col("digest").alias("leaf"), "item.seen", "path", "subroot", "root")
