"""Operator 13: a Merkle manifest of a dataset by sibling-shift self-joins.

Every row becomes a leaf, the SHA-256 of its length-prefixed fields.  The leaves of a group are numbered in order and
stand in runs of ``arity``.  A level joins its nodes ``arity - 1`` times with themselves, each time on the computed index of
another slot of the same run (the index XOR 1 for two slots, the next slots of the run otherwise), so every node knows the digests
to its left and right; rows in slot zero then emit the parents.  Each level is a written table a third as large as the one
before.  The groups' roots are the leaves of one more tree of the same kind.

Proofs go the other way: from the root down, each node takes its parent's path and puts its own siblings before it, so the paths are
joined at every level with the fewer rows of the level above, and texts are read once.

Positions need no single task: rows are dealt by ranges of (group, order), a range counts its rows of each group, and
only these counts are added up over the ranges.  Digests travel as 32 bytes and are hashed as lower-case hex text.

Defined results: a null field is ``-``; null groups are one group, before all others; rows with a null order column come first in their group; rows that repeat it
are ordered by their leaf, equal rows are equal leaves; a group of one row has its leaf as root, one group alone gives the root; an
empty table gives an empty result.  Only the named columns are read, whatever else there is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from framesift.plans.shared import write_shared

ARITY = 3
#: Nodes of a task in a level's table.
LEVEL_ROWS = 100_000
NOTHING = F.lit(b"")


def hashed(*parts: Column) -> Column:
    """SHA-256 of the concatenated parts, 32 bytes."""
    return F.unhex(F.sha2(F.concat(*parts), 256))


def text_of(digests: Column) -> Column:
    return F.lower(F.hex(digests))


def field(column: Column) -> Column:
    """``-`` for null, else the number of UTF-8 bytes, a colon and the value."""
    value = column.cast("string")
    return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))


def leaf_of(columns: list[Column]) -> Column:
    return hashed(*map(field, columns))


def numbered(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """Adds ``at``, the 0-based position of a row in its group, and ``n``, the group's rows; a written table.

    A hot group is spread over many ranges; equal rows are told apart by a number, so that ranges can part them.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    told = rows.withColumn("_tie", F.monotonically_increasing_id())
    keys = [group, *order, "_tie"]
    ranged = write_shared(told.repartitionByRange(parts, *keys).sortWithinPartitions(*keys).withColumn("_place", F.monotonically_increasing_id()).drop("_tie"), "merkle-ranges")
    # the upper bits of the number name the task, the lower 33 count its rows
    ranged = ranged.withColumn("_range", F.shiftright("_place", 33)).withColumn("_in", F.col("_place").bitwiseAND((1 << 33) - 1))
    counts = ranged.groupBy(F.col("_range").alias("_r"), F.col(group).alias("_g")).agg(F.min("_in").alias("_first"), F.count("*").alias("_rows"))
    of_group = W.partitionBy("_g")
    before = F.coalesce(F.sum("_rows").over(of_group.orderBy("_r").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select("_r", "_g", (before - F.col("_first")).alias("_shift"), F.sum("_rows").over(of_group).alias("n"))
    placed = ranged.join(starts, (F.col("_range") == F.col("_r")) & F.col(group).eqNullSafe(F.col("_g")))
    return write_shared(placed.withColumn("at", F.col("_in") + F.col("_shift")).drop("_place", "_range", "_in", "_r", "_g", "_shift"), "merkle-numbered")


def with_siblings(level: DataFrame, arity: int = ARITY) -> DataFrame:
    """Adds ``left`` and ``right``, the digests of the run's other nodes, to nodes of (tree, at, n, digest, ...)."""
    slot = F.col("at") % arity
    left, right = NOTHING, NOTHING
    joined = level
    for shift in range(1, arity):
        wanted = F.col("at").bitwiseXOR(F.lit(1)) if arity == 2 else F.col("at") - slot + (slot + shift) % arity
        other = level.where("n > 1").select(F.col("tree").alias(f"_tree{shift}"), F.col("at").alias(f"_at{shift}"), F.col("digest").alias(f"_digest{shift}"))
        joined = joined.join(other, F.col("tree").eqNullSafe(F.col(f"_tree{shift}")) & (wanted == F.col(f"_at{shift}")), "left")
        found = F.coalesce(F.col(f"_digest{shift}"), NOTHING)
        left = F.concat(left, F.when(slot + shift >= arity, found).otherwise(NOTHING))
        right = F.concat(right, F.when(slot + shift < arity, found).otherwise(NOTHING))
    return joined.select(*level.columns, left.alias("left"), right.alias("right"))


def levels_of(leaves: DataFrame, arity: int = ARITY) -> list[DataFrame]:
    """The written levels of all trees of ``leaves`` (tree, at, n, digest, ...), leaves first; trees of one node leave."""
    levels, level = [], leaves
    rows, trees, most = leaves.agg(F.count("*"), F.count_if(F.col("at") == 0), F.coalesce(F.max("n"), F.lit(0))).first()
    while True:
        whole = with_siblings(level, arity) if most > 1 else level.withColumn("left", NOTHING).withColumn("right", NOTHING)
        written = write_shared(whole.coalesce(1 + rows // LEVEL_ROWS), "merkle-level")
        levels.append(written)
        if most <= 1:
            return levels
        firsts = written.where((F.col("n") > 1) & (F.col("at") % arity == 0))
        level = firsts.select(
            "tree", F.expr(f"at div {arity}").alias("at"), F.expr(f"(n + {arity - 1}) div {arity}").alias("n"), hashed(text_of(F.col("digest")), text_of(F.col("right"))).alias("digest")
        )
        rows, most = rows // arity + trees, -(-most // arity)


def roots_of(levels: list[DataFrame]) -> DataFrame:
    """(tree, digest) of every tree's root."""
    ends = [level.where("n = 1").select("tree", "digest") for level in levels]
    out = ends[0]
    for end in ends[1:]:
        out = out.union(end)
    return out


def paths_of(levels: list[DataFrame], above_roots: DataFrame | None = None, arity: int = ARITY) -> DataFrame:
    """The leaves with ``path``, the (left, right) siblings from the leaf up, and ``top``, the digest at the head of their tree.

    ``above_roots`` (tree, path) continues the paths of the trees' roots.
    """
    down = None
    step = F.array(F.struct("left", "right"))
    for number, level in reversed(list(enumerate(levels))):
        kept = [c for c in level.columns if c not in ("left", "right")] if number == 0 else ["tree", "at"]
        ends = level.where("n = 1")
        if above_roots is None:
            ends = ends.withColumn("path", F.expr("slice(array(struct(left, right)), 1, 0)"))
        else:
            beyond = above_roots.select(F.col("tree").alias("_tree"), "path")
            ends = ends.join(beyond, F.col("tree").eqNullSafe(F.col("_tree")))
        now = ends.select(*kept, "path", F.col("digest").alias("top"))
        if down is not None:
            parents = down.select(F.col("tree").alias("_tree"), F.col("at").alias("_at"), F.col("path").alias("_path"), "top")
            inner = level.where("n > 1").join(parents, F.col("tree").eqNullSafe(F.col("_tree")) & (F.expr(f"at div {arity}") == F.col("_at")))
            now = now.unionByName(inner.select(*kept, F.concat(step, F.col("_path")).alias("path"), "top"))
        down = now
    return down


def folded(path: Column, start: Column) -> Column:
    """The root that ``start`` and the siblings of ``path`` give, as hex text."""
    return F.aggregate(path, text_of(start), lambda so_far, x: F.sha2(F.concat(text_of(x["left"]), so_far, text_of(x["right"])), 256))


def manifest(rows: DataFrame, fields: list[str], group: str, order: str, checked: dict[str, Column] | None = None, arity: int = ARITY) -> DataFrame:
    """Per row: the order column, ``leaf``, ``subroot`` (of its group), ``root``, ``proof_sha256``, ``folded_root`` and ``verified``.

    A leaf hashes ``fields``.  ``checked`` gives columns of the same names as they are found now: the proof is folded from them, and
    ``verified`` tells whether they still lead to the root.
    """
    now = [(checked or {}).get(c, F.col(c)) for c in fields]
    leaves = rows.select(F.col(group).cast("string").alias("tree"), F.col(order).alias("_order"), leaf_of([F.col(c) for c in fields]).alias("digest"), leaf_of(now).alias("_found"))
    placed = numbered(write_shared(leaves, "merkle-leaves"), "tree", ["_order", "digest"])
    levels = levels_of(placed, arity)
    heads = numbered(roots_of(levels).select(F.lit(0).alias("_all"), F.col("tree").alias("_group"), "digest"), "_all", ["_group"])
    upper = levels_of(heads.select(F.col("_all").alias("tree"), "at", "n", "digest", "_group"), arity)
    top = roots_of(upper).first()
    root = F.lit(bytes(top["digest"]).hex() if top else "")
    upper_paths = write_shared(paths_of(upper, None, arity).select(F.col("_group").alias("tree"), "path"), "merkle-heads")
    proofs = paths_of(levels, upper_paths, arity)
    siblings = F.array_join(F.transform("path", lambda x: F.concat(text_of(x["left"]), text_of(x["right"]))), "")
    told = proofs.select(
        F.col("_order").alias(order), text_of(F.col("digest")).alias("leaf"), text_of(F.col("top")).alias("subroot"), root.alias("root"),
        F.sha2(siblings, 256).alias("proof_sha256"), folded(F.col("path"), F.col("_found")).alias("folded_root"),
    )
    return told.withColumn("verified", F.col("folded_root") == F.col("root"))
