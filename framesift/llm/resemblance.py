"""Groups by the exact resemblance of shingle sets, inside groups that an estimate has found.

The estimate of ``wide`` decides which texts may belong together; here every link is a pair of texts whose sets of
five-word shingles have the resemblance asked for.  A group of at most ``CELL_NODES`` nodes and ``CELL_BYTES`` of sets is one cell, compared whole.
In a larger group every member first meets the group's leader, the node nearest to the majority bits of ``SAMPLE`` members.
Those alike to it are one component and need not meet each other; every other member meets all members, in cells of one
block of the former and one of the latter.  So a group of near copies of one text costs one comparison a member, however
many there are; what is quadratic is the members that do not resemble the leader.

In a cell, pairs in one component already, and pairs whose fingerprints differ in more bits than a pair at the similarity does by
``SURE`` standard deviations, are passed over; the sets of all others are compared, nearest first.  A cell gives links between
components, never all its pairs.

Defined results: a text without words resembles only its own fingerprint; nodes of one id (rows that repeat a doc_id) are one; an empty table
gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from itertools import groupby

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F, types as T

from framesift.llm.arrow import map_rows
from framesift.llm.simhash import bit_counts
from framesift.llm.words import run_hashes, word_hashes, words_of
from framesift.plans.graph import connected_components
from framesift.plans.shared import write_shared

CELL_NODES, CELL_BYTES = 512, 8 << 20
SAMPLE = 64
#: A pair at the similarity is compared with probability 0.99997.
SURE = 4.0

SETS = T.StructType([T.StructField("id", T.LongType()), T.StructField("mark", T.LongType()), T.StructField("hashes", T.BinaryType())])
CENTRES = T.StructType([T.StructField("group", T.LongType()), T.StructField("centre", T.BinaryType())])
LINKS = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])


def shingle_set(text: str | None, shingle_words: int) -> np.ndarray:
    """The text's distinct shingles as sorted hashes."""
    return np.unique(run_hashes(word_hashes(words_of(text)), shingle_words))


def resemble(x: np.ndarray, y: np.ndarray, similarity: float) -> bool:
    """Whether two sorted sets have that resemblance: shared shingles by all shingles."""
    if min(len(x), len(y)) + 1e-9 < similarity * max(len(x), len(y)) or not len(x):
        return False
    common = len(np.intersect1d(x, y, assume_unique=True))
    return common + 1e-9 >= similarity * (len(x) + len(y) - common)


def bits_apart(similarity: float, bits: int) -> int:
    """Differing bits beyond which no pair of that similarity lies."""
    share = math.acos(2 * similarity / (1 + similarity)) / math.pi
    return math.ceil(bits * share + SURE * math.sqrt(bits * share * (1 - share)))


def cell_links(rows: list[tuple], similarity: float) -> Iterator[tuple[int, int]]:
    """Links between the components of (id, component, probe, target, fp, hashes): every probe meets every target."""
    ids = [r[0] for r in rows]
    fps = np.frombuffer(b"".join(r[4] for r in rows), "<u8").reshape(len(rows), -1)
    sets = [np.frombuffer(r[5], "<u8") for r in rows]
    # the component as known here; nodes of one id are one
    labels = np.unique([r[1] for r in rows], return_inverse=True)[1]
    first: dict[int, int] = {}
    for k, node in enumerate(ids):
        if labels[first.setdefault(node, k)] != labels[k]:
            labels[labels == labels[k]] = labels[first[node]]
    target, most = np.array([r[3] for r in rows]), bits_apart(similarity, 64 * fps.shape[1])
    for k in (k for k, r in enumerate(rows) if r[2]):
        others = np.flatnonzero(target & (labels != labels[k]))
        apart = np.bitwise_count(fps[others] ^ fps[k]).sum(axis=1, dtype=np.int64)
        for m in others[np.argsort(apart, kind="stable")][: int((apart <= most).sum())].tolist():
            if labels[m] != labels[k] and resemble(sets[k], sets[m], similarity):
                labels[labels == labels[m]] = labels[k]
                yield ids[k], ids[m]


def _cells(similarity: float):
    def run(rows: Iterator[tuple]) -> Iterable[tuple]:
        for _, own in groupby(rows, key=lambda r: r[:3]):
            yield from cell_links([r[3:] for r in own], similarity)

    return run


def _parts(nodes: Column, size: Column) -> Column:
    return F.greatest(F.lit(1), F.ceil(nodes / CELL_NODES), F.ceil(size / CELL_BYTES)).cast("int").alias("parts")


def _block(parts: str, salt: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(salt), "id"), F.col(parts)).cast("int")


def _with_leaders(large: DataFrame, similarity: float) -> DataFrame:
    """``large`` (group, parts, id, mark, fp, hashes; a written table) with ``leader``, its group's, and ``near``, whether it resembles that."""

    def centres(rows: Iterator[tuple]) -> Iterable[tuple]:
        for group, fps in rows:
            bits = bit_counts(np.frombuffer(b"".join(fps), "<u8").reshape(len(fps), -1)) * 2 > len(fps)
            yield group, np.packbits(bits, bitorder="little").tobytes()

    def distances(rows: Iterator[tuple]) -> Iterable[tuple]:
        for group, node, mark, fp, centre in rows:
            yield group, int(np.bitwise_count(np.frombuffer(fp, "<u8") ^ np.frombuffer(centre, "<u8")).sum()), node, mark

    def compared(rows: Iterator[tuple]) -> Iterable[tuple]:
        for *rest, hashes, leader, other in rows:
            yield *rest, hashes, leader, rest[2] == leader or resemble(np.frombuffer(hashes, "<u8"), np.frombuffer(other, "<u8"), similarity)

    # the sample's size is fixed, so the rank is cut before the shuffle and a group's sample is one small row
    ranked = large.selectExpr("group", "fp", "row_number() OVER (PARTITION BY group ORDER BY xxhash64(3, id), id, mark) AS place").where(F.col("place") <= SAMPLE)
    centre = write_shared(map_rows(ranked.groupBy("group").agg(F.collect_list("fp")), centres, CENTRES), "centres").withColumnRenamed("group", "of")
    far = T.StructType([T.StructField(x, T.LongType()) for x in ("group", "far", "id", "mark")])
    placed = map_rows(large.join(centre, F.col("group") == F.col("of")).select("group", "id", "mark", "fp", "centre"), distances, far)
    first = placed.groupBy("group").agg(F.min(F.struct("far", "id", "mark")).alias("first")).select(F.col("group").alias("of"), F.col("first.id").alias("leader"), F.col("first.mark").alias("leader_mark"))
    own = large.select(F.col("group").alias("in"), F.col("id").alias("at"), F.col("mark").alias("at_mark"), F.col("hashes").alias("leader_hashes"))
    leaders = first.join(own, (F.col("of") == F.col("in")) & (F.col("leader") == F.col("at")) & (F.col("leader_mark") == F.col("at_mark")))
    leaders = write_shared(leaders.select("of", "leader", "leader_hashes"), "leaders")
    schema = T.StructType([*large.schema.fields, T.StructField("leader", T.LongType()), T.StructField("near", T.BooleanType())])
    both = large.join(leaders, F.col("group") == F.col("of")).select(*large.columns, "leader", "leader_hashes")
    return write_shared(map_rows(both, compared, schema, weight=lambda r: len(r[5])), "led")


def exact_links(members: DataFrame, similarity: float) -> DataFrame:
    """Links (a, b) between ids of ``members`` (group, id, mark, fp, hashes; a written table) that make the exact components of each group."""
    spark = members.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    sizes = members.groupBy(F.col("group").alias("of")).agg(F.count("*").alias("nodes"), F.sum(F.octet_length("hashes")).alias("size"))
    sizes = write_shared(sizes.select("of", _parts(F.col("nodes"), F.col("size"))), "group-sizes")
    # a hot group's members are split by adaptive execution: both sides are written tables
    sized = members.join(sizes, F.col("group") == F.col("of")).select("group", "parts", "id", "mark", "fp", "hashes")
    whole = F.lit(True)
    cells = sized.where("parts = 1").select("group", F.lit(0).alias("i"), F.lit(0).alias("j"), "id", F.col("id").alias("component"), whole.alias("probe"), whole.alias("target"), "fp", "hashes")
    links = None
    if sizes.where("parts > 1").limit(1).count():
        led = _with_leaders(write_shared(sized.where("parts > 1"), "large-groups"), similarity)
        links = led.where("near AND id <> leader").select(F.col("leader").alias("a"), F.col("id").alias("b"))
        rest = led.where("NOT near").groupBy(F.col("group").alias("of")).agg(F.count("*").alias("nodes"), F.sum(F.octet_length("hashes")).alias("size"))
        rest = write_shared(rest.select("of", _parts(F.col("nodes"), F.col("size")).alias("open")), "open-sizes")
        opened = led.join(rest, F.col("group") == F.col("of"))
        component = F.when(F.col("near"), F.col("leader")).otherwise(F.col("id")).alias("component")

        def side(rows: DataFrame, i: Column, j: Column, probe: bool) -> DataFrame:
            out = rows.select("*", i.alias("i")).select("*", j.alias("j"))
            return out.select("group", "i", "j", "id", component, F.lit(probe).alias("probe"), F.lit(not probe).alias("target"), "fp", "hashes")

        probes = side(opened.where("NOT near"), _block("open", 5), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)), True)
        targets = side(opened, F.explode(F.sequence(F.lit(0), F.col("open") - 1)), _block("parts", 7), False)
        cells = cells.union(probes).union(targets)
    found = map_rows(cells.repartition(n, "group", "i", "j").sortWithinPartitions("group", "i", "j"), _cells(similarity), LINKS)
    return found if links is None else found.union(links)


def exact_groups(groups: DataFrame, docs: DataFrame, similarity: float, shingle_words: int) -> DataFrame:
    """(id, mark, fp, group) of ``groups`` (the same columns; a written table) with ``group`` the least id of the exact component.

    ``mark`` is xxhash64 of a text of that id in ``docs`` (doc_id, text).  Only texts of groups of two or more are read again.
    """

    def sets_of(rows: Iterator[tuple]) -> Iterable[tuple]:
        for node, mark, text in rows:
            yield node, mark, shingle_set(text, shingle_words).tobytes()

    others = groups.where("group <> id")
    owners = others.select(F.col("group").alias("owner")).distinct()
    members = write_shared(others.unionByName(groups.join(owners, (F.col("id") == F.col("owner")) & (F.col("group") == F.col("id")), "left_semi")), "members")
    wanted = members.select(F.col("id").alias("of"), F.col("mark").alias("of_mark"))
    marked = docs.select("doc_id", F.xxhash64("text").alias("mark"), "text")
    texts = marked.join(wanted, (F.col("doc_id") == F.col("of")) & (F.col("mark") == F.col("of_mark")), "left_semi")
    sets = map_rows(texts, sets_of, SETS, weight=lambda r: len(r[2])).groupBy("id", "mark").agg(F.first("hashes").alias("hashes"))
    sets = sets.withColumnsRenamed({"id": "set_id", "mark": "set_mark"})
    full = members.join(sets, (F.col("id") == F.col("set_id")) & (F.col("mark") == F.col("set_mark"))).select("group", "id", "mark", "fp", "hashes")
    named = connected_components(exact_links(write_shared(full, "member-sets"), similarity)).select(F.col("node").alias("was"), F.col("component").alias("now"))
    joined = groups.join(named, F.col("id") == F.col("was"), "left")
    return joined.select("id", "mark", "fp", F.coalesce("now", "id").alias("group"))
