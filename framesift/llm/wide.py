"""Near-duplicate groups at a word-shingle similarity of 0.8, from wide SimHash fingerprints.

Three of 64 bits are a far stricter likeness than a resemblance of 0.8 between sets of five-word shingles.  For
that the same method runs on 2048 bits: the share of differing bits d gives the cosine cos(pi d) of the
two shingle sets and with it the resemblance c / (2 - c), to about 0.01.  The limit of differing bits lies ``SLACK``
standard deviations above the expected number at the similarity, so that a pair just at it passes with probability 0.9.

256 byte positions are indexed in lists, each keyed by the bytes at ``width`` random positions: three, and one more
whenever the nodes outgrow ``NODES_A_KEY`` for each possible key.  There are so many lists that a pair at the similarity meets in one
with probability ``MEETS`` (171 lists of three bytes) whatever the width; a pair at 0.85 does with 0.998, and exact copies always.  Pairs
that meet are tallied over all 256 positions, kept from the least number of equal bytes on that any pair within the
limit has (five standard deviations below its mean: no smaller number is guaranteed, as more bits may differ than there are
bytes), and verified bit by bit.  That makes likely groups; in them ``resemblance`` compares the sets of shingles themselves, so that
documents are only joined by pairs whose resemblance is the one asked for.

The lists are read in two rounds.  What the first ``1 / FIRST_SHARE`` of them links is one group; in the others, nodes of one group are
never compared or linked again and lists of one group only are passed over, so a large group of near copies costs a few
links a node, not one for every list.

Lists of two give a pair, which is verified by a join with the fingerprints.  For longer lists the
fingerprints come to the list: its medoid (the node nearest to the list's majority bits) is linked to every node it
matches, which makes those one component, and only nodes that it does not match are compared with all.  That
finds exactly the list's components, gives at most one link less than its nodes, and takes time linear in a
group of near copies.  A list is read in parts of ``LIST_NODES``.  Nodes of all parts that match the first part's
medoid are one component; every other node is compared with the nodes of all other parts, in blocks, unless both are
linked already or their distances from that medoid differ by more than the limit (the triangle inequality).  So a list
of several parts is exact too; earlier parts' fingerprints wait in an unnamed scratch file, and ids, roots and
distances take 18 bytes a node in memory.

Defined results: blank and null texts form one group; texts of fewer than five words have one shingle; rows that
repeat a doc_id are one document, of which every row is dropped or kept alike; rows with a null doc_id are never dropped; ties go to the
smallest doc_id; other columns are carried whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import tempfile
from collections.abc import Iterable, Iterator
from itertools import groupby, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from framesift.llm.arrow import map_rows
from framesift.llm.resemblance import exact_groups, shingle_set
from framesift.llm.simhash import _runs, bit_counts, shared_bytes
from framesift.llm.words import MIX, mixed
from framesift.plans.graph import connected_components
from framesift.plans.shared import write_shared

SHINGLE_WORDS = 5
LANES = 32
SIMILARITY = 0.8
SLACK = 1.3
MEETS = 0.965
NODES_A_KEY = 64
FIRST_SHARE = 7
#: Shingles hashed at once.
CHUNK = 4096
LIST_NODES = 65_536
#: Bits compared at once, in 64-bit words.
CELL_WORDS = 1 << 20

PRINTS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("mark", T.LongType()), T.StructField("fp", T.BinaryType())])
INDEX = T.StructType([T.StructField("key", T.LongType()), T.StructField("id", T.LongType()), T.StructField("group", T.LongType())])
#: A pair (id, other), or a node of a longer list (key, id).
FOUND = T.StructType([T.StructField("key", T.LongType()), T.StructField("id", T.LongType()), T.StructField("other", T.LongType())])
LINKS = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])


def wide_fingerprint(text: str | None, shingle_words: int = SHINGLE_WORDS, lanes: int = LANES) -> bytes:
    """64·lanes majority bits over the distinct shingles' hashes."""
    hashes = shingle_set(text, shingle_words)
    if not len(hashes):
        return bytes(8 * lanes)
    totals = np.zeros(64 * lanes, np.int64)
    with np.errstate(over="ignore"):
        steps = np.arange(1, lanes + 1, dtype=np.uint64) * MIX
        for at in range(0, len(hashes), CHUNK):
            totals += bit_counts(mixed(hashes[at : at + CHUNK, None] + steps))
    return np.packbits(totals * 2 > len(hashes), bitorder="little").tobytes()


def differing_share(similarity: float) -> float:
    """The expected share of differing bits of two texts of that resemblance."""
    return math.acos(2 * similarity / (1 + similarity)) / math.pi


def most_bits(similarity: float, bits: int, slack: float = SLACK) -> int:
    """The number of differing bits up to which two fingerprints stand for ``similarity``."""
    d = differing_share(similarity)
    return int(bits * d + slack * math.sqrt(bits * d * (1 - d)))


def least_bytes(most: int, bits: int) -> int:
    """The number of equal bytes that any two fingerprints with ``most`` differing bits have."""
    share = (1 - most / bits) ** 8
    return max(0, math.floor(bits / 8 * share - 5 * math.sqrt(bits / 8 * share * (1 - share))))


def list_width(nodes: int) -> int:
    width = 3
    while nodes > NODES_A_KEY << 8 * width:
        width += 1
    return width


def list_positions(size: int, width: int, similarity: float, meets: float = MEETS) -> np.ndarray:
    """The byte positions of each list: random permutations, cut into pieces of ``width``."""
    share = (1 - differing_share(similarity)) ** (8 * width)
    lists, pieces = math.ceil(math.log(1 - meets) / math.log(1 - share)), size // width
    draw = np.random.default_rng(width)
    dealt = [draw.permutation(size)[: pieces * width].reshape(pieces, width) for _ in range(-(-lists // pieces))]
    return np.concatenate(dealt)[:lists]


def _index(positions: np.ndarray, first: int):
    """(key, id, group) of every list a node belongs to; the key is the list's number, from ``first`` on, and its bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = to_arrow_schema(INDEX)
        n, width = positions.shape
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                b = np.frombuffer(b"".join(part.column(1).to_pylist()), np.uint8).reshape(part.num_rows, -1)
                keys = np.broadcast_to(np.arange(first, first + n), (part.num_rows, n)).astype(np.int64)
                for k in range(width):
                    keys = keys << 8 | b[:, positions[:, k]]
                ids, groups = (np.repeat(part.column(i).to_numpy(), n) for i in (0, 2))
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(ids), pa.array(groups)], schema=schema)

    return run


def _lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs and longer lists of the sorted index; lists of one node or of one group go."""
    schema = to_arrow_schema(FOUND)

    def batch(key, node, other) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (key, node, other)], schema=schema)

    for key, starts, node, group in _runs(batches):
        sizes = np.diff(np.r_[starts, len(key)])
        mixed_groups = np.minimum.reduceat(group, starts) != np.maximum.reduceat(group, starts)
        two = starts[(sizes == 2) & mixed_groups]
        if len(two):
            yield batch([None] * len(two), np.minimum(node[two], node[two + 1]), np.maximum(node[two], node[two + 1]))
        longer = np.repeat((sizes > 2) & mixed_groups, sizes)
        if longer.any():
            yield batch(key[longer], node[longer], [None] * int(longer.sum()))


def alike(x: np.ndarray, y: np.ndarray, most: int) -> np.ndarray:
    """Which fingerprints (rows of 64-bit words, broadcast) share enough bytes and differ in few enough bits."""
    diff = x ^ y
    good = shared_bytes(diff).sum(axis=-1, dtype=np.int64) >= least_bytes(most, 64 * diff.shape[-1])
    if good.any():
        good[good] = np.bitwise_count(diff[good]).sum(axis=-1, dtype=np.int64) <= most
    return good


def list_links(groups: np.ndarray, fps: np.ndarray, most: int) -> tuple[list[tuple[int, int]], int]:
    """One list's components as links from their least group, and the place of the list's medoid; nodes of equal group are linked already."""
    n = len(groups)
    names, labels = np.unique(groups, return_inverse=True)
    majority = np.packbits(bit_counts(fps) * 2 > n, bitorder="little").view("<u8")
    medoid = int(np.bitwise_count(fps ^ majority).sum(axis=1, dtype=np.int64).argmin())
    near = alike(fps, fps[medoid], most)
    near[medoid] = True
    up, touched = np.arange(len(names)), np.unique(labels[near])
    up[touched] = touched[0]
    labels = up[labels]
    rest = np.flatnonzero(labels != labels[medoid])
    step = max(1, CELL_WORDS // (n * fps.shape[1]))
    for at in range(0, len(rest), step):
        part = rest[at : at + step]
        hits = alike(fps[part][:, None, :], fps[None, :, :], most)
        for u, row in zip(part.tolist(), hits, strict=True):
            for label in np.unique(labels[row]).tolist():
                own = int(labels[u])
                if label != own:
                    labels[labels == max(label, own)] = min(label, own)
    other = names[labels] != groups
    return [tuple(x) for x in np.unique(np.stack([names[labels][other], groups[other]], axis=1), axis=0).tolist()], medoid


def _roots(parent: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The roots of some nodes, which then point at them."""
    root = parent[at]
    while (root != parent[root]).any():
        root = parent[root]
    parent[at] = root
    return root


def _join(parent: np.ndarray, x: np.ndarray, y: np.ndarray) -> None:
    """Make each x and its y one component; the least place is the root."""
    pairs = np.unique(np.stack([_roots(parent, x), _roots(parent, y)], axis=1), axis=0)
    for a, b in pairs[pairs[:, 0] != pairs[:, 1]].tolist():
        while a != parent[a]:
            a = int(parent[a])
        while b != parent[b]:
            b = int(parent[b])
        parent[max(a, b)] = min(a, b)


def _join_alike(parent: np.ndarray, far: np.ndarray, rows: np.ndarray, x: np.ndarray, columns: np.ndarray, y: np.ndarray, most: int) -> None:
    """Join the nodes ``rows`` (fingerprints x) with all of ``columns`` (y) that are alike, ``far`` from one leader."""
    order = np.argsort(_roots(parent, rows), kind="stable")  # once two components are joined, the rest of them is passed over
    rows, x = rows[order], x[order]
    at = 0
    while at < len(rows) and len(columns):
        step = max(1, CELL_WORDS // (len(columns) * x.shape[1]))
        own = rows[at : at + step]
        roots = _roots(parent, own)
        open_ = (far[columns] >= int(far[own].min()) - most) & (far[columns] <= int(far[own].max()) + most)
        if (roots == roots[0]).all():
            open_ &= _roots(parent, columns) != roots[0]
        left = np.flatnonzero(open_)
        if len(left):
            u, v = np.nonzero(alike(x[at : at + step][:, None, :], y[left][None, :, :], most))
            if len(u):
                _join(parent, own[u], columns[left[v]])
        at += step


def long_list_links(parts: Iterable[tuple[np.ndarray, np.ndarray]], most: int) -> Iterator[tuple[int, int]]:
    """The components of a list that comes in parts (groups, fingerprints), as links between its groups."""
    ids, parent, far = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int16)
    leader = None
    earlier: list[tuple[int, int, np.ndarray]] = []  # begin, end, places that do not match the leader
    seen: dict[int, int] = {}  # a place of each group
    with tempfile.TemporaryFile() as held:
        for groups, fps in parts:
            low, high = len(ids), len(ids) + len(groups)
            places = np.arange(low, high)
            names, at, own = np.unique(groups, return_index=True, return_inverse=True)
            links, medoid = list_links(low + at[own], fps, most)
            if leader is None:
                leader, leader_place = fps[medoid].copy(), medoid
            ids, parent = np.r_[ids, groups], np.r_[parent, low + at[own]]
            far = np.r_[far, np.bitwise_count(fps ^ leader).sum(axis=1, dtype=np.int16)]
            again = [(low + int(p), seen.setdefault(g, low + int(p))) for g, p in zip(names.tolist(), at, strict=True)]
            for pairs in (links, again):
                if pairs:
                    _join(parent, *np.array(pairs).T)
            near = alike(fps, leader, most)
            _join(parent, places[near], np.full(int(near.sum()), leader_place))
            rest = places[~near]
            for begin, end, others in earlier:
                if len(rest) or len(others):
                    held.seek(begin * fps.shape[1] * 8)
                    before = np.frombuffer(held.read((end - begin) * fps.shape[1] * 8), "<u8").reshape(end - begin, -1)
                    _join_alike(parent, far, rest, fps[~near], np.arange(begin, end), before, most)
                    _join_alike(parent, far, others, before[others - begin], places[near], fps[near], most)
            held.seek(low * fps.shape[1] * 8)
            held.write(np.ascontiguousarray(fps).tobytes())
            earlier.append((low, high, rest))
    for low, high, _ in earlier:
        first = ids[_roots(parent, np.arange(low, high))]
        other = first != ids[low:high]
        yield from (tuple(x) for x in np.unique(np.stack([first[other], ids[low:high][other]], axis=1), axis=0).tolist())


def _search_lists(most: int):
    """Links between groups from the sorted rows (key, id, fp, group) of whole lists."""

    def arrays(part: list[tuple]) -> tuple[np.ndarray, np.ndarray]:
        return np.array([r[3] for r in part], np.int64), np.frombuffer(b"".join(r[2] for r in part), "<u8").reshape(len(part), -1)

    def all_parts(part: list[tuple], own: Iterator[tuple]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        while part:
            yield arrays(part)
            part = list(islice(own, LIST_NODES))

    def run(rows: Iterator[tuple]) -> Iterable[tuple]:
        for _, own in groupby(rows, key=lambda r: r[0]):
            part = list(islice(own, LIST_NODES))
            yield from list_links(*arrays(part), most)[0] if len(part) < LIST_NODES else long_list_links(all_parts(part, own), most)

    return run


def _verify(most: int):
    def run(rows: Iterator[tuple]) -> Iterable[tuple]:
        for a, b, x, y in rows:
            if alike(np.frombuffer(x, "<u8")[None, :], np.frombuffer(y, "<u8"), most)[0]:
                yield a, b

    return run


def _links(nodes: DataFrame, positions: np.ndarray, first: int, most: int) -> DataFrame:
    """Links between the groups of ``nodes`` (id, fp, group; a written table) in some of the lists."""
    n = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    index = nodes.select("id", "fp", "group").mapInArrow(_index(positions, first), INDEX)
    found = write_shared(index.repartition(n, "key").sortWithinPartitions("key", "id").mapInArrow(_lists, FOUND), "lists")
    a = nodes.select(F.col("id").alias("a_id"), F.col("fp").alias("a_fp"), F.col("group").alias("a_group"))
    b = nodes.select(F.col("id").alias("b_id"), F.col("fp").alias("b_fp"), F.col("group").alias("b_group"))
    pairs = write_shared(found.where("other IS NOT NULL").select("id", "other").distinct(), "pairs")
    both = pairs.join(a, F.col("id") == F.col("a_id")).join(b, F.col("other") == F.col("b_id")).select("a_group", "b_group", "a_fp", "b_fp")
    lists = found.where("other IS NULL").select("key", "id").join(a, F.col("id") == F.col("a_id")).select("key", "id", "a_fp", "a_group")
    lists = lists.repartition(n, "key").sortWithinPartitions("key", "id")
    return map_rows(both, _verify(most), LINKS).union(map_rows(lists, _search_lists(most), LINKS))


def near_groups(nodes: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(id, fp, group) of the distinct fingerprints (id, fp) of ``nodes`` (a written table); ``group`` is the least id of the group."""
    bits = 64 * LANES
    positions = list_positions(bits // 8, list_width(nodes.count()), similarity)
    cut = -(-len(positions) // FIRST_SHARE)
    grouped = nodes.withColumn("group", F.col("id"))
    for low, high in ((0, cut), (cut, len(positions))):
        links = _links(grouped, positions[low:high], low, most_bits(similarity, bits))
        named = connected_components(links).select(F.col("node").alias("was"), F.col("component").alias("now"))
        joined = grouped.join(named, F.col("group") == F.col("was"), "left")
        grouped = write_shared(joined.select("id", "fp", F.coalesce("now", "group").alias("group")), "near-groups")
    return grouped


def near_duplicate_ids(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(doc_id, kept_id) of every document that a near-duplicate with a smaller doc_id stands for."""

    def prints_of(rows: Iterator[tuple]) -> Iterable[tuple]:
        return ((doc_id, mark, wide_fingerprint(text)) for doc_id, mark, text in rows)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id IS NOT NULL")
    prints = write_shared(map_rows(rows.select("doc_id", F.xxhash64("text"), "text"), prints_of, PRINTS), "wide-prints")
    first = prints.groupBy("fp").agg(F.min(F.struct("doc_id", "mark")).alias("first"))
    nodes = write_shared(first.select(F.col("first.doc_id").alias("id"), "first.mark", "fp"), "wide-nodes")
    found = near_groups(nodes.select("id", "fp"), similarity).select(F.col("fp").alias("node_fp"), "group")
    groups = write_shared(nodes.join(found, F.col("fp") == F.col("node_fp")).select("id", "mark", "fp", "group"), "likely-groups")
    owners = exact_groups(groups, rows, similarity, SHINGLE_WORDS).select(F.col("fp").alias("node_fp"), F.col("group").alias("kept_id"))
    return prints.join(owners, prints["fp"] == owners["node_fp"]).where("doc_id <> kept_id").select("doc_id", "kept_id").distinct()


def without_near_duplicates(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """``docs`` with one document (the smallest doc_id) of each near-duplicate group; columns stay as they are."""
    dropped = write_shared(near_duplicate_ids(docs, similarity).select(F.col("doc_id").alias("_dropped")), "dropped")
    # the dropped ids grow with the documents, so they are never broadcast
    return docs.join(dropped.hint("merge"), docs["doc_id"].cast("long") == F.col("_dropped"), "left_anti")
