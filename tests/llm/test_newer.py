"""Ranked search, decision lists and the Merkle manifest against brute force, and on awkward rows."""

import hashlib
import math
import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F
from test_documents import docs, labels, none, rows  # noqa: F401

# ranked search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def plain_ranking(documents, items, k=20):
    counts = [(d, Counter(terms(t))) for d, t in documents]
    counts = [(d, c) for d, c in counts if c]
    n, length = len(counts), sum(sum(c.values()) for _, c in counts)
    df = Counter(w for _, c in counts for w in c)
    out = []
    for item, text in items:
        asked, found = Counter(terms(text)), []
        for d, c in counts:
            m = 75 + 25 * sum(c.values()) * n // length
            score = sum(times * math.floor(1000 * math.log((2 * n + 2) / (2 * df[w] + 1))) * (10**9 * c[w] // (1000 * c[w] + 12 * m)) for w, times in asked.items() if w in c)
            if score:
                found.append((-score, d is None, d or 0, d))
        out += [(item, rank, d, -s) for rank, (s, _, _, d) in enumerate(sorted(found)[:k], 1)]
    return sorted(out, key=str)


ITEMS = [(1, "sun3 MOON4 rain-12 lake7, lake7"), (2, None), (3, ""), (4, "nothing that occurs"), (5, "Ünï çödé 日本語"), (6, "alpha beta one"), (7, "sun1 " * 50), (1, "sun3 MOON4 rain-12 lake7, lake7"), (None, "fire2 fire3"), (8, "id here wind0 wind1 wind2 wind3 wind4 wind5 wind6 wind7 wind8 wind9")]


@pytest.mark.parametrize("block_terms", [200_000, 5])
def test_search_equals_brute_force(spark, docs, rows, block_terms):  # noqa: F811
    from framesift.llm.lexical import build_index, search

    items = spark.createDataFrame(ITEMS, "item_id long, text string").withColumn("score", F.lit("x"))
    found = search(build_index(docs), items, 5, block_terms)
    want = plain_ranking([(r[0], r[1]) for r in rows], list(dict.fromkeys(ITEMS)), 5)
    assert sorted(map(tuple, found.collect()), key=str) == want
    assert found.columns == ["item_id", "rank", "doc_id", "score"]


def test_search_of_nothing(spark, docs, none):  # noqa: F811
    from framesift.llm.lexical import ranked

    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert ranked(none, items).count() == 0
    assert ranked(docs, items.limit(0)).count() == 0
    assert ranked(docs, items.where("item_id IN (2, 3, 4)")).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.sampled_from("a b c d e f g h i j k l m n".split()), min_size=1, max_size=400), min_size=1, max_size=6))
def test_bounds_are_never_below_scores(texts):
    from framesift.llm.lexical import Block, Bounds, Hashes, fold

    counts = [Counter(w.encode() for w in t) for t in texts]
    df = dict(Counter(w for c in counts for w in c))
    block = Block([(i, c) for i, c in enumerate(counts)], df, len(texts), sum(map(len, texts)))
    bounds = Bounds(block)
    for c in counts:
        many = np.array(list(c.values()), np.uint32)
        exact = block.exact(int(many.sum()), b" ".join(c), many.astype("<u4").tobytes())
        assert (bounds(int(many.sum()), fold(Hashes()(c), many).tobytes()) >= exact).all()


def test_few_documents_are_rescored():
    from framesift.llm.lexical import Best, Block, Bounds, Hashes, fold, rescore

    r = np.random.default_rng(1)
    texts = [Counter(f"w{int(x)}".encode() for x in r.zipf(1.3, 120) if x < 5000) for _ in range(3000)]
    df = Counter(w for c in texts for w in c)
    items = [(i, texts[i]) for i in range(0, 3000, 600)]
    asked = {w: df[w] for _, c in items for w in c}
    block = Block(items, asked, len(texts), sum(sum(c.values()) for c in texts))
    best, bounds, scored = Best(len(items), 5), Bounds(block), 0
    for at in range(0, 3000, 500):
        batch = []
        for i in range(at, at + 500):
            many = np.array(list(texts[i].values()), np.uint32)
            batch.append((i, int(many.sum()), fold(Hashes()(texts[i]), many).tobytes(), b" ".join(texts[i]), many.astype("<u4").tobytes()))
        scored += rescore(batch, block, bounds, best)
    assert scored < 1500
    assert [max(heap)[2] for heap in best.heaps] == [-i for i, _ in items]  # every item finds itself


# decision lists


def plain_counts(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
    often = Counter(windows)
    inside = {j for i, x in enumerate(windows) if often[x] > 1 for j in range(i, i + 8)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(inside)


@settings(max_examples=300, deadline=None)
@given(st.one_of(st.text(), st.text(alphabet="ab \n#| é"), st.lists(st.sampled_from(["a", "b"]), max_size=60).map(" ".join), st.lists(st.sampled_from("abcdefgh\n"), max_size=60).map(" ".join)))
def test_counts(text):
    from framesift.llm.rules import COUNTS, SHARES, statistics

    found = statistics(text)
    assert found[: len(COUNTS)] == plain_counts(text)
    assert len(found) == len(COUNTS) + len(SHARES)


def test_rules_are_learned_and_written_out(spark):
    from framesift.llm.rules import FEATURES, base_failed, covered, fit, judged, learn, verdict_sql

    r = np.random.default_rng(3)
    x = r.random((3000, len(FEATURES)))
    x[:, 0] = r.integers(20, 400, 3000)
    bad = (x[:, 2] > 0.9) | ((x[:, 3] > 0.7) & (x[:, 5] <= 0.2))
    rules = learn(x, bad, np.arange(3000) % 3 != 0)
    found = np.zeros(3000, bool)
    for rule in rules:
        found |= covered(x, rule.conditions)
    assert (found == bad).mean() > 0.98
    assert {c.feature for rule in rules for c in rule.conditions} <= {FEATURES[i] for i in (2, 3, 5)}
    data = [(i, int(a[0]), *map(int, (100, 0, 0, 0)), *map(float, a[1:])) for i, a in enumerate(x)]
    from framesift.llm.rules import STATISTICS

    stats = spark.createDataFrame(data, STATISTICS)
    told = judged(stats, rules).withColumn("by_sql", F.expr(verdict_sql(rules))).orderBy("doc_id").collect()
    first = [next((k for k, rule in enumerate(rules, 1) if covered(a[None], rule.conditions)[0]), 0) for a in x]
    assert [row["rule"] for row in told] == first == [row["by_sql"] for row in told]
    assert [row["kept"] for row in told] == [k == 0 for k in first]
    marked = spark.createDataFrame([(i, int(not b)) for i, b in enumerate(bad)] + [(None, 0), (5, None)], "doc_id long, quality int")
    again = fit(stats.union(stats.where("doc_id = 7")).union(stats.where("doc_id = 7")), marked)
    assert len(again) >= 2
    assert judged(stats.where(~base_failed()), again).where("kept").count() == pytest.approx((~bad).sum(), rel=0.02)


def test_noise_gives_no_rule():
    from framesift.llm.rules import FEATURES, learn

    r = np.random.default_rng(5)
    assert learn(r.random((2000, len(FEATURES))), r.random(2000) < 0.1, np.arange(2000) % 3 != 0) == []


def test_decision_list_of_awkward_rows(docs, rows, none, labels):  # noqa: F811
    from framesift.llm.rules import COUNTS, quality_rules

    found = quality_rules(docs, labels)
    want = Counter((r[0], *plain_counts(r[1])) for r in rows)
    assert Counter((r["doc_id"], *(r[c] for c in COUNTS)) for r in found.collect()) == want
    assert found.where("kept AND base_failed").count() == 0
    assert found.where("base_failed <> (n_words < 20 OR 100 * n_repeat_words > 30 * n_words)").count() == 0
    assert quality_rules(none, labels).count() == 0
    alone = quality_rules(docs, labels.limit(0))
    assert alone.where("rule <> 0 OR kept = base_failed").count() == 0


# Merkle manifest


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_leaf(values):
    return digest(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def plain_tree(level, arity):
    levels = [level]
    while len(level) > 1:
        level = [digest(*level[i : i + arity]) for i in range(0, len(level), arity)]
        levels.append(level)
    return levels


def plain_path(levels, at, arity):
    out = []
    for level in levels[:-1]:
        run = at - at % arity
        out.append((level[run:at], level[at + 1 : run + arity]))
        at //= arity
    return out


def plain_manifest(data, now, arity):
    """Rows of (doc_id, text, lang, source); ``now`` gives the text found."""
    groups = {}
    for doc_id, text, lang, source in data:
        leaf, found = plain_leaf((doc_id, source, lang, text)), plain_leaf((doc_id, source, lang, now(doc_id, text)))
        groups.setdefault(source, []).append((doc_id is not None, doc_id or 0, leaf, found))
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    for g in groups.values():
        g.sort()
    trees = {s: plain_tree([x[2] for x in groups[s]], arity) for s in order}
    top = plain_tree([trees[s][-1][0] for s in order], arity)
    out = []
    for k, s in enumerate(order):
        for i, (known, doc_id, leaf, found) in enumerate(groups[s]):
            path = plain_path(trees[s], i, arity) + plain_path(top, k, arity)
            for left, right in path:
                found = digest(*left, found, *right)
            out.append((doc_id if known else None, leaf, trees[s][-1][0], top[-1][0], digest(*(x for a, b in path for x in a + b)), found, found == top[-1][0]))
    return sorted(out, key=str)


@pytest.mark.parametrize("arity", [2, 3, 4])
def test_manifest_equals_brute_force(spark, docs, rows, arity):  # noqa: F811
    from framesift.llm.merkle import manifest

    changed = F.when(F.col("doc_id") % 5 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text"))
    found = manifest(docs, ["doc_id", "source", "lang", "text"], "source", "doc_id", {"text": changed}, arity)
    want = plain_manifest(rows, lambda d, t: t + "!" if d is not None and d % 5 == 0 and t is not None else t, arity)
    assert sorted(map(tuple, found.collect()), key=str) == want
    assert found.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


def test_manifest_of_small_tables(spark, docs, none):  # noqa: F811
    from framesift.llm.merkle import manifest

    fields = ["doc_id", "source", "lang", "text"]
    assert manifest(none, fields, "source", "doc_id").count() == 0
    one = manifest(docs.where("doc_id = 2"), fields, "source", "doc_id").first()
    assert one["leaf"] == one["subroot"] == one["root"] == one["folded_root"] and one["verified"]
    assert one["proof_sha256"] == digest()
    equal = spark.createDataFrame([(1, "same")] * 10, "doc_id long, text string").withColumn("source", F.lit(None).cast("string"))
    assert manifest(equal, ["doc_id", "text"], "source", "doc_id").where("verified").count() == 10
