"""Queries of the operators over the given tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from framesift.llm.licenses import license_scan_sql

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def packed_digests(pieces: DataFrame) -> DataFrame:
    """The columns of packed pieces, with a checksum in place of the ids."""
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "bucket")


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from framesift.llm.packing import pack_power_of_two

    return packed_digests(pack_power_of_two(table(spark, sf_dir, "documents"), tokenizer_path()))


def op1_arc_to_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from framesift.llm.archives import pages_through_archives

    records = pages_through_archives(table(spark, sf_dir, "pages")).where("record_type IN ('response', 'revisit')")
    return records.select(
        F.col("id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to_id").alias("refers_to"), "record_id", "url", "date"
    )


def op2_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    from framesift.llm.personal import KINDS, LABELS, fit, personal_spans

    docs = table(spark, sf_dir, "documents")
    found = personal_spans(docs, fit(docs))

    def count(kind: str):
        return F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")

    def joined(spans):
        return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")

    rank = F.array(*[F.lit(k) for k in LABELS])
    ordered = F.transform(
        F.array_sort(F.transform(F.concat("base", "added"), lambda x: F.struct(F.array_position(rank, x["kind"]).alias("rank"), x["start"].alias("start"), x["end"].alias("end"), x["kind"].alias("kind")))),
        lambda x: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end")),
    )
    return found.select("doc_id", *[count(k) for k in KINDS], F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(ordered).alias("spans"))


def op3_bottom_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    from framesift.llm.sketches import sketch_neighbours

    return sketch_neighbours(table(spark, sf_dir, "documents"))


def fold(of: int = 5):
    """crc32(doc_id as text) mod ``of``; null for a null doc_id."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % of


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from framesift.llm.toxicity import toxicity

    scored = toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), fold() != 0)
    held_out = F.coalesce(fold() == 0, F.lit(False)).alias("held_out")
    return scored.select("doc_id", held_out, "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op5_backoff_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    from framesift.llm.backoff import backoff_scores

    scored = backoff_scores(table(spark, sf_dir, "documents"), fold() != 1)
    held_out = F.coalesce(fold() == 1, F.lit(False)).alias("held_out")
    return scored.select("doc_id", held_out, "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from framesift.llm.decontaminate import find_leaks

    leaks = find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return leaks.select("doc_id", "item_id", "score", "start", "end", "n_seeds")


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from framesift.llm.quality import quality

    found = quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return found.select("doc_id", "evidence", "host_rate", "path_rate", "quality", F.col("keep").cast("int").alias("keep"))


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    from framesift.llm.licenses import license_scan

    return license_scan(table(spark, sf_dir, "documents"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from framesift.llm.simhash import simhash_components

    found = simhash_components(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from framesift.llm.lexical import ranked

    return ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


RANKED_SQL = r"""WITH
  found AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents),
  asked AS (SELECT item_id, term, count(*) AS times FROM (SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark) GROUP BY ALL),
  docs AS (SELECT doc_id, count(*) AS n FROM found GROUP BY doc_id),
  whole AS (SELECT count(*) AS documents, sum(n)::bigint AS length FROM docs),
  lengths AS (SELECT doc_id, 75 + (25 * n * documents) // length AS m FROM docs, whole),
  counts AS (SELECT doc_id, term, count(*) AS tf FROM found WHERE term IN (SELECT term FROM asked) GROUP BY ALL),
  weights AS (SELECT term, floor(1000 * ln((2 * documents + 2)::double / (2 * count(*) + 1)::double))::bigint AS w FROM counts, whole GROUP BY term, documents),
  scores AS (SELECT item_id, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * m)))::bigint AS score
    FROM counts JOIN lengths USING (doc_id) JOIN weights USING (term) JOIN asked USING (term) GROUP BY ALL)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::int AS rank, doc_id, score FROM scores WHERE score > 0 QUALIFY rank <= 20"""


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    from framesift.llm.merkle import manifest

    docs = table(spark, sf_dir, "documents")
    even = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    found = F.when(even, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    return manifest(docs, ["doc_id", "source", "lang", "n_chars", "text"], "source", "doc_id", {"text": found})


def op12_decision_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    from framesift.llm.rules import COUNTS, quality_rules

    found = quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return found.select("doc_id", *COUNTS, "base_failed", "kept", "rule")


#: Levels by a recursive grouping; proofs by the runs that hold each leaf's ancestors; CRC32 bit by bit.
MERKLE_SQL = """WITH RECURSIVE
  fields AS (SELECT doc_id, source, text, concat(strlen(doc_id::varchar), ':', doc_id, coalesce(concat(strlen(source), ':', source), '-'), coalesce(concat(strlen(lang), ':', lang), '-'),
      coalesce(concat(strlen(n_chars::varchar), ':', n_chars), '-')) AS head,
    list_reduce(list_prepend(4294967295::bigint, list_transform(string_split(doc_id::varchar, ''), lambda x: ascii(x)::bigint)), lambda c, b:
      list_reduce(list_prepend(xor(c, b), range(8)), lambda x, i: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)) AS crc FROM documents),
  leaves AS (SELECT doc_id, source, sha256(concat(head, coalesce(concat(strlen(text), ':', text), '-'))) AS leaf,
    sha256(concat(head, coalesce(concat(strlen(now), ':', now), '-'))) AS found FROM (SELECT *, CASE WHEN crc & 1 = 1 THEN replace(text, chr(10), '') ELSE text END AS now FROM fields)),
  placed AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS pos, count(*) OVER (PARTITION BY source) AS n FROM leaves),
  low(level, source, pos, n, digest) AS (SELECT 0, source, pos, n, leaf FROM placed UNION ALL
    SELECT level + 1, source, pos // 3, (n + 2) // 3, sha256(string_agg(digest, '' ORDER BY pos)) FROM low WHERE n > 1 GROUP BY level, source, pos // 3, n),
  heads AS (SELECT source, level AS height, digest AS subroot, row_number() OVER (ORDER BY encode(source) NULLS FIRST) - 1 AS pos, count(*) OVER () AS n FROM low WHERE n = 1),
  high(level, pos, n, digest) AS (SELECT 0, pos, n, subroot FROM heads UNION ALL
    SELECT level + 1, pos // 3, (n + 2) // 3, sha256(string_agg(digest, '' ORDER BY pos)) FROM high WHERE n > 1 GROUP BY level, pos // 3, n),
  runs AS (SELECT level, source, pos // 3 AS run, list(digest ORDER BY pos) AS nodes FROM low WHERE n > 1 GROUP BY ALL),
  upper_runs AS (SELECT level, pos // 3 AS run, list(digest ORDER BY pos) AS nodes FROM high WHERE n > 1 GROUP BY ALL),
  steps AS (SELECT p.doc_id, r.level, p.pos // (3 ** r.level)::bigint % 3 AS slot, r.nodes FROM placed p JOIN runs r ON p.source IS NOT DISTINCT FROM r.source AND p.pos // (3 ** (r.level + 1))::bigint = r.run
    UNION ALL SELECT p.doc_id, h.height + r.level, h.pos // (3 ** r.level)::bigint % 3, r.nodes FROM placed p JOIN heads h ON p.source IS NOT DISTINCT FROM h.source JOIN upper_runs r ON h.pos // (3 ** (r.level + 1))::bigint = r.run),
  proofs AS (SELECT doc_id, list({'l': array_to_string(nodes[:slot], ''), 'r': array_to_string(nodes[slot + 2:], '')} ORDER BY level) AS path FROM steps GROUP BY doc_id),
  told AS (SELECT p.doc_id, p.leaf, h.subroot, (SELECT digest FROM high WHERE n = 1) AS root, sha256(array_to_string(list_transform(coalesce(path, []), lambda x: concat(x.l, x.r)), '')) AS proof_sha256,
    list_reduce(list_prepend({'l': p.found, 'r': ''}, coalesce(path, [])), lambda a, x: {'l': sha256(concat(x.l, a.l, x.r)), 'r': ''}).l AS folded_root
    FROM placed p JOIN heads h ON p.source IS NOT DISTINCT FROM h.source LEFT JOIN proofs USING (doc_id))
SELECT *, folded_root = root AS verified FROM told"""


QUERIES: dict[str, Query] = {
    "op1_arc_to_warc": op1_arc_to_warc,
    "op2_personal_data": op2_personal_data,
    "op3_bottom_k": op3_bottom_k,
    "op4_toxicity": op4_toxicity,
    "op5_backoff_lm": op5_backoff_lm,
    "op6_decontamination": op6_decontamination,
    "op7_quality": op7_quality,
    "op8_licenses": op8_licenses,
    "op9_simhash": op9_simhash,
    "op10_packing": op10_packing,
    "op11_ranked_search": op11_ranked_search,
    "op12_decision_list": op12_decision_list,
    "op13_merkle": op13_merkle,
}

ORACLE: dict[str, str] = {
    "op8_licenses": license_scan_sql(),
    "op11_ranked_search": RANKED_SQL,
    "op13_merkle": MERKLE_SQL,
}
