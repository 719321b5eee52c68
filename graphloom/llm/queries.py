"""The queries that apply each operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import ann, decontamination, licenses, line_dedup, lm_scoring, packing, quality, sharding, simhash, token_counts
from .common import table

VOCABULARY = "byte_bpe_50k.json"


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of all documents by the vocabulary of ``VOCABULARY``; see ``token_counts.token_counts``."""
    return token_counts.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY), 1024)


def op2_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target: documents labelled as of good quality."""
    good = table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    return lm_scoring.cross_entropy_difference(table(spark, sf_dir, "documents"), good)


def op3_ann_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest of every vector whose id 20 divides; see ``ann.nearest`` for ties, odd vectors and repeated ids."""
    return ann.nearest(table(spark, sf_dir, "embeddings"), 20, 20)


def op4_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints, links and components of all documents; see ``simhash.near_duplicates``."""
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that are kept."""
    judged = quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return judged.where("keep").select("doc_id", "lang", "n_chars", "perplexity", "threshold")


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that hold benchmark passages, with these."""
    return decontamination.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 2,048 tokens; see ``packing.pack_documents``."""
    return packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY), 2048, 0)


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The license templates found in all documents; see ``licenses.scan_licenses``."""
    return licenses.scan_licenses(table(spark, sf_dir, "documents"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the lines that ten of them share, as digests; see ``line_dedup.dedup_lines``."""
    return line_dedup.digest(line_dedup.dedup_lines(table(spark, sf_dir, "documents"), min_docs=10, least_chars=1))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 40 shards; see ``sharding.shard_documents``."""
    return sharding.shard_documents(table(spark, sf_dir, "documents"), 40)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    every = (op1_token_counts, op2_lm_scoring, op3_ann_search, op4_simhash_near_dedup, op5_quality_classifier, op6_decontamination, op7_best_fit_packing, op8_license_scan, op9_line_dedup, op10_sharding)
    return {f.__name__: f for f in every}


_AZ = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


def oracle_sql() -> dict[str, str]:
    return {
        "op3_ann_search": """
            with good as (
                select vec_id, embedding::double[] as v from embeddings
                where embedding is not null and len(embedding) > 0
                  and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0
                  and len(list_filter(embedding, lambda x: x <> 0)) > 0),
            scored as (
                select q.vec_id as query_id, c.vec_id, list_inner_product(c.v, q.v) as score
                from good q join good c on q.vec_id <> c.vec_id where q.vec_id % 20 = 0),
            ranked as (select query_id, (row_number() over (partition by query_id order by score desc, vec_id))::int as rank, vec_id, score from scored)
            select query_id, rank, vec_id, score from ranked where rank <= 20
        """,
        "op9_line_dedup": f"""
            with docs as (select row_number() over () as r, doc_id, coalesce(text, '') as text from documents),
            lines as (
                select r, doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as pos from docs),
            keyed as (select r, doc_id, pos, line, trim({_AZ.format("line")}, {_WS}) as key from lines),
            often as (select key from keyed where length(key) >= 1 group by key having count(distinct r) >= 10),
            marked as (select k.r, k.doc_id, k.pos, k.line, o.key is not null as gone from keyed k left join often o on k.key = o.key)
            select doc_id, count(*) as n_lines, count(*) filter (gone) as n_dropped,
                   sha256(coalesce(string_agg(line, chr(10) order by pos) filter (not gone), '')) as kept_sha256
            from marked group by r, doc_id
        """,
    }
