"""The operators as named queries over the whole of their tables, and their SQL where it exists."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lendlake.functions.workspace import new_folder
from lendlake.llm import (
    alignment, exact_dedup, language, lexical, mixing, nearest, ngram_join, packing, pii, sharding, simhash,
    token_files, toxicity)
from lendlake.llm.labels import held_out, train_toxicity
from lendlake.llm.shared import read, text_of

SHARDS = 16


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_folder(spark, "token-files")
    token_files.write_token_files(read(spark, sf_dir, "documents"), folder,
                                  public_tokenizers.path("word_bpe_49k.json"), end_id=1)
    return token_files.checksums(token_files.read_token_files(spark, folder))


def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.similar_documents(read(spark, sf_dir, "documents"))


def op3_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest.nearest_neighbours(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0) \
        .select("query_id", "rank", "vec_id", "score")


def op4_temperature_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.plan_mixture(read(spark, sf_dir, "documents"))


def op5_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_personal_data(read(spark, sf_dir, "documents"))
    kinds = F.transform("pii_base", lambda s: s["kind"])
    counts = [(F.size(kinds) - F.size(F.array_remove(kinds, k))).cast("bigint").alias(f"n_{k}")
              for k in pii.KINDS]
    return found.select(
        "doc_id", *counts, F.sha2(pii.written(F.col("pii_base")), 256).alias("base_sha256"),
        pii.written(F.col("pii_spans")).alias("spans"))


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held = held_out(3, 1)
    found = language.identify(docs.select("doc_id", "text"), language.train(docs, ~held), reject=False)
    return found.select("doc_id", held.alias("held_out"), "lang_pred",
                        F.col("lang_score").alias("score"), F.col("lang_rejected").alias("rejected"))


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(read(spark, sf_dir, "documents"),
                                  public_tokenizers.path("byte_bpe_50k.json"), end_id=0)


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.mark_duplicates(read(spark, sf_dir, "documents")).select(
        "doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = text_of("text")
    return sharding.shuffle_to_shards(read(spark, sf_dir, "documents"), SHARDS).select(
        "doc_id", (F.octet_length(text) + 1).cast("bigint").alias("size"),
        F.crc32(text).alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    model = train_toxicity(docs, read(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).select(
        "doc_id", held_out(5, 0).alias("held_out"), F.col("toxicity").alias("score"),
        (F.col("toxicity") >= 0.5).cast("int").alias("predicted"))


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    aligned = alignment.align(read(spark, sf_dir, "documents"), alignment.Vocabularies(
        public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")))
    return alignment.digests(aligned, alignment.link_counts(aligned))


def op12_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read(spark, sf_dir, "documents"))


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.rank_documents(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (
        op1_token_files, op2_ngram_jaccard_join, op3_nearest_neighbours, op4_temperature_mixing,
        op5_personal_data, op6_language, op7_best_fit_packing, op8_exact_dedup, op9_sharding,
        op10_toxicity, op11_token_alignment, op12_simhash_near_dedup,
        op13_lexical_search)}

# Rounds of halving, and places a weight's exponent is rounded to, as in mixing.
_MIX = mixing.Mix()
ORACLE_SQL: dict[str, str] = {
    "op8_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
               doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))""",
    "op4_temperature_mixing": f"""
        WITH RECURSIVE thin AS (
            SELECT doc_id, source,
                   len(regexp_extract_all(coalesce(text, ''), '[^ \\t\\n\\r]+')) AS n_tokens
            FROM documents),
        totals AS (SELECT source, sum(n_tokens)::BIGINT AS source_tokens FROM thin GROUP BY source),
        shares AS (SELECT *, source_tokens / (SELECT sum(source_tokens)::BIGINT FROM totals) AS share
                   FROM totals),
        facts AS (SELECT list(share ORDER BY share) FILTER (share > 0) AS p FROM shares),
        entropy(i, lo, hi) AS (
            SELECT 0, 0.0::DOUBLE, 1.0::DOUBLE
            UNION ALL
            SELECT i + 1, CASE WHEN good THEN mid ELSE lo END, CASE WHEN good THEN hi ELSE mid END
            FROM (SELECT i, lo, hi, (lo + hi) / 2 AS mid,
                  ln(list_sum(list_transform(p, lambda x: pow(x, (lo + hi) / 2))))
                  - (lo + hi) / 2 * list_sum(list_transform(p, lambda x: pow(x, (lo + hi) / 2) * ln(x)))
                  / list_sum(list_transform(p, lambda x: pow(x, (lo + hi) / 2)))
                  >= {_MIX.target_entropy}::DOUBLE * ln(len(p)) AS good FROM entropy, facts WHERE i < 40)),
        even AS (SELECT CASE WHEN - list_sum(list_transform(p, lambda x: x * ln(x)))
                        >= {_MIX.target_entropy}::DOUBLE * ln(len(p)) OR p[1] = p[-1] THEN 1.0
                        ELSE (SELECT lo FROM entropy WHERE i = 40) END AS a, p[1] AS least, p[-1] AS most
                 FROM facts),
        chosen AS (SELECT round(greatest(a, CASE WHEN most = least THEN 0.0 ELSE
                     1 - ln({_MIX.repetition_limit}::DOUBLE) / ln(most / least) END),
                     {mixing.DIGITS}) AS alpha FROM even),
        weighed AS (SELECT *, CASE WHEN share > 0 THEN pow(share, (SELECT alpha FROM chosen))
                    ELSE 0.0 END AS raw FROM shares),
        scaled AS (SELECT *, raw / sum(raw) OVER () AS weight,
                   max(source_tokens / nullif(raw, 0)) OVER () * sum(raw) OVER () AS budget
                   FROM weighed),
        quotas AS (SELECT source, source_tokens, round(weight * budget)::BIGINT AS quota FROM scaled),
        blocks AS (SELECT greatest(1, ceil(sum(quota)::DOUBLE / {_MIX.block_tokens}))::BIGINT AS n
                   FROM quotas),
        used AS (
            SELECT t.*, q.source_tokens, q.quota, e.epoch,
                   md5(concat_ws(':', '{_MIX.seed}', e.epoch, t.doc_id)) AS spot
            FROM thin t JOIN quotas q ON t.source IS NOT DISTINCT FROM q.source
            JOIN (SELECT unnest(range(1, 1 + {int(_MIX.repetition_limit) + 1})) AS epoch) e
            ON e.epoch <= greatest(1, coalesce(ceil(q.quota::DOUBLE / nullif(q.source_tokens, 0)), 1))),
        placed AS (SELECT *, (epoch - 1) * source_tokens + coalesce(sum(n_tokens) OVER (
                       PARTITION BY source, epoch ORDER BY spot, doc_id
                       ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS place FROM used),
        dealt AS (SELECT doc_id, source, n_tokens, epoch, CASE WHEN place < quota THEN
                      least(n - 1, floor(place::DOUBLE / quota * n)::BIGINT)
                      ELSE ('0x' || spot[1:3])::BIGINT % n END AS block
                  FROM placed, blocks WHERE place < quota OR (epoch = 1 AND n_tokens = 0))
        SELECT doc_id, source, n_tokens, epoch, block, row_number() OVER (PARTITION BY block
                   ORDER BY md5(concat_ws(':', '{_MIX.seed}', block, epoch, doc_id)), doc_id, epoch)
                   AS position FROM dealt""",
    "op13_lexical_search": r"""
        WITH terms AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''),
                       'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                       '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents),
        wanted AS (
            SELECT item_id, term, count(*) AS times
            FROM (SELECT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''),
                       'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                       '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark)
            GROUP BY ALL),
        sums AS (SELECT count(*) AS n_docs, sum(len(terms))::BIGINT AS n_terms
                 FROM terms WHERE len(terms) > 0),
        held AS (SELECT doc_id, len(terms)::BIGINT AS n, unnest(terms) AS term FROM terms),
        counts AS (SELECT doc_id, n, term, count(*) AS tf FROM held
                   WHERE term IN (SELECT term FROM wanted) GROUP BY ALL),
        weights AS (SELECT term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w
                    FROM counts, sums GROUP BY term, n_docs),
        scores AS (
            SELECT item_id, doc_id, sum(times * w * ((1000000000 * tf) //
                       (1000 * tf + 12 * (75 + (25 * n * n_docs) // n_terms))))::BIGINT AS score
            FROM wanted JOIN counts USING (term) JOIN weights USING (term), sums
            GROUP BY item_id, doc_id),
        ranked AS (SELECT item_id, (row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id))
                       ::INTEGER AS rank, doc_id, score FROM scores WHERE score > 0)
        SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 20""",
}
