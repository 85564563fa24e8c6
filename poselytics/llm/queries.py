"""The operators as registered queries, with production parameters over whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from poselytics.llm import (
    alignment,
    bitplanes,
    decontaminate,
    gam,
    line_dedup,
    ngram_ratio,
    packing,
    phrases,
    simhash,
    skip_chain,
    span_dedup,
    templates,
    toxicity,
)
from poselytics.llm.common import table

WORDS = "word_bpe_49k.json"
BYTES = "byte_bpe_50k.json"
PIECES = "piece_bpe_32k.model"


def op1_bit_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    path = bitplanes.new_dataset(spark)
    bitplanes.write_ids(docs, path, public_tokenizers.path(WORDS), 1)
    return bitplanes.read_digests(spark, path)


def op2_site_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return templates.extract(table(spark, sf_dir, "pages"))


def op3_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path(BYTES), 2)


def op4_skip_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return skip_chain.find(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")


def op5_simhash_bktree(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = simhash.near_duplicates(docs)
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op6_ngram_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_ratio.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_gam(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = gam.train(docs, table(spark, sf_dir, "labels"))
    return gam.classify(docs, model).select("doc_id", "held_out", "score", "predicted")


def op8_line_cuckoo(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = line_dedup.LineIndex.build(docs).apply(docs)
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op9_sentence_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return span_dedup.deduplicate(docs)


def op10_ngram_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return decontaminate.scan(docs, table(spark, sf_dir, "benchmark")).drop("text", "hits")


def op11_nnpu(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.classify(docs, model).select("doc_id", "held_out", "score", "predicted")


def op12_era_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.mine(table(spark, sf_dir, "documents"))


def op13_csr_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return alignment.digests(docs, public_tokenizers.path(BYTES), public_tokenizers.path(PIECES))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_bit_planes": op1_bit_planes,
    "op2_site_templates": op2_site_templates,
    "op3_best_fit": op3_best_fit,
    "op4_skip_chain": op4_skip_chain,
    "op5_simhash_bktree": op5_simhash_bktree,
    "op6_ngram_ratio": op6_ngram_ratio,
    "op7_gam": op7_gam,
    "op8_line_cuckoo": op8_line_cuckoo,
    "op9_sentence_spans": op9_sentence_spans,
    "op10_ngram_scan": op10_ngram_scan,
    "op11_nnpu": op11_nnpu,
    "op12_era_phrases": op12_era_phrases,
    "op13_csr_alignment": op13_csr_alignment,
}


_LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS_SQL = r"regexp_extract_all(" + _LOWER.format("coalesce(text, '')") + r", '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

ORACLES: dict[str, str] = {
    "op8_line_cuckoo": f"""
        WITH lines AS (
            SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
                   unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS pos
            FROM documents),
        keyed AS (
            SELECT *, {_LOWER.format("trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))")} AS key
            FROM lines),
        common AS (
            SELECT key FROM keyed WHERE key <> '' GROUP BY key HAVING count(DISTINCT doc_id) >= 10)
        SELECT doc_id, count(*) AS n_lines, count(common.key) AS n_dropped,
               sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (common.key IS NULL), '')) AS kept_sha256
        FROM keyed LEFT JOIN common USING (key) GROUP BY doc_id""",
    "op10_ngram_scan": f"""
        WITH items AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS_SQL} AS w FROM benchmark),
        windows AS (
            SELECT DISTINCT item, least(10, len(w)) AS size, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS gram
            FROM items, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS t(i) WHERE len(w) > 0),
        docs AS (SELECT doc_id, {_WORDS_SQL} AS w FROM documents),
        places AS (
            SELECT doc_id, i, size, array_to_string(w[i:i + size - 1], ' ') AS gram
            FROM docs, (SELECT DISTINCT size FROM windows) AS sizes, unnest(range(1, len(w) - size + 2)) AS t(i)),
        found AS (SELECT doc_id, i, size, item FROM places JOIN windows USING (size, gram)),
        hit AS (SELECT DISTINCT doc_id, unnest(range(i, i + size)) AS pos FROM found),
        hits AS (SELECT doc_id, count(*) AS n_hit FROM hit GROUP BY doc_id),
        named AS (
            SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS all_items
            FROM (SELECT DISTINCT doc_id, item FROM found) GROUP BY doc_id)
        SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
               sha256(coalesce(all_items, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
        FROM docs LEFT JOIN hits USING (doc_id) LEFT JOIN named USING (doc_id)""",
    "op12_era_phrases": f"""
        WITH pieces AS (
            SELECT coalesce(lang, 'und') AS lang,
                   unnest(regexp_split_to_array({_LOWER.format("coalesce(text, '')")}, '[.,;:!?\\x0A-\\x0D]')) AS piece
            FROM documents),
        cut AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM pieces),
        total AS (SELECT lang, sum(len(w))::HUGEINT AS n FROM cut GROUP BY lang),
        found AS (
            SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase, count(*)::HUGEINT AS f
            FROM cut, (SELECT unnest(range(1, 6)) AS k) AS sizes, unnest(range(1, len(w) - k + 2)) AS t(i)
            GROUP BY ALL HAVING count(*) >= 100),
        candidates AS (SELECT *, string_split(phrase, ' ') AS w FROM found WHERE k > 1),
        cuts AS (
            SELECT lang, phrase, f AS a, j, array_to_string(w[1:j], ' ') AS left_part,
                   array_to_string(w[j + 1:k], ' ') AS right_part
            FROM candidates, unnest(range(1, k)) AS t(j)),
        scores AS (
            SELECT c.lang, c.phrase, a, j, x.f AS l, y.f AS r, n, 1000 * a * n // (x.f * y.f) AS score
            FROM cuts AS c JOIN found AS x ON x.lang = c.lang AND x.phrase = left_part
            JOIN found AS y ON y.lang = c.lang AND y.phrase = right_part JOIN total ON total.lang = c.lang),
        lowest AS (
            SELECT * FROM scores QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
        inner_phrases AS (
            SELECT DISTINCT lang, array_to_string(w[i:i + m - 1], ' ') AS phrase, f AS outer_f
            FROM candidates, (SELECT unnest(range(2, 5)) AS m) AS sizes, unnest(range(1, k - m + 2)) AS t(i) WHERE m < k),
        kept AS (
            SELECT * FROM lowest WHERE NOT EXISTS (
                SELECT 1 FROM inner_phrases AS p
                WHERE p.lang = lowest.lang AND p.phrase = lowest.phrase AND 100 * outer_f >= 100 * a)),
        places AS (
            SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
        SELECT lang, rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score
        FROM places WHERE rank <= 2000""",
}
