"""The registered queries of the subpackage and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from lexivane.llm import align, contain, jaccard, langid, mixing, packing, periods, pii, quality, rules, suffix, tokens, urls

TOKENIZER = "word_bpe_49k.json"
BYTE_SIDE, PIECE_SIDE = "byte_bpe_50k.json", "piece_bpe_32k.model"
URL_RULES = [
    urls.Rule("allow", "com/"),
    urls.Rule("block", "example.com/en/"),
    urls.Rule("allow", "www.example.com/en/"),
    urls.Rule("block", "net/es/"),
    urls.Rule("block", "net/fr/"),
]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.count_tokens(_table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))


def op2_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(_table(spark, sf_dir, "documents"))


def op3_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.filter_urls(_table(spark, sf_dir, "pages"), URL_RULES)


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify_quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.dedup_substrings(_table(spark, sf_dir, "documents"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(_table(spark, sf_dir, "documents"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contain.find_contained(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    scanned = pii.scan(_table(spark, sf_dir, "documents"))
    return pii.report(pii.find_pii(scanned, pii.learn_patterns(scanned)))


def op9_bestfit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    ledger = rules.apply_policy(rules.rule_ledger(_table(spark, sf_dir, "documents")))
    return ledger.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "fail_bits"
    )


def op11_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.score_texts(_table(spark, sf_dir, "documents"))


def op12_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.alignment_counts(_table(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_SIDE), public_tokenizers.path(PIECE_SIDE))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periods.run_digests(_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_counts": op1_token_counts,
    "op2_ngram_jaccard": op2_ngram_jaccard,
    "op3_url_filters": op3_url_filters,
    "op4_quality_classifier": op4_quality_classifier,
    "op5_suffix_dedup": op5_suffix_dedup,
    "op6_language_id": op6_language_id,
    "op7_decontamination": op7_decontamination,
    "op8_pii": op8_pii,
    "op9_bestfit_packing": op9_bestfit_packing,
    "op10_quality_rules": op10_quality_rules,
    "op11_lm_scoring": op11_lm_scoring,
    "op12_tokenizer_alignment": op12_tokenizer_alignment,
    "op13_periodic_runs": op13_periodic_runs,
}


# --- SQL twins ------------------------------------------------------------------------

_WORD = r"[^\x20\x09-\x0D]+"

# (doc_id, ws): the folded words of each text; (doc_id, g): its distinct shingles
_FOLD = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def shingle_sql(table: str, key: str, name: str) -> str:
    """Two common table expressions: words and distinct five-word shingles of a table."""
    return rf"""{name}_words AS (SELECT {key}, regexp_extract_all({_FOLD.format("coalesce(text, '')")}, '{_WORD}') AS ws FROM {table}),
    {name}_grams AS (SELECT DISTINCT {key}, unnest(CASE WHEN len(ws) >= 5
            THEN list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i+4], ' '))
            WHEN len(ws) > 0 THEN [len(ws) || ':' || array_to_string(ws, ' ')] ELSE [] END) AS g FROM {name}_words)"""


CONTAINED = f"""WITH {shingle_sql("documents", "doc_id", "d")}, {shingle_sql("benchmark", "item_id", "b")},
    sizes AS (SELECT item_id, count(*) AS n_item FROM b_grams GROUP BY item_id),
    met AS (SELECT doc_id, item_id, count(*) AS n_shared FROM d_grams JOIN b_grams USING (g) GROUP BY ALL)
    SELECT doc_id, item_id, n_shared, n_item FROM met JOIN sizes USING (item_id) WHERE 5 * n_shared >= 4 * n_item"""

# classes are the components of the links; the links are counted row by row
CLASSES = f"""WITH RECURSIVE {shingle_sql("documents", "doc_id", "d")},
    sizes AS (SELECT doc_id, count(*) AS n FROM d_grams GROUP BY doc_id),
    met AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n_both FROM d_grams a JOIN d_grams b ON a.g = b.g AND a.doc_id <> b.doc_id
            GROUP BY ALL),
    links AS (SELECT a, b FROM met JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 5 * n_both >= 4 * (x.n + y.n - n_both)),
    reach AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
    least AS (SELECT a AS doc_id, min(b) AS m FROM reach GROUP BY a),
    counted AS (SELECT a AS doc_id, count(*) AS n_links FROM links GROUP BY a),
    same AS (SELECT doc_id, CASE WHEN regexp_matches(text, '{_WORD}') THEN count(*) OVER (PARTITION BY text) ELSE 1 END AS n_copies
             FROM documents)
    SELECT d.doc_id, least(d.doc_id, coalesce(m, d.doc_id)) AS class_id, coalesce(n_links, 0) AS n_links, n_copies
    FROM documents d LEFT JOIN least USING (doc_id) LEFT JOIN counted USING (doc_id) JOIN same USING (doc_id)"""

_MEASURED = rf"""w AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS ws FROM documents),
    lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM w),
    by_line AS (SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines FROM lines
                WHERE regexp_matches(line, '{_WORD}') GROUP BY doc_id),
    grams AS (SELECT doc_id, unnest(range(1, len(ws) - 1)) AS i, ws[i:i+2] AS g FROM w WHERE len(ws) > 2),
    again AS (SELECT doc_id, i FROM grams QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
    repeats AS (SELECT doc_id, count(DISTINCT j) AS n_repeat_words
                FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS j FROM again) GROUP BY doc_id),
    m AS (SELECT doc_id, len(ws) AS n_words, length(array_to_string(ws, '')) AS word_chars,
            length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
            coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(n_lines, 0) AS n_lines,
            len(list_filter(ws, lambda x: regexp_matches(x, '[A-Z].*[A-Z]') AND NOT regexp_matches(x, '[a-z]'))) AS n_upper_words,
            len(list_filter(ws, lambda x: regexp_matches(x, '[A-Za-z]|[^\x00-\x7F]'))) AS n_letter_words
          FROM w LEFT JOIN by_line USING (doc_id) LEFT JOIN repeats USING (doc_id))"""


def ledger_sql(policy: rules.Policy = rules.DEFAULT_POLICY) -> str:
    bits = " + ".join(f"(CASE WHEN {test} THEN {1 << i} ELSE 0 END)" for i, test in enumerate(rules.RULES.values()))
    mask = rules.BASE_POLICY.mask
    return f"""WITH {_MEASURED}, judged AS (SELECT *, ({bits})::BIGINT AS fail_bits FROM m)
        SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, fail_bits & {mask} <> 0 AS base_failed,
               fail_bits & {mask | policy.mask} = 0 AS kept, fail_bits FROM judged"""


ORACLE_SQL: dict[str, str] = {
    "op2_ngram_jaccard": CLASSES,
    "op7_decontamination": CONTAINED,
    "op10_quality_rules": ledger_sql(),
}
