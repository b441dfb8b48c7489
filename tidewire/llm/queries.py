"""The numbered corpus operators as queries over the test tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import bpe, decontam, html, interactions, langid, merkle, mixing, oracle, repetition, secrets, simhash, substring, syncmers, wavelet
from .common import documents, pages, shared_root, table


def op4_wavelet(spark: SparkSession, sf_dir: str) -> DataFrame:
    import uuid

    path = f"{shared_root(spark)}/wavelet-{uuid.uuid4().hex}"
    wavelet.write_shards(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"), path)
    return wavelet.read_shards(spark, path)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_secret_scan": lambda s, d: secrets.op1_secrets(documents(s, d)),
        "op2_mixing": lambda s, d: mixing.op2_mixing(documents(s, d)),
        "op3_simhash": lambda s, d: simhash.op3_simhash(documents(s, d)),
        "op4_wavelet": op4_wavelet,
        "op5_syncmers": lambda s, d: syncmers.op5_fingerprints(documents(s, d)),
        "op6_repetition": lambda s, d: repetition.op6_quality(documents(s, d)),
        "op7_substring": lambda s, d: substring.op7_substring(documents(s, d)),
        "op8_bpe": lambda s, d: bpe.op8_bpe(documents(s, d), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN),
        "op9_html": lambda s, d: html.op9_html(pages(s, d)),
        "op10_langid": lambda s, d: langid.op10_langid(documents(s, d)),
        "op11_merkle": lambda s, d: merkle.op11_merkle(documents(s, d)),
        "op12_decontamination": lambda s, d: decontam.op12_decontamination(documents(s, d), table(s, d, "benchmark")),
        "op13_interactions": lambda s, d: interactions.op13_interactions(documents(s, d), table(s, d, "labels")),
    }


#: Words of DuckDB's view of a text: the pieces between runs of white space.
OP7_SQL = r"""
WITH w AS (
    SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents
), win AS (
    SELECT doc_id, i, array_to_string(words[i:i + 34], ' ') AS body FROM (SELECT doc_id, words, unnest(range(1, len(words) - 33)) AS i FROM w WHERE len(words) >= 35)
), twice AS (
    SELECT body FROM win GROUP BY body HAVING count(*) > 1
), hit AS (
    SELECT DISTINCT doc_id, i + k AS place FROM win JOIN twice USING (body), range(0, 35) r(k)
), gone AS (
    SELECT doc_id, list(place) AS ats FROM hit GROUP BY doc_id
)
SELECT w.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(len(ats), 0) AS BIGINT) AS n_removed,
    sha256(array_to_string(CASE WHEN ats IS NULL THEN words ELSE list_filter(words, lambda x, i: NOT list_contains(ats, i)) END, ' ')) AS kept_sha256
FROM w LEFT JOIN gone USING (doc_id)
"""


def oracle_sql() -> dict[str, str]:
    return {"op7_substring": OP7_SQL, "op11_merkle": oracle.MERKLE, "op12_decontamination": oracle.DECONTAMINATION, "op13_interactions": oracle.INTERACTIONS}
