"""The queries of the operators, with production parameters, and their SQL where SQL can express them."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, licenses, linededup, media, mixing, packing, simhash, tokencount, tokenfile, toxicity
from .pieces import tokenizer_path
from .shared import shared_dir, table, written

#: Production parameters that the pipeline shares.
LINES = {"ratio": 0.05, "least": 5}
MIXTURE = {
    "weights": {"domain": {"d0": 4, "d1": 3, "d2": 2, "d3": 1}, "lang": {"en": 5, "de": 2, "fr": 2, "es": 1}},
    "fraction": 0.6,
    "epochs": 2,
    "seed": 1,
}


def levels() -> dict:
    """The tree of the mixture. A source's domain follows from the number in its name, 'other' without one."""
    number = F.regexp_extract("source", "([0-9]{1,9})$", 1)
    domain = F.when(number != "", F.concat(F.lit("d"), (number.try_cast("int") % 4).cast("string"))).otherwise("other")
    return {"domain": domain, "lang": F.col("lang"), "source": F.col("source")}


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), end_id=1, window=2048)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"), width=3, distance=2)


def op3_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"), k=10, every=100)


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = linededup.without_boilerplate(table(spark, sf_dir, "documents"), **LINES, counts=True)
    return rows.select("doc_id", F.col("_ld_lines").alias("n_lines"), F.col("_ld_dropped").alias("n_dropped"), F.length("text").cast("long").alias("kept_chars"), F.md5("text").alias("text_md5"))


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_dir(spark)}/millrace/token-files-{uuid.uuid4().hex}"
    tokenfile.write(table(spark, sf_dir, "documents"), path, tokenizer_path("word_bpe_49k.json"), end_id=2)
    return tokenfile.read(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.count_tokens(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"), limit=2048)


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.best(licenses.scan(table(spark, sf_dir, "documents")))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = mixing.copies(table(spark, sf_dir, "documents"), levels(), **MIXTURE)
    return rows.select("doc_id", F.col("_mx_domain").alias("domain"), "lang", "source", F.col("_mx_copies").alias("copies"))


def op10_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tables have no recordings: the bytes of each whole text are taken as 8-bit samples, at a rate at which short ones last."""
    sound = table(spark, sf_dir, "documents").select("doc_id", F.col("text").cast("binary").alias("audio"))
    prints = media.fingerprints(sound, encoding="u8", rate=11025 / 32, frame=128, hop=43, id_col="doc_id")
    found = media.search(written(prints, "media-prints"), every=100)
    return found.withColumnRenamed("id", "doc_id")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_packing": op1_packing,
    "op2_simhash": op2_simhash,
    "op3_nearest": op3_nearest,
    "op4_line_dedup": op4_line_dedup,
    "op5_token_files": op5_token_files,
    "op6_toxicity": op6_toxicity,
    "op7_token_counts": op7_token_counts,
    "op8_licenses": op8_licenses,
    "op9_mixing": op9_mixing,
    "op10_media": op10_media,
}

ORACLE_SQL: dict[str, str] = {
    "op4_line_dedup": """
        WITH d AS (SELECT row_number() OVER () AS r, doc_id, source, text FROM documents),
        l AS (SELECT r, doc_id, source, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS k FROM d),
        b AS (SELECT *, trim(line, chr(32) || chr(9) || chr(13)) AS bare FROM l),
        n AS (SELECT source, bare, count(DISTINCT r) AS n FROM b WHERE bare <> '' GROUP BY source, bare),
        t AS (SELECT source, count(*) AS pages FROM d GROUP BY source),
        bad AS (SELECT n.source, n.bare FROM n JOIN t ON n.source IS NOT DISTINCT FROM t.source WHERE n >= 5 AND n > 0.05 * pages),
        m AS (SELECT b.r, b.k, b.line, bad.bare IS NOT NULL AS gone FROM b LEFT JOIN bad ON b.source IS NOT DISTINCT FROM bad.source AND b.bare = bad.bare),
        s AS (SELECT r, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped, coalesce(string_agg(line, chr(10) ORDER BY k) FILTER (WHERE NOT gone), '') AS text FROM m GROUP BY r)
        SELECT d.doc_id, CAST(coalesce(n_lines, 0) AS BIGINT) AS n_lines, CAST(coalesce(n_dropped, 0) AS BIGINT) AS n_dropped,
               CAST(length(s.text) AS BIGINT) AS kept_chars, md5(s.text) AS text_md5
        FROM d LEFT JOIN s ON d.r = s.r""",
    "op9_mixing": """
        WITH d AS (
            SELECT doc_id, lang, source, CASE WHEN regexp_extract(source, '([0-9]{1,9})$', 1) <> '' THEN 'd' || CAST(CAST(regexp_extract(source, '([0-9]{1,9})$', 1) AS INTEGER) % 4 AS VARCHAR) ELSE 'other' END AS domain,
                   CAST(coalesce(len(regexp_extract_all(text, '[^ \t\r\n]+')), 0) AS BIGINT) AS tokens FROM documents),
        leaf AS (SELECT domain, lang, source, sum(tokens) AS t, 2.0 * sum(tokens) AS cap, 1.0 AS w FROM d GROUP BY ALL),
        a0 AS (SELECT 0.6 * sum(t) AS budget FROM leaf),
        n1 AS (SELECT domain, sum(cap) AS cap, CASE domain WHEN 'd0' THEN 4.0 WHEN 'd1' THEN 3.0 WHEN 'd2' THEN 2.0 ELSE 1.0 END AS w FROM leaf GROUP BY domain),
        v1 AS (SELECT *, cap / w AS f, (budget - coalesce(sum(cap) OVER (ORDER BY cap / w, domain ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(w) OVER (ORDER BY cap / w, domain ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS l FROM n1, a0),
        s1 AS (SELECT domain, CASE WHEN l < f THEN w * max(CASE WHEN l < f THEN l END) OVER () ELSE cap END AS budget FROM v1),
        n2 AS (SELECT domain, lang, sum(cap) AS cap, CASE lang WHEN 'en' THEN 5.0 WHEN 'de' THEN 2.0 WHEN 'fr' THEN 2.0 ELSE 1.0 END AS w FROM leaf GROUP BY domain, lang),
        v2 AS (SELECT n2.*, cap / w AS f, (budget - coalesce(sum(cap) OVER (PARTITION BY n2.domain ORDER BY cap / w, lang ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(w) OVER (PARTITION BY n2.domain ORDER BY cap / w, lang ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS l FROM n2 JOIN s1 ON n2.domain = s1.domain),
        s2 AS (SELECT domain, lang, CASE WHEN l < f THEN w * max(CASE WHEN l < f THEN l END) OVER (PARTITION BY domain) ELSE cap END AS budget FROM v2),
        v3 AS (SELECT leaf.*, cap / w AS f, (budget - coalesce(sum(cap) OVER (PARTITION BY leaf.domain, leaf.lang ORDER BY cap / w, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(w) OVER (PARTITION BY leaf.domain, leaf.lang ORDER BY cap / w, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS l FROM leaf JOIN s2 ON leaf.domain = s2.domain AND leaf.lang IS NOT DISTINCT FROM s2.lang),
        s3 AS (SELECT domain, lang, source, t, CAST(floor(round(CASE WHEN l < f THEN w * max(CASE WHEN l < f THEN l END) OVER (PARTITION BY domain, lang) ELSE cap END, 4)) AS BIGINT) AS target FROM v3),
        e AS (SELECT domain, lang, source, target, t, CASE WHEN t > 0 THEN least(CAST(target // t AS BIGINT), 2) ELSE 0 END AS whole FROM s3),
        p AS (SELECT d.*, whole, CASE WHEN whole < 2 THEN target - whole * t ELSE -1 END AS rest, md5('1:' || CAST(whole AS VARCHAR) || ':' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS h
              FROM d JOIN e ON d.domain = e.domain AND d.lang IS NOT DISTINCT FROM e.lang AND d.source IS NOT DISTINCT FROM e.source),
        c AS (SELECT *, sum(tokens) OVER (PARTITION BY domain, lang, source ORDER BY h, coalesce(CAST(doc_id AS VARCHAR), 'null') RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS s FROM p)
        SELECT doc_id, domain, lang, source, CAST(whole + CASE WHEN rest >= 0 AND s <= rest THEN 1 ELSE 0 END AS BIGINT) AS copies FROM c""",
}
