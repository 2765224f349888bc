"""The registered queries of this subpackage and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import exact_dedup, language, line_dedup, mixing, pii, quality, resampling, secrets, sentencepieces, simhash, suffix_dedup, whitening, word_bpe
from .common import documents, model_path


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the one that stays for its text."""
    return exact_dedup.exact_dedup(documents(spark, sf_dir))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's size and the words that the mix takes of it."""
    docs = documents(spark, sf_dir).select("doc_id", "text", "source")
    return mixing.mix_counts(docs).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, with whether it was held out."""
    return language.identify(documents(spark, sf_dir))


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much of every document repeats elsewhere, and the digest of the rest."""
    spans = F.col("spans")
    removed = F.aggregate(spans, F.lit(0).cast("long"), lambda a, x: a + x["stop"] - x["start"])
    kept = suffix_dedup.suffix_dedup(documents(spark, sf_dir))
    return kept.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size(spans).cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


BASE_COLUMNS = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counts and the verdict of every document."""
    return quality.quality_rules(documents(spark, sf_dir)).select(BASE_COLUMNS)


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers and digests of the ids of every document, and of the text decoded from them."""
    return sentencepieces.encode_decode(documents(spark, sf_dir), model_path())


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fingerprint and the group of every document."""
    return simhash.simhash_groups(documents(spark, sf_dir))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of every document, how many are dropped, and the digest of the rest."""
    kept = line_dedup.line_dedup(documents(spark, sf_dir).select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with surrogates, and how many of each kind."""
    found = pii.replace_pii(documents(spark, sf_dir).select("doc_id", "text"))
    count = lambda k: F.coalesce(F.col("n_replaced")[k], F.lit(0)).cast("long").alias(f"n_{k}")
    return found.select("doc_id", "text", *[count(k) for k in pii.KINDS])


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every candidate of every document, by digest, with score and verdict."""
    found = secrets.scan_secrets(documents(spark, sf_dir))
    return found.select("doc_id", "ordinal", F.length("value").alias("length"), F.sha2("value", 256).alias("value_sha256"), "score", "kept")


def op11_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's weight towards the benchmark's words, its score, and its rank if it is drawn."""
    return resampling.resample(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op12_word_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers and digests of the word-end BPE ids of every document, and of the text decoded from them."""
    return word_bpe.encode_decode(documents(spark, sf_dir), model_path("word_bpe_49k.json"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every embedding on the 16 first principal components, whitened; a deviation beyond a long is null."""
    found = whitening.whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return found.withColumn("deviation", F.expr("try_cast(deviation AS long)"))


QUERIES = {
    "op1_exact_dedup": op1_exact_dedup,
    "op2_mixing": op2_mixing,
    "op3_language": op3_language,
    "op4_suffix_dedup": op4_suffix_dedup,
    "op5_quality": op5_quality,
    "op6_sentencepiece": op6_sentencepiece,
    "op7_simhash": op7_simhash,
    "op8_line_dedup": op8_line_dedup,
    "op9_pii": op9_pii,
    "op10_secrets": op10_secrets,
    "op11_resampling": op11_resampling,
    "op12_word_bpe": op12_word_bpe,
    "op13_whitening": op13_whitening,
}

ORACLES = {
    "op1_exact_dedup": r"""
        WITH t AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS h FROM documents)
        SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               doc_id = min(doc_id) OVER w AS kept, h AS text_sha256
        FROM t WINDOW w AS (PARTITION BY h)
    """,
    "op2_mixing": r"""
        WITH RECURSIVE d AS (
            SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
        s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
                     [5, 2, 1][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS INT)] AS w FROM d GROUP BY source),
        tot AS (SELECT sum(source_size) AS t, sum(w) AS w FROM s),
        r(i, c, v) AS (
            SELECT 0, CAST(0 AS HUGEINT), CAST(0 AS HUGEINT)
            UNION ALL
            SELECT i + 1, n.c, n.v FROM (
                SELECT r.i AS i, r.v AS old, coalesce(sum(3 * s.source_size) FILTER (WHERE s.source_size * 3 * (tot.w - r.v) < s.w * (tot.t - r.c)), 0) AS c,
                       coalesce(sum(s.w) FILTER (WHERE s.source_size * 3 * (tot.w - r.v) < s.w * (tot.t - r.c)), 0) AS v
                FROM r, s, tot GROUP BY r.i, r.v) n WHERE n.v <> n.old),
        last AS (SELECT c, v FROM r ORDER BY i DESC LIMIT 1),
        g AS (SELECT s.source, s.source_size,
                     CASE WHEN s.source_size * 3 * (tot.w - last.v) < s.w * (tot.t - last.c) THEN s.source_size * 3.0::DOUBLE
                          ELSE CAST(tot.t - last.c AS DOUBLE) * s.w / CAST(greatest(1, tot.w - last.v) AS DOUBLE) END AS target
              FROM s, tot, last),
        u AS (SELECT d.doc_id, d.size, g.source_size, g.target,
                     CASE WHEN g.source_size > 0 THEN g.target / g.source_size ELSE 0 END AS rate,
                     CAST(CAST('0x' || substr(sha256('42:' || CAST(d.doc_id AS VARCHAR)), 1, 13) AS BIGINT) AS DOUBLE) / 4503599627370496.0::DOUBLE AS unit
              FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source)
        SELECT doc_id, size, source_size, target,
               CAST(size * (floor(rate) + CASE WHEN unit < rate - floor(rate) THEN 1 ELSE 0 END) AS BIGINT) AS taken
        FROM u
    """,
    "op8_line_dedup": r"""
        WITH l AS (
            SELECT doc_id, i, ls[i] AS line,
                   translate(regexp_replace(regexp_replace(ls[i], '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
            FROM (SELECT doc_id, ls, unnest(generate_series(1, len(ls))) AS i
                  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents))),
        k AS (SELECT key, max(doc_id) AS keep FROM l WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
        m AS (SELECT l.doc_id, i, line, k.key IS NOT NULL AND l.doc_id <> k.keep AS gone FROM l LEFT JOIN k ON l.key = k.key)
        SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
               sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
        FROM m GROUP BY doc_id
    """,
    "op5_quality": r"""
        WITH d AS (SELECT doc_id, source, coalesce(text, '') AS text FROM documents),
        w AS (SELECT doc_id, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws FROM d),
        g AS (SELECT doc_id, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS tri
              FROM (SELECT doc_id, ws, unnest(generate_series(1, len(ws) - 2)) AS i FROM w)),
        hit AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, tri) AS n FROM g) WHERE n > 1),
        rep AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM hit) GROUP BY doc_id),
        l AS (SELECT doc_id, source, line, lower(regexp_replace(regexp_replace(regexp_replace(line, '[\x20\x09\x0B-\x0D]+', ' ', 'g'), '^ +', ''), ' +$', '')) AS k
              FROM (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line FROM d)),
        ll AS (SELECT * FROM l WHERE k <> ''),
        dup AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM ll GROUP BY doc_id),
        hosts AS (SELECT source, count(*) AS n FROM d GROUP BY source),
        freq AS (SELECT ll.source, k FROM ll JOIN hosts ON ll.source IS NOT DISTINCT FROM hosts.source
                 GROUP BY ll.source, k, hosts.n HAVING count(DISTINCT doc_id) > 20 AND (count(DISTINCT doc_id) > hosts.n * 0.1::DOUBLE OR count(DISTINCT doc_id) > 1000)),
        lost AS (SELECT doc_id, sum(length(ll.k) - length(replace(ll.k, ' ', '')) + 1) AS n
                 FROM ll JOIN freq ON ll.k = freq.k AND ll.source IS NOT DISTINCT FROM freq.source GROUP BY doc_id),
        b AS (SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words,
                     CAST(length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
                     CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
                     CAST(coalesce(dup.n, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words, coalesce(lost.n, 0) AS lost
              FROM d JOIN w USING (doc_id) LEFT JOIN dup USING (doc_id) LEFT JOIN rep USING (doc_id) LEFT JOIN lost USING (doc_id)),
        f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM b)
        SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
               NOT base_failed AND lost <= n_words * 0.5::DOUBLE AS kept
        FROM f
    """,
    "op11_resampling": r"""
        WITH byte_table AS (
            SELECT [list_reduce([CAST(b AS BIGINT), 0, 0, 0, 0, 0, 0, 0, 0], lambda c, _: xor(c >> 1, 3988292384 * (c & 1))) FOR b IN range(256)] AS t),
        seen AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
        wanted AS (SELECT regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
        f AS (SELECT doc_id, unnest(ws) AS w FROM seen),
        g AS (SELECT unnest(ws) AS w FROM wanted),
        words AS (SELECT DISTINCT w, hex(encode(w)) AS h FROM (SELECT w FROM f UNION ALL SELECT w FROM g)),
        coded AS (SELECT w, xor(4294967295, list_reduce(
                      list_concat([4294967295], [CAST(CAST('0x' || h[2 * i + 1:2 * i + 2] AS INTEGER) AS BIGINT) FOR i IN range(length(h) // 2)]),
                      lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]))) % 10000 AS bucket
                  FROM words, byte_table),
        s AS (SELECT bucket, count(*) AS n FROM f JOIN coded USING (w) GROUP BY bucket),
        t AS (SELECT bucket, count(*) AS n FROM g JOIN coded USING (w) GROUP BY bucket),
        sums AS (SELECT CAST(coalesce((SELECT sum(n) FROM s), 0) AS DOUBLE) AS s_all, CAST(coalesce((SELECT sum(n) FROM t), 0) AS DOUBLE) AS t_all),
        gain AS (SELECT s.bucket, CAST(floor(1000 * ln((coalesce(t.n, 0) + 1)::DOUBLE * (s_all + 10000) / ((s.n + 1)::DOUBLE * (t_all + 10000)))) AS BIGINT) AS gain
                 FROM sums, s LEFT JOIN t USING (bucket)),
        weighed AS (SELECT doc_id, CAST(sum(gain) AS BIGINT) AS weight FROM f JOIN coded USING (w) JOIN gain USING (bucket) GROUP BY doc_id),
        d AS (SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_features, coalesce(weight, 0) AS weight,
                     CAST(CAST('0x' || substr(sha256('2024:' || CAST(doc_id AS VARCHAR)), 1, 8) AS BIGINT) AS DOUBLE) AS h
              FROM seen LEFT JOIN weighed USING (doc_id)),
        e AS (SELECT doc_id, n_features, weight, weight + CAST(floor(-1000 * ln(-ln((h + 0.5) / 4294967296))) AS BIGINT) AS score FROM d),
        r AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM e WHERE n_features >= 20)
        SELECT e.doc_id, n_features, weight, score, CASE WHEN rank <= 10 * (SELECT count(*) FROM r) // 100 THEN rank END AS rank
        FROM e LEFT JOIN r USING (doc_id)
    """,
}
