"""The queries of the numbered operators, over whole tables with production parameters, and SQL where it can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pyspark.sql import functions as F

from . import audit, bpe, jaccard, media, mixing, periods, privacy, quality, sentencepiece, sharding, substrings, toxicity, urls
from .common import WORD, table

#: (host, start of the path, verdict).
URL_RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = sharding.shard_by_bytes(table(spark, sf_dir, "documents").select("doc_id", "text"), 8)
    return moved.select("doc_id", "size", F.crc32("text").alias("text_crc32"), F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.clean_lines(table(spark, sf_dir, "documents")).drop("clean_text")


def op3_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join_components(table(spark, sf_dir, "documents")).drop("point", "root")


def op4_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_columns(table(spark, sf_dir, "documents"))


#: Of these tests; a real run takes its key from a secret store.
PSEUDONYM_KEY = "test-key"


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return privacy.pseudonymise(table(spark, sf_dir, "documents").select("doc_id", "text"), PSEUDONYM_KEY)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return toxicity.score_toxicity(docs, table(spark, sf_dir, "labels")).withColumn("held_out", toxicity.held_out()).drop("text")


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.remove_repeats(table(spark, sf_dir, "documents"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source", "block", "draws")


def op10_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages, marks = table(spark, sf_dir, "pages").select("page_id", "url"), table(spark, sf_dir, "labels")
    # The number that ends a page's path is its document's id; a document of good quality makes its page a good one.
    number = F.regexp_extract(F.coalesce("url", F.lit("")), r"://[^?#]*/([0-9]{1,18})(?:\.html|/)?(?:[?#]|$)", 1)
    labels = pages.select("page_id", number.try_cast("long").alias("doc_id"))
    labels = labels.join(marks.select("doc_id", F.col("quality").alias("good")), "doc_id").select("page_id", "good")
    return urls.judge_urls(pages, URL_RULES, labels)


#: Names the model file of pieces; unset, the tokenizer package's is taken.
PIECES = "spark.tidemark.pieces"


def piece_model(spark: SparkSession | None = None) -> str:
    if spark is not None and (path := spark.conf.get(PIECES, None)):
        return path
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = sentencepiece.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), piece_model(spark))
    return coded.select("doc_id", "n_tokens", "round_trip", "ids")


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of each document's words; a tenth of the documents, told by a checksum of their ids, first have their later words made to repeat."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    words = F.filter(F.split("text", WORD.replace("[^", "[")), lambda w: w != "")
    n, h = F.size("_w"), F.crc32(F.col("doc_id").cast("string"))
    told = docs.withColumn("_w", F.when(h % 10 == 0, words)).withColumn("_g", F.floor(h / 10))
    told = told.withColumn("_a", F.when(n > 0, F.col("_g") % n)).withColumn("_p", 1 + F.floor((n - F.col("_a")) / (3 + F.col("_g") % 8)))
    again = "array_join(transform(sequence(0, size(_w) - 1), i -> _w[if(i < _a, i, cast(_a + (i - _a) % _p as int))]), ' ')"
    found = periods.periodic_runs(told.select("doc_id", F.when(F.col("_a").isNotNull(), F.expr(again)).otherwise(F.col("text")).alias("text")))
    line = "array_join(transform(runs, r -> concat_ws(',', r.start, r.length, r.period) || '\n'), '')"
    digests = [F.sha2(F.expr(line), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256")]
    return found.select("doc_id", "n_runs", "start", "length", "period", "exponent_milli", *digests)


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.audit(audit.parity_sums(audit.failure_counts(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))))


#: Names the vocabulary file of byte pairs; unset, the tokenizer package's is taken.
BYTE_PAIRS = "spark.tidemark.byte_pairs"


def byte_pairs(spark: SparkSession | None = None) -> str:
    if spark is not None and (path := spark.conf.get(BYTE_PAIRS, None)):
        return path
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op13_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    coded = bpe.encode(docs, byte_pairs(spark), decoded="decoded")
    digests = [F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")]
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), *digests)


QUERIES = {
    "op1_sharding": op1_sharding, "op2_quality_rules": op2_quality_rules, "op3_ngram_jaccard": op3_ngram_jaccard, "op4_media_columns": op4_media_columns, "op5_pii": op5_pii,
    "op6_toxicity": op6_toxicity, "op7_substring_dedup": op7_substring_dedup, "op8_mixing": op8_mixing, "op9_sentencepiece": op9_sentencepiece, "op10_url_filters": op10_url_filters,
    "op11_periodic_runs": op11_periodic_runs, "op12_filter_audit": op12_filter_audit, "op13_bpe": op13_bpe,
}

_SPLIT = r"list_filter(regexp_split_to_array({0}, '[\x20\x09-\x0D]+'), lambda x: x <> '')"
_LOW = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: For the operators whose results SQL can state outright; the others are held against brute force in tests.
SQL: dict[str, str] = {
    "op3_ngram_jaccard": f"""WITH RECURSIVE w AS (SELECT doc_id, {_SPLIT.format(_LOW)} AS ws FROM documents),
      s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) >= 5 THEN list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) WHEN len(ws) > 0 THEN [array_to_string(ws, ' ') || '|' || len(ws)] ELSE [] END) AS g FROM w),
      n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1), pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
      links AS (SELECT a, b FROM pairs JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)), ends AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
      reach(a, b) AS (SELECT a, b FROM ends UNION SELECT r.a, e.b FROM reach r JOIN ends e ON r.b = e.a), least AS (SELECT a, min(b) AS b FROM reach GROUP BY 1)
      SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least(d.doc_id, coalesce(l.b, d.doc_id)) AS component_id FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN least l ON l.a = d.doc_id""",
    "op7_substring_dedup": f"""WITH w AS (SELECT doc_id, {_SPLIT.format("coalesce(text, '')")} AS ws FROM documents),
      win AS (SELECT doc_id, i, array_to_string(ws[i:i + 12], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS i FROM w WHERE len(ws) >= 13)),
      head AS (SELECT g, min(doc_id) AS f FROM win GROUP BY 1), gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS p FROM win JOIN head USING (g) WHERE f < doc_id),
      each AS (SELECT doc_id, unnest(ws) AS x, unnest(range(1, len(ws) + 1)) AS p FROM w), kept AS (SELECT doc_id, count(*) AS n, string_agg(x, ' ' ORDER BY p) AS t FROM each ANTI JOIN gone USING (doc_id, p) GROUP BY 1)
      SELECT w.doc_id, len(ws) AS n_words, CAST(len(ws) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM w LEFT JOIN kept ON kept.doc_id = w.doc_id""",
    "op12_filter_audit": f"""WITH t AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text, {_SPLIT.format("coalesce(text, '')")} AS ws FROM documents),
      f AS (SELECT part, d.doc_id, len(ws) < 50 AS a, 100 * len(list_distinct(ws)) < 65 * len(ws) AS b, 100 * len(regexp_replace(text, '[^A-Z]', '', 'g')) > 5 * len(text) AS c,
          regexp_matches(text, '[#$%&*|]') AS d, coalesce(d.doc_id > min(d.doc_id) OVER (PARTITION BY text), false) AS e, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic
        FROM t d LEFT JOIN (SELECT doc_id, max(CAST(quality = 1 AS INT)) AS good, max(CAST(toxic = 1 AS INT)) AS toxic FROM labels GROUP BY 1) l ON l.doc_id = d.doc_id),
      k AS (SELECT part, a::INT + 2 * b::INT + 4 * c::INT + 8 * d::INT + 16 * e::INT AS m, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY 1, 2),
      x AS (SELECT unnest(range(5)) AS i),
      o AS (SELECT [a.i, b.i, c.i, d.i, e.i] AS o FROM x a JOIN x b ON b.i <> a.i JOIN x c ON c.i NOT IN (a.i, b.i) JOIN x d ON d.i NOT IN (a.i, b.i, c.i) JOIN x e ON e.i NOT IN (a.i, b.i, c.i, d.i)),
      s AS (SELECT array_to_string(list_transform(o, lambda v: chr(CAST(65 + v AS INT))), '') AS filter_order, s AS step, CAST(1 << o[s] AS BIGINT) AS bit, CAST(coalesce(list_sum(list_transform(o[1:s - 1], lambda v: 1 << v)), 0) AS BIGINT) AS before
        FROM o, (SELECT unnest(range(1, 6)) AS s)),
      y AS (SELECT part, bit, CAST(sum(CASE WHEN m & bit <> 0 THEN n * 120 // bit_count(m) ELSE 0 END) AS BIGINT) AS shapley FROM k, (SELECT DISTINCT bit FROM s) GROUP BY 1, 2)
      SELECT part, filter_order, CAST(step AS INT) AS step, CAST(sum(CASE WHEN m & (before | bit) = 0 THEN n ELSE 0 END) AS BIGINT) AS kept, CAST(sum(CASE WHEN m & bit <> 0 AND m & before = 0 THEN n ELSE 0 END) AS BIGINT) AS removed,
        CAST(sum(CASE WHEN m & bit <> 0 AND m & before <> 0 THEN n ELSE 0 END) AS BIGINT) AS redundant, CAST(sum(CASE WHEN m = bit THEN n ELSE 0 END) AS BIGINT) AS unique_fails,
        CAST(sum(CASE WHEN m & bit <> 0 AND m & before = 0 THEN good ELSE 0 END) AS BIGINT) AS good_lost, CAST(sum(CASE WHEN m & bit <> 0 AND m & before = 0 THEN toxic ELSE 0 END) AS BIGINT) AS toxic_lost, any_value(shapley) AS shapley
      FROM k JOIN y USING (part) JOIN s USING (bit) GROUP BY part, filter_order, step""",
}
