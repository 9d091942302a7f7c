"""The registered queries of the operators in this subpackage, with production parameters, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .shared import table


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .secrets import scan

    return scan(table(spark, sf_dir, "documents"))


def op2_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pii import personal_data

    return personal_data(table(spark, sf_dir, "documents"))


def op3_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .html_wrappers import main_text

    return main_text(table(spark, sf_dir, "pages"))


def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .near_dedup import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import quality_scores

    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import toxicity_scores

    return toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import contaminated

    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .chat import fitted, raw_transcripts, rendered

    parts = raw_transcripts(table(spark, sf_dir, "conversations"))
    return rendered(parts.drop("role"), model=fitted(parts)).drop("order")


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sentencepiece_codec import encoded

    return encoded(table(spark, sf_dir, "documents"))


def op9_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .topk import top_k

    vectors = table(spark, sf_dir, "embeddings")
    return top_k(vectors, vectors.where("vec_id % 50 = 0"))


def op11_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sharding import sharded

    return sharded(table(spark, sf_dir, "documents"))


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .fill_in_middle import digests

    return digests(table(spark, sf_dir, "documents"))


def op13_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .importance import resampled

    return resampled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {"op1_secret_scan": op1_secret_scan, "op2_personal_data": op2_personal_data, "op3_html_text": op3_html_text, "op4_near_dedup": op4_near_dedup, "op5_decontamination": op5_decontamination, "op6_chat_format": op6_chat_format, "op7_sentencepiece": op7_sentencepiece, "op8_quality": op8_quality, "op9_top_k": op9_top_k, "op10_toxicity": op10_toxicity, "op11_sharding": op11_sharding, "op12_fill_in_middle": op12_fill_in_middle, "op13_importance": op13_importance}

_CRC_TABLE = "SELECT list_transform(range(256), lambda n: list_reduce([n] || range(8), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END)) AS crc"  # of the reversed polynomial 0xEDB88320
_BYTES = "list_transform(range(1, 2 * octet_length(encode({w})) + 1, 2), lambda i: ('0x' || substr(hex(encode({w})), i, 2))::BIGINT)"
_CRC = f"xor(list_reduce([4294967295::BIGINT] || {_BYTES}, lambda c, b: xor(crc[(xor(c, b) & 255) + 1], c >> 8)), 4294967295)"

ORACLE_SQL = {
    "op9_top_k": """
        WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS x FROM embeddings
                   WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
             s AS (SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.x, c.x), lambda p: p[1] * p[2]))::BIGINT AS score
                   FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
             r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5""",
    "op12_fill_in_middle": r"""
        WITH u AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS units, sha256('7:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
             d AS (SELECT *, len(units)::BIGINT AS n, list_transform([0, 1, 2, 3], lambda k: ('0x' || substr(h, 8 * k + 1, 8))::BIGINT) AS x FROM u),
             c AS (SELECT *, least(x[1] % (n + 1), x[2] % (n + 1)) AS low, greatest(x[1] % (n + 1), x[2] % (n + 1)) AS high,
                          CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR x[3] % 100 >= 100 THEN 'plain' WHEN x[4] % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM d),
             p AS (SELECT *, array_to_string(units[1:low], '') AS prefix, array_to_string(units[low + 1:high], '') AS middle, array_to_string(units[high + 1:n], '') AS suffix FROM c)
        SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
               sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256, sha256(text) AS restored_sha256 FROM p""",
    "op13_importance": rf"""
        WITH texts AS (SELECT coalesce(text, '') AS text, count(*) AS copies, true AS own FROM documents GROUP BY 1 UNION ALL SELECT coalesce(text, ''), count(*), false FROM benchmark GROUP BY 1),
             found AS (SELECT *, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM texts),
             each AS (SELECT text, own, copies, unnest(ws) AS w FROM found), kinds AS (SELECT DISTINCT w FROM each), crcs AS ({_CRC_TABLE}),
             bucket AS (SELECT w, {_CRC.format(w="w")} % 10000 AS b FROM kinds, crcs),
             counts AS (SELECT b, coalesce(sum(copies) FILTER (own), 0)::DOUBLE AS s, coalesce(sum(copies) FILTER (NOT own), 0)::DOUBLE AS t FROM each JOIN bucket USING (w) GROUP BY b),
             sums AS (SELECT sum(s) AS all_s, sum(t) AS all_t FROM counts),
             gain AS (SELECT b, floor(1000 * ln((t + 1) * (all_s + 10000) / ((s + 1) * (all_t + 10000))))::BIGINT AS g FROM counts, sums),
             weighed AS (SELECT text, count(*) AS n, floor(sum(g)::DOUBLE / count(*))::BIGINT AS weight FROM each JOIN bucket USING (w) JOIN gain USING (b) WHERE own GROUP BY text),
             rows AS (SELECT doc_id, coalesce(n, 0) AS n_features, coalesce(weight, 0) AS weight, ('0x' || substr(sha256('2024:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT AS h FROM documents LEFT JOIN weighed ON coalesce(documents.text, '') = weighed.text),
             scored AS (SELECT doc_id, n_features, weight, weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score FROM rows),
             ranked AS (SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) AS r, count(*) OVER (PARTITION BY n_features >= 20) AS c FROM scored)
        SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= 20 AND r <= 10 * c // 100 THEN r END AS rank FROM ranked""",
}
