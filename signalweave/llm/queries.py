"""Registered queries of the text operators, with SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat_format, decontam, exact_dedup, language_id, line_dedup, lm_scoring, merkle, mixing, resampling, simhash, token_output, toxicity, url_filter
from .common import fold, table


def tokenizer_file() -> str:
    """The public byte-level vocabulary of 50 257 ids."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = fold(F.col("doc_id"), 4) == 2
    found = language_id.classify(docs, language_id.fit(docs, ~held_out), "language")
    return found.select("doc_id", held_out.alias("held_out"), "language.*")


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(table(spark, sf_dir, "documents"))


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").union(extra)
    return chat_format.digests(rows)


def op4_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_output.document_index(token_output.write(table(spark, sf_dir, "documents"), tokenizer_file()))


def op5_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op6_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = fold(F.col("doc_id"), 7) == 2
    found = lm_scoring.scores(docs, ~held_out)
    return found.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"), url_filter.rules_table(spark))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = fold(F.col("doc_id"), 4) == 2
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), ~held_out)
    found = toxicity.score(docs, model, "score")
    return found.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"))


def op11_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    kept = line_dedup.dedup_lines(docs, counts=("n_lines", "n_dropped"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_features", "weight", "score", "rank")


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.digests(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_language_id": op1_language_id,
    "op2_exact_dedup": op2_exact_dedup,
    "op3_chat_format": op3_chat_format,
    "op4_token_output": op4_token_output,
    "op5_simhash_near_dedup": op5_simhash_near_dedup,
    "op6_lm_scoring": op6_lm_scoring,
    "op7_decontamination": op7_decontamination,
    "op8_url_filter": op8_url_filter,
    "op9_mixing": op9_mixing,
    "op10_toxicity": op10_toxicity,
    "op11_line_dedup": op11_line_dedup,
    "op12_importance_resampling": op12_importance_resampling,
    "op13_merkle_manifest": op13_merkle_manifest,
}

ORACLES: dict[str, str] = {
    "op2_exact_dedup": r"""
        WITH t AS (
            SELECT doc_id, length(coalesce(text, '')) AS n_cp,
                   regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm
            FROM documents),
        r AS (
            SELECT *, row_number() OVER (PARTITION BY norm ORDER BY n_cp DESC, doc_id) AS rn,
                   first_value(doc_id) OVER (PARTITION BY norm ORDER BY n_cp DESC, doc_id) AS keep_id,
                   count(*) OVER (PARTITION BY norm) AS group_size
            FROM t)
        SELECT doc_id, keep_id, group_size, rn = 1 AS kept, sha256(norm) AS text_sha256 FROM r
    """,
    "op3_chat_format": """
        WITH t AS (
            SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
            UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]')
        SELECT conv_id, count(*) AS n_turns,
               sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
               CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
               sha256(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn NULLS FIRST, role, text)) AS loss_sha256,
               CAST(sum(length(role || text) + length(regexp_replace(role || text, '[^<\\[\\\\]', '', 'g')) + 24) AS BIGINT) AS formatted_chars
        FROM t GROUP BY conv_id
    """,
    "op8_url_filter": """
        WITH u AS (
            SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
        h AS (
            SELECT page_id, rest, regexp_extract(rest, '^[^/?#]*') AS raw FROM u),
        p AS (
            SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                   regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM h),
        r(rule_host, rule_path, verdict) AS (VALUES
            ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'),
            ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
        m AS (
            SELECT page_id, max_by(struct_pack(rule := rule_host || rule_path, verdict := verdict), length(rule_host || rule_path)) AS best
            FROM p JOIN r ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
            GROUP BY page_id)
        SELECT p.page_id, host, path, best.rule AS rule, coalesce(best.verdict, 'allow') AS verdict
        FROM p LEFT JOIN m USING (page_id)
    """,
    "op9_mixing": r"""
        WITH d AS (
            SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
                   CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) AS hash
            FROM documents),
        s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
        w AS (
            SELECT *, [3.0::DOUBLE, 1.0, 2.0][CAST((row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1 AS INT)] AS weight,
                   source_size * 2.0::DOUBLE AS cap, sum(source_size) OVER () * 1.5::DOUBLE AS budget FROM s),
        l AS (
            SELECT *, (budget - coalesce(sum(cap) OVER (ORDER BY cap / weight, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
                   / sum(weight) OVER (ORDER BY cap / weight, source IS NULL, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
        f AS (SELECT arg_min(level, cap / weight) FILTER (level * weight <= cap) AS level FROM l),
        t AS (
            SELECT source, source_size, coalesce(least(cap, f.level * weight), cap) AS target,
                   CAST(CASE WHEN source_size > 0 THEN floor(coalesce(least(cap, f.level * weight), cap) / source_size) ELSE 0 END AS BIGINT) AS passes
            FROM l, f),
        k AS (
            SELECT source, hash, sum(sum(size)) OVER (PARTITION BY source ORDER BY hash) AS upto, sum(size) AS n FROM d GROUP BY source, hash),
        x AS (
            SELECT k.*, target - passes * source_size AS need FROM k JOIN t ON k.source IS NOT DISTINCT FROM t.source),
        e AS (
            SELECT source, need, arg_min(struct_pack(h := hash, upto := upto, n := n), hash) FILTER (upto >= need) AS hit,
                   arg_max(struct_pack(h := hash, upto := upto, n := n), hash) AS fin FROM x GROUP BY source, need),
        c AS (
            SELECT source, CASE WHEN coalesce(hit, fin).upto - need < need - (coalesce(hit, fin).upto - coalesce(hit, fin).n)
                                THEN coalesce(hit, fin).h + 1 ELSE coalesce(hit, fin).h END AS threshold FROM e)
        SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target, CAST(size * (passes + CASE WHEN hash < threshold THEN 1 ELSE 0 END) AS BIGINT) AS taken
        FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source JOIN c ON d.source IS NOT DISTINCT FROM c.source
    """,
    "op11_line_dedup": r"""
        WITH d AS (
            SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
        l AS (
            SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS pos FROM d),
        k AS (
            SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                                'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
        r AS (
            SELECT key, max(doc_id) AS keep FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
        j AS (
            SELECT doc_id, pos, line, keep IS NOT NULL AND keep <> doc_id AS gone FROM k LEFT JOIN r USING (key))
        SELECT doc_id, count(*) AS n_lines, CAST(count(*) FILTER (gone) AS BIGINT) AS n_dropped,
               sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
        FROM j GROUP BY doc_id
    """,
    "op13_merkle_manifest": """
        WITH RECURSIVE v AS (
            SELECT doc_id, source, CAST(doc_id AS VARCHAR) AS a, CAST(n_chars AS VARCHAR) AS n, lang, text, replace(text, chr(10), '') AS flat FROM documents),
        p AS (
            SELECT doc_id, source, a, flat, text, coalesce(strlen(a) || ':' || a, '-') || coalesce(strlen(source) || ':' || source, '-')
                   || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(n) || ':' || n, '-') AS head FROM v),
        b AS (
            SELECT *, list_reduce(list_transform(range(1, length(a) + 1), lambda i: ascii(substr(a, i, 1))::UBIGINT), lambda c, x:
                       list_reduce(range(8)::UBIGINT[], lambda k, i: xor(k >> 1, CASE WHEN k % 2 = 1 THEN 3988292384::UBIGINT ELSE 0::UBIGINT END), xor(c, x)),
                       4294967295::UBIGINT) AS crc FROM p),
        leaf AS (
            SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS number, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
                   CASE WHEN crc % 2 = 1 THEN sha256(head || coalesce(strlen(flat) || ':' || flat, '-')) END AS claimed FROM b),
        tree AS (
            SELECT source, 0 AS level, number, leaf AS h FROM leaf
            UNION ALL
            SELECT source, any_value(level) + 1, number // 3, sha256(string_agg(h, '' ORDER BY number))
            FROM (SELECT *, count(*) OVER (PARTITION BY source) AS n FROM tree) WHERE n > 1 GROUP BY source, number // 3),
        sub AS (
            SELECT source, row_number() OVER (ORDER BY source IS NOT NULL, source) - 1 AS place, arg_max(h, level) AS subroot, max(level) AS top FROM tree GROUP BY source),
        crown AS (
            SELECT 0 AS level, place, subroot AS h FROM sub
            UNION ALL
            SELECT any_value(level) + 1, place // 3, sha256(string_agg(h, '' ORDER BY place)) FROM (SELECT *, count(*) OVER () AS n FROM crown) WHERE n > 1 GROUP BY place // 3),
        total AS (SELECT arg_max(h, level) AS root FROM crown),
        fold AS (
            SELECT doc_id, source, 0 AS level, number, coalesce(claimed, leaf) AS h, '' AS path FROM leaf
            UNION ALL
            SELECT f.doc_id, any_value(f.source), any_value(f.level) + 1, any_value(f.number) // 3,
                   sha256(string_agg(CASE WHEN t.number = f.number THEN f.h ELSE t.h END, '' ORDER BY t.number)),
                   any_value(f.path) || coalesce(string_agg(t.h, '' ORDER BY t.number) FILTER (t.number <> f.number), '')
            FROM fold f JOIN sub s ON s.source IS NOT DISTINCT FROM f.source AND f.level < s.top
                 JOIN tree t ON t.source IS NOT DISTINCT FROM f.source AND t.level = f.level AND t.number // 3 = f.number // 3
            GROUP BY f.doc_id),
        high AS (
            SELECT f.doc_id, 0 AS level, s.place, f.h, f.path FROM fold f JOIN sub s ON s.source IS NOT DISTINCT FROM f.source AND f.level = s.top
            UNION ALL
            SELECT f.doc_id, any_value(f.level) + 1, any_value(f.place) // 3, sha256(string_agg(CASE WHEN t.place = f.place THEN f.h ELSE t.h END, '' ORDER BY t.place)),
                   any_value(f.path) || coalesce(string_agg(t.h, '' ORDER BY t.place) FILTER (t.place <> f.place), '')
            FROM high f JOIN crown t ON t.level = f.level AND t.place // 3 = f.place // 3 WHERE f.level < (SELECT max(level) FROM crown) GROUP BY f.doc_id),
        done AS (SELECT doc_id, arg_max(h, level) AS folded_root, arg_max(path, level) AS path FROM high GROUP BY doc_id)
        SELECT doc_id, leaf, subroot, root, sha256(path) AS proof_sha256, folded_root, folded_root = root AS verified
        FROM leaf JOIN done USING (doc_id) JOIN sub ON sub.source IS NOT DISTINCT FROM leaf.source, total
    """,
}
