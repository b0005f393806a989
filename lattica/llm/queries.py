"""The registered queries of the numbered operators, with their production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, cap_filters, decontaminate, fim, html_text, license_scan, lm_score, minhash, prefix_trie, quality, secret_scan, simhash, suffix_dedup
from .textkit import crc_mod, table


def sha256(column: str):
    return F.sha2(F.col(column).cast("binary"), 256)


def op1_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.find_secrets(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", sha256("base_spans").alias("base_sha256"), "spans")


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.deduplicate(table(spark, sf_dir, "documents"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return groups.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_decode(table(spark, sf_dir, "documents"), bpe.default_tokenizer())


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    scored = quality.with_scores(docs.select("doc_id", "text", "n_chars"), model)
    return scored.select("doc_id", (crc_mod("doc_id", 4) == 2).alias("held_out"), "score", (F.col("score") >= quality.THRESHOLD).cast("int").alias("predicted"))


def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan_licenses(table(spark, sf_dir, "documents"))


def op8_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.fingerprint_with_next(table(spark, sf_dir, "documents"))


def op9_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = html_text.extract(table(spark, sf_dir, "pages"))
    return text.select("page_id", "text", F.char_length("text").cast("long").alias("n_chars"))


def op10_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.score_documents(table(spark, sf_dir, "documents"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.conversation_trie(table(spark, sf_dir, "conversations"))


def op12_cap_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cap_filters.near_duplicates(table(spark, sf_dir, "embeddings"))


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fim.digests(fim.fill_in_middle(table(spark, sf_dir, "documents")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_secret_scans": op1_secret_scans,
    "op2_suffix_dedup": op2_suffix_dedup,
    "op3_simhash": op3_simhash,
    "op4_bpe": op4_bpe,
    "op5_decontamination": op5_decontamination,
    "op6_quality": op6_quality,
    "op7_licenses": op7_licenses,
    "op8_minhash": op8_minhash,
    "op9_html": op9_html,
    "op10_lm_score": op10_lm_score,
    "op11_prefix_trie": op11_prefix_trie,
    "op12_cap_filters": op12_cap_filters,
    "op13_fill_in_middle": op13_fill_in_middle,
}

#: DuckDB SQL of the queries that SQL can express.
ORACLES: dict[str, str] = {
    # crc32 bit by bit: each byte of the decimal id is taken in by xor, then eight shifts (marked -1) follow.
    "op11_prefix_trie": """
        WITH t AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) - 1 AS pos FROM conversations WHERE conv_id IS NOT NULL),
        own AS (SELECT conv_id, list({'r': role, 't': text} ORDER BY pos) AS turns FROM t GROUP BY conv_id),
        crc AS (SELECT conv_id, turns, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(range(1, length(conv_id::VARCHAR) + 1), lambda i: [ascii(substr(conv_id::VARCHAR, i::INT, 1))::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
            lambda a, b: CASE WHEN b >= 0 THEN xor(a, b) WHEN a % 2 = 1 THEN xor(a // 2, 3988292384) ELSE a // 2 END)) % 9 AS h FROM own),
        rebuilt AS (SELECT c.conv_id, list_concat(coalesce(f.turns[1:c.h], []), c.turns[c.h + 1:]) AS turns FROM crc c LEFT JOIN own f ON f.conv_id = c.conv_id - c.conv_id % 5),
        steps AS (SELECT conv_id, unnest(range(0, len(turns) + 1)) AS depth, turns FROM rebuilt),
        nodes AS (SELECT turns[1:depth] AS path, depth, min(conv_id) AS conv_id, count(*) AS n_convs, string_agg(CASE WHEN len(turns) = depth THEN conv_id::VARCHAR END, ',' ORDER BY conv_id) AS ends FROM steps GROUP BY ALL),
        named AS (SELECT n.*, p.conv_id AS parent_conv_id, CASE WHEN n.depth = 0 THEN 0 ELSE (n.n_convs - 1) * strlen(n.path[n.depth].t) END AS saved FROM nodes n LEFT JOIN nodes p ON n.depth > 0 AND p.depth = n.depth - 1 AND p.path = n.path[1:n.depth - 1]),
        counted AS (SELECT a.*, (SELECT count(*) FROM named c WHERE c.depth = a.depth + 1 AND c.parent_conv_id = a.conv_id) AS n_children FROM named a),
        up AS (SELECT turns[1:d.depth] AS path, c.depth AS below, c.conv_id AS id FROM rebuilt r, unnest(range(0, len(r.turns) + 1)) AS d(depth), counted c WHERE c.conv_id = r.conv_id AND c.depth >= d.depth AND c.depth <= len(r.turns)),
        sums AS (SELECT u.path, sum(c.saved) AS saved_tokens, count(*) FILTER (WHERE c.n_children = 0) AS n_leaves FROM (SELECT DISTINCT * FROM up) u JOIN counted c ON c.depth = u.below AND c.conv_id = u.id GROUP BY u.path)
        SELECT c.conv_id, c.depth, c.parent_conv_id, c.n_convs, c.n_children, s.n_leaves, s.saved_tokens::BIGINT AS saved_tokens, sha256(coalesce(c.ends, '')) AS ends_sha256 FROM counted c JOIN sums s ON s.path = c.path
    """,
    "op12_cap_filters": """
        WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0 AND len(list_filter(embedding, lambda e: e <> 0)) > 0),
        links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.x) = len(b.x) AND list_cosine_similarity(a.x, b.x) >= 0.9),
        reach AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b),
        least AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a)
        SELECT e.vec_id, (SELECT count(*) FROM links l WHERE l.a = e.vec_id) AS n_links, least.component_id, e.vec_id = least.component_id AS kept FROM embeddings e JOIN least ON least.a = e.vec_id
    """,
    "op13_fill_in_middle": """
        WITH d AS (SELECT doc_id, coalesce(text, '') AS text, sha256('1:' || doc_id::VARCHAR) AS h FROM documents),
        u AS (SELECT *, regexp_extract_all(text, '[A-Za-z]+|[^A-Za-z]') AS units, [('0x' || h[1:8])::UBIGINT, ('0x' || h[9:16])::UBIGINT, ('0x' || h[17:24])::UBIGINT, ('0x' || h[25:32])::UBIGINT] AS r FROM d),
        f AS (SELECT doc_id, text, len(units) AS n, units, least(r[1] % (len(units) + 1), r[2] % (len(units) + 1)) AS lo, greatest(r[1] % (len(units) + 1), r[2] % (len(units) + 1)) AS hi,
            CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR r[3] % 100 >= 90 THEN 'plain' WHEN r[4] % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM u),
        p AS (SELECT *, array_to_string(units[1:lo::BIGINT], '') AS prefix, array_to_string(units[lo::BIGINT + 1:hi::BIGINT], '') AS middle, array_to_string(units[hi::BIGINT + 1:], '') AS suffix FROM f)
        SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
            sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256, sha256(text) AS restored_sha256 FROM p
    """,
}
