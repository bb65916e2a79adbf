"""The registered queries of the training-data operators.

Each takes (spark, sf_dir) and runs over its whole tables. Vocabulary files are
named by the environment variable LOGGROVE_TOKENIZERS or, without it, by the
``public_tokenizers`` package.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

from loggrove.llm.common import fresh_path


def vocabulary(name: str) -> str:
    """Path of a tokenizer file on every machine."""
    folder = os.environ.get("LOGGROVE_TOKENIZERS")
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from loggrove.llm.token_counts import token_counts

    counts = token_counts(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), fresh_path(spark, "token-cache"))
    return counts.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 512).alias("over_limit"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loggrove.llm.quality import fit_quality, score_quality

    docs = table(spark, sf_dir, "documents")
    return score_quality(docs, fit_quality(docs, table(spark, sf_dir, "labels")))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from loggrove.llm.line_dedup import dedup_lines

    found = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_removed", F.char_length("text").cast("long").alias("n_chars"), F.char_length("new_text").cast("long").alias("kept_chars"), F.sha2("new_text", 256).alias("kept_sha256"))


def op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loggrove.llm.fingerprints import fingerprint_table

    return fingerprint_table(table(spark, sf_dir, "documents"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loggrove.llm.packing import pack

    return pack(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"), end_id=1)


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loggrove.llm.decontamination import contaminations

    return contaminations(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loggrove.llm.warc import round_trip

    return round_trip(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op8_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loggrove.llm.near_duplicates import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"), shingle_words=4)


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loggrove.llm.license_scan import scan_licenses

    return scan_licenses(table(spark, sf_dir, "documents")).drop("passages")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loggrove.llm.toxicity import fit_toxicity, score_toxicity

    docs = table(spark, sf_dir, "documents")
    return score_toxicity(docs, fit_toxicity(docs, table(spark, sf_dir, "labels")))


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from loggrove.llm.fill_middle import fill_in_middle, restore

    filled = fill_in_middle(table(spark, sf_dir, "documents"))
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    return filled.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest(F.col("output")).alias("output_sha256"), digest(restore(F.col("output"), F.col("form"))).alias("restored_sha256"))


def op12_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loggrove.llm.centroids import cluster_vectors

    return cluster_vectors(table(spark, sf_dir, "embeddings"))


def op13_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from loggrove.llm.suffix_dedup import without_repeats

    return without_repeats(table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_token_counts,
        op2_quality,
        op3_line_dedup,
        op4_fingerprints,
        op5_packing,
        op6_decontamination,
        op7_warc,
        op8_near_duplicates,
        op9_license_scan,
        op10_toxicity,
        op11_fill_in_middle,
        op12_centroids,
        op13_suffix_dedup,
    )
}

_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
# five hexadecimal digits are twenty bits, or four signs of base 32
_SIGNS = " || ".join(f"substr('{_BASE32}', CAST(((('0x' || substr(h, {5 * k + 1}, 5))::BIGINT >> {shift}) & 31) + 1 AS BIGINT), 1)" for k in range(8) for shift in (15, 10, 5, 0))



def _centroid_sql(rounds: int = 10) -> str:
    """Lloyd's rounds as a chain of common table expressions."""
    nearest = """SELECT x.r, arg_min(x.c, struct_pack(d := x.d, c := x.c)) AS c, min(x.d) AS d FROM (SELECT v.r, m.c, sum((v.x - m.x) * (v.x - m.x)) AS d FROM v JOIN m{} m ON m.i = v.i GROUP BY v.r, m.c) x GROUP BY x.r"""
    parts = [
        """w AS MATERIALIZED (SELECT vec_id, row_number() OVER (ORDER BY sha256('3:' || vec_id), vec_id) AS r, list_transform(embedding, lambda e: CAST(floor(1024 * CAST(e AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
 WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0)""",
        "v AS MATERIALIZED (SELECT r, unnest(range(64)) AS i, unnest(x) AS x FROM w)",
        "m0 AS MATERIALIZED (SELECT r - 1 AS c, i, x FROM v WHERE r <= 8)",
    ]
    for k in range(rounds):
        parts.append(f"a{k} AS MATERIALIZED ({nearest.format(k)})")
        parts.append(f"s{k} AS MATERIALIZED (SELECT a.c, v.i, sum(v.x) AS s, count(*) AS n FROM v JOIN a{k} a ON a.r = v.r GROUP BY a.c, v.i)")
        # the remainder is taken off first, as // cuts towards zero
        parts.append(f"m{k + 1} AS MATERIALIZED (SELECT m.c, m.i, CASE WHEN s.n IS NULL THEN m.x ELSE CAST((s.s - ((s.s % s.n) + s.n) % s.n) // s.n AS BIGINT) END AS x FROM m{k} m LEFT JOIN s{k} s ON s.c = m.c AND s.i = m.i)")
    parts.append(f"f AS MATERIALIZED ({nearest.format(rounds)})")
    parts.append(f"h AS (SELECT c, sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY i)) AS h FROM m{rounds} GROUP BY c)")
    return f"""WITH {", ".join(parts)}
 SELECT w.vec_id, CAST(f.c AS INTEGER) AS cluster, CAST(f.d AS BIGINT) AS distance, CAST(sum(f.d) OVER (PARTITION BY f.c) AS BIGINT) AS cluster_inertia, CAST(sum(f.d) OVER () AS BIGINT) AS inertia, h.h AS centroid_sha256
 FROM w JOIN f ON f.r = w.r JOIN h ON h.c = f.c"""


#: The other operators learn, tokenize, sketch or edit, which SQL cannot state;
#: tests/llm holds them against brute force.
ORACLE_SQL: dict[str, str] = {
    "op7_warc": f"""WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
 m AS (SELECT *, max(page_id) OVER (PARTITION BY html) AS last FROM p)
 SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, {_SIGNS} AS payload_digest, CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> last THEN last END AS refers_to FROM m""",
    "op11_fill_in_middle": r"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u, sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
 g AS (SELECT *, len(u) AS n, ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2, ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4 FROM d),
 c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b, CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 50 THEN 'plain' WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM g),
 p AS (SELECT *, coalesce(array_to_string(u[1:a], ''), '') AS prefix, coalesce(array_to_string(u[a + 1:b], ''), '') AS middle, coalesce(array_to_string(u[b + 1:], ''), '') AS suffix FROM c)
 SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN CAST(length(prefix) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(middle) AS BIGINT) END AS middle_chars,
 sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256, sha256(t) AS restored_sha256 FROM p""",
    "op12_centroids": _centroid_sql(),
    # bytes as two hexadecimal digits each
    "op13_suffix_dedup": """WITH d AS MATERIALIZED (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, CAST(strlen(coalesce(text, '')) AS BIGINT) AS n FROM documents),
 p AS (SELECT doc_id, h, unnest(range(0, n - 99)) AS s FROM d),
 q AS (SELECT doc_id, s, row_number() OVER (PARTITION BY substr(h, 2 * s + 1, 200) ORDER BY doc_id, s) AS k FROM p),
 g AS (SELECT doc_id, s, CASE WHEN s <= lag(s) OVER (PARTITION BY doc_id ORDER BY s) + 100 THEN 0 ELSE 1 END AS new FROM q WHERE k > 1),
 i AS (SELECT doc_id, s, sum(new) OVER (PARTITION BY doc_id ORDER BY s) AS i FROM g),
 r AS (SELECT doc_id, min(s) AS a, max(s) + 100 AS b FROM i GROUP BY doc_id, i),
 c AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS o FROM r),
 k AS (SELECT c.doc_id, sum(b - a) AS n_removed, count(*) AS n_spans, string_agg(substr(h, 2 * o + 1, 2 * (a - o)), '' ORDER BY a) || substr(any_value(h), 2 * max(b) + 1) AS h FROM c JOIN d ON d.doc_id = c.doc_id GROUP BY c.doc_id)
 SELECT d.doc_id, d.n AS n_bytes, CAST(coalesce(k.n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(k.n_spans, 0) AS BIGINT) AS n_spans, sha256(unhex(coalesce(k.h, d.h))) AS kept_sha256 FROM d LEFT JOIN k ON k.doc_id = d.doc_id""",
    "op8_near_duplicates": """WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \t\n\x0b\x0c\r]+'), lambda x: x <> '') AS w FROM documents),
 s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) < 4 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) END) AS g FROM w),
 n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
 l AS (SELECT x.doc_id AS a, y.doc_id AS b FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id JOIN n p ON p.doc_id = x.doc_id JOIN n q ON q.doc_id = y.doc_id GROUP BY x.doc_id, y.doc_id, p.n, q.n HAVING 100 * count(*) >= 80 * (p.n + q.n - count(*))),
 r AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
 SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least(d.doc_id, coalesce(c.b, d.doc_id)) AS component_id, d.doc_id <= coalesce(c.b, d.doc_id) AS kept
 FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN (SELECT a, min(b) AS b FROM r GROUP BY a) c ON c.a = d.doc_id""",
}
