"""The registered queries of the training-data operators: name -> (spark, sf_dir) -> DataFrame, and their SQL."""

from __future__ import annotations

from . import op01_lines, op02_suffix, op03_rules, op04_classifier, op05_jaccard, op06_licenses, op07_mixture, op08_substring, op09_pii, op10_decontamination, op11_spelling, op12_centroids, op13_pieces

WORDS = r"[^\x20\x09-\x0D]+"


def table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_line_dedup(spark, sf_dir):
    return op01_lines.line_digest(table(spark, sf_dir, "documents"))


def op2_suffix_dedup(spark, sf_dir):
    return op02_suffix.suffix_digest(table(spark, sf_dir, "documents"))


def op3_quality_rules(spark, sf_dir):
    return op03_rules.quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_quality_classifier(spark, sf_dir):
    return op04_classifier.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_jaccard_join(spark, sf_dir):
    return op05_jaccard.jaccard_components(table(spark, sf_dir, "documents"))


def op6_license_scan(spark, sf_dir):
    return op06_licenses.license_spans(table(spark, sf_dir, "documents"))


def op7_mixture(spark, sf_dir):
    return op07_mixture.mixture(table(spark, sf_dir, "documents"))


def op8_substring_dedup(spark, sf_dir):
    return op08_substring.substring_digest(table(spark, sf_dir, "documents"))


def op9_pii_spans(spark, sf_dir):
    return op09_pii.pii_spans(table(spark, sf_dir, "documents"))


def op10_decontamination_leaks(spark, sf_dir):
    return op10_decontamination.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_spelling_variants(spark, sf_dir):
    return op11_spelling.spelling_variants(op11_spelling.word_counts(table(spark, sf_dir, "documents"), every=199))


def op12_centroid_clusters(spark, sf_dir):
    return op12_centroids.cluster_digest(table(spark, sf_dir, "embeddings"))


def op13_pieces_encoding(spark, sf_dir):
    import public_tokenizers

    return op13_pieces.encoding_digest(table(spark, sf_dir, "documents"), op13_pieces.read_model(public_tokenizers.path("piece_bpe_32k.model")))


QUERIES = {
    "op1_line_dedup": op1_line_dedup,
    "op2_suffix_dedup": op2_suffix_dedup,
    "op3_quality_rules": op3_quality_rules,
    "op4_quality_classifier": op4_quality_classifier,
    "op5_jaccard_join": op5_jaccard_join,
    "op6_license_scan": op6_license_scan,
    "op7_mixture": op7_mixture,
    "op8_substring_dedup": op8_substring_dedup,
    "op9_pii_spans": op9_pii_spans,
    "op10_decontamination_leaks": op10_decontamination_leaks,
    "op11_spelling_variants": op11_spelling_variants,
    "op12_centroid_clusters": op12_centroid_clusters,
    "op13_pieces_encoding": op13_pieces_encoding,
}

ORACLES = {
    "op1_line_dedup": op01_lines.ORACLE,
    "op7_mixture": op07_mixture.ORACLE,
    "op11_spelling_variants": op11_spelling.ORACLE,
    "op12_centroid_clusters": op12_centroids.ORACLE,
    "op8_substring_dedup": r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
p AS (SELECT doc_id, ws, len(ws) AS n FROM w),
win AS (SELECT doc_id, i, md5(array_to_string(ws[i:i+34], ' ')) AS h FROM p, unnest(range(1, n - 33)) AS u(i)),
rep AS (SELECT h FROM win GROUP BY h HAVING count(*) > 1),
hit AS (SELECT doc_id, i FROM win SEMI JOIN rep USING (h)),
gone AS (SELECT DISTINCT doc_id, j FROM hit, unnest(range(i, i + 35)) AS v(j)),
word AS (SELECT doc_id, i, ws[i] AS word FROM p, unnest(range(1, n + 1)) AS u(i)),
marked AS (SELECT w.doc_id, w.i, w.word, g.j IS NOT NULL AS gone FROM word w LEFT JOIN gone g ON g.doc_id = w.doc_id AND g.j = w.i),
runs AS (SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY i), false) AS opens FROM marked),
kept AS (SELECT doc_id, count(*) FILTER (WHERE gone) AS n_removed, count(*) FILTER (WHERE opens) AS n_spans,
  string_agg(word, ' ' ORDER BY i) FILTER (WHERE NOT gone) AS kept FROM runs GROUP BY doc_id)
SELECT p.doc_id, CAST(p.n AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
  CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans, sha256(coalesce(kept, '')) AS kept_sha256
FROM p LEFT JOIN kept USING (doc_id)""",
}
