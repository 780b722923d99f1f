"""Registered queries of the package's operators, and their SQL where there is one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glotsieve.llm import byte_bpe, embedding_tiles, hard_negatives, hilbert, html_subsequence, merkle_manifest, ngram_jaccard, pii_boosting, quality_cnn, suffix_dedup, toxicity_ftrl, url_trie, wu_manber
from glotsieve.llm.common import held_out, table

QUALITY = 0.3  # texts scored below are rejected
TOKENIZER = "byte_bpe_multi_50k.tiktoken"


def byte_bpe_of(spark: SparkSession, name: str = TOKENIZER) -> byte_bpe.ByteBpe:
    import public_tokenizers

    return byte_bpe.ByteBpe(spark, public_tokenizers.path(name), public_tokenizers.PATTERN)


def op1_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_jaccard.near_duplicates(table(spark, sf_dir, "documents"))


def op2_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shards by rows: counts at most one apart, so `grown_shard` is null."""
    placed = hilbert.hilbert_shards(table(spark, sf_dir, "documents"))
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op3_embedding_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_tiles.near_duplicates(table(spark, sf_dir, "embeddings"))


def _judged(scores: DataFrame, least: float) -> DataFrame:
    predicted = (F.col("score") >= least).cast("int").alias("predicted")
    return scores.select("doc_id", held_out("doc_id").alias("held_out"), "score", predicted)


def op4_toxicity_ftrl(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity_ftrl.fit(docs, table(spark, sf_dir, "labels"))
    return _judged(toxicity_ftrl.score(docs, model), 0.5)


def op5_url_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_trie.filter_urls(table(spark, sf_dir, "pages"))


def op6_quality_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality_cnn.fit(docs, table(spark, sf_dir, "labels"))
    return _judged(quality_cnn.score(docs, model), QUALITY)


def op7_pii_boosting(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = pii_boosting.personal_data(docs, pii_boosting.fit(docs))
    counts = [pii_boosting.count_of(F.col("base"), kind).alias(f"n_{kind}") for kind in pii_boosting.KINDS]
    return found.select(
        "doc_id", *counts, F.sha2(pii_boosting.as_text(F.col("base")), 256).alias("base_sha256"),
        pii_boosting.as_text(F.col("spans")).alias("spans"),
    )


def op8_wu_manber(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = wu_manber.benchmark_overlaps(
        table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), unnamed=True
    )
    hits = wu_manber.hit_words(F.col("spans"))
    return found.select(
        "doc_id",
        "n_words",
        hits.alias("n_hit"),
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
        (hits > 0).alias("contaminated"),
    )


def op9_html_subsequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    texts = html_subsequence.extract(pages, html_subsequence.fit(pages))
    return texts.select("page_id", "url", "text", F.length("text").cast("bigint").alias("n_chars"))


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = byte_bpe.encode_documents(table(spark, sf_dir, "documents"), byte_bpe_of(spark))
    return coded.select(
        "doc_id",
        F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op11_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("bigint"), lambda n, x: n + x["end"] - x["start"])
    return found.select(
        "doc_id",
        "n_bytes",
        removed.alias("n_removed"),
        F.size("spans").cast("bigint").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.hard_negatives(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, label=moved)


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    given = [F.col(c) for c in merkle_manifest.COLUMNS]
    changed = [F.col(c) + 1 if c == "n_chars" else F.col(c) for c in merkle_manifest.COLUMNS]
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    presented = F.when(tampered, merkle_manifest.digest(changed)).otherwise(merkle_manifest.digest(given))
    proofs = merkle_manifest.prove(merkle_manifest.build(docs, carry={"presented": presented}))
    text = lambda c: F.lower(F.hex(c))
    folded = merkle_manifest.folded("presented", "steps", "siblings")
    return proofs.select("*", folded.alias("folded")).select(
        F.col("key").alias("doc_id"),
        text("leaf").alias("leaf"),
        text("subroot").alias("subroot"),
        text("root").alias("root"),
        F.sha2(F.concat_ws("", F.transform("siblings", text)), 256).alias("proof_sha256"),
        text("folded").alias("folded_root"),
        (F.col("folded") == F.col("root")).alias("verified"),
    )


QUERIES = {
    "op1_ngram_jaccard": op1_ngram_jaccard,
    "op2_hilbert_shards": op2_hilbert_shards,
    "op3_embedding_tiles": op3_embedding_tiles,
    "op4_toxicity_ftrl": op4_toxicity_ftrl,
    "op5_url_trie": op5_url_trie,
    "op6_quality_cnn": op6_quality_cnn,
    "op7_pii_boosting": op7_pii_boosting,
    "op8_wu_manber": op8_wu_manber,
    "op9_html_subsequence": op9_html_subsequence,
    "op10_byte_bpe": op10_byte_bpe,
    "op11_suffix_dedup": op11_suffix_dedup,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_merkle_manifest": op13_merkle_manifest,
}

SQL: dict[str, str] = {}

SQL["op1_ngram_jaccard"] = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct([array_to_string(w[i:i + 4], ' ') FOR i IN generate_series(1, len(w) - 4)]) END AS s
  FROM words
), grams AS (
  SELECT doc_id, hash(g) AS g, len(s) AS n FROM (SELECT doc_id, s, unnest(s) AS g FROM sets)
), links AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))
), reach AS (
  SELECT a AS doc_id, a AS far FROM links UNION SELECT reach.doc_id, links.b FROM reach JOIN links ON reach.far = links.a
)
SELECT doc_id, len(s)::BIGINT AS n_shingles, least(doc_id, coalesce(low, doc_id)) AS component_id
FROM sets LEFT JOIN (SELECT doc_id, min(far) AS low FROM reach GROUP BY doc_id) USING (doc_id)
"""

SQL["op3_embedding_tiles"] = """
WITH RECURSIVE given AS (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), usable AS (
  SELECT vec_id, e, sqrt(list_dot_product(e, e)) AS norm FROM given WHERE list_dot_product(e, e) > 0
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM usable a JOIN usable b
    ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_dot_product(a.e, b.e) / (a.norm * b.norm) >= 0.95
), reach AS (
  SELECT a AS vec_id, a AS far FROM links
  UNION
  SELECT reach.vec_id, links.b FROM reach JOIN links ON reach.far = links.a
), least AS (
  SELECT vec_id, min(far) AS component_id FROM reach GROUP BY vec_id
), counts AS (
  SELECT a AS vec_id, count(*) AS n_links FROM links GROUP BY a
)
SELECT vec_id, coalesce(n_links, 0) AS n_links, coalesce(component_id, vec_id) AS component_id,
       coalesce(component_id, vec_id) = vec_id AS kept
FROM embeddings LEFT JOIN counts USING (vec_id) LEFT JOIN least USING (vec_id)
"""

SQL["op5_url_trie"] = r"""
WITH given AS (
  SELECT page_id,
         CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest
  FROM pages
), parts AS (
  SELECT page_id,
         translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') AS path
  FROM given
), rules(verdict, rule_host, rule_path) AS (
  VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'),
         ('allow', 'com', '/fr/'), ('block', 'com', '/de/')
), best AS (
  SELECT page_id, any_value(host) AS host, any_value(path) AS path,
         arg_max(rule_host || rule_path, length(rule_host || rule_path)) AS rule,
         arg_max(verdict, length(rule_host || rule_path)) AS verdict
  FROM parts LEFT JOIN rules
    ON (host = rule_host OR suffix(host, '.' || rule_host)) AND starts_with(path, rule_path)
  GROUP BY page_id
)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM best
"""

#: words of a text, lower-cased, as a list
_WORDS = r"""regexp_extract_all(
  translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
  '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"""

SQL["op8_wu_manber"] = f"""
WITH item_words AS (
  SELECT item_id::VARCHAR AS item, {_WORDS} AS w FROM benchmark
), item_windows AS (
  SELECT DISTINCT item, least(10, len(w)) AS n, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS win
  FROM (SELECT item, w, unnest(generate_series(1, greatest(1, len(w) - 9))) AS i FROM item_words WHERE len(w) > 0)
), doc_words AS (
  SELECT doc_id, {_WORDS} AS w FROM documents
), doc_windows AS (
  SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS win
  FROM (
    SELECT doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) AS i
    FROM doc_words, (SELECT DISTINCT n FROM item_windows) WHERE len(w) >= n
  )
), found AS (
  SELECT doc_id, i, n, item FROM doc_windows JOIN item_windows USING (n, win)
), hits AS (
  SELECT doc_id, count(DISTINCT j) AS n_hit
  FROM (SELECT doc_id, unnest(generate_series(i, i + n - 1)) AS j FROM found) GROUP BY doc_id
), named AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, item FROM found) GROUP BY doc_id
)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM doc_words LEFT JOIN hits USING (doc_id) LEFT JOIN named USING (doc_id)
"""

SQL["op11_suffix_dedup"] = """
WITH given AS (
  SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents
), windows AS (
  SELECT doc_id, i, hash(substr(h, 2 * i + 1, 100)) AS w, substr(h, 2 * i + 1, 100) AS s
  FROM (SELECT doc_id, h, unnest(generate_series(0, length(h) // 2 - 50)) AS i FROM given WHERE length(h) >= 100)
), firsts AS (
  SELECT w, s, min(doc_id) AS low FROM windows GROUP BY w, s
), gone AS (
  SELECT DISTINCT doc_id, i FROM windows JOIN firsts USING (w, s) WHERE low < doc_id
), edges AS (
  SELECT doc_id, i AS a, i + 50 AS b,
         coalesce(i > max(i + 50) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS new
  FROM gone
), spans AS (
  SELECT doc_id, min(a) AS a, max(b) AS b
  FROM (SELECT doc_id, a, b, count(*) FILTER (new) OVER (PARTITION BY doc_id ORDER BY a) AS k FROM edges) GROUP BY doc_id, k
), gaps AS (
  SELECT doc_id, b, lead(a) OVER (PARTITION BY doc_id ORDER BY a) AS next, row_number() OVER (PARTITION BY doc_id ORDER BY a) AS k, a
  FROM spans
), kept AS (
  SELECT doc_id, sum(b - a) AS n_removed, count(*) AS n_spans,
         string_agg(CASE WHEN k = 1 THEN substr(h, 1, 2 * a) ELSE '' END
           || substr(h, 2 * b + 1, 2 * (coalesce(next, length(h) // 2) - b)), '' ORDER BY k) AS rest
  FROM gaps JOIN given USING (doc_id) GROUP BY doc_id
)
SELECT doc_id, length(h) // 2 AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0) AS n_spans,
       sha256(unhex(coalesce(rest, h))) AS kept_sha256
FROM given LEFT JOIN kept USING (doc_id)
"""

SQL["op12_hard_negatives"] = """
WITH given AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         [floor(256 * x::DOUBLE) FOR x IN embedding] AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other, a.label = b.label AS same, list_dot_product(a.v, b.v)::BIGINT AS score
  FROM given a JOIN given b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
), positives AS (
  SELECT * FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5
), ranked AS (
  SELECT p.anchor_id, p.other AS positive_id, n.other AS negative_id, p.score AS positive_score, n.score AS negative_score,
         row_number() OVER (PARTITION BY p.anchor_id, p.other ORDER BY n.score DESC, n.other) AS rank
  FROM positives p JOIN scored n ON n.anchor_id = p.anchor_id AND NOT n.same
    AND 80 * p.score <= 100 * n.score AND n.score <= p.score
)
SELECT anchor_id, positive_id, rank::INT AS rank, negative_id, positive_score, negative_score FROM ranked WHERE rank <= 5
"""

SQL["op13_merkle_manifest"] = """
WITH RECURSIVE entries(i, k, v) AS (
  SELECT i, 0, i::BIGINT FROM range(256) r(i)
  UNION ALL
  SELECT i, k + 1, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END FROM entries WHERE k < 8
), crc(doc_id, s, k, v) AS (
  SELECT doc_id, doc_id::VARCHAR, 0, 4294967295::BIGINT FROM documents WHERE doc_id IS NOT NULL
  UNION ALL
  SELECT doc_id, s, crc.k + 1, xor(crc.v >> 8, entries.v)
  FROM crc JOIN entries ON entries.k = 8 AND entries.i = xor(crc.v & 255, ascii(substr(s, crc.k + 1, 1)))
  WHERE crc.k < length(s)
), tampered AS (
  SELECT doc_id FROM crc WHERE k = length(s) AND xor(v, 4294967295) % 7 = 0
), parts AS (
  SELECT doc_id, lang,
    coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-')
      || coalesce(strlen(lang) || ':' || lang, '-') AS a,
    coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') AS n,
    coalesce(strlen((n_chars + 1)::VARCHAR) || ':' || (n_chars + 1), '-') AS n1,
    coalesce(strlen(text) || ':' || text, '-') AS t
  FROM documents
), leaves AS (
  SELECT doc_id, lang, sha256(a || n || t) AS leaf,
    sha256(a || CASE WHEN doc_id IN (SELECT doc_id FROM tampered) THEN n1 ELSE n END || t) AS shown,
    row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST) - 1 AS place, count(*) OVER (PARTITION BY lang) AS n
  FROM parts
), low(lang, k, place, hash, n) AS (
  SELECT lang, 0, place, leaf, n FROM leaves
  UNION ALL
  SELECT lang, k + 1, place // 2, sha256(string_agg(hash, '' ORDER BY place)), (n + 1) // 2
  FROM low WHERE n > 1 GROUP BY lang, k, place // 2, n
), subroots AS (
  SELECT lang, hash, k AS height, row_number() OVER (ORDER BY encode(lang) NULLS FIRST) - 1 AS place, count(*) OVER () AS n
  FROM low WHERE n = 1
), high(k, place, hash, n) AS (
  SELECT 0, place, hash, n FROM subroots
  UNION ALL
  SELECT k + 1, place // 2, sha256(string_agg(hash, '' ORDER BY place)), (n + 1) // 2
  FROM high WHERE n > 1 GROUP BY k, place // 2, n
), root AS (
  SELECT hash AS root, k AS top FROM high WHERE n = 1
), steps AS (
  SELECT doc_id, low.k, low.hash, low.place FROM leaves JOIN low
    ON low.lang IS NOT DISTINCT FROM leaves.lang AND low.place = xor(leaves.place >> low.k, 1)
  UNION ALL
  SELECT doc_id, height + high.k, high.hash, high.place
  FROM leaves JOIN subroots s ON s.lang IS NOT DISTINCT FROM leaves.lang JOIN high ON high.place = xor(s.place >> high.k, 1)
), proofs AS (
  SELECT doc_id, string_agg(hash, '' ORDER BY k) AS siblings FROM steps GROUP BY doc_id
), folds(doc_id, k, hash, ends) AS (
  SELECT doc_id, 0, shown, height + top FROM leaves JOIN subroots s ON s.lang IS NOT DISTINCT FROM leaves.lang, root
  UNION ALL
  SELECT f.doc_id, f.k + 1,
    sha256(CASE WHEN s.hash IS NULL THEN f.hash WHEN s.place % 2 = 0 THEN s.hash || f.hash ELSE f.hash || s.hash END), ends
  FROM folds f LEFT JOIN steps s ON s.doc_id = f.doc_id AND s.k = f.k WHERE f.k < ends
)
SELECT doc_id, leaf, s.hash AS subroot, root, sha256(coalesce(siblings, '')) AS proof_sha256, folds.hash AS folded_root,
       folds.hash = root AS verified
FROM leaves JOIN subroots s ON s.lang IS NOT DISTINCT FROM leaves.lang LEFT JOIN proofs USING (doc_id)
  JOIN folds USING (doc_id), root
WHERE folds.k = folds.ends
"""
