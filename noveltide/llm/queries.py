"""The registered queries of the training-data operators, with their DuckDB twins where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .line_dedup import dedup_lines

    kept = dedup_lines(_read(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .bpe import decode, encode

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    both = decode(encode(_read(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN), path)
    return both.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .packing import pack

    packed = pack(_read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import fit, score

    docs = _read(spark, sf_dir, "documents")
    return score(docs, fit(docs, _read(spark, sf_dir, "labels")))


def op5_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ppm import score

    remainder = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5
    found = score(_read(spark, sf_dir, "documents"), remainder != 1)
    held_out = F.coalesce(remainder == 1, F.lit(False)).alias("held_out")
    return found.select("doc_id", held_out, "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op6_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .embed_dedup import near_vectors

    return near_vectors(_read(spark, sf_dir, "embeddings"))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sharding import shard_documents

    rows = shard_documents(_read(spark, sf_dir, "documents"))
    return rows.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .jaccard import similar_documents

    found = similar_documents(_read(spark, sf_dir, "documents"), width=3, percent=90)
    return found.select("doc_id", "n_shingles", "component_id")


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .suffix_dedup import dedup_passages

    found = dedup_passages(_read(spark, sf_dir, "documents").select("doc_id", "text"), 50)
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import assess, fit

    docs = _read(spark, sf_dir, "documents")
    return assess(docs, fit(docs, _read(spark, sf_dir, "labels")))


def op11_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .url_filter import RULES, judge

    return judge(_read(spark, sf_dir, "pages"), RULES).select("page_id", "host", "path", "rule", "verdict")


def op12_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .phrases import collocations

    return collocations(_read(spark, sf_dir, "documents"))


def op13_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .search import build_index, search

    return search(build_index(_read(spark, sf_dir, "documents")), _read(spark, sf_dir, "benchmark"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    f.__name__: f
    for f in (
        op1_line_dedup,
        op2_byte_bpe,
        op3_packing,
        op4_toxicity,
        op5_lm_scoring,
        op6_embedding_dedup,
        op7_sharding,
        op8_jaccard_join,
        op9_suffix_dedup,
        op10_quality_rules,
        op11_url_filter,
        op12_phrases,
        op13_search,
        pipeline,
    )
}

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_TERM = "[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"
_SPACE = "concat(' ', chr(9), chr(10), chr(11), chr(12), chr(13))"

#: Components of an edge list e(a, b) over nodes v(id), as c(id, component_id).
_COMPONENTS = """
w AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
r AS (SELECT id, id AS o FROM v UNION SELECT r.id, w.b FROM r JOIN w ON r.o = w.a),
c AS (SELECT id, min(o) AS component_id FROM r GROUP BY id)
"""

ORACLES = {
    "op1_line_dedup": f"""
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents
), k AS (SELECT doc_id, pos, line, {_LOWER.format(f"trim(line, {_SPACE})")} AS key FROM l),
g AS (SELECT key, max(doc_id) AS keep FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
j AS (SELECT k.doc_id, pos, line, g.keep IS NOT NULL AND g.keep <> k.doc_id AS gone FROM k LEFT JOIN g ON k.key = g.key)
SELECT doc_id, count(*) AS n_lines, count_if(gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM j GROUP BY doc_id
""",
    "op6_embedding_dedup": f"""
WITH RECURSIVE u AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS x FROM embeddings
), p AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.label = b.label AND a.vec_id < b.vec_id AND list_cosine_similarity(a.x, b.x) >= 0.98
), e AS (SELECT a, b FROM p), v AS (SELECT vec_id AS id FROM u), {_COMPONENTS},
n AS (SELECT a, count(*) AS n FROM (SELECT a FROM p UNION ALL SELECT b FROM p) GROUP BY a)
SELECT c.id AS vec_id, coalesce(n.n, 0) AS n_links, component_id, c.id = component_id AS kept FROM c LEFT JOIN n ON n.a = c.id
""",
    "op8_jaccard_join": f"""
WITH RECURSIVE t AS (
  SELECT doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\\x20\\x09-\\x0D]+') AS ws FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')]
    ELSE list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2]) END) AS g FROM t
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
b AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS both_n FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM b JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * both_n >= 90 * (x.n + y.n - both_n)),
v AS (SELECT doc_id AS id FROM documents), {_COMPONENTS}
SELECT t.doc_id, coalesce(n.n, 0) AS n_shingles, component_id FROM t LEFT JOIN n ON n.doc_id = t.doc_id JOIN c ON c.id = t.doc_id
""",
    "op12_phrases": f"""
WITH t AS (
  SELECT doc_id, coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array({_LOWER.format("coalesce(text, '')")}, '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents
), w AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS ws FROM t),
n AS (SELECT lang, sum(len(ws)) AS n FROM w GROUP BY lang),
g AS (
  SELECT lang, k, array_to_string(ws[i : i + k - 1], ' ') AS phrase FROM (
    SELECT lang, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM w, (SELECT unnest([1, 2, 3, 4]) AS k)
  )
), f AS (SELECT lang, k, phrase, count(*) AS f FROM g GROUP BY lang, k, phrase HAVING count(*) >= 30),
c AS (SELECT lang, k AS size, phrase, f AS a, string_split(phrase, ' ') AS ws FROM f WHERE k >= 2),
s AS (
  SELECT c.lang, c.phrase, c.a, c.k, l.f AS l, r.f AS r, CAST(2000000 AS HUGEINT) * c.a // (CAST(l.f AS HUGEINT) + r.f) AS score
  FROM (SELECT *, unnest(range(1, size)) AS k FROM c) c
  JOIN f l ON l.lang = c.lang AND l.phrase = array_to_string(ws[1 : c.k], ' ')
  JOIN f r ON r.lang = c.lang AND r.phrase = array_to_string(ws[c.k + 1 : size], ' ')
), best AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
o AS (
  SELECT lang, array_to_string(ws[i : i + m - 1], ' ') AS phrase, max(a) AS around FROM (
    SELECT *, unnest(range(1, size - m + 2)) AS i FROM (SELECT *, unnest(range(2, size)) AS m FROM c WHERE size > 2)
  ) GROUP BY ALL
), kept AS (
  SELECT best.* FROM best LEFT JOIN o ON o.lang = best.lang AND o.phrase = best.phrase WHERE around IS NULL OR 100 * CAST(around AS HUGEINT) < 80 * CAST(a AS HUGEINT)
)
SELECT kept.lang, row_number() OVER (PARTITION BY kept.lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, CAST(n.n AS BIGINT) AS n, CAST(score AS BIGINT) AS score
FROM kept JOIN n ON n.lang = kept.lang QUALIFY rank <= 2000
""",
    "op13_search": f"""
WITH t AS (
  SELECT doc_id, unnest(regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '{_TERM}')) AS term FROM documents
), tf AS (SELECT doc_id, term, count(*) AS tf FROM t GROUP BY ALL),
dl AS (SELECT doc_id, count(*) AS n FROM t GROUP BY ALL),
k AS (SELECT count(*) AS n_docs, CAST(sum(n) AS BIGINT) AS total FROM dl),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY ALL),
w AS (SELECT term, CAST(floor(1000 * ln((2 * n_docs + 2) / (2 * df + 1))) AS BIGINT) AS w FROM df, k),
m AS (SELECT doc_id, 75 + (25 * n * n_docs) // total AS m FROM dl, k),
q AS (SELECT item_id, unnest(regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '{_TERM}')) AS term FROM benchmark),
s AS (
  SELECT item_id, tf.doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 12 * m))) AS BIGINT) AS score
  FROM q JOIN tf ON tf.term = q.term JOIN w ON w.term = q.term JOIN m ON m.doc_id = tf.doc_id GROUP BY ALL
)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM s WHERE score > 0 QUALIFY rank <= 20
""",
}
