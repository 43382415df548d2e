"""The registered queries of the corpus operators and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomlake.session import scratch, table

from . import bpe, decontaminate, langid, lm, media, ngram_join, sharding, suffix_dedup, tokenstore, toxicity
from .common import held_out


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    with open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as file:
        vocabulary = file.read()
    decoded = bpe.round_trip(table(spark, sf_dir, "documents"), vocabulary, public_tokenizers.PATTERN)
    return decoded.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("text", 256).alias("decoded_sha256"),
    )


def op2_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    counts, words, parameters = lm.fit(lm.training_rows(docs))
    found = lm.score(docs, counts, words, parameters)
    return found.select("doc_id", held_out("doc_id", 1).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contained(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.withColumn("containment", F.col("n_shared") / F.col("n_shingles"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.train(docs, toxicity.training_labels(table(spark, sf_dir, "labels")))
    return toxicity.score(docs, model).select("doc_id", held_out("doc_id", 0).alias("held_out"), "score", "predicted")


def op5_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = media.write(table(spark, sf_dir, "documents"), scratch(spark, "media"))
    return media.read(stored, tensors=False).drop("tensor")


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = suffix_dedup.dedupe(table(spark, sf_dir, "documents"))
    return done.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op7_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.train(langid.training_rows(docs))
    return langid.identify(docs, model).select("doc_id", held_out("doc_id", 0).alias("held_out"), "lang_pred", "score", "langs", "shares")


def op8_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id", "class_id")


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def op10_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as file:
        definition = file.read()
    path = tokenstore.new_store(spark)
    tokenstore.write(table(spark, sf_dir, "documents"), path, definition)
    return tokenstore.read_all(spark, path)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_bpe": op1_bpe,
    "op2_lm": op2_lm,
    "op3_decontaminate": op3_decontaminate,
    "op4_toxicity": op4_toxicity,
    "op5_media": op5_media,
    "op6_suffix_dedup": op6_suffix_dedup,
    "op7_langid": op7_langid,
    "op8_ngram_join": op8_ngram_join,
    "op9_sharding": op9_sharding,
    "op10_token_store": op10_token_store,
}

#: Words and distinct five-word shingles of a text; fewer words make one shingle of all.
WORDS = "regexp_extract_all(translate({text}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+')"
SHINGLES = "list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(generate_series(1, len(w) - 4), lambda i: array_to_string(w[i:i + 4], ' ')) END)"


def _shingled(name: str, table_: str, key: str) -> str:
    words = WORDS.format(text="coalesce(text, '')")
    return f"{name} AS (SELECT {key}, {SHINGLES} AS s FROM (SELECT {key}, {words} AS w FROM {table_}))"


ORACLE_SQL: dict[str, str] = {
    "op3_decontaminate": f"""
WITH {_shingled("d", "documents", "doc_id")}, {_shingled("b", "benchmark", "item_id")},
du AS (SELECT doc_id, unnest(s) AS g FROM d), bu AS (SELECT item_id, len(s) AS n_shingles, unnest(s) AS g FROM b)
SELECT doc_id, item_id, n_shingles::BIGINT AS n_shingles, count(*) AS n_shared, count(*)::DOUBLE / n_shingles AS containment
FROM du JOIN bu USING (g) GROUP BY doc_id, item_id, n_shingles HAVING count(*) >= 0.75 * n_shingles
""",
    "op6_suffix_dedup": """
WITH d AS MATERIALIZED (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS MATERIALIZED (SELECT doc_id, p, substr(h, 2 * p + 1, 100) AS s FROM (SELECT doc_id, h, unnest(range(len(h) // 2 - 49)) AS p FROM d)),
f AS (SELECT s, min(doc_id) AS first FROM w GROUP BY s),
r AS MATERIALIZED (SELECT doc_id, p FROM w JOIN f USING (s) WHERE doc_id > first),
g AS MATERIALIZED (SELECT DISTINCT doc_id, p + k AS b FROM r, range(50) AS t(k)),
c AS (SELECT doc_id, count(*) AS n_removed, count(*) FILTER (start) AS n_spans FROM (SELECT doc_id, b, b - 1 IS DISTINCT FROM lag(b) OVER (PARTITION BY doc_id ORDER BY b) AS start FROM g) GROUP BY doc_id),
k AS (SELECT doc_id, string_agg(substr(h, 2 * b + 1, 2), '' ORDER BY b) AS left_over FROM (SELECT doc_id, h, unnest(range(len(h) // 2)) AS b FROM d SEMI JOIN c USING (doc_id)) ANTI JOIN g USING (doc_id, b) GROUP BY doc_id)
SELECT doc_id, len(h) // 2 AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
  sha256(unhex(CASE WHEN n_removed IS NULL THEN h ELSE coalesce(left_over, '') END)) AS kept_sha256
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN k USING (doc_id)
""",
    "op8_ngram_join": f"""
WITH RECURSIVE {_shingled("d", "documents", "doc_id")}, u AS MATERIALIZED (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM d),
l AS MATERIALIZED (SELECT a.doc_id AS x, b.doc_id AS y FROM u a JOIN u b USING (g) WHERE a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))),
e AS MATERIALIZED (SELECT a.doc_id AS x, b.doc_id AS y FROM d a JOIN d b ON list_sort(a.s) = list_sort(b.s) WHERE len(a.s) > 0),
r(x, y) AS (SELECT doc_id, doc_id FROM d UNION SELECT r.x, l.y FROM r JOIN l ON l.x = r.y)
SELECT d.doc_id, len(s)::BIGINT AS n_shingles, (SELECT min(y) FROM r WHERE r.x = d.doc_id) AS component_id,
  coalesce((SELECT min(y) FROM e WHERE e.x = d.doc_id), d.doc_id) AS class_id FROM d
""",
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return QUERIES | {"pipeline": pipeline}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE_SQL)
