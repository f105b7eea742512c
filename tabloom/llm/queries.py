"""The registered queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

import secrets
from collections.abc import Callable
from hashlib import blake2b

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabloom.llm import _core as C
from tabloom.llm import cover_tree, decontaminate, feistel_pii, host_paths, jaccard_join, katz, ppm_language, suffix_dedup, url_markov, vector_packing

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def tokenizer_file(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@query
def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = C.table(spark, sf_dir, "documents")
    model = ppm_language.language_model(docs)
    found = ppm_language.identify(docs.select("doc_id", "text"), model)
    return found.select("doc_id", (ppm_language.fold(F.col("doc_id"), 4) == 2).alias("held_out"), "lang_pred", "score", "bits_per_byte")


@query
def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.join(C.table(spark, sf_dir, "documents"))


WORDS = r"list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '')"
SHINGLES = "CASE WHEN len(t) >= 5 THEN list_transform(range(1, len(t) - 3), lambda i: array_to_string(t[i:i + 4], ' ')) WHEN len(t) > 0 THEN [array_to_string(t, ' ')] ELSE [] END"
SQL["op2_jaccard_join"] = f"""
WITH RECURSIVE w AS (SELECT doc_id AS id, {WORDS} AS t FROM documents), s AS (SELECT DISTINCT id, unnest({SHINGLES}) AS g FROM w), n AS (SELECT id, count(*) AS n FROM s GROUP BY id),
p AS (SELECT a.id AS a, b.id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.id <> b.id GROUP BY 1, 2), e AS (SELECT a, b FROM p JOIN n x ON x.id = a JOIN n y ON y.id = b WHERE 100 * k >= 75 * (x.n + y.n - k)),
r AS (SELECT doc_id AS id, doc_id AS c FROM documents UNION SELECT r.id, e.b FROM r JOIN e ON e.a = r.c)
SELECT r.id AS doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(r.c) AS component_id FROM r LEFT JOIN n ON n.id = r.id GROUP BY r.id
"""


@query
def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.search(C.table(spark, sf_dir, "documents"), C.table(spark, sf_dir, "benchmark"))


SQL["op3_decontaminate"] = f"""
WITH w AS (SELECT 'd' AS kind, doc_id AS id, {WORDS} AS t FROM documents UNION ALL SELECT 'i', item_id, {WORDS} FROM benchmark
), s AS (SELECT DISTINCT kind, id, unnest({SHINGLES}) AS g FROM w
), n AS (SELECT id, count(*) AS n FROM s WHERE kind = 'i' GROUP BY id)
SELECT d.id AS doc_id, i.id AS item_id, any_value(n.n) AS item_shingles, count(*) AS shared_shingles, count(*) / any_value(n.n) AS containment
FROM s d JOIN s i ON d.kind = 'd' AND i.kind = 'i' AND d.g = i.g JOIN n ON n.id = i.id
GROUP BY d.id, i.id HAVING 100 * count(*) >= 75 * any_value(n.n)
"""


_SECRET = secrets.token_bytes(32)


def secret_key(spark: SparkSession) -> bytes:
    """The key of the pseudonyms: that of the session's spark.tabloom.pseudonyms.key, else one drawn for this run and kept nowhere."""
    given = spark.conf.get("spark.tabloom.pseudonyms.key", None)
    return blake2b(given.encode()).digest() if given else _SECRET


@query
def op1_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = feistel_pii.pseudonymise(C.table(spark, sf_dir, "documents").select("doc_id", "text"), secret_key(spark))
    return found.select("doc_id", "text", F.size("pii").cast("long").alias("n_replaced"), F.array_join(F.array_sort(F.array_distinct(F.transform("pii", lambda x: x["kind"]))), ",").alias("kinds"))


#: At most 4096 tokens, 16 pieces and 3968 loss-bearing tokens a sequence; the first of several lines is a prompt, which bears none.
PACKING = vector_packing.Limits(4096, 16, 3968)


@query
def op5_vector_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_packing.pack(C.table(spark, sf_dir, "documents"), tokenizer_file(), limits=PACKING, prompt=vector_packing.first_line, with_ids=False)


@query
def op4_katz_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = C.table(spark, sf_dir, "documents").select("doc_id", "text")
    return katz.score(docs.withColumn("held_out", ppm_language.fold(F.col("doc_id"), 10) == 0), "held_out")


#: The rules of the query's contract.
URL_RULES = [("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/")]


@query
def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_markov.judge(C.table(spark, sf_dir, "pages"), URL_RULES)


@query
def op10_cover_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cover_tree.near_duplicates(C.table(spark, sf_dir, "embeddings"))


@query
def op6_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return host_paths.extract(C.table(spark, sf_dir, "pages"))


@query
def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_dedup.remove_repeats(C.table(spark, sf_dir, "documents"), with_kept=False)
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["length"])
    return found.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), "kept_sha256")


SQL["op10_cover_tree"] = """
WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS x FROM embeddings WHERE label IS NOT NULL),
e AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND list_cosine_similarity(a.x, b.x) >= 0.98),
r AS (SELECT vec_id AS id, vec_id AS c FROM embeddings UNION SELECT r.id, e.b FROM r JOIN e ON e.a = r.c),
k AS (SELECT id, min(c) AS component_id FROM r GROUP BY id)
SELECT k.id AS vec_id, (SELECT count(*) FROM e WHERE e.a = k.id) AS n_links, component_id, k.id = component_id AS kept FROM k
"""
