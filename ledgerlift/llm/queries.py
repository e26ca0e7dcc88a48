"""Named queries of the training-data operators, each over its whole table, and their SQL for DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

import corpus_pipeline

from ..session import shared_dir, ship_package
from . import audit, binary, codes, counting, ensemble, jaccard, minhash, mixing, naming, packing, repeats, rules, toxicity
from .store import documents, in_fold, labels

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function as query, with SQL where SQL can say it."""
    def put(build: Callable[[SparkSession, str], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship_package(spark)
            return build(spark, sf_dir)

        QUERIES[build.__name__] = run
        if sql:
            ORACLES[build.__name__] = sql
        return build
    return put


@query()
def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pieces_digest(packing.pack(documents(spark, sf_dir)))


@query()
def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = toxicity.toxicity_model(docs, labels(spark, sf_dir), ~in_fold("doc_id", 3, 1))
    scored = toxicity.score(docs, model, keep=["doc_id"])
    return scored.select("doc_id", in_fold("doc_id", 3, 1).alias("held_out"), "score",
                         F.when(F.col("score") >= 0.7, 1).otherwise(0).alias("predicted"))


@query("""
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))""")
def op3_block_naming(spark: SparkSession, sf_dir: str) -> DataFrame:
    return naming.exact_groups(documents(spark, sf_dir)).drop("row")


@query(r"""
WITH sizes AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
         md5('17:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || coalesce(source, '')) AS key FROM documents),
keyed AS (SELECT doc_id, source, size, CAST('0x' || substr(key, 1, 3) AS BIGINT) AS high, CAST('0x' || substr(key, 4, 3) AS BIGINT) AS low FROM sizes),
sources AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, 1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS weight
            FROM keyed GROUP BY source),
sorted AS (SELECT *, 3 * source_size AS cap, sum(source_size) OVER () AS total,
                  coalesce(sum(3 * source_size) OVER w, 0) AS spent, sum(weight) OVER () - coalesce(sum(weight) OVER w, 0) AS free_w,
                  row_number() OVER (ORDER BY 3.0 * source_size / weight, source NULLS LAST) AS k
           FROM sources WHERE source_size > 0
           WINDOW w AS (ORDER BY 3.0 * source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
level AS (SELECT CAST(total - spent AS DOUBLE) / CAST(free_w AS DOUBLE) AS level FROM sorted
          WHERE weight * (CAST(total - spent AS DOUBLE) / CAST(free_w AS DOUBLE)) <= cap ORDER BY k LIMIT 1),
shares AS (SELECT source, source_size, CASE WHEN source_size > 0 THEN least(CAST(3 * source_size AS DOUBLE), CAST(weight AS DOUBLE) * level) ELSE 0.0 END AS target
           FROM sources, level),
plan AS (SELECT *, CAST(CASE WHEN source_size > 0 THEN least(floor(target / source_size), 3) ELSE 0 END AS BIGINT) AS whole FROM shares),
rest AS (SELECT *, greatest(CAST(round(target - whole * source_size) AS BIGINT), 0) AS extra FROM plan),
groups AS (SELECT source, high, low, CAST(sum(size) AS BIGINT) AS gsize,
                  CAST(sum(sum(size)) OVER (PARTITION BY source ORDER BY high, low) AS BIGINT) AS upto FROM keyed GROUP BY source, high, low),
cut AS (SELECT g.source, g.high, g.low, g.gsize, CASE WHEN upto <= extra THEN gsize ELSE greatest(extra - (upto - gsize), 0) END AS take
        FROM groups g JOIN rest r ON g.source IS NOT DISTINCT FROM r.source)
SELECT k.doc_id, k.size, r.source_size, r.target,
       CAST(k.size * r.whole + CASE WHEN c.gsize > 0 THEN k.size * c.take // c.gsize ELSE 0 END AS BIGINT) AS taken
FROM keyed k JOIN rest r ON k.source IS NOT DISTINCT FROM r.source
JOIN cut c ON c.source IS NOT DISTINCT FROM k.source AND c.high = k.high AND c.low = k.low""")
def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


@query()
def op4_vertical_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.similar_groups(documents(spark, sf_dir)).select("doc_id", "n_shingles", "component_id")


@query(corpus_pipeline.ORACLE_SQL)
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_pipeline.run(spark, sf_dir)


@query(r"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
words AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w,
                 [x FOR x IN string_split(text, chr(10)) IF regexp_matches(x, '[^\x20\x09-\x0D]')] AS l FROM docs),
places AS (SELECT r, w, unnest(range(1, len(w) - 3)) AS pos FROM words WHERE len(w) >= 5),
windows AS (SELECT r, pos, w[pos:pos + 4] AS win FROM places),
twice AS (SELECT r, pos FROM windows QUALIFY count(*) OVER (PARTITION BY r, win) > 1),
covered AS (SELECT r, count(DISTINCT pos + o) AS n FROM twice, (SELECT unnest(range(0, 5)) AS o) GROUP BY r),
base AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(list_sum([length(x) FOR x IN w]), 0) AS BIGINT) AS word_chars,
                CAST(len(regexp_extract_all(text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
                CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words
         FROM words LEFT JOIN covered USING (r)),
judged AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM base)
SELECT *, NOT (base_failed OR 10 * n_symbols > n_words OR 20 * n_dup_lines > n_words OR word_chars < 2 * n_words OR word_chars > 25 * n_words) AS kept
FROM judged""")
def op8_quality_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    cascade = rules.order_rules(docs, rules.default_rules())
    base = rules.with_base(docs).withColumn("base_failed", rules.base_failed())
    return rules.apply_rules(base, cascade).drop("failed_rule")


@query()
def op5_rule_ensemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = ensemble.fit(docs, labels(spark, sf_dir), ~in_fold("doc_id", 4, 2))
    return ensemble.score(docs, model, ["doc_id"]).select(
        "doc_id", in_fold("doc_id", 4, 2).alias("held_out"), "score", F.when(F.col("score") >= 0.7, 1).otherwise(0).alias("predicted"))


@query()
def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counting.token_counts(documents(spark, sf_dir)).withColumn("over_limit", F.col("n_tokens") > 1024)


@query()
def op2_range_coder(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_dir(spark, "llm-ids")
    binary.write_ids(documents(spark, sf_dir), path)
    return binary.ids_digest(binary.read_ids(spark, path))


@query()
def op7_induced_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.remove_repeats(documents(spark, sf_dir)).select(
        "doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


@query()
def op11_tensored_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_groups(documents(spark, sf_dir)).select("doc_id", "n_shingles", "component_id", "kept")


@query(r"""
WITH first AS (SELECT coalesce(text, '') AS t, min(doc_id) AS least FROM documents GROUP BY 1),
marks AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic
          FROM labels GROUP BY doc_id),
docs AS (SELECT d.doc_id, coalesce(d.source, '') AS part, coalesce(d.text, '') AS t, regexp_extract_all(coalesce(d.text, ''), '[^\x20\x09-\x0D]+') AS w,
                coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic
         FROM documents d LEFT JOIN marks m ON m.doc_id = d.doc_id),
judged AS (SELECT part, good, toxic,
                  CASE WHEN len(w) < 200 THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 'B' ELSE '' END
                  || CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * length(t) THEN 'C' ELSE '' END
                  || CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END || CASE WHEN doc_id > least THEN 'E' ELSE '' END AS fails
           FROM docs JOIN first USING (t)),
masks AS (SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM judged GROUP BY part, fails),
f AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
orders AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM f a, f b, f c, f d, f e
           WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
steps AS (SELECT filter_order, CAST(step AS INTEGER) AS step, filter_order[step] AS x, substr(filter_order, 1, step - 1) AS before
          FROM orders, (SELECT unnest(range(1, 6)) AS step)),
met AS (SELECT part, filter_order, step, x, n, good, toxic, fails, contains(fails, x) AS here, translate(fails, before, '') != fails AS gone
        FROM steps, masks),
counted AS (SELECT part, filter_order, step, x, sum(CASE WHEN NOT here AND NOT gone THEN n ELSE 0 END) AS kept,
                   sum(CASE WHEN here AND NOT gone THEN n ELSE 0 END) AS removed, sum(CASE WHEN here AND gone THEN n ELSE 0 END) AS redundant,
                   sum(CASE WHEN fails = x THEN n ELSE 0 END) AS unique_fails, sum(CASE WHEN here AND NOT gone THEN good ELSE 0 END) AS good_lost,
                   sum(CASE WHEN here AND NOT gone THEN toxic ELSE 0 END) AS toxic_lost FROM met GROUP BY part, filter_order, step, x)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
       CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
       CAST(sum(removed) OVER (PARTITION BY part, x) AS BIGINT) AS shapley FROM counted""")
def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.audit(documents(spark, sf_dir), labels(spark, sf_dir))


def _codebook_sql() -> str:
    """The three assignments and two updates one after another."""
    steps = []
    for i in range(3):
        steps.append(f"""
near{i} AS (SELECT r, p, any_value(v) AS v, min({{'far': far, 'e': e}}) AS best
            FROM (SELECT r, p, v, e, list_sum(list_transform(range(1, len(v) + 1), lambda j: (v[j] - w[j]) * (v[j] - w[j]))) AS far
                  FROM pieces JOIN book{i} USING (p)) GROUP BY r, p)""")
        if i < 2:
            steps.append(f"""
mean{i} AS (SELECT p, e, list(m ORDER BY j) AS w FROM (
              SELECT p, best.e AS e, j, CAST(floor(sum(v[j]) / count(*)) AS BIGINT) AS m
              FROM near{i}, (SELECT unnest(range(1, (SELECT max(len(v)) FROM pieces) + 1)) AS j) GROUP BY ALL) GROUP BY p, e),
book{i + 1} AS (SELECT b.p, b.e, coalesce(m.w, b.w) AS w FROM book{i} b LEFT JOIN mean{i} m USING (p, e))""")
    return f"""
WITH kept AS (SELECT row_number() OVER (ORDER BY vec_id NULLS LAST) AS r, vec_id, label,
                     list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q
              FROM embeddings WHERE embedding IS NOT NULL
              AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pieces AS (SELECT r, p, q[p * len(q) // 16 + 1:(p + 1) * len(q) // 16] AS v FROM kept, (SELECT unnest(range(0, 16)) AS p)),
book0 AS (SELECT p, r - 1 AS e, v AS w FROM pieces WHERE r <= 64),{','.join(steps)},
digest AS (SELECT sha256(string_agg(array_to_string(w, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM book2),
coded AS (SELECT r, string_agg(printf('%02x', best.e), '' ORDER BY p) AS code, CAST(sum(best.far) AS BIGINT) AS error FROM near2 GROUP BY r)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256
FROM kept JOIN coded USING (r), digest"""


@query(_codebook_sql())
def op12_dual_tree_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codes.compress(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
