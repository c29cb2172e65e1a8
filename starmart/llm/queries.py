"""The registered queries of the operators, over the given tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from starmart.llm.divergence import source_divergence
from starmart.llm.filter_audit import audit_filters
from starmart.llm.language_model import score_texts
from starmart.llm.ngram_join import ngram_classes
from starmart.llm.packing import pack
from starmart.llm.quality import score_quality
from starmart.llm.quality_rules import quality_rules
from starmart.llm.quotes import reply_order
from starmart.llm.secrets import dictionary_of, scan_secrets
from starmart.llm.store import new_folder, table
from starmart.llm.tiling import contaminated
from starmart.llm.token_files import read_tokens, write_tokens
from starmart.llm.topk import top_k
from starmart.llm.urls import judge_urls

Query = Callable[[SparkSession, str], DataFrame]

TOKENIZER = "word_bpe_49k.json"


def tokenizer_path() -> str:
    import public_tokenizers

    return str(public_tokenizers.path(TOKENIZER))


def op1_exact_topk(spark: SparkSession, folder: str) -> DataFrame:
    """The five highest inner products for every vector whose id is divisible by 50."""
    whole = F.transform("embedding", lambda x: F.floor(256 * x.cast("double")).cast("long"))
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = table(spark, folder, "embeddings").filter(F.col("embedding").isNotNull() & finite).select(
        F.col("vec_id").alias("id"),
        F.sequence(F.lit(0).cast("long"), F.size("embedding").cast("long")).alias("places"),
        whole.alias("all"),
    )
    # Zero weights are left out of the index.
    rows = rows.withColumn("some", F.filter(F.arrays_zip("places", "all"), lambda x: x["all"] != 0)).select(
        "id", F.transform("some", lambda x: x["places"]).alias("terms"), F.transform("some", lambda x: x["all"]).alias("weights")
    )
    found = top_k(rows, rows.filter(F.col("id") % 50 == 0), 5)
    return found.select("query_id", "rank", F.col("id").alias("vec_id"), "score")


def op2_token_files(spark: SparkSession, folder: str) -> DataFrame:
    files = new_folder(spark, "tokens")
    parts = write_tokens(table(spark, folder, "documents"), files, tokenizer_path(), end_id=1, vocabulary=49_408)
    return read_tokens(parts, files, vocabulary=49_408)


def op3_quotation_linking(spark: SparkSession, folder: str) -> DataFrame:
    messages = reply_order(table(spark, folder, "conversations"))
    return messages.select(
        "conv_id", "turn", "reply_to", "thread", "depth", "n_quotes", "n_linked",
        F.length("text").cast("long").alias("n_chars"), F.crc32(F.col("text").cast("binary")).alias("text_crc32"),
    )


def op4_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return contaminated(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def op5_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    found = scan_secrets(table(spark, folder, "documents"), dictionary=dictionary_of(tokenizer_path()))
    return found.select("doc_id", "nth", "start", F.length("candidate").alias("length"), "secret")


def op6_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    return judge_urls(table(spark, folder, "pages"))


def op7_quality(spark: SparkSession, folder: str) -> DataFrame:
    return score_quality(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op8_deleted_interpolation(spark: SparkSession, folder: str) -> DataFrame:
    return score_texts(table(spark, folder, "documents"), order=3)


def op9_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    return pack(table(spark, folder, "documents"), tokenizer_path(), end_id=0, capacity=2048)


def op10_ngram_jaccard(spark: SparkSession, folder: str) -> DataFrame:
    return ngram_classes(table(spark, folder, "documents"), words=4, percent=85)


def op11_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    return quality_rules(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op12_source_divergence(spark: SparkSession, folder: str) -> DataFrame:
    return source_divergence(table(spark, folder, "documents"))


def op13_filter_audit(spark: SparkSession, folder: str) -> DataFrame:
    return audit_filters(table(spark, folder, "documents"), table(spark, folder, "labels"))


QUERIES: dict[str, Query] = {
    "op1_exact_topk": op1_exact_topk,
    "op2_token_files": op2_token_files,
    "op3_quotation_linking": op3_quotation_linking,
    "op4_decontamination": op4_decontamination,
    "op5_secret_scan": op5_secret_scan,
    "op6_url_filter": op6_url_filter,
    "op7_quality": op7_quality,
    "op8_deleted_interpolation": op8_deleted_interpolation,
    "op9_best_fit_packing": op9_best_fit_packing,
    "op10_ngram_jaccard": op10_ngram_jaccard,
    "op11_quality_rules": op11_quality_rules,
    "op12_source_divergence": op12_source_divergence,
    "op13_filter_audit": op13_filter_audit,
}

ORACLES: dict[str, str] = {
    "op10_ngram_jaccard": r"""
        WITH RECURSIVE d AS (
          SELECT doc_id, regexp_extract_all(
            translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
          FROM documents
        ),
        s AS (
          SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
            ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) END AS grams
          FROM d
        ),
        n AS (SELECT doc_id, len(grams) AS n FROM s),
        x AS (SELECT doc_id, unnest(grams) AS gram FROM s),
        shared AS (
          SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM x a JOIN x b ON a.gram = b.gram AND a.doc_id <> b.doc_id GROUP BY ALL
        ),
        links AS (
          SELECT a, b FROM shared JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b
          WHERE 100 * shared.n >= 85 * (na.n + nb.n - shared.n)
        ),
        reach AS (SELECT a AS node, b AS other FROM links UNION SELECT r.node, l.b FROM reach r JOIN links l ON r.other = l.a),
        low AS (SELECT node, min(other) AS other FROM reach GROUP BY node),
        degree AS (SELECT a, count(*) AS n FROM links GROUP BY a)
        SELECT n.doc_id, CAST(n.n AS BIGINT) AS n_shingles, least(n.doc_id, coalesce(low.other, n.doc_id)) AS component_id,
          CAST(coalesce(degree.n, 0) AS BIGINT) AS n_links
        FROM n LEFT JOIN low ON low.node = n.doc_id LEFT JOIN degree ON degree.a = n.doc_id
    """,
    "op1_exact_topk": """
        WITH v AS (
          SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS w
          FROM embeddings
          WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
            AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ),
        s AS (
          SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.w, c.w) AS BIGINT) AS score
          FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0
        ),
        r AS (
          SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS n FROM s
        )
        SELECT query_id, CAST(n AS INTEGER) AS rank, vec_id, score FROM r WHERE n <= 5
    """,
    "op12_source_divergence": r"""
        WITH d AS (
          SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text
          FROM documents
        ),
        w AS (
          SELECT lang, source, row, unnest(regexp_extract_all(
            translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term
          FROM d
        ),
        lang_terms AS (
          SELECT lang, term, CAST(count(*) AS HUGEINT) AS n FROM w GROUP BY lang, term HAVING count(DISTINCT row) >= 10
        ),
        langs AS (SELECT lang, CAST(count(*) AS HUGEINT) AS v, sum(n) AS n FROM lang_terms GROUP BY lang),
        counts AS (
          SELECT w.lang, w.source, w.term, CAST(count(*) AS HUGEINT) AS n FROM w JOIN lang_terms USING (lang, term)
          GROUP BY w.lang, w.source, w.term
        ),
        groups AS (
          SELECT g.lang, g.source, coalesce(s.n, 0) + 2 * coalesce(l.v, 0) AS whole
          FROM (SELECT DISTINCT lang, source FROM d) g
          LEFT JOIN (SELECT lang, source, sum(n) AS n FROM counts GROUP BY lang, source) s USING (lang, source)
          LEFT JOIN langs l USING (lang)
        ),
        p AS (
          SELECT g.lang, g.source, t.term, 1 + (1000000000 * (coalesce(c.n, 0) + 2)) // g.whole AS p
          FROM groups g JOIN lang_terms t USING (lang) LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = t.term
        ),
        pair_value AS (
          SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value
          FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY a.lang, a.source, b.source
        ),
        pairs AS (
          SELECT a.lang, a.source, b.source AS item, coalesce(v.value, 0) AS value
          FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
          LEFT JOIN pair_value v ON v.lang = a.lang AND v.source = a.source AND v.item = b.source
        ),
        q AS (SELECT t.lang, t.term, 1 + (1000000000 * (t.n + 2)) // (l.n + 2 * l.v) AS q FROM lang_terms t JOIN langs l USING (lang)),
        terms AS (
          SELECT c.lang, c.source, c.term AS item, (p.p - q.q) * (p.p - q.q) // (p.p + q.q) AS value
          FROM counts c JOIN p USING (lang, source, term) JOIN q USING (lang, term) WHERE p.p > q.q
        ),
        both_parts AS (SELECT *, 'pair' AS part FROM pairs UNION ALL SELECT *, 'term' AS part FROM terms),
        ranked AS (
          SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item)) AS n FROM both_parts
        )
        SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(n AS INTEGER) AS rank
        FROM ranked WHERE part = 'pair' OR n <= 10
    """,
    "op13_filter_audit": r"""
        WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents),
        w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS words FROM d),
        l AS (SELECT doc_id, max(CAST(quality = 1 AS INT)) AS good, max(CAST(toxic = 1 AS INT)) AS toxic FROM labels GROUP BY doc_id),
        m AS (
          SELECT w.part, coalesce(l.good, 0) AS good, coalesce(l.toxic, 0) AS toxic,
            CAST(len(words) < 100 AS INT)
            + 2 * CAST(100 * len(list_distinct(words)) < 80 * len(words) AS INT)
            + 4 * CAST(100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 10 * length(t) AS INT)
            + 8 * CAST(regexp_matches(t, '[#$%&*|]') AS INT)
            + 16 * CAST(coalesce(w.doc_id > min(w.doc_id) OVER (PARTITION BY t), false) AS INT) AS mask
          FROM w LEFT JOIN l ON l.doc_id = w.doc_id
        ),
        h AS (SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM m GROUP BY part, mask),
        f AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x, unnest([1, 2, 4, 8, 16]) AS bit),
        o AS (
          SELECT a.x || b.x || c.x || e.x || g.x AS filter_order, [a.bit, b.bit, c.bit, e.bit, g.bit] AS bits
          FROM f a, f b, f c, f e, f g WHERE a.bit | b.bit | c.bit | e.bit | g.bit = 31
        ),
        s AS (
          SELECT filter_order, step, bits[step] AS bit, CAST(coalesce(list_sum(bits[1:step - 1]), 0) AS INT) AS before
          FROM o, (SELECT unnest([1, 2, 3, 4, 5]) AS step)
        ),
        r AS (
          SELECT h.part, s.filter_order, s.step, s.bit,
            sum(CASE WHEN h.mask & (s.before | s.bit) = 0 THEN h.n ELSE 0 END) AS kept,
            sum(CASE WHEN h.mask & s.bit > 0 AND h.mask & s.before = 0 THEN h.n ELSE 0 END) AS removed,
            sum(CASE WHEN h.mask & s.bit > 0 AND h.mask & s.before > 0 THEN h.n ELSE 0 END) AS redundant,
            sum(CASE WHEN h.mask = s.bit THEN h.n ELSE 0 END) AS unique_fails,
            sum(CASE WHEN h.mask & s.bit > 0 AND h.mask & s.before = 0 THEN h.good ELSE 0 END) AS good_lost,
            sum(CASE WHEN h.mask & s.bit > 0 AND h.mask & s.before = 0 THEN h.toxic ELSE 0 END) AS toxic_lost
          FROM h, s GROUP BY h.part, s.filter_order, s.step, s.bit
        )
        SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed,
          CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost,
          CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, bit) AS BIGINT) AS shapley
        FROM r
    """,
}
