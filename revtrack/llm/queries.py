"""The registered queries of this package: each operator with production parameters over its whole table, and its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import alignment, divergence, jaccard, langid, licenses, mixing, neighbours, ordering, packing, quality, shards, simhash, toxicity, urls
from .common import configure_batches, crc_remainder, rows_of, stage

# --- quality ------------------------------------------------------------------------------------------------------


def op1_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.assess(rows_of(configure_batches(spark), sf_dir, "documents"), "doc_id")
    counts = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    return judged.select("doc_id", *(F.col(f"s.{c}").alias(c) for c in counts), "base_failed", "kept", "distance")


# --- licences -----------------------------------------------------------------------------------------------------


def op2_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = rows_of(configure_batches(spark), sf_dir, "documents")
    return docs.select("doc_id", licenses.scan(F.col("text")).alias("s")).select(
        "doc_id", *(f"s.{c}" for c in ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")),
        F.size("s.spans").cast("long").alias("n_spans"),
    )


# --- toxicity -----------------------------------------------------------------------------------------------------


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = rows_of(configure_batches(spark), sf_dir, "documents").select("doc_id", "text")
    labels = rows_of(spark, sf_dir, "labels").select("doc_id", F.col("toxic").alias("label"))
    model = toxicity.fit(docs, labels.where(crc_remainder(F.col("doc_id"), 5) != 0))
    scored = docs.select(
        "doc_id", F.coalesce(crc_remainder(F.col("doc_id"), 5) == 0, F.lit(False)).alias("held_out"), toxicity.score(model, F.col("text")).alias("score")
    )
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


# --- language identification --------------------------------------------------------------------------------------


def op7_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = rows_of(configure_batches(spark), sf_dir, "documents").select("doc_id", "text", "lang")
    model = langid.fit(docs.where(crc_remainder(F.col("doc_id"), 4) != 2))
    held_out = F.coalesce(crc_remainder(F.col("doc_id"), 4) == 2, F.lit(False))
    return docs.select("doc_id", held_out.alias("held_out"), langid.identify(model, F.col("text")).alias("p")).select("doc_id", "held_out", "p.*")


# --- fingerprints -------------------------------------------------------------------------------------------------


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Beside the contract's columns, `n_near`: for ids divisible by 50, the other rows within the radius."""
    docs = rows_of(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    ranked, after = ordering.with_next(docs, "doc_id", ["text"], ["text"])
    n, third = F.length("text"), F.floor(F.length("text") / 3).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - third), F.substring("next_text", F.lit(1), third))
    both = ranked.select("_range", "_rank", "doc_id", n.cast("long").alias("n_chars"), "text", edited.alias("edited"))
    told = both.select(
        "_range", "_rank", "doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        F.explode(F.array(F.struct(F.lit(0).alias("kind"), F.col("text").alias("body")), F.struct(F.lit(1).alias("kind"), F.col("edited").alias("body")))).alias("v"),
    ).select("_range", "_rank", "doc_id", "n_chars", "edited_sha256", "v.*")
    row = ["_range", "_rank", "doc_id", "n_chars", "edited_sha256"]
    prints = simhash.fingerprints(told, [*row, "kind"], "body")
    prints = stage(prints.groupBy(*row).agg(F.max(F.when(F.col("kind") == 0, F.col("fp"))).alias("fp"), F.max(F.when(F.col("kind") == 1, F.col("fp"))).alias("edited")))
    # The next row's fingerprint: within a range by rank, at its end from the range that follows.
    heads = prints.where(F.col("_rank") == 1).select(F.col("_range").alias("_after"), F.col("fp").alias("_head"))
    heads = stage(after.join(heads, "_after").select("_range", "_head"))
    down = Window.partitionBy("_range").orderBy("_rank")
    following = F.coalesce(F.lead("fp").over(down), F.col("_head"))
    asked = prints.where(F.col("doc_id") % 50 == 0)
    found = simhash.near(asked, prints).groupBy("query").agg(F.sum("n").alias("_near"))
    with_head = prints.join(F.broadcast(heads), "_range")  # a row for each range, see ordering
    out = with_head.select(
        "doc_id", "n_chars", "edited_sha256", simhash.as_text(F.col("fp")).alias("fingerprint"), simhash.as_text(F.col("edited")).alias("edited_fingerprint"),
        simhash.likeness(F.col("fp"), F.col("edited")).alias("near_edited"), simhash.likeness(F.col("fp"), following).alias("near_next"), "fp",
    )
    wanted = F.col("doc_id") % 50 == 0
    return out.join(found, (F.col("fp") == F.col("query")) & wanted, "left").withColumn(
        "n_near", F.when(wanted, F.col("_near") - 1)
    ).drop("fp", "query", "_near")


# --- mixing -------------------------------------------------------------------------------------------------------


def op5_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(rows_of(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", F.col("epochs").cast("long").alias("epochs"))


OP5_SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size, md5('mix-1|' || doc_id) AS k FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size, [5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS w FROM d GROUP BY source
), o AS (
  SELECT *, sum(source_size) OVER () AS total,
    sum(3 * source_size) OVER (ORDER BY source_size * (10 // w), source NULLS LAST ROWS UNBOUNDED PRECEDING) - 3 * source_size AS before,
    sum(w) OVER (ORDER BY source_size * (10 // w), source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest FROM s
), c AS (SELECT *, 3 * source_size * rest <= (total - before) * w AS capped FROM o
), t AS (
  SELECT *, total - coalesce(sum(CASE WHEN capped THEN 3 * source_size END) OVER (), 0) AS open_words, sum(CASE WHEN NOT capped THEN w END) OVER () AS open_weight FROM c
), p AS (
  SELECT source, source_size,
    CASE WHEN capped THEN (3 * source_size)::DOUBLE ELSE (w * open_words)::DOUBLE / open_weight::DOUBLE END AS target,
    (CASE WHEN capped THEN 3 * source_size ELSE (w * open_words) // open_weight END)::BIGINT AS budget FROM t
), r AS (
  SELECT d.doc_id, d.size, p.source_size, p.target, p.budget, CASE WHEN p.source_size > 0 THEN p.budget // p.source_size ELSE 0 END AS epochs,
    sum(d.size) OVER (PARTITION BY d.source ORDER BY d.k, d.doc_id ROWS UNBOUNDED PRECEDING) - d.size AS before
  FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source
)
SELECT doc_id, size, source_size, target, (epochs * size + greatest(0, least(size, budget - epochs * source_size - before)))::BIGINT AS taken,
  epochs::BIGINT AS epochs FROM r
"""

# --- sharding -----------------------------------------------------------------------------------------------------


def op6_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = stage(rows_of(spark, sf_dir, "documents").select(
        "doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32")
    ))
    done = shards.shard(rows, shards.new_store(spark, "documents"), shards=8, order=("text_crc32", "size"))
    return done.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "virtual_slot"
    )


# --- packing ------------------------------------------------------------------------------------------------------


def op8_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = rows_of(configure_batches(spark), sf_dir, "documents")
    return packing.pack(packing.pieces(docs, public_tokenizers.path("word_bpe_49k.json")))


# --- n-gram Jaccard join ------------------------------------------------------------------------------------------


def op9_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = rows_of(configure_batches(spark), sf_dir, "documents")
    return jaccard.classes(docs).select("doc_id", "n_shingles", "component_id")


# --- url filters --------------------------------------------------------------------------------------------------

# Host and path prefix of each rule and its verdict: fixed values.
RULES = {
    ("com", "/en/"): "block",
    ("example.com", "/en/7"): "allow",
    ("net", "/de/"): "allow",
    ("example.net", "/de/8"): "block",
    ("org", "/es/"): "block",
}


def op10_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules first; hosts whose pages are often junk (`urls.junk_hosts` of the whole table) are blocked where no rule decides."""
    rule_keys = spark.createDataFrame([(h + p,) for h, p in RULES], "key string")
    verdicts = F.create_map(*(F.lit(x) for (h, p), v in RULES.items() for x in (h + p, v)))
    crawl = rows_of(configure_batches(spark), sf_dir, "pages").select("page_id", "html", urls.host_of(F.col("url")).alias("host"), urls.path_of(F.col("url")).alias("path"))
    ruled = urls.longest_keys_of(crawl.drop("html"), rule_keys, {len(p) for _, p in RULES}, "rule")
    found = urls.longest_keys_of(ruled, urls.junk_hosts(crawl), {0}, "listed")
    verdict = F.coalesce(F.try_element_at(verdicts, F.col("rule")), F.when(F.col("listed").isNotNull(), F.lit("block")).otherwise(F.lit("allow")))
    return found.select("page_id", "host", "path", "rule", verdict.alias("verdict"), F.col("listed").isNotNull().alias("listed"))


_SQL_RULES = ", ".join(f"('{h}', '{p}', '{v}')" for (h, p), v in RULES.items())
OP10_SQL = rf"""
WITH u AS (
  SELECT page_id, coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path,
    coalesce(html, '') AS html FROM pages
), r(h, p, v) AS (VALUES {_SQL_RULES}),
b AS (
  SELECT host AS h FROM u WHERE host <> '' GROUP BY host
  HAVING 100 * count_if({urls.JUNK_RATIO} * (length(html) - length(translate(html, '{urls.JUNK_SYMBOLS}', ''))) > length(html)) >= {urls.JUNK_PERCENT} * count(*)
),
best AS (
  SELECT page_id, max_by(h || p, length(h || p)) AS rule, max_by(v, length(h || p)) AS v
  FROM u JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY page_id
), listed AS (SELECT DISTINCT page_id FROM u JOIN b ON host = h OR ends_with(host, '.' || h))
SELECT u.page_id, host, path, rule, coalesce(v, CASE WHEN l.page_id IS NULL THEN 'allow' ELSE 'block' END) AS verdict, l.page_id IS NOT NULL AS listed
FROM u LEFT JOIN best USING (page_id) LEFT JOIN listed l ON l.page_id = u.page_id
"""

# --- alignment of tokenizers --------------------------------------------------------------------------------------


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = rows_of(configure_batches(spark), sf_dir, "documents")
    found, _ = alignment.align(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
    return found.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


# --- nearest neighbours -------------------------------------------------------------------------------------------


def op12_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.search(rows_of(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, 20)


# --- divergence of sources ----------------------------------------------------------------------------------------


def op13_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(rows_of(configure_batches(spark), sf_dir, "documents"))


OP13_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents
), o AS (SELECT r, lang, source, term, count(*) AS n FROM (SELECT r, lang, source, unnest(w) AS term FROM d) GROUP BY ALL
), k AS (SELECT lang, term, sum(n)::HUGEINT AS lang_n FROM o GROUP BY ALL HAVING count(*) >= 30
), c AS (SELECT lang, source, term, sum(n)::HUGEINT AS n FROM o SEMI JOIN k USING (lang, term) GROUP BY ALL
), l AS (SELECT lang, count(*)::HUGEINT AS v, sum(lang_n)::HUGEINT AS total FROM k GROUP BY lang
), g AS (
  SELECT lang, source, coalesce(v, 0) AS v, coalesce(total, 0) AS lang_total, coalesce(n, 0)::HUGEINT AS total FROM (SELECT DISTINCT lang, source FROM d)
  LEFT JOIN l USING (lang) LEFT JOIN (SELECT lang, source, sum(n) AS n FROM c GROUP BY ALL) USING (lang, source)
), p AS (
  SELECT lang, source, term, coalesce(n, 0) AS n, 1 + (1000000000 * (coalesce(n, 0) + 5)) // (total + 5 * v) AS p, 1 + (1000000000 * (lang_n + 5)) // (lang_total + 5 * v) AS q
  FROM g JOIN k USING (lang) LEFT JOIN c USING (lang, source, term)
), s AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
), x AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
  UNION ALL SELECT lang, source, 'term', term, p - q FROM p WHERE n > 0 AND p > q
)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank
FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM x) WHERE part = 'pair' OR rank <= 50
"""

QUERIES = {
    "op1_outliers": (op1_outliers, None),
    "op2_licenses": (op2_licenses, None),
    "op3_toxicity": (op3_toxicity, None),
    "op5_mix": (op5_mix, OP5_SQL),
    "op6_slots": (op6_slots, None),
    "op4_simhash": (op4_simhash, None),
    "op7_languages": (op7_languages, None),
    "op8_pack": (op8_pack, None),
    "op9_jaccard": (op9_jaccard, None),
    "op10_urls": (op10_urls, OP10_SQL),
    "op11_alignment": (op11_alignment, None),
    "op12_neighbours": (op12_neighbours, None),
    "op13_divergence": (op13_divergence, OP13_SQL),
}
