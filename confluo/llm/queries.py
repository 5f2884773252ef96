"""Queries opN_<name> over the driver's tables and their DuckDB SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from confluo.llm import decontam, langid, linededup, media, mixing, neardup, quality, suffixdedup, tokens, warc

#: Vocabulary files of public tokenizers.
TOKENIZERS = "/opt/tokenizers"
VOCABULARY = "byte_bpe_multi_50k.tiktoken"
#: Splits text into letters, digits, other characters and space before merging (fixed value).
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op3_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = media.store(_table(spark, sf_dir, "documents"))
    return media.features(media.load(spark, folder))


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffixdedup.remove_repeats(_table(spark, sf_dir, "documents"), carry=["doc_id"])
    return out.select(
        "doc_id",
        "n_bytes",
        F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"]).alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


OP4_SQL = """
WITH texts AS (
  SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, strlen(coalesce(text, ''))::BIGINT AS n FROM documents
), windows AS (
  SELECT doc_id, p, substr(h, 2 * p + 1, 100) AS s FROM (SELECT doc_id, h, unnest(range(0, n - 49)) AS p FROM texts WHERE n >= 50)
), hits AS (
  SELECT w.doc_id, w.p FROM windows w JOIN (SELECT s, min(doc_id) AS low FROM windows GROUP BY s) f ON w.s = f.s WHERE f.low < w.doc_id
), marked AS (
  SELECT doc_id, p, coalesce(p - lag(p) OVER d > 50, true) AS fresh FROM hits WINDOW d AS (PARTITION BY doc_id ORDER BY p)
), numbered AS (
  SELECT doc_id, p, sum(fresh::INT) OVER (PARTITION BY doc_id ORDER BY p) AS run FROM marked
), runs AS (
  SELECT doc_id, min(p) AS a, max(p) + 50 AS b FROM numbered GROUP BY doc_id, run
), gaps AS (
  SELECT doc_id, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS x, a AS y FROM runs
  UNION ALL SELECT t.doc_id, coalesce(max(r.b), 0), any_value(t.n) FROM texts t LEFT JOIN runs r ON t.doc_id = r.doc_id GROUP BY t.doc_id
), kept AS (
  SELECT g.doc_id, string_agg(substr(t.h, (2 * g.x + 1)::BIGINT, (2 * (g.y - g.x))::BIGINT), '' ORDER BY g.x) AS h
  FROM gaps g JOIN texts t ON g.doc_id = t.doc_id GROUP BY g.doc_id
), totals AS (
  SELECT doc_id, sum(b - a)::BIGINT AS n_removed, count(*) AS n_spans FROM runs GROUP BY doc_id
)
SELECT t.doc_id, t.n AS n_bytes, coalesce(x.n_removed, 0)::BIGINT AS n_removed, coalesce(x.n_spans, 0)::BIGINT AS n_spans, sha256(unhex(k.h)) AS kept_sha256
FROM texts t JOIN kept k ON t.doc_id = k.doc_id LEFT JOIN totals x ON t.doc_id = x.doc_id
"""


def op5_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = neardup.classes(_table(spark, sf_dir, "documents"), shingle=2, percent=80, per_row=True)
    return found.select(F.col("_id").alias("doc_id"), "n_shingles", "component_id", "kept")


OP5_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x20\x09-\x0D]+'), []) AS w FROM documents
), sets AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 2 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) END) AS s FROM words
), grams AS (
  SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets
), coded AS (
  SELECT doc_id, n, dense_rank() OVER (ORDER BY g) AS g FROM grams
), pairs AS (
  SELECT a.doc_id AS x, b.doc_id AS y, a.n AS nx, b.n AS ny, count(*) AS common
  FROM coded a JOIN coded b ON a.g = b.g AND a.doc_id < b.doc_id AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
  GROUP BY ALL
), links AS (
  SELECT x, y FROM pairs WHERE 100 * common >= 80 * (nx + ny - common)
), edges AS (
  SELECT x, y FROM links UNION ALL SELECT y, x FROM links
), reach AS (
  SELECT doc_id AS node, doc_id AS seen FROM documents
  UNION
  SELECT r.node, e.y FROM reach r JOIN edges e ON r.seen = e.x
), lowest AS (
  SELECT node, min(seen) AS component_id FROM reach GROUP BY node
)
SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, l.component_id, s.doc_id = l.component_id AS kept
FROM sets s JOIN lowest l ON s.doc_id = l.node
"""


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    archives = warc.write_archives(_table(spark, sf_dir, "pages"))
    records = warc.resolve_revisits(warc.read_archives(archives))
    return records.select("page_id", "payload_bytes", F.col("digest").alias("payload_digest"), F.col("type").alias("record_type"), "refers_to", "error")


OP6_SQL = """
WITH payloads AS (
  SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS n, sha1(coalesce(html, '')) AS digest FROM pages
), firsts AS (
  SELECT digest, max(page_id) AS first FROM payloads WHERE n >= 1000 GROUP BY digest
), marked AS (
  SELECT p.*, f.first, f.first IS NOT NULL AND p.page_id IS DISTINCT FROM f.first AS again FROM payloads p LEFT JOIN firsts f ON p.digest = f.digest
)
SELECT page_id, n AS payload_bytes, digest AS payload_digest, CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN again THEN first END AS refers_to, NULL::VARCHAR AS error FROM marked
"""


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.count_tokens(_table(spark, sf_dir, "documents"), f"{TOKENIZERS}/{VOCABULARY}", PATTERN)


def op8_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix_sources(_table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


OP8_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents
), totals AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         [1, 2, 3][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::BIGINT AS weight
  FROM sized GROUP BY source
), capped AS (
  SELECT *, source_size * 3 AS capacity, sum(source_size) OVER ()::DOUBLE AS budget, sum(weight) OVER () AS weights,
    coalesce(sum(source_size * 3) OVER w, 0) AS spent, coalesce(sum(weight) OVER w, 0) AS gone,
    row_number() OVER (ORDER BY source_size * 3 / weight, source NULLS LAST) AS place
  FROM totals
  WINDOW w AS (ORDER BY source_size * 3 / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), leveled AS (
  SELECT *, (budget - spent::DOUBLE) / (weights - gone)::DOUBLE AS level FROM capped
), final AS (
  SELECT arg_min(level, place) AS level FROM leveled WHERE capacity > level * weight
), targets AS (
  SELECT source, source_size, coalesce(least(capacity::DOUBLE, f.level * weight), capacity::DOUBLE) AS target
  FROM leveled, final f
), rated AS (
  SELECT s.doc_id, s.size, t.source_size, t.target,
    CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0.0 END AS rate,
    ('0x' || substr(md5('7:' || coalesce(s.doc_id::VARCHAR, 'null')), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target,
  least(floor(rate)::BIGINT * size + floor((rate - floor(rate)) * size + u)::BIGINT, size * 3)::BIGINT AS taken
FROM rated
"""


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = langid.train(docs.where(F.col("doc_id").isNotNull() & ~langid.held_out(F.col("doc_id"))))
    out = langid.identify(docs.withColumn("held_out", langid.held_out(F.col("doc_id"))), model, ["doc_id", "held_out"])
    return out.select("doc_id", "held_out", "lang_pred", "score", "rejected")


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = linededup.dedup_lines(_table(spark, sf_dir, "documents"))
    return out.select(
        "doc_id",
        "n_lines",
        "n_removed",
        F.sha2(F.coalesce(F.encode("kept_text", "UTF-8"), F.encode(F.lit(""), "UTF-8")), 256).alias("kept_sha256"),
    )


OP10_SQL = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos
  FROM documents WHERE text IS NOT NULL
), windows AS (
  SELECT doc_id, pos, line AS a, lead(line, 1) OVER d AS b, lead(line, 2) OVER d AS c
  FROM lines WINDOW d AS (PARTITION BY doc_id ORDER BY pos)
), ranked AS (
  SELECT doc_id, pos, row_number() OVER (PARTITION BY a, b, c ORDER BY doc_id, pos) AS nth
  FROM windows WHERE b IS NOT NULL AND c IS NOT NULL
), gone AS (
  SELECT DISTINCT doc_id, pos + d AS pos FROM ranked, (VALUES (0), (1), (2)) v(d) WHERE nth > 1
), kept AS (
  SELECT l.doc_id, count(*) AS n_lines, count(g.pos) AS n_removed,
         coalesce(string_agg(CASE WHEN g.pos IS NULL THEN l.line END, chr(10) ORDER BY l.pos), '') AS kept
  FROM lines l LEFT JOIN gone g ON l.doc_id = g.doc_id AND l.pos = g.pos GROUP BY l.doc_id
)
SELECT d.doc_id, coalesce(k.n_lines, 0)::BIGINT AS n_lines, coalesce(k.n_removed, 0)::BIGINT AS n_removed,
       sha256(coalesce(k.kept, '')) AS kept_sha256
FROM documents d LEFT JOIN kept k ON d.doc_id = k.doc_id
"""


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grades: 0 toxic, 1 not toxic and of low quality, 2 not toxic and of high quality.

    ``kept`` leaves out what is probably toxic, ``selected`` takes what is probably of high quality.
    """
    docs = _table(spark, sf_dir, "documents")
    grade = F.when(F.col("toxic") == 1, 0).otherwise(1 + F.col("quality"))
    model = quality.train(docs, _table(spark, sf_dir, "labels").select("doc_id", grade.alias("grade")))
    out = quality.score(docs, model, tail_from=1, carry=["doc_id"])
    high = F.coalesce(F.get("above", F.lit(1)), F.lit(0.0))
    return out.select("doc_id", "expected_grade", "tail", (F.col("tail") >= 0.5).alias("kept"), high.alias("high"), (high >= 0.5).alias("selected"))


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.find_matches(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), carry=["doc_id"])
    items = F.array_sort(F.array_distinct(F.transform("items", lambda i: i["item_id"])))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size(items).cast("long").alias("n_items"),
        F.sha2(F.encode(F.array_join(items, ","), "UTF-8"), 256).alias("items_sha256"),
        "contaminated",
    )


OP2_SQL = r"""
WITH doc AS (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS words FROM documents
), item AS (
  SELECT coalesce(item_id::VARCHAR, 'null') AS item_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS words FROM benchmark
), need AS (
  SELECT item_id, words, least(13, len(words)) AS w FROM item WHERE len(words) > 0
), windows AS (
  SELECT DISTINCT item_id, w, words[p : p + w - 1] AS win
  FROM (SELECT item_id, words, w, unnest(range(1, len(words) - w + 2)) AS p FROM need)
), sizes AS (
  SELECT DISTINCT w FROM need
), spots AS (
  SELECT doc_id, w, p, words[p : p + w - 1] AS win
  FROM (SELECT doc_id, words, w, unnest(range(1, len(words) - w + 2)) AS p FROM doc, sizes WHERE len(words) >= w)
), hits AS (
  SELECT s.doc_id, s.p, s.w, i.item_id FROM spots s JOIN windows i ON s.w = i.w AND s.win = i.win
), covered AS (
  SELECT doc_id, count(DISTINCT word) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + w)) AS word FROM hits) GROUP BY doc_id
), named AS (
  SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id, ',' ORDER BY item_id) AS names FROM hits GROUP BY doc_id
)
SELECT d.doc_id, len(d.words)::BIGINT AS n_words, coalesce(c.n_hit, 0)::BIGINT AS n_hit, coalesce(n.n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(n.names, '')) AS items_sha256,
  coalesce(c.n_hit, 0) > 0 AND 20 * coalesce(c.n_hit, 0) >= len(d.words) AS contaminated
FROM doc d LEFT JOIN covered c ON d.doc_id = c.doc_id LEFT JOIN named n ON d.doc_id = n.doc_id
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality": op1_quality,
    "op2_decontaminate": op2_decontaminate,
    "op3_media": op3_media,
    "op4_suffix_dedup": op4_suffix_dedup,
    "op5_near_duplicates": op5_near_duplicates,
    "op6_warc": op6_warc,
    "op7_token_counts": op7_token_counts,
    "op8_mix_sources": op8_mix_sources,
    "op9_language_id": op9_language_id,
    "op10_line_dedup": op10_line_dedup,
}
ORACLE: dict[str, str] = {"op2_decontaminate": OP2_SQL, "op4_suffix_dedup": OP4_SQL, "op5_near_duplicates": OP5_SQL, "op6_warc": OP6_SQL, "op8_mix_sources": OP8_SQL, "op10_line_dedup": OP10_SQL}
