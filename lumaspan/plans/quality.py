"""Queries of image quality and pair verdicts: part stands for images, pairs of neighbours by key in a brand for candidate pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumaspan.functions import pairs as P
from lumaspan.functions import quality as Q
from lumaspan.tables import table

QUERIES, SQL = {}, {}


def query(sql: str):
    def register(f):
        QUERIES[f.__name__] = f
        SQL[f.__name__] = sql
        return f
    return register


FORMATS = ("PNG", "JPEG", "WEBP", "TIFF", "GIF", "BMP", "JPG", "AVIF")
IMAGE_SQL = f"""im AS (SELECT p_partkey AS id, p_brand AS grp, p_name || p_partkey % 7 AS path, p_size % 5 * 100 AS w, 100 AS h, CASE WHEN p_size % 3 = 0 THEN 16 ELSE 8 END AS bit_depth, p_size % 2 = 0 AS lossless,
CASE WHEN p_partkey % 3 > 0 THEN p_partkey % 5 END AS quant, CASE WHEN p_partkey % 3 > 0 THEN 90 - p_partkey % 5 END AS jpeg_quality, [{', '.join(repr(f) for f in FORMATS)}][p_partkey % 8 + 1] AS format,
CAST(p_partkey % 4 AS DOUBLE) AS sharpness, p_partkey % 6 / 10.0::DOUBLE AS noise, p_partkey % 2 / 10.0::DOUBLE AS blockiness, p_partkey % 9 AS size FROM part)"""


def _images(spark, sf) -> DataFrame:
    k, s = F.col("p_partkey"), F.col("p_size")
    return table(spark, sf, "part").select(
        k.alias("id"), F.col("p_brand").alias("grp"), F.concat("p_name", (k % 7).cast("string")).alias("path"), (s % 5 * 100).alias("w"), F.lit(100).alias("h"), F.when(s % 3 == 0, 16).otherwise(8).alias("bit_depth"),
        (s % 2 == 0).alias("lossless"), F.when(k % 3 > 0, k % 5).cast("double").alias("jpeg_quant_mean"), F.when(k % 3 > 0, 90 - k % 5).alias("jpeg_quality"), F.element_at(F.array(*map(F.lit, FORMATS)), (k % 8 + 1).cast("int")).alias("format"),
        (k % 4).cast("double").alias("sharpness"), (k % 6 / F.lit(10.0)).alias("noise_sigma"), (k % 2 / F.lit(10.0)).alias("blockiness"), (k % 9).alias("size"))


def best_with_reason(images: DataFrame, group: str) -> DataFrame:
    """The best image of each group by the quality key, then path, then id, and the first attribute in which it beats the next of another key
    (else the next by path). Aggregates only: a group is never sorted."""
    row = F.struct(*(c for c in images.columns if c != group))
    keyed = images.withColumn("_key", Q.quality_key()).withColumn("_row", row).withColumn("_place", F.struct("path", "id"))
    heads = keyed.groupBy(group, "_key").agg(F.min_by("_row", "_place").alias("_row"), F.min("_place").alias("_place"))
    best = heads.groupBy(group).agg(F.max_by(F.struct("_key", "_row", "_place"), "_key").alias("_best"))
    other = heads.join(best, group).where(F.col("_key") != F.col("_best._key")).groupBy(group).agg(F.max_by("_row", "_key").alias("_other"))
    same = keyed.join(best, group).where((F.col("_key") == F.col("_best._key")) & (F.col("_place") != F.col("_best._place"))).groupBy(group).agg(F.min_by("_row", "_place").alias("_same"))
    j = best.join(other, group, "left").join(same, group, "left")
    return j.select(group, F.col("_best._row.id").alias("id"), Q.winner_reason(F.col("_best._row"), F.coalesce("_other", "_same")).alias("reason"))


@query(f"""WITH {IMAGE_SQL}, k AS (SELECT *, [w * h, bit_depth, lossless::INT, coalesce(-quant, -1000), CASE format WHEN 'PNG' THEN 6 WHEN 'TIFF' THEN 5 WHEN 'WEBP' THEN 4 WHEN 'GIF' THEN 3 WHEN 'BMP' THEN 2 WHEN 'JPEG' THEN 1 WHEN 'JPG' THEN 1 ELSE 0 END,
ln(1 + sharpness) - 0.12::DOUBLE * noise - 0.08::DOUBLE * blockiness, size]::DOUBLE[] AS q FROM im),
r AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY q DESC, path, id) AS n FROM k), b AS (SELECT * FROM r WHERE n = 1),
o AS (SELECT r.*, row_number() OVER (PARTITION BY r.grp ORDER BY r.q = b.q, r.n) AS m FROM r JOIN b ON b.grp = r.grp WHERE r.n > 1), x AS (SELECT * FROM o WHERE m = 1)
SELECT b.grp, b.id, CASE WHEN x.id IS NULL THEN 'only member' WHEN b.w * b.h <> x.w * x.h THEN 'more pixels' WHEN b.bit_depth <> x.bit_depth THEN 'deeper' WHEN b.lossless <> x.lossless THEN 'lossless' WHEN b.jpeg_quality <> x.jpeg_quality THEN 'finer quantisation'
WHEN b.format <> x.format THEN 'preferred format' WHEN b.noise + 0.05::DOUBLE < x.noise THEN 'less noise' WHEN abs(b.sharpness - x.sharpness) > 1 THEN 'more detail' WHEN b.size <> x.size THEN 'larger file' ELSE 'first path' END AS reason FROM b LEFT JOIN x ON x.grp = b.grp""")
def quality_winners(spark, sf):
    return best_with_reason(_images(spark, sf), "grp")


@query(f"WITH {IMAGE_SQL} SELECT id, format IN ('PNG', 'BMP', 'TIFF', 'GIF') OR (format = 'WEBP' AND id % 3 = 0) AS lossless, CASE WHEN id % 4 < 2 THEN 16 ELSE 8 END AS depth, id % 5 = 2 AS transparent FROM im")
def image_flags(spark, sf):
    """Lossless coding by format or header, bit depth by mode, transparency by any pixel."""
    im = _images(spark, sf)
    header = F.encode(F.concat(F.lit("RIFFxxxxWEBP"), F.when(F.col("id") % 3 == 0, "VP8L").otherwise("VP8 ")), "utf-8")
    mode = F.element_at(F.array(*map(F.lit, ("I;16", "F", "RGB", "L"))), (F.col("id") % 4 + 1).cast("int"))
    alpha = F.when(F.col("id") % 5 == 2, F.array(F.lit(255), F.lit(254))).when(F.col("id") % 5 == 1, F.array(F.lit(255)))
    return im.select("id", Q.is_lossless(F.col("format"), header).alias("lossless"), Q.bit_depth(mode).alias("depth"), Q.is_transparent(alpha).alias("transparent"))


@query("""WITH q AS (SELECT s_suppkey, 1 + s_suppkey * 7 % 100 AS q FROM supplier) SELECT s_suppkey, CAST(CASE WHEN s_suppkey % 5 < 4 THEN q END AS INT) AS quality, CASE WHEN s_suppkey % 5 < 4 THEN 0.0::DOUBLE END AS error FROM q WHERE q < 99 AND q > 4""")
def jpeg_qualities(spark, sf):
    """The quality by which an encoder scaled the standard tables is read back from them."""
    q = F.lit(1) + F.col("s_suppkey") * 7 % 100
    scale = F.when(q < 50, F.floor(F.lit(5000.0) / q * 1e6) / 1e6).otherwise(F.lit(200.0) - 2 * q)
    made = F.array(*(F.transform(F.array(*map(F.lit, t)), lambda b: F.least(F.lit(255.0), F.greatest(F.lit(1.0), F.floor((b * scale + 50) / 100).cast("double")))) for t in Q.standard_tables()))
    tables = F.when(F.col("s_suppkey") % 5 < 4, made).otherwise(F.array(F.array(F.lit(1.0))))
    found = Q.jpeg_quality(tables)
    return table(spark, sf, "supplier").where(q.between(5, 98)).select("s_suppkey", found["quality"].alias("quality"), found["error"].alias("error"))


@query("""WITH b AS (SELECT vec_id, list_transform(embedding[1:16], lambda x: round(1 - abs(x::DOUBLE) * (1 + vec_id % 4), 6)) AS b FROM embeddings)
SELECT vec_id, round(CASE WHEN len(list_filter(b, lambda x: x < 0.8)) <= 6 THEN 0.4 * 0.9 + 0.6 * list_avg(list_reverse_sort(b)[1:12]) ELSE 0.6 * 0.9 + 0.4 * list_avg(b) END, 9) AS score FROM b""")
def review_scores(spark, sf):
    """From 16 block similarities: the twelve best where six or fewer are bad, else all."""
    e = table(spark, sf, "embeddings")
    blocks = F.transform(F.slice("embedding", 1, 16), lambda x: F.round(1 - F.abs(x.cast("double")) * (1 + F.col("vec_id") % 4), 6))
    return e.select("vec_id", F.round(Q.review_score(F.lit(0.9), blocks), 9).alias("score"))


METRICS = {
    "aspect_delta": "id * 7 % 25 / 100.0", "resolution_ratio": "1 + id * 3 % 9 / 20.0 * (id % 2)", "hash_distance": "id * 11 % 26", "sscd_similarity": "CASE WHEN id % 4 > 0 THEN id * 13 % 100 / 100.0 END",
    "dino_similarity": "CASE WHEN id % 5 > 0 THEN id * 17 % 100 / 100.0 END", "edge_similarity": "id * 19 % 70 / 100.0", "geometric_similarity": "id * 23 % 8 / 100.0", "review_score": "0.8 + id * 29 % 20 / 100.0",
    "residual_std": "id * 5 % 90 / 100.0", "residual_edge_correlation": "id * 3 % 12 / 100.0", "noise_sigma_delta": "id * 31 % 40 / 100.0",
}
FLAGS = {"same_size_lossless": "id % 6 = 0", "icc_mismatch": "id % 9 = 0", "alpha_mismatch": "id % 10 = 0"}
PAIR_SQL = "pm AS (SELECT o_orderkey AS id, " + ", ".join(f"CAST({e.replace('id', 'o_orderkey')} AS DOUBLE) AS {c}" for c, e in METRICS.items()) + ", " + ", ".join(f"{e.replace('id', 'o_orderkey')} AS {c}" for c, e in FLAGS.items()) + " FROM orders)"


def _pairs(spark, sf) -> DataFrame:
    """Metrics of made-up pairs, many of them on the bounds."""
    rows = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"))
    return rows.select("id", *(F.expr(f"CAST({e} AS DOUBLE)").alias(c) for c, e in METRICS.items()), *(F.expr(e).alias(c) for c, e in FLAGS.items()))


NOISE = "(resolution_ratio <= 1.05 AND ((residual_std >= 0.45 AND residual_edge_correlation <= 0.05) OR noise_sigma_delta >= 0.25))"
REVIEW = f"(aspect_delta <= 0.03 AND review_score >= 0.88 AND (hash_distance <= 12 OR (hash_distance <= 20 AND review_score >= 0.95 AND (same_size_lossless OR {NOISE}))))"
COPY = "(coalesce(sscd_similarity, -1) >= 0.72 AND aspect_delta <= 0.2)"
STRUCTURE = "(coalesce(dino_similarity, -1) >= 0.82 AND edge_similarity >= 0.32 AND (hash_distance <= 18 OR geometric_similarity >= 0.035) AND aspect_delta <= 0.2)"


@query(f"""WITH {PAIR_SQL} SELECT id, CASE WHEN {COPY} THEN 'L1-SSCD' WHEN {STRUCTURE} THEN 'L2-structure' WHEN {REVIEW} THEN 'L1-pHash' END AS level,
round(CASE WHEN {COPY} THEN sscd_similarity WHEN {STRUCTURE} THEN sqrt(dino_similarity * edge_similarity) WHEN {REVIEW} THEN review_score ELSE 0 END, 6) AS score FROM pm""")
def review_levels(spark, sf):
    level = Q.review_level()
    return _pairs(spark, sf).select("id", level["level"].alias("level"), F.round(level["score"], 6).alias("score"))


@query(f"""WITH {PAIR_SQL} SELECT id FROM pm WHERE (aspect_delta <= 0.005 AND resolution_ratio <= 4.1 AND NOT same_size_lossless AND NOT icc_mismatch AND NOT alpha_mismatch AND coalesce(sscd_similarity, -1) >= 0.94 AND hash_distance <= 20)
OR {COPY} OR (coalesce(dino_similarity, -1) >= 0.82 AND aspect_delta <= 0.2) OR (aspect_delta <= 0.03 AND (hash_distance <= 12 OR (hash_distance <= 20 AND (same_size_lossless OR resolution_ratio <= 1.05))))""")
def gated_pairs(spark, sf):
    """Pairs that could reach a verdict."""
    return _pairs(spark, sf).where(Q.cheap_gate()).select("id")
