"""Image queries. The test data has no pictures; an embedding of 64 numbers becomes an 8x8 picture by rule.

The same rule is written for Spark and in SQL. The set also holds exact copies, pictures with one changed pixel,
unreadable files, blank pictures, and grey, colour and transparent ones.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillage.functions.bits import distance
from tillage.operators import imagecopies, imagesets, rasters
from tillage.operators.labels import dataset_root, unique_names

from .registry import query, table

# ---------------------------------------------------------------- the picture set


def pictures(spark: SparkSession, folder: str) -> DataFrame:
    """path, name, ext, size, corrupted, error, height, width, n_channels, data (and id)."""
    e = table(spark, folder, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("e"))
    kinds = F.concat(
        F.array(F.lit(0)),
        F.when(F.col("vec_id") % 10 == 0, F.array(F.lit(1))).otherwise(F.array().cast("array<int>")),
        F.when(F.col("vec_id") % 15 == 0, F.array(F.lit(2))).otherwise(F.array().cast("array<int>")),
    )
    e = e.withColumn("kind", F.explode(kinds)).withColumn("id", F.col("vec_id") + F.col("kind") * 1_000_000)
    bytes_ = F.expr("""
      flatten(transform(sequence(0, 63), p -> transform(
        array(CASE WHEN vec_id % 4 = 3 THEN 128 ELSE
          CASE WHEN kind = 2 AND p = 0 THEN 255 - int(floor(least(255D, greatest(0D, 100 + 6 * (p % 8) + CASE vec_id % 4 WHEN 0 THEN 255 WHEN 1 THEN 13 ELSE 6 END * e[p]))))
               ELSE int(floor(least(255D, greatest(0D, 100 + 6 * (p % 8) + CASE vec_id % 4 WHEN 0 THEN 255 WHEN 1 THEN 13 ELSE 6 END * e[p])))) END END),
        g -> CASE vec_id % 5 WHEN 0 THEN array(g) WHEN 1 THEN array(g, (g + 40) % 256, 255 - g, CASE WHEN vec_id % 10 = 1 THEN 255 ELSE 200 END)
             WHEN 2 THEN array(g, g, g) ELSE array(g, (g + 40) % 256, 255 - g) END)))""")
    pixels = F.unhex(F.array_join(F.transform(F.flatten(bytes_), lambda v: F.lpad(F.hex(v), 2, "0")), ""))
    ext = F.expr("CASE vec_id % 4 WHEN 0 THEN '.png' WHEN 1 THEN '.jpg' WHEN 2 THEN '.bmp' ELSE '.jpeg' END")
    name = F.concat(F.lpad(F.col("id").cast("string"), 8, "0"), ext)
    broken = F.col("vec_id") % 50 == 49
    nc = F.expr("CASE vec_id % 5 WHEN 0 THEN 1 WHEN 1 THEN 4 ELSE 3 END")
    return e.select(
        "id", "label", F.concat(F.lit("set/"), F.col("label").cast("string"), F.lit("/"), name).alias("path"), name.alias("name"), ext.alias("ext"),
        F.when(broken, 100).otherwise(54 + 64 * nc).cast("long").alias("size"), broken.alias("corrupted"),
        F.when(broken, F.concat(F.lit("undecodable: "), ext)).alias("error"),
        *[F.when(~broken, v).alias(c) for c, v in (("height", F.lit(8)), ("width", F.lit(8)), ("n_channels", nc), ("data", pixels))],
    )


PICTURES = """k AS (SELECT vec_id, label, 0 AS kind FROM embeddings UNION ALL SELECT vec_id, label, 1 FROM embeddings WHERE vec_id % 10 = 0
   UNION ALL SELECT vec_id, label, 2 FROM embeddings WHERE vec_id % 15 = 0),
 f AS (SELECT *, vec_id + kind * 1000000 AS id, CASE vec_id % 4 WHEN 0 THEN '.png' WHEN 1 THEN '.jpg' WHEN 2 THEN '.bmp' ELSE '.jpeg' END AS ext,
   vec_id % 50 = 49 AS corrupted, CASE vec_id % 5 WHEN 0 THEN 1 WHEN 1 THEN 4 ELSE 3 END AS nc FROM k),
 files AS (SELECT id, vec_id, label, kind, ext, corrupted, nc, lpad(id::VARCHAR, 8, '0') || ext AS name, 'set/' || label || '/' || lpad(id::VARCHAR, 8, '0') || ext AS path,
   CASE WHEN corrupted THEN 100 ELSE 54 + 64 * nc END AS size FROM f),
 e AS (SELECT vec_id, unnest(range(64)) AS p, unnest(embedding)::DOUBLE AS e FROM embeddings),
 g AS (SELECT vec_id, p, floor(least(255::DOUBLE, greatest(0::DOUBLE, 100 + 6 * (p % 8) + CASE vec_id % 4 WHEN 0 THEN 255 WHEN 1 THEN 13 ELSE 6 END * e)))::INT AS g FROM e),
 q AS (SELECT id, nc, files.vec_id, p, p % 8 AS x, p // 8 AS y, CASE WHEN files.vec_id % 4 = 3 THEN 128 WHEN kind = 2 AND p = 0 THEN 255 - g ELSE g END AS g
   FROM files JOIN g ON g.vec_id = files.vec_id WHERE NOT corrupted),
 px AS (SELECT id, nc, p, x, y, g AS r, CASE WHEN vec_id % 5 IN (0, 2) THEN g ELSE (g + 40) % 256 END AS gg, CASE WHEN vec_id % 5 IN (0, 2) THEN g ELSE 255 - g END AS b,
   CASE WHEN nc = 4 AND vec_id % 10 <> 1 THEN 200 ELSE 255 END AS al FROM q),
 v AS (SELECT *, (r + gg + b) / 3::DOUBLE AS v, 0.299::DOUBLE * r + 0.587::DOUBLE * gg + 0.114::DOUBLE * b AS w FROM px),
 lap AS (SELECT id, x, y, lag(v, 8) OVER o + lead(v, 8) OVER o + lag(v) OVER o + lead(v) OVER o - 4 * v AS l, lag(w) OVER o AS before, w, v, al, r, gg, b, p
   FROM v WINDOW o AS (PARTITION BY id ORDER BY p)),
 m0 AS (SELECT id, avg(v) AS brightness, stddev_pop(v) AS contrast, var_pop(l) FILTER (x BETWEEN 1 AND 6 AND y BETWEEN 1 AND 6) AS blur_score,
   bool_or(al < 255) AS has_alpha, bool_and(r = gg AND gg = b) AS all_grey,
   coalesce(sum(CASE WHEN x > 0 AND before > w THEN 1::BIGINT << (CASE WHEN x > 0 THEN 63 - p ELSE 0 END)::INT END), 0)::BIGINT AS dhash,
   string_agg(r || ',' || gg || ',' || b || ',' || al, ';' ORDER BY p) AS content FROM lap GROUP BY id),
 m AS (SELECT files.*, brightness, contrast, blur_score, has_alpha, all_grey, dhash,
   CASE WHEN contrast < 1 THEN 'Blank' WHEN blur_score < 100::DOUBLE / 3 THEN 'Very Blurry' WHEN blur_score < 100 THEN 'Blurry' WHEN blur_score IS NOT NULL THEN 'Sharp' END AS state,
   CASE WHEN corrupted THEN NULL WHEN nc = 1 THEN 'Grayscale' WHEN nc = 4 THEN 'RGBA' ELSE 'RGB' END AS color_mode,
   CASE WHEN NOT corrupted AND min(path) OVER (PARTITION BY corrupted, nc, content) <> path THEN min(path) OVER (PARTITION BY corrupted, nc, content) END AS dup_of
   FROM files LEFT JOIN m0 ON m0.id = files.id)"""
WITH_PICTURES = "WITH " + PICTURES + " "


def measured(spark, folder):
    """The set with metrics, state and colour mode."""
    return imagesets.describe(rasters.measure(pictures(spark, folder)))


def reported(spark, folder):
    """The set as the reports need it. Copies are found by the pixels, which stand for the file content."""
    df = imagecopies.exact_copies(measured(spark, folder), "data")
    return df.withColumn("near_of", F.lit(None).cast("string"))


# ---------------------------------------------------------------- diagnostics


@query("i01_i03_metrics", WITH_PICTURES + """SELECT id, round(brightness, 6) AS brightness, round(contrast, 6) AS contrast, round(blur_score, 6) AS blur_score,
   has_alpha, all_grey, dhash FROM m""")
def i01(spark, folder):
    m = rasters.measure(pictures(spark, folder))
    return m.select("id", *[F.round(c, 6).alias(c) for c in ("brightness", "contrast", "blur_score")], "has_alpha", "all_grey", "dhash")


@query("i04_states", WITH_PICTURES + "SELECT id, state FROM m")
def i04(spark, folder):
    return measured(spark, folder).select("id", "state")


@query("i05_color_modes", WITH_PICTURES + """SELECT id, color_mode, CASE WHEN corrupted THEN NULL WHEN has_alpha THEN 'RGBA' WHEN all_grey THEN 'Grayscale' ELSE 'RGB' END AS by_pixels FROM m""")
def i05(spark, folder):
    m = rasters.measure(pictures(spark, folder))
    return m.select("id", imagesets.color_mode().alias("color_mode"), imagesets.color_mode("pixels").alias("by_pixels"))


@query("i06_geometry", WITH_PICTURES + """SELECT id, CASE WHEN NOT corrupted THEN '8x8' END AS resolution, CASE WHEN NOT corrupted THEN 0::DOUBLE END AS megapixels,
   CASE WHEN NOT corrupted THEN 1::DOUBLE END AS aspect_ratio, round(size / 1024::DOUBLE, 2) AS file_size_kb FROM m""")
def i06(spark, folder):
    return measured(spark, folder).select("id", "resolution", "megapixels", "aspect_ratio", "file_size_kb")


DOC_PATH = "lang || '/' || source || '/' || doc_id || '.txt'"


def doc_files(spark, folder):
    return table(spark, folder, "documents").select(
        "doc_id", "lang", "source", F.concat_ws("/", "lang", "source", F.concat(F.col("doc_id").cast("string"), F.lit(".txt"))).alias("path"),
        F.col("text").alias("content"),
    )


@query("i07_exact_copies", f"""WITH d AS (SELECT {DOC_PATH} AS path, sha256(text) AS h FROM documents),
   c AS (SELECT path, min(path) OVER (PARTITION BY h) AS first FROM d) SELECT path, CASE WHEN path <> first THEN first END AS dup_of FROM c""")
def i07(spark, folder):
    return imagecopies.exact_copies(doc_files(spark, folder)).select("path", "dup_of")


@query("i07_picture_copies", WITH_PICTURES + "SELECT path, dup_of FROM m")
def i07_pictures(spark, folder):
    return imagecopies.exact_copies(pictures(spark, folder), "data").select("path", "dup_of")


@query("i08_picture_hash", WITH_PICTURES + "SELECT id, dhash FROM m WHERE NOT corrupted")
def i08(spark, folder):
    return rasters.measure(pictures(spark, folder)).filter(~F.col("corrupted")).select("id", "dhash")


@query("i09_bit_distance", WITH_PICTURES + """SELECT a.id, bit_count(xor(a.dhash, b.dhash))::INT AS bits FROM m a JOIN m b ON b.id = a.vec_id + 2000000 WHERE a.kind = 0 AND NOT a.corrupted AND NOT b.corrupted""")
def i09(spark, folder):
    m = rasters.measure(pictures(spark, folder)).filter(~F.col("corrupted")).select("id", "dhash")
    a, b = m.filter("id < 1000000"), m.filter("id >= 2000000").select((F.col("id") - 2_000_000).alias("id"), F.col("dhash").alias("other"))
    return a.join(b, "id").select("id", distance(F.col("dhash"), F.col("other")).alias("bits"))


@query("i10_similar_pictures", WITH_PICTURES + """, h AS (SELECT dhash AS h, count(*) AS n FROM m WHERE NOT corrupted GROUP BY 1)
  SELECT a.h AS h_a, b.h AS h_b, a.n AS n_a, b.n AS n_b, bit_count(xor(a.h, b.h))::INT AS bits FROM h a JOIN h b ON a.h < b.h WHERE bit_count(xor(a.h, b.h)) <= 5""")
def i10(spark, folder):
    m = rasters.measure(pictures(spark, folder))
    return imagecopies.similar_hashes(imagecopies.distinct_hashes(m), ("n",))


def key_hashes(df, key):
    """A 63-bit hash per key, and for every fourth key a second one with 1 to 8 bits flipped."""
    o = df.select(F.col(key).alias("o_orderkey"), F.md5(F.col(key).cast("string")).alias("m"))
    half = lambda at: F.conv(F.substring("m", at, 8), 16, 10).cast("long")
    h = (half(1) % F.lit(1 << 31)) * F.lit(1 << 32) + half(9)
    flips = F.expr("aggregate(sequence(0L, o_orderkey % 8), 0L, (a, j) -> a ^ shiftleft(1L, int((o_orderkey * 5 + 11 * j) % 63)))")
    both = F.when(F.col("o_orderkey") % 4 == 0, F.array(h, h.bitwiseXOR(flips))).otherwise(F.array(h))
    return o.select("o_orderkey", F.posexplode(both).alias("copy", "dhash")).select(
        (F.col("o_orderkey") * 2 + F.col("copy")).alias("path"), "dhash"
    )


def order_hashes(spark, folder):
    return key_hashes(table(spark, folder, "orders"), "o_orderkey")


ORDER_HASHES = """o AS (SELECT o_orderkey AS k, (('0x' || substr(md5(o_orderkey::VARCHAR), 1, 8))::BIGINT % 2147483648) * 4294967296 + ('0x' || substr(md5(o_orderkey::VARCHAR), 9, 8))::BIGINT AS h FROM orders),
  h0 AS (SELECT k * 2 AS path, h FROM o UNION ALL SELECT k * 2 + 1, xor(h, list_sum(list_transform(range(k % 8 + 1), lambda j: 1::BIGINT << ((k * 5 + 11 * j) % 63)::INT))::BIGINT) FROM o WHERE k % 4 = 0),
  h AS (SELECT h, min(path) AS first, count(*) AS n FROM h0 GROUP BY 1)"""


@query("i10_similar_hashes", f"WITH {ORDER_HASHES} SELECT a.h AS h_a, b.h AS h_b, a.first AS first_a, b.first AS first_b, bit_count(xor(a.h, b.h))::INT AS bits "
       "FROM h a JOIN h b ON a.h < b.h WHERE bit_count(xor(a.h, b.h)) <= 5")
def i10_hashes(spark, folder):
    return imagecopies.similar_hashes(imagecopies.distinct_hashes(order_hashes(spark, folder)), ("first",))


# The look-alikes: in order of the path, a hash is an anchor unless an earlier anchor is near.
WITH_NEAR = WITH_PICTURES.replace("WITH ", "WITH RECURSIVE ", 1) + """, c AS (SELECT path, dhash FROM m WHERE NOT corrupted AND state <> 'Blank' AND dup_of IS NULL),
  u AS (SELECT dhash AS h, min(path) AS first FROM c GROUP BY 1), o AS (SELECT h, first, row_number() OVER (ORDER BY first) AS i FROM u),
  hs AS (SELECT list(h ORDER BY i) AS hs, list(first ORDER BY i) AS firsts FROM o),
  step AS (SELECT 0::BIGINT AS i, []::BIGINT[] AS anchors, NULL::BIGINT AS near
    UNION ALL SELECT n.i, CASE WHEN len(f) > 0 THEN anchors ELSE list_append(anchors, n.i) END, f[1] FROM (
      SELECT s.i + 1 AS i, anchors, list_filter(anchors, lambda a: bit_count(xor(hs[a], hs[s.i + 1])) <= 5) AS f FROM step s, hs WHERE s.i < len(hs)) n),
  nr AS (SELECT c.path, CASE WHEN near IS NULL THEN o.first ELSE firsts[near] END AS near_of FROM c JOIN o ON o.h = c.dhash JOIN step ON step.i = o.i, hs
  WHERE near IS NOT NULL OR c.path <> o.first) """


@query("i11_similar_to", WITH_NEAR + "SELECT path, near_of FROM nr")
def i11(spark, folder):
    df = imagecopies.exact_copies(measured(spark, folder), "data")
    return imagecopies.mark_similar(df).filter(F.col("near_of").isNotNull()).select("path", "near_of")


@query("i12_live_copies", WITH_PICTURES + """, s AS (SELECT * FROM m WHERE state IS DISTINCT FROM 'Very Blurry' AND label <> 3) SELECT path, CASE WHEN dup_of IN (SELECT path FROM s) THEN dup_of END AS dup_of FROM s""")
def i12(spark, folder):
    df = imagesets.remove_states(reported(spark, folder), ["Very Blurry"]).filter("label <> 3")
    return imagecopies.live_links(df, "dup_of").select("path", "dup_of")


@query("i13_image_rows", WITH_NEAR + """SELECT row_number() OVER (ORDER BY m.path) AS "index", m.path, name, ext, CASE ext WHEN '.jpg' THEN 'JPEG' ELSE upper(substr(ext, 2)) END AS format, round(size / 1024::DOUBLE, 2) AS file_size_kb, corrupted, CASE WHEN corrupted THEN 'undecodable: ' || ext END AS error,
   CASE WHEN NOT corrupted THEN 8 END AS width, CASE WHEN NOT corrupted THEN 8 END AS height, CASE WHEN NOT corrupted THEN '8x8' END AS resolution,
   CASE WHEN NOT corrupted THEN 0::DOUBLE END AS megapixels, CASE WHEN NOT corrupted THEN 1::DOUBLE END AS aspect_ratio, color_mode,
   round(brightness, 6) AS brightness, round(blur_score, 6) AS blur_score, state, dup_of, near_of FROM m LEFT JOIN nr ON nr.path = m.path""")
def i13(spark, folder):
    df = imagecopies.mark_similar(reported(spark, folder).drop("near_of"))
    exact = imagesets.image_rows(df).drop("brightness", "blur_score")
    return exact.join(df.select("path", F.round("brightness", 6).alias("brightness"), F.round("blur_score", 6).alias("blur_score")), "path")


@query("i14_set_summary", WITH_PICTURES + """SELECT count(*) AS files, count(*) FILTER (NOT corrupted) AS readable, count(*) FILTER (corrupted) AS corrupted,
   round(count(*) FILTER (corrupted) * 100::DOUBLE / count(*), 2) AS corrupted_pct, round(sum(size) / 1048576::DOUBLE, 2) AS total_mb FROM m""")
def i14(spark, folder):
    return imagesets.set_summary(pictures(spark, folder))


_TALLY = """, t AS (SELECT count(*) AS files, count(*) FILTER (NOT corrupted) AS readable, count(*) FILTER (corrupted) AS corrupted, count(dup_of) AS duplicates,
   count(*) FILTER (color_mode = 'RGB') AS rgb, count(*) FILTER (color_mode = 'Grayscale') AS grayscale, count(*) FILTER (color_mode = 'RGBA') AS rgba,
   count(*) FILTER (state = 'Sharp') AS sharp, count(*) FILTER (state = 'Blurry') AS blurry, count(*) FILTER (state = 'Very Blurry') AS very_blurry, count(*) FILTER (state = 'Blank') AS blank FROM m)"""


@query("i15_color_blur_tallies", WITH_PICTURES + _TALLY + " SELECT rgb, grayscale, rgba, sharp, blurry, very_blurry, blank, readable - duplicates AS unique_images FROM t")
def i15(spark, folder):
    return imagesets.color_blur_tallies(reported(spark, folder))


_PENALTY = _TALLY + """, p AS (SELECT corrupted * 100::DOUBLE / files AS pen_corrupted, duplicates * 100::DOUBLE / readable * 0.6::DOUBLE AS pen_duplicates,
   blurry * 100::DOUBLE / readable * 0.25::DOUBLE AS pen_blurry, very_blurry * 100::DOUBLE / readable * 0.5::DOUBLE AS pen_very_blurry, blank * 100::DOUBLE / readable * 0.5::DOUBLE AS pen_blank,
   (1 - greatest(rgb, grayscale, rgba)::DOUBLE / readable) * 10 AS pen_mixed_colors FROM t) """


@query("i16_set_health", WITH_PICTURES + _PENALTY + """, s AS (SELECT *, greatest(0::DOUBLE, 100 - (pen_corrupted + pen_duplicates + pen_blurry + pen_very_blurry + pen_blank + pen_mixed_colors)) AS raw FROM p)
  SELECT round(raw, 1) AS health, CASE WHEN raw >= 90 THEN 'Excellent' WHEN raw >= 75 THEN 'Good' WHEN raw >= 50 THEN 'Fair' ELSE 'Poor' END AS label,
   round(pen_corrupted, 6) AS pen_corrupted, round(pen_duplicates, 6) AS pen_duplicates, round(pen_blurry, 6) AS pen_blurry, round(pen_very_blurry, 6) AS pen_very_blurry,
   round(pen_blank, 6) AS pen_blank, round(pen_mixed_colors, 6) AS pen_mixed_colors FROM s""")
def i16(spark, folder):
    h = imagesets.set_health(reported(spark, folder))
    return h.select("health", "label", *[F.round(c, 6).alias(c) for c in h.columns if c.startswith("pen_")])


@query("i17_biggest_issue", WITH_PICTURES + _PENALTY + """, s AS (UNPIVOT p ON pen_corrupted, pen_duplicates, pen_blurry, pen_very_blurry, pen_blank, pen_mixed_colors INTO NAME issue VALUE penalty)
  SELECT substr(issue, 5) AS issue, round(penalty, 6) AS penalty FROM s ORDER BY penalty DESC LIMIT 1""")
def i17(spark, folder):
    return imagesets.biggest_issue(reported(spark, folder)).withColumn("penalty", F.round("penalty", 6))


def _detail(name: str, expr: str) -> str:
    return f"""SELECT '{name}' AS detail, round(min({expr}), 2) AS "min", round(max({expr}), 2) AS "max", round(avg({expr}), 2) AS mean, round(median({expr}), 2) AS median FROM m WHERE NOT corrupted"""


@query("i18_detail_stats", WITH_PICTURES + " UNION ALL ".join([
    _detail("width", "8::DOUBLE"), _detail("height", "8::DOUBLE"), _detail("megapixels", "64 / 1000000::DOUBLE"),
    _detail("file_size_kb", "size / 1024::DOUBLE"), _detail("brightness", "brightness"), _detail("blur_score", "blur_score")]))
def i18(spark, folder):
    return imagesets.detail_stats(measured(spark, folder))


@query("i19_tally_ext", WITH_PICTURES + "SELECT ext, count(*) AS n FROM m WHERE NOT corrupted GROUP BY 1")
def i19(spark, folder):
    return imagesets.tally(pictures(spark, folder), "ext")


@query("i19_top_resolutions", WITH_PICTURES + "SELECT '8x8' AS resolution, count(*) AS n FROM m WHERE NOT corrupted")
def i19_resolutions(spark, folder):
    return imagesets.tally(measured(spark, folder), "resolution", imagesets.TOP_RESOLUTIONS)


def cropped(spark: SparkSession, folder: str) -> DataFrame:
    """The set with pictures of six heights: all but the first 3 to 8 lines are cut off."""
    height = (F.col("id") % 1_000_000 % 6 + 3).cast("int")
    rows = F.expr("substring(data, 1, height * width * n_channels)")
    return pictures(spark, folder).withColumn("height", F.when(~F.col("corrupted"), height)).withColumn("data", rows)


@query("i19_most_frequent_sizes", WITH_PICTURES + """, s AS (SELECT '8x' || (vec_id % 6 + 3) AS resolution, count(*) AS n FROM files WHERE NOT corrupted GROUP BY 1)
  SELECT * FROM s ORDER BY n DESC, resolution LIMIT 5""")
def i19_sizes(spark, folder):
    """The five most frequent of six sizes."""
    return imagesets.tally(imagesets.describe(rasters.measure(cropped(spark, folder))), "resolution", imagesets.TOP_RESOLUTIONS)


@query("i18_detail_stats_of_sizes", WITH_PICTURES + """, h AS (SELECT (vec_id % 6 + 3)::DOUBLE AS h FROM files WHERE NOT corrupted)
  SELECT 'height' AS detail, round(min(h), 2) AS "min", round(max(h), 2) AS "max", round(avg(h), 2) AS mean, round(median(h), 2) AS median FROM h""")
def i18_sizes(spark, folder):
    return imagesets.detail_stats(imagesets.describe(rasters.measure(cropped(spark, folder)))).filter(F.col("detail") == "height")


@query("i20_blurry_images", WITH_PICTURES + "SELECT path, state FROM m WHERE state IN ('Blurry', 'Very Blurry') AND contains(lower(path), '/3/')")
def i20(spark, folder):
    return imagesets.search_path(imagesets.with_issue(measured(spark, folder), "blurry"), "/3/").select("path", "state")


@query("i21_issue_counts", WITH_NEAR + _TALLY + " SELECT corrupted, duplicates, (SELECT count(*) FROM nr) AS similar, blurry + very_blurry AS blurry, blank FROM t")
def i21(spark, folder):
    return imagesets.issue_counts(imagecopies.mark_similar(reported(spark, folder).drop("near_of")))


@query("i22_decoded_size", WITH_PICTURES + "SELECT sum(64 * nc)::BIGINT AS decoded_bytes, count(*) FILTER (nc <> 3) AS edited FROM m WHERE NOT corrupted")
def i22(spark, folder):
    done = rasters.to_rgb(pictures(spark, folder)).select("id", "changed")
    return imagesets.decoded_size(pictures(spark, folder).join(done, "id"))


# ---------------------------------------------------------------- cleaning


@query("g01_remove_copies", WITH_PICTURES + "SELECT path FROM m WHERE NOT corrupted AND dup_of IS NULL")
def g01(spark, folder):
    return imagesets.remove(reported(spark, folder), corrupted=True, copies="all").select("path")


@query("g01_remove_chosen", WITH_PICTURES + "SELECT path FROM m WHERE dup_of IS NULL OR label <> 1")
def g01_chosen(spark, folder):
    df = reported(spark, folder)
    return imagesets.remove(df, copies=df.filter("dup_of IS NOT NULL AND label = 1")).select("path")


def _pixel_rows(df: DataFrame) -> DataFrame:
    """The pixel bytes as text, one row per picture."""
    return df.filter(~F.col("corrupted")).select("id", "n_channels", F.lower(F.hex("data")).alias("pixels"))


def _pixel_sql(channels: str, hex_of: str) -> str:
    return WITH_PICTURES + f"SELECT id, any_value({channels})::INT AS n_channels, string_agg({hex_of}, '' ORDER BY p) AS pixels FROM px GROUP BY id"


def _hx(v: str) -> str:
    return f"printf('%02x', ({v})::INT)"


@query("g02_to_rgb", _pixel_sql("3", f"{_hx('r')} || {_hx('gg')} || {_hx('b')}"))
def g02(spark, folder):
    return _pixel_rows(rasters.to_rgb(pictures(spark, folder)))


@query("g03_to_grey", _pixel_sql("1", _hx("CASE WHEN nc = 1 THEN r ELSE floor(0.299::DOUBLE * r + 0.587::DOUBLE * gg + 0.114::DOUBLE * b) END")))
def g03(spark, folder):
    return _pixel_rows(rasters.to_grey(pictures(spark, folder)))


@query("g04_to_bgr", _pixel_sql("3", f"{_hx('b')} || {_hx('gg')} || {_hx('r')}"))
def g04(spark, folder):
    return _pixel_rows(rasters.to_bgr(pictures(spark, folder)))


def _bright(v: str, fn: str) -> str:
    return _hx(f"least(255, {fn.format(f'{v} * 1.3::DOUBLE')})")


def _bright_sql(fn: str) -> str:
    three = " || ".join(_bright(v, fn) for v in ("r", "gg", "b"))
    return _pixel_sql("nc", f"CASE nc WHEN 1 THEN {_bright('r', fn)} WHEN 3 THEN {three} ELSE {three} || {_hx('al')} END")


@query("g05_brightness", _bright_sql("floor({})"))
def g05(spark, folder):
    return _pixel_rows(rasters.brighten(pictures(spark, folder), 1.3))


@query("g05_brightness_nearest", _bright_sql("round_even({}, 0)"))
def g05_nearest(spark, folder):
    return _pixel_rows(rasters.brighten(pictures(spark, folder), 1.3, "nearest"))


SHARPENED = WITH_PICTURES + """, ch AS (SELECT px.id, px.nc, x, y, c, CASE c WHEN 0 THEN r WHEN 1 THEN gg ELSE b END AS v FROM px, range(3) t(c), m
    WHERE m.id = px.id AND m.state IN ('Blurry', 'Very Blurry') AND (px.nc > 1 OR c = 0)),
  kw AS (SELECT d, exp(-d * d / 8::DOUBLE) / sum(exp(-d * d / 8::DOUBLE)) OVER () AS w FROM range(-6, 7) t(d)),
  w AS (SELECT o, least(7, greatest(0, o + d)) AS i, sum(w) AS w FROM range(8) t(o), kw GROUP BY ALL),
  s1 AS (SELECT id, c, x, w.o AS y, sum(v * w.w) AS v FROM ch JOIN w ON w.i = y GROUP BY ALL),
  s2 AS (SELECT id, c, w.o AS x, y, sum(v * w.w) AS v FROM s1 JOIN w ON w.i = x GROUP BY ALL),
  d AS (SELECT ch.*, ch.v - s2.v AS diff FROM ch JOIN s2 ON s2.id = ch.id AND s2.c = ch.c AND s2.x = ch.x AND s2.y = ch.y),
  n AS (SELECT id, nc, x, y, c, CASE WHEN abs(diff) > 3 THEN least(255, greatest(0, round_even(v + diff * 1.5::DOUBLE, 0)))::INT ELSE v END AS v FROM d
    UNION ALL SELECT px.id, px.nc, x, y, 3, al FROM px, m WHERE m.id = px.id AND px.nc = 4 AND m.state IN ('Blurry', 'Very Blurry'))
  """


@query("g06_sharpen", SHARPENED + "SELECT id, any_value(nc)::INT AS n_channels, string_agg(printf('%02x', v), '' ORDER BY y, x, c) AS pixels FROM n GROUP BY id")
def g06(spark, folder):
    """The pixels of the blurry pictures after sharpening."""
    return _pixel_rows(rasters.sharpen(measured(spark, folder)).filter("state = 'Sharpened'"))


@query("g06_blur_before_after", SHARPENED.rstrip() + """, sv AS (SELECT id, x, y, y * 8 + x AS p, avg(v) AS v FROM n WHERE c < 3 GROUP BY ALL),
  sl AS (SELECT id, x, y, lag(v, 8) OVER o + lead(v, 8) OVER o + lag(v) OVER o + lead(v) OVER o - 4 * v AS l FROM sv WINDOW o AS (PARTITION BY id ORDER BY p)),
  sb AS (SELECT id, var_pop(l) AS blur FROM sl WHERE x BETWEEN 1 AND 6 AND y BETWEEN 1 AND 6 GROUP BY id)
  SELECT count(*) AS sharpened, round(avg(blur_score), 4) AS before, round(avg(blur), 4) AS after FROM sb JOIN m ON m.id = sb.id""")
def g06_scores(spark, folder):
    """Mean blur score before and after sharpening."""
    before = measured(spark, folder).select("id", "state", F.col("blur_score").alias("before"), "corrupted", "height", "width", "n_channels", "data")
    after = rasters.measure(rasters.sharpen(before))
    return after.filter("state = 'Sharpened'").agg(F.count(F.lit(1)).alias("sharpened"), F.round(F.avg("before"), 4).alias("before"), F.round(F.avg("blur_score"), 4).alias("after"))


@query("g07_remove_blurry", WITH_PICTURES + "SELECT path FROM m WHERE state IS NULL OR state NOT IN ('Blurry', 'Very Blurry', 'Blank')")
def g07(spark, folder):
    return imagesets.remove_states(measured(spark, folder), ["Blurry", "Very Blurry", "Blank"]).select("path")


def sized_files(spark, folder):
    """Sizes for plans: every document is a file of a width and height taken from its length."""
    return table(spark, folder, "documents").select(
        "doc_id", (F.col("n_chars") % 1900 + 20).cast("int").alias("width"), (F.col("n_chars") % 1070 + 30).cast("int").alias("height"),
        F.expr("CASE doc_id % 6 WHEN 0 THEN '.gif' WHEN 1 THEN '.jpg' WHEN 2 THEN '.jpeg' WHEN 3 THEN '.tif' WHEN 4 THEN '.png' ELSE '.webp' END").alias("ext"),
        (F.col("doc_id") % 17 == 0).alias("corrupted"), (F.col("doc_id") % 4 == 0).alias("changed"),
    )


SIZED = """WITH s AS (SELECT doc_id, (n_chars % 1900 + 20)::INT AS width, (n_chars % 1070 + 30)::INT AS height,
   CASE doc_id % 6 WHEN 0 THEN '.gif' WHEN 1 THEN '.jpg' WHEN 2 THEN '.jpeg' WHEN 3 THEN '.tif' WHEN 4 THEN '.png' ELSE '.webp' END AS ext,
   doc_id % 17 = 0 AS corrupted, doc_id % 4 = 0 AS changed FROM documents) """


def _resize_sql(w: str, h: str, rounding: str = "round_even({}, 0)") -> str:
    a, b = (f"greatest(1, {rounding.format(v)}::INT)" for v in (w, h))
    return SIZED + f"SELECT doc_id, {a} AS new_width, {b} AS new_height, {a} <> width OR {b} <> height AS resized FROM s"


def _planned(spark, folder, *args, **options):
    return rasters.resize_plan(sized_files(spark, folder), *args, **options).select("doc_id", "new_width", "new_height", "resized")


@query("g08_resize_percent", _resize_sql("width * 50::DOUBLE / 100", "height * 50::DOUBLE / 100"))
def g08_percent(spark, folder):
    return _planned(spark, folder, "percent", 50)


@query("g08_resize_width", _resize_sql("640::DOUBLE", "height * 640::DOUBLE / width"))
def g08_width(spark, folder):
    return _planned(spark, folder, "width", 640)


@query("g08_resize_height", _resize_sql("width * 480::DOUBLE / height", "480::DOUBLE", "floor({} + 0.5::DOUBLE)"))
def g08_height(spark, folder):
    return _planned(spark, folder, "height", 480, rounding="half_up")


@query("g08_resize_exact", _resize_sql("224::DOUBLE", "224::DOUBLE"))
def g08_exact(spark, folder):
    return _planned(spark, folder, "exact", 224, 224)


@query("g08_resize_megapixels", _resize_sql("width * sqrt(250000::DOUBLE / (width::DOUBLE * height))", "height * sqrt(250000::DOUBLE / (width::DOUBLE * height))"))
def g08_megapixels(spark, folder):
    return _planned(spark, folder, "megapixels", 0.25)


def _lanczos_sql(new: int) -> str:
    """Normalised Lanczos-3 weights from 8 to ``new`` samples: columns o, i, w."""
    scale = f"(8 / {new}::DOUBLE)"
    wide = f"greatest(1::DOUBLE, {scale})"
    return f"""(SELECT o, i, f / sum(f) OVER (PARTITION BY o) AS w FROM (SELECT o, i, CASE WHEN x = 0 THEN 1::DOUBLE WHEN abs(x) < 3 THEN sin(pi() * x) / (pi() * x) * sin(pi() * x / 3) / (pi() * x / 3) ELSE 0::DOUBLE END AS f
      FROM (SELECT o, i, (i + 0.5::DOUBLE - (o + 0.5::DOUBLE) * {scale}) / {wide} AS x FROM range({new}) a(o), range(8) b(i))))"""


@query("g09_resample", WITH_PICTURES + f""", ch AS (SELECT id, nc, x, y, c, CASE c WHEN 0 THEN r WHEN 1 THEN gg WHEN 2 THEN b ELSE al END AS v FROM px, range(4) t(c) WHERE c < nc),
  wx AS {_lanczos_sql(12)}, wy AS {_lanczos_sql(6)},
  s1 AS (SELECT id, nc, c, x, wy.o AS y, sum(v * w) AS v FROM ch JOIN wy ON wy.i = y GROUP BY ALL),
  s2 AS (SELECT id, nc, c, wx.o AS x, y, sum(v * w) AS v FROM s1 JOIN wx ON wx.i = x GROUP BY ALL)
  SELECT id, any_value(nc)::INT AS n_channels, string_agg(printf('%02x', least(255, greatest(0, round_even(round(v, 9), 0)))::INT), '' ORDER BY y, x, c) AS pixels FROM s2 GROUP BY id""")
def g09(spark, folder):
    """Pictures resampled to 12x6 pixels."""
    return _pixel_rows(rasters.resize(pictures(spark, folder), "exact", 12, 6))


@query("g10_format_plan", SIZED + """SELECT doc_id, CASE WHEN NOT corrupted AND ext NOT IN ('.tif', '.tiff') THEN '.tiff' WHEN changed AND ext = '.gif' THEN '.png' ELSE ext END AS new_ext,
   NOT corrupted AND ext NOT IN ('.tif', '.tiff') AS converted FROM s""")
def g10(spark, folder):
    return imagesets.format_plan(sized_files(spark, folder), ".tiff").select("doc_id", "new_ext", "converted")


@query("g11_user_function", _pixel_sql("nc", "CASE nc WHEN 1 THEN {0} WHEN 3 THEN {0} || {1} || {2} ELSE {0} || {1} || {2} || {3} END".format(
    *[_hx(f"255 - {v}") for v in ("r", "gg", "b", "al")])))
def g11(spark, folder):
    return _pixel_rows(rasters.apply_raster(pictures(spark, folder), lambda a: 255 - a))


@query("g11_before_after", WITH_PICTURES + """SELECT id, CASE WHEN NOT corrupted THEN printf('8x8, %s, brightness %.0f', color_mode, round_even(round(brightness, 9), 0)) END AS summary FROM m""")
def g11_text(spark, folder):
    return imagesets.one_line(measured(spark, folder)).select("id", "summary")


# ---------------------------------------------------------------- paths


@query("s10_dataset_root", f"SELECT 'data/' || {DOC_PATH} AS path, 'data' AS root, lang || '/' || source AS rel FROM documents")
def s10(spark, folder):
    df = doc_files(spark, folder).select(F.concat(F.lit("data/"), "path").alias("path"))
    return dataset_root(df)


@query("x02_unique_names", """WITH d AS (SELECT doc_id, lang, 'File' || (doc_id % 50) AS stem, row_number() OVER (PARTITION BY lang, doc_id % 50 ORDER BY doc_id) - 1 AS k FROM documents)
  SELECT doc_id, lang, CASE WHEN k = 0 THEN stem || '.txt' ELSE stem || '_' || k || '.txt' END AS target FROM d""")
def x02(spark, folder):
    df = table(spark, folder, "documents").select(
        "doc_id", "lang", F.concat(F.lit("File"), (F.col("doc_id") % 50).cast("string")).alias("stem"), F.lit(".txt").alias("ext")
    )
    return unique_names(df, "lang", "stem", "ext", ["doc_id"]).select("doc_id", "lang", "target")
