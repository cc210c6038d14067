"""Per-image measures (P1-P20): `embeddings` as 8 x 8 colour rasters, `pages` as grey rasters of their bytes."""

from __future__ import annotations

from pyspark.sql import functions as F

from framewright.functions import photometry as ph
from framewright.operators import measures
from framewright.queries.base import query, rounded, spread_scan, table

# An embedding is one raster: green from the vector, blue from its mirror image, red with more contrast.
PIXELS_SQL = """
px AS (
  SELECT vec_id, i // 8 AS y, i % 8 AS x,
    CAST(least(255, greatest(0, floor((CAST(embedding[i + 1] AS DOUBLE) + 0.5) * 255))) AS BIGINT) AS g,
    CAST(least(255, greatest(0, floor((CAST(embedding[64 - i] AS DOUBLE) + 0.5) * 255))) AS BIGINT) AS b,
    CAST(least(255, greatest(0, floor((CAST(embedding[i + 1] AS DOUBLE) * 1.25 + 0.5) * 255))) AS BIGINT) AS r
  FROM embeddings, range(0, 64) AS t(i))
"""
# Neighbours with borders reflected without repeating the edge.
REFLECT = "CASE WHEN {0} < 0 THEN -({0}) WHEN {0} > 7 THEN 14 - ({0}) ELSE {0} END"


def _near(dy: str, dx: str) -> str:
    return f"n.y = {REFLECT.format(f'(p.y + {dy})')} AND n.x = {REFLECT.format(f'(p.x + {dx})')}"


NEAR_SQL = (
    PIXELS_SQL
    + f""",
near AS (
  SELECT p.vec_id, p.y, p.x, p.g, o.dy, o.dx, n.g AS v
  FROM px p, (SELECT a.v AS dy, c.v AS dx FROM (VALUES (-1), (0), (1)) a(v), (VALUES (-1), (0), (1)) c(v)) o, px n
  WHERE n.vec_id = p.vec_id AND {_near('o.dy', 'o.dx')}),
grad AS (
  SELECT vec_id, y, x, any_value(g) AS g,
    sum(v * dx * CASE WHEN dy = 0 THEN 2 ELSE 1 END)::BIGINT AS gx,
    sum(v * dy * CASE WHEN dx = 0 THEN 2 ELSE 1 END)::BIGINT AS gy,
    sum(CASE WHEN dy = 0 AND dx = 0 THEN -4 * v WHEN dy = 0 OR dx = 0 THEN v ELSE 0 END)::BIGINT AS lap,
    sum(v * CASE WHEN dy = 0 THEN 2 ELSE 1 END * CASE WHEN dx = 0 THEN 2 ELSE 1 END)::BIGINT AS smooth
  FROM near GROUP BY vec_id, y, x)
"""
)


def _pixel(x):
    return F.least(F.lit(255), F.greatest(F.lit(0), F.floor((x + 0.5) * 255))).cast("int")


def embedding_rasters(spark, sf):
    """path, height, width, n_channels, data and the planes as arrays of numbers."""
    e = F.transform("embedding", lambda x: x.cast("double"))
    planes = spread_scan(table(spark, sf, "embeddings"), "vec_id").select(
        "vec_id",
        "label",
        F.format_string("/vectors/%08d.png", "vec_id").alias("path"),
        F.transform(e, _pixel).alias("green"),
        F.transform(F.reverse(e), _pixel).alias("blue"),
        F.transform(e, lambda x: _pixel(x * 1.25)).alias("red"),
    )
    triple = F.zip_with(F.arrays_zip("blue", "green"), F.col("red"), lambda bg, r: F.concat(
        F.lpad(F.hex(bg["blue"]), 2, "0"), F.lpad(F.hex(bg["green"]), 2, "0"), F.lpad(F.hex(r), 2, "0")
    ))
    return planes.withColumns(
        {
            "height": F.lit(8),
            "width": F.lit(8),
            "n_channels": F.lit(3),
            "data": F.unhex(F.array_join(triple, "")),
        }
    )


def text_rasters(df, path, text, width: int = 64):
    """Whole texts as grey rasters: one pixel per byte, the last row filled up with blanks."""
    body = F.col(text).cast("binary")
    rows = F.greatest(F.lit(1), F.ceil(F.octet_length(body) / width).cast("int"))
    return df.select(
        path.alias("path"),
        rows.alias("height"),
        F.lit(width).alias("width"),
        F.lit(1).alias("n_channels"),
        F.rpad(body, rows * width, F.lit(b" ")).alias("data"),
    )


PAGE_ROWS = 500  # pages of a task: seconds, not minutes


def page_rasters(spark, sf):
    return text_rasters(spread_scan(table(spark, sf, "pages"), "page_id", PAGE_ROWS), F.format_string("/pages/%08d.png", "page_id"), "html")


def _columns(spark, sf, **digits):
    found = measures.image_measures(embedding_rasters(spark, sf), ["vec_id"], wanted=tuple(digits))
    return found.select("vec_id", *[rounded(c, d).alias(c) for c, d in digits.items()])


@query("p1_green_plane", f"WITH {PIXELS_SQL} SELECT vec_id, string_agg(g::VARCHAR, ',' ORDER BY y, x) AS green FROM px GROUP BY vec_id")
def p1(spark, sf):
    plane = measures.green_plane(F.col("data"))
    return embedding_rasters(spark, sf).select("vec_id", F.array_join(plane.cast("array<string>"), ",").alias("green"))


@query(
    "p2_depth_to_uint8",
    """WITH v AS (SELECT vec_id, i, CAST(floor((CAST(embedding[i] AS DOUBLE) + 0.5) * 40000) AS BIGINT) AS d, CAST(embedding[i] AS DOUBLE) * 1000 AS f
      FROM embeddings, range(1, 65) t(i)),
    w AS (SELECT *, CAST(trunc(min(f) OVER (PARTITION BY vec_id)) AS BIGINT) AS lo, CAST(trunc(max(f) OVER (PARTITION BY vec_id)) AS BIGINT) AS hi FROM v)
    SELECT vec_id, string_agg((greatest(0, least(65535, d)) >> 8)::VARCHAR, ',' ORDER BY i) AS from_uint16,
      string_agg(CAST(floor(greatest(0.0, least(255.0, (f - lo) / (hi - lo) * 255.0))) AS BIGINT)::VARCHAR, ',' ORDER BY i) AS from_float
    FROM w GROUP BY vec_id""",
)
def p2(spark, sf):
    e = F.transform("embedding", lambda x: x.cast("double"))
    wide = F.transform(e, lambda x: F.greatest(F.lit(0), F.least(F.lit(65535), F.floor((x + 0.5) * 40000))).cast("int"))
    arrays = table(spark, sf, "embeddings").select("vec_id", wide.alias("d"), F.transform(e, lambda x: x * 1000).alias("f"))
    text = lambda a: F.array_join(a.cast("array<string>"), ",")
    return arrays.select(
        "vec_id",
        text(measures.depth_to_uint8("d", "uint16")).alias("from_uint16"),
        text(measures.depth_to_uint8("f", "float")).alias("from_float"),
    )


@query(
    "p3_orient",
    f"""WITH {PIXELS_SQL}, o AS (SELECT vec_id, 1 + vec_id % 8 AS t FROM embeddings)
    SELECT o.vec_id, avg(g) AS top_left FROM o JOIN px ON px.vec_id = o.vec_id
      AND y = CASE WHEN t IN (3, 4, 6, 7) THEN 7 ELSE 0 END
      AND x = CASE WHEN t IN (2, 3, 7, 8) THEN 7 ELSE 0 END
    GROUP BY o.vec_id""",
)
def p3(spark, sf):
    """The first pixel of the upright raster for every orientation tag."""
    from framewright.functions import pixels as px

    turned = embedding_rasters(spark, sf).withColumn("turn", (1 + F.col("vec_id") % 8).cast("int"))

    def first_pixel(batches):
        import pandas as pd

        for batch in batches:
            top = [
                float(px.orient(px.decode_plane(d, 8, 8, 3), int(t))[0, 0, 1]) for d, t in zip(batch["data"], batch["turn"])
            ]
            yield pd.DataFrame({"vec_id": batch["vec_id"], "top_left": top})

    return turned.select("vec_id", "turn", "data").mapInPandas(first_pixel, "vec_id bigint, top_left double")


@query(
    "p3_visible_size",
    """SELECT page_id, CASE WHEN page_id % 9 IN (5, 6, 7, 8) THEN CAST(greatest(1, ceil(octet_length(encode(html)) / 64.0)) AS BIGINT) ELSE 64 END AS shown_width,
    CASE WHEN page_id % 9 IN (5, 6, 7, 8) THEN 64 ELSE CAST(greatest(1, ceil(octet_length(encode(html)) / 64.0)) AS BIGINT) END AS shown_height FROM pages""",
)
def p3_size(spark, sf):
    rows = F.greatest(F.lit(1), F.ceil(F.octet_length("html") / 64)).cast("bigint")
    sized = table(spark, sf, "pages").select("page_id", F.lit(64).cast("bigint").alias("w"), rows.alias("h"), (F.col("page_id") % 9).alias("o"))
    w, h = measures.visible_size("w", "h", "o")
    return sized.select("page_id", w.alias("shown_width"), h.alias("shown_height"))


@query(
    "p4_area_downsample",
    f"""WITH {PIXELS_SQL}, cells AS (SELECT vec_id, y // 2 AS y, x // 2 AS x, round_even(avg(g), 0) AS g FROM px GROUP BY ALL)
    SELECT vec_id, 4 AS small_height, 4 AS small_width, round(avg(g), 6) AS brightness FROM cells GROUP BY vec_id""",
)
def p4(spark, sf):
    """Longest side limited to 4: every pixel becomes the mean of a 2 x 2 area."""
    from framewright.config import QualityParams

    small = measures.image_measures(embedding_rasters(spark, sf), ["vec_id"], p=QualityParams(analysis_dim=4), wanted=("brightness",))
    return small.select(
        "vec_id", F.col("stat_height").alias("small_height"), F.col("stat_width").alias("small_width"), rounded("brightness").alias("brightness")
    )


@query(
    "p5_block_sharpness",
    f"""WITH {NEAR_SQL}, cells AS (SELECT vec_id, y // 4 AS cy, x // 4 AS cx, var_pop(lap) AS v FROM grad GROUP BY ALL)
    SELECT vec_id, round(max(v * 256) FILTER (cy = 0 AND cx = 0), 0) AS b1, round(max(v * 256) FILTER (cy = 0 AND cx = 1), 0) AS b2,
      round(max(v * 256) FILTER (cy = 1 AND cx = 0), 0) AS b3, round(max(v * 256) FILTER (cy = 1 AND cx = 1), 0) AS b4 FROM cells GROUP BY vec_id""",
)
def p5(spark, sf):
    from framewright.config import QualityParams

    blocks = measures.image_measures(embedding_rasters(spark, sf), ["vec_id"], p=QualityParams(grid_size=2), wanted=("blocks",))
    return blocks.select("vec_id", *[rounded(F.element_at("blocks", i) * 256, 0).alias(f"b{i}") for i in range(1, 5)])


# Discrete Fourier transform of the windowed 8 x 8 raster, half plane, written out as sums.
P6_SQL = f"""
WITH {PIXELS_SQL}, w AS (
  SELECT vec_id, y, x, (g - avg(g) OVER (PARTITION BY vec_id))
    * (0.5 - 0.5 * cos(2 * pi() * y / 7)) * (0.5 - 0.5 * cos(2 * pi() * x / 7)) AS v FROM px),
freq AS (SELECT v, u, CASE WHEN v > 3 THEN v - 8 ELSE v END / 8.0 AS fy, u / 8.0 AS fx FROM range(0, 8) a(v), range(0, 5) b(u)),
freq2 AS (SELECT v, u, sqrt(fx * fx + fy * fy) AS radius,
    CASE WHEN atan2(CASE WHEN v = 4 THEN -0.5 ELSE fy END, fx) < 0 THEN atan2(CASE WHEN v = 4 THEN -0.5 ELSE fy END, fx) + pi()
      ELSE atan2(fy, fx) END AS angle FROM freq),
power AS (
  SELECT vec_id, freq2.v, freq2.u, any_value(radius) AS radius, any_value(angle) AS angle,
    power(sum(w.v * cos(2 * pi() * (freq2.v * y + freq2.u * x) / 8)), 2) + power(sum(w.v * sin(2 * pi() * (freq2.v * y + freq2.u * x) / 8)), 2) AS e
  FROM w, freq2 GROUP BY vec_id, freq2.v, freq2.u),
binned AS (
  SELECT vec_id, CASE WHEN radius >= 0.04 AND radius <= 0.10 THEN 'low' WHEN radius >= 0.15 AND radius <= 0.40 THEN 'high' END AS band,
    greatest(0, least(47, ceil(angle * 48) - 1)) AS bin, e FROM power),
shares AS (SELECT vec_id, band, bin, sum(e) AS e FROM binned WHERE band IS NOT NULL GROUP BY ALL),
tops AS (SELECT vec_id, band, CASE WHEN sum(e) > 0 THEN max(e) / sum(e) ELSE 0.0 END AS top FROM shares GROUP BY ALL)
SELECT vec_id, round(coalesce(max(top) FILTER (band = 'high'), 0.0) - coalesce(max(top) FILTER (band = 'low'), 0.0), 5) AS mb_delta_conc
FROM tops GROUP BY vec_id
"""


@query("p6_spectral_concentration", P6_SQL)
def p6(spark, sf):
    return _columns(spark, sf, mb_delta_conc=5)


# Pages as grey rasters 64 pixels wide: bytes of the text, the last row filled up with blanks.
PAGE_PIXELS_SQL = """
bytes AS (SELECT page_id, hex(encode(html)) AS digits, octet_length(encode(html)) AS n, greatest(1, CAST(ceil(octet_length(encode(html)) / 64.0) AS BIGINT)) AS rows FROM pages),
img AS (SELECT page_id, rows, regexp_extract_all(rpad(digits, CAST(rows * 128 AS INTEGER), '20'), '..') AS pairs FROM bytes),
flat AS (SELECT page_id, rows, unnest(range(0, rows * 64)) AS i, unnest(pairs) AS pair FROM img),
pos AS (SELECT page_id, rows, i // 64 AS y, i % 64 AS x, 16 * (strpos('0123456789ABCDEF', pair[1]) - 1) + strpos('0123456789ABCDEF', pair[2]) - 1 AS g FROM flat),
dots AS (
  SELECT *, coalesce(lag(g) OVER w_down, lead(g) OVER w_down, g) + coalesce(lead(g) OVER w_down, lag(g) OVER w_down, g)
    + coalesce(lag(g) OVER w_across, lead(g) OVER w_across) + coalesce(lead(g) OVER w_across, lag(g) OVER w_across) - 4 * g AS lap
  FROM pos WINDOW w_down AS (PARTITION BY page_id, x ORDER BY y), w_across AS (PARTITION BY page_id, y ORDER BY x))
"""
P7_SQL = f"""
WITH {PAGE_PIXELS_SQL}, cells AS (
  SELECT page_id, rows // 8 AS ch, y, x, y // (rows // 8) AS cy, x // 8 AS cx, g, lap FROM dots WHERE rows >= 8 AND y < rows // 8 * 8),
sharp AS (SELECT page_id, cy, cx, var_pop(lap) AS s FROM cells GROUP BY ALL),
steps AS (SELECT * FROM (VALUES (0, 0, 1), (1, 1, 0), (2, 1, 1), (3, -1, 1)) o(d, dy, dx)),
energy AS (
  SELECT a.page_id, a.cy, a.cx, d, avg(power(a.g - b.g, 2)) AS e FROM steps, cells a, cells b
  WHERE a.page_id = b.page_id AND a.cy = b.cy AND a.cx = b.cx AND b.y = a.y + dy AND b.x = a.x + dx AND a.ch - abs(dy) >= 2 GROUP BY ALL),
picked AS (
  SELECT s.page_id, s.cy, s.cx, row_number() OVER (PARTITION BY s.page_id ORDER BY s.s DESC, coalesce(e0.e, 0) DESC, coalesce(e1.e, 0) DESC, coalesce(e2.e, 0) DESC, coalesce(e3.e, 0) DESC) AS rank,
    coalesce(e0.e, 0) AS d0, coalesce(e1.e, 0) AS d1, coalesce(e2.e, 0) AS d2, coalesce(e3.e, 0) AS d3
  FROM sharp s LEFT JOIN energy e0 ON e0.page_id = s.page_id AND e0.cy = s.cy AND e0.cx = s.cx AND e0.d = 0
    LEFT JOIN energy e1 ON e1.page_id = s.page_id AND e1.cy = s.cy AND e1.cx = s.cx AND e1.d = 1
    LEFT JOIN energy e2 ON e2.page_id = s.page_id AND e2.cy = s.cy AND e2.cx = s.cx AND e2.d = 2
    LEFT JOIN energy e3 ON e3.page_id = s.page_id AND e3.cy = s.cy AND e3.cx = s.cx AND e3.d = 3),
pooled AS (SELECT page_id, sum(d0) AS d0, sum(d1) AS d1, sum(d2) AS d2, sum(d3) AS d3 FROM picked WHERE rank <= 6 GROUP BY page_id)
SELECT printf('/pages/%08d.png', p.page_id) AS path, round(CASE WHEN d0 IS NULL OR greatest(d0, d1, d2, d3) < 1e-6 THEN 1.0 ELSE least(d0, d1, d2, d3) / greatest(d0, d1, d2, d3) END, 6) AS mb_lag_aniso
FROM pages p LEFT JOIN pooled USING (page_id)
"""


@query("p7_lag_anisotropy", P7_SQL)
def p7(spark, sf):
    """On rasters of whole pages; cells of 8 x 8 rasters have one pixel and no lag."""
    return measures.image_measures(page_rasters(spark, sf), ["path"], wanted=("mb_lag_aniso",)).select("path", rounded("mb_lag_aniso").alias("mb_lag_aniso"))


CORNER_SQL = (
    NEAR_SQL
    + f""",
win AS (
  SELECT p.vec_id, p.y, p.x, sum(n.gx * n.gx) / power(5100.0, 2) AS a, sum(n.gx * n.gy) / power(5100.0, 2) AS b, sum(n.gy * n.gy) / power(5100.0, 2) AS c
  FROM grad p, (SELECT i.v - 2 AS dy, j.v - 2 AS dx FROM range(0, 5) i(v), range(0, 5) j(v)) o, grad n
  WHERE n.vec_id = p.vec_id AND {_near('o.dy', 'o.dx')} GROUP BY p.vec_id, p.y, p.x),
corners AS (SELECT vec_id, y, x, CASE WHEN a * c - b * b - 0.04 * power(a + c, 2) > 0.0002 THEN 1 ELSE 0 END AS hit FROM win)
"""
)


@query("p8_feature_density", f"WITH {CORNER_SQL} SELECT vec_id, round(sum(hit) / (64 / 1000.0), 4) AS feature_density FROM corners GROUP BY vec_id")
def p8(spark, sf):
    return _columns(spark, sf, feature_density=4)


@query(
    "p9_feature_uniformity",
    f"""WITH {CORNER_SQL}, cells AS (SELECT vec_id, y // 2 AS cy, x // 2 AS cx, sum(hit) AS n FROM corners GROUP BY ALL)
    SELECT vec_id, round(CASE WHEN max(n) > 0 THEN min(n) / max(n) ELSE 1.0 END, 6) AS feature_uniformity FROM cells GROUP BY vec_id""",
)
def p9(spark, sf):
    return _columns(spark, sf, feature_uniformity=6)


@query(
    "p10_vignetting",
    f"""WITH {PIXELS_SQL} SELECT vec_id, round(CASE WHEN avg(g) FILTER (y BETWEEN 2 AND 5 AND x BETWEEN 2 AND 5) < 1.0 THEN 1.0
      ELSE avg(g) FILTER (y IN (0, 7) AND x IN (0, 7)) / avg(g) FILTER (y BETWEEN 2 AND 5 AND x BETWEEN 2 AND 5) END, 6) AS vignetting
    FROM px GROUP BY vec_id""",
)
def p10(spark, sf):
    return _columns(spark, sf, vignetting=6)


@query(
    "p11_clip_stats",
    f"""WITH {PIXELS_SQL} SELECT vec_id, round(count_if(greatest(r, g, b) >= 253) / 64.0, 6) AS clip_high,
    round(count_if(least(r, g, b) <= 2) / 64.0, 6) AS clip_low FROM px GROUP BY vec_id""",
)
def p11(spark, sf):
    return _columns(spark, sf, clip_high=6, clip_low=6)


@query("p12_laplacian_variance", f"WITH {NEAR_SQL} SELECT vec_id, round(var_pop(lap) * 4096, 0) AS laplacian_variance_4096 FROM grad GROUP BY vec_id")
def p12(spark, sf):
    """Times 64 squared, which makes the variance of 64 integers an integer."""
    found = measures.image_measures(embedding_rasters(spark, sf), ["vec_id"], wanted=("laplacian_variance",))
    return found.select("vec_id", rounded(F.col("laplacian_variance") * 4096, 0).alias("laplacian_variance_4096"))


@query(
    "p13_gradient_stats",
    f"""WITH {NEAR_SQL}, s AS (
      SELECT vec_id, var_pop(sqrt(gx * gx + gy * gy)) AS sv, var_pop(gx) AS vx, var_pop(gy) AS vy, avg(gx * gx + gy * gy) AS t,
        quantile_cont(sqrt(gx * gx + gy * gy), 0.95) AS p95 FROM grad GROUP BY vec_id)
    SELECT vec_id, round(sv, 3) AS sobel_variance, round(vx * 4096, 0) AS sobel_var_x_4096, round(vy * 4096, 0) AS sobel_var_y_4096,
      round(CASE WHEN greatest(vx, vy) > 1e-6 THEN least(vx, vy) / greatest(vx, vy) ELSE 1.0 END, 6) AS sobel_aniso,
      round(t, 6) AS tenengrad, round(p95, 4) AS gradient_p95 FROM s""",
)
def p13(spark, sf):
    wanted = ("sobel_variance", "sobel_var_x", "sobel_var_y", "sobel_aniso", "tenengrad", "gradient_p95")
    found = measures.image_measures(embedding_rasters(spark, sf), ["vec_id"], wanted=wanted)
    return found.select(
        "vec_id",
        rounded("sobel_variance", 3).alias("sobel_variance"),
        *[rounded(F.col(c) * 4096, 0).alias(f"{c}_4096") for c in ("sobel_var_x", "sobel_var_y")],
        rounded("sobel_aniso").alias("sobel_aniso"),
        rounded("tenengrad").alias("tenengrad"),
        rounded("gradient_p95", 4).alias("gradient_p95"),
    )


P14_SQL = f"""
WITH RECURSIVE {PAGE_PIXELS_SQL},
limits AS (SELECT page_id, greatest(0, trunc(avg(g) - stddev_pop(g))) AS low, least(255, trunc(avg(g) + stddev_pop(g))) AS high FROM pos GROUP BY page_id),
columns AS (
  SELECT page_id, y, x, coalesce(lag(g) OVER w, g) + 2 * g + coalesce(lead(g) OVER w, g) AS s, coalesce(lead(g) OVER w, g) - coalesce(lag(g) OVER w, g) AS d
  FROM pos WINDOW w AS (PARTITION BY page_id, x ORDER BY y)),
slopes AS (
  SELECT page_id, y, x, coalesce(lead(s) OVER w, s) - coalesce(lag(s) OVER w, s) AS gx, coalesce(lag(d) OVER w, d) + 2 * d + coalesce(lead(d) OVER w, d) AS gy
  FROM columns WINDOW w AS (PARTITION BY page_id, y ORDER BY x)),
strength AS (SELECT *, abs(gx) + abs(gy) AS m FROM slopes),
updown AS (SELECT *, coalesce(lag(m) OVER w, 0) AS up, coalesce(lead(m) OVER w, 0) AS down FROM strength WINDOW w AS (PARTITION BY page_id, x ORDER BY y)),
around AS (
  SELECT *, coalesce(lag(m) OVER w, 0) AS before, coalesce(lead(m) OVER w, 0) AS after, coalesce(lag(up) OVER w, 0) AS up_before, coalesce(lead(up) OVER w, 0) AS up_after,
    coalesce(lag(down) OVER w, 0) AS down_before, coalesce(lead(down) OVER w, 0) AS down_after
  FROM updown WINDOW w AS (PARTITION BY page_id, y ORDER BY x)),
thin AS (
  SELECT page_id, y, x, m, low, high FROM around JOIN limits USING (page_id)
  WHERE m > low AND CASE WHEN abs(gy) < abs(gx) * tan(pi() / 8) THEN m > before AND m >= after WHEN abs(gy) > abs(gx) * tan(3 * pi() / 8) THEN m > up AND m >= down
    WHEN (gx < 0) <> (gy < 0) THEN m > up_after AND m > down_before ELSE m > up_before AND m > down_after END),
steps AS (SELECT a.v AS dy, b.v AS dx FROM (VALUES (-1), (0), (1)) a(v), (VALUES (-1), (0), (1)) b(v)),
edge AS (
  SELECT page_id, y, x FROM thin WHERE m > high
  UNION SELECT t.page_id, t.y, t.x FROM edge e, steps s, thin t WHERE t.page_id = e.page_id AND t.y = e.y + s.dy AND t.x = e.x + s.dx)
SELECT printf('/pages/%08d.png', page_id) AS path, round(coalesce(found, 0) / (rows * 64), 6) AS edge_density
FROM bytes LEFT JOIN (SELECT page_id, count(*) AS found FROM edge GROUP BY page_id) f USING (page_id)
"""


@query("p14_edge_density", P14_SQL)
def p14(spark, sf):
    """Edges of whole pages; weak edges are followed from strong ones."""
    return measures.image_measures(page_rasters(spark, sf), ["path"], wanted=("edge_density",)).select("path", rounded("edge_density").alias("edge_density"))


@query(
    "p15_noise_level",
    f"WITH {NEAR_SQL} SELECT vec_id, round(quantile_cont(abs(g - (smooth + 8) // 16), 0.5), 4) AS noise_level FROM grad GROUP BY vec_id",
)
def p15(spark, sf):
    return _columns(spark, sf, noise_level=4)


@query(
    "p16_brightness_contrast",
    f"WITH {PIXELS_SQL} SELECT vec_id, round(avg(g), 6) AS brightness, round(stddev_pop(g), 5) AS contrast FROM px GROUP BY vec_id",
)
def p16(spark, sf):
    return _columns(spark, sf, brightness=6, contrast=5)


@query(
    "p17_saturation",
    f"""WITH {PIXELS_SQL}, m AS (SELECT vec_id, greatest(r, g, b) AS hi, greatest(r, g, b) - least(r, g, b) AS d FROM px)
    SELECT vec_id, round(avg(CASE WHEN hi = 0 THEN 0 ELSE (d * CAST(round_even((255 * 4096) / (hi * 1.0), 0) AS BIGINT) + 2048) // 4096 END), 6) AS saturation
    FROM m GROUP BY vec_id""",
)
def p17(spark, sf):
    return _columns(spark, sf, saturation=6)


@query(
    "p18_luma_percentiles",
    f"""WITH {PIXELS_SQL} SELECT vec_id, round(quantile_cont(g, 0.5), 4) AS luma_median,
    round(quantile_cont(g, 0.95) - quantile_cont(g, 0.05), 4) AS dynamic_range FROM px GROUP BY vec_id""",
)
def p18(spark, sf):
    return _columns(spark, sf, luma_median=4, dynamic_range=4)


@query(
    "p19_white_point_gains",
    f"""WITH {PIXELS_SQL}, w AS (SELECT vec_id, quantile_cont(r, 0.95) AS wr, quantile_cont(g, 0.95) AS wg, quantile_cont(b, 0.95) AS wb FROM px GROUP BY vec_id)
    SELECT vec_id, round(CASE WHEN wg > 1e-6 THEN wr / wg ELSE 1.0 END, 6) AS wb_gain_rg, round(CASE WHEN wg > 1e-6 THEN wb / wg ELSE 1.0 END, 6) AS wb_gain_bg FROM w""",
)
def p19(spark, sf):
    return _columns(spark, sf, wb_gain_rg=6, wb_gain_bg=6)


def _linear(c: str) -> str:
    return f"CASE WHEN {c} / 255.0 <= 0.04045 THEN {c} / 255.0 / 12.92 ELSE power((least(1.0, {c} / 255.0) + 0.055) / 1.055, 2.4) END"


@query(
    "p20_kelvin_estimate",
    f"""WITH c AS (SELECT l_orderkey, l_linenumber, l_extendedprice % 256 AS r, l_quantity * 5 AS g, CAST(l_partkey % 256 AS DOUBLE) AS b FROM lineitem),
    l AS (SELECT l_orderkey, l_linenumber, {_linear('r')} AS r, {_linear('g')} AS g, {_linear('b')} AS b FROM c),
    z AS (SELECT *, 0.4124 * r + 0.3576 * g + 0.1805 * b AS x, 0.2126 * r + 0.7152 * g + 0.0722 * b AS y, 0.0193 * r + 0.1192 * g + 0.9505 * b AS w FROM l),
    n AS (SELECT *, (x / (x + y + w) - 0.3320) / (0.1858 - y / (x + y + w)) AS n FROM z)
    SELECT l_orderkey, l_linenumber, round(CASE WHEN x + y + w <= 1e-9 THEN 6500.0
      ELSE least(11000.0, greatest(1500.0, 449.0 * n * n * n - 3522.0 * n * n + 10226.0 * n + 6550.0)) END, 3) AS kelvin FROM n""",
)
def p20(spark, sf):
    k = ph.kelvin(F.col("l_extendedprice") % 256, F.col("l_quantity") * 5, (F.col("l_partkey") % 256).cast("double"))
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", rounded(k, 3).alias("kelvin"))


@query("page_measures")
def page_measures(spark, sf):
    """Every measure of every page as a raster: the pixel pass on rasters of real size."""
    return measures.image_measures(page_rasters(spark, sf), ["path"])
