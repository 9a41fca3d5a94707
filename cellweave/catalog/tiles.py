"""Queries: tiles, patches, embeddings, attributions."""

from __future__ import annotations

from pyspark.sql import functions as F

from cellweave.catalog import fixtures as fx
from cellweave.catalog.registry import R, query, round_columns, rounded
from cellweave.functions import patches
from cellweave.functions.categories import DEPTHS
from cellweave.operators import attribution, labels, tiles
from cellweave.plans.maps import depth_maps

P, S = fx.PATCH, fx.STRIDE
BANDS = ["b2", "b3", "b4"]

TILES_SQL = f"""{fx.CELLS_SQL},
  origins AS (SELECT r, c FROM dim, (SELECT unnest(range(0, 100000, {S})) AS r), (SELECT unnest(range(0, {fx.WIDTH}, {S})) AS c) WHERE r <= h - {P} AND c <= w - {P}),
  tile_cells AS (
    SELECT r, c, k.* FROM origins JOIN cells k ON k.row >= r AND k.row < r + {P} AND k.col >= c AND k.col < c + {P}),
  tile_stats AS (
    SELECT r, c, sum(CASE WHEN coalesce(b2, 0) + coalesce(b3, 0) <> 0 AND b5 > 4500 THEN 1 ELSE 0 END) / {P * P}.0::DOUBLE AS valid,
           sum(coalesce(b2, 0)) / {P * P} AS b2, sum(coalesce(b3, 0)) / {P * P} AS b3, sum(coalesce(b4, 0)) / {P * P} AS b4
    FROM tile_cells GROUP BY r, c)"""


def _masked(spark, folder):
    """Cells whose bands are unknown over about half of the area."""
    base = fx.stored_cells(spark, folder).select("row", "col", "label", "b5", *BANDS)
    return base.select("row", "col", "label", *[F.when(F.col("b5") > 4500, F.col(b)).alias(b) for b in ("b2", "b3")])


def _shape(spark, folder):
    grid = fx.cell_grid(spark, folder)
    return grid.height, grid.width


@query("j8_tile_cell_join", f"WITH {TILES_SQL} SELECT CAST(r AS BIGINT) AS r, CAST(c AS BIGINT) AS c, row, col, b1 FROM tile_cells")
def j8(spark, folder):
    base = fx.cells(spark, folder).select("row", "col", "b1")
    return tiles.tile_cells(base, *_shape(spark, folder), P, S).select("r", "c", "row", "col", "b1")


@query(
    "a33_tile_valid_fraction",
    f"WITH {TILES_SQL} SELECT CAST(r AS BIGINT) AS r, CAST(c AS BIGINT) AS c, valid FROM tile_stats WHERE valid >= 0.5",
)
def a33(spark, folder):
    return tiles.tile_valid_fraction(_masked(spark, folder), ["b2", "b3"], *_shape(spark, folder), P, S)


@query(
    "a33_inference_tiles",
    f"WITH {TILES_SQL} SELECT CAST(r + {P // 2} AS BIGINT) AS row, CAST(c + {P // 2} AS BIGINT) AS col, valid FROM tile_stats, dim WHERE valid >= 0.3 AND r + {P // 2} < h - {P // 2} AND c + {P // 2} < w - {P // 2}",
)
def a33_inference(spark, folder):
    return tiles.inference_tiles(_masked(spark, folder), ["b2", "b3"], *_shape(spark, folder), P)


@query(
    "a27_patch_channel_mean",
    f"WITH {TILES_SQL} SELECT CAST(r AS BIGINT) AS r, CAST(c AS BIGINT) AS c, {R('b2', 12)} AS b2, {R('b3', 12)} AS b3, {R('b4', 12)} AS b4 FROM tile_stats",
)
def a27(spark, folder):
    return round_columns(tiles.patch_channel_mean(fx.cells(spark, folder), BANDS, *_shape(spark, folder), P, S), BANDS, 12)


@query(
    "a14_tile_overlap_mean",
    f"""WITH {TILES_SQL}, kept AS (SELECT r, c, b2 AS mean, b3 AS std FROM tile_stats WHERE valid >= 0.5)
    SELECT k.row, k.col, count(t.r) AS n_tiles, {R('avg(mean)', 12)} AS mean, {R('avg(std)', 12)} AS std
    FROM cells k LEFT JOIN kept t ON k.row >= t.r AND k.row < t.r + {P} AND k.col >= t.c AND k.col < t.c + {P} GROUP BY k.row, k.col""",
)
def a14(spark, folder):
    shape = _shape(spark, folder)
    means = tiles.patch_channel_mean(fx.stored_cells(spark, folder), ["b2", "b3"], *shape, P, S)
    kept = tiles.tile_valid_fraction(_masked(spark, folder), ["b2", "b3"], *shape, P, S)
    centred = means.join(kept, ["r", "c"]).select(
        (F.col("r") + P // 2).alias("row"), (F.col("c") + P // 2).alias("col"), F.col("b2").alias("mean"), F.col("b3").alias("std")
    )
    return round_columns(tiles.tile_overlap_mean(centred, ["mean", "std"], *shape, P, S), ["mean", "std"], 12)


@query(
    "a14_tile_overlap_any_centre",
    f"""WITH {TILES_SQL}, kept AS (SELECT r + (r * 7 + c) % 3 AS r, c - (r + c * 5) % 4 AS c, b2 * sqrt(2) AS mean, b3 * sqrt(2) AS std FROM tile_stats WHERE valid >= 0.5)
    SELECT k.row, k.col, count(t.r) AS n_tiles, {R('avg(mean)', 9)} AS mean, {R('avg(std)', 9)} AS std
    FROM cells k LEFT JOIN kept t ON k.row >= t.r AND k.row < t.r + {P} AND k.col >= t.c AND k.col < t.c + {P} GROUP BY k.row, k.col""",
)
def a14_any(spark, folder):
    """Centres off the grid of the stride, some of them with tiles that reach over the edge; roots never end in a tie of the rounding."""
    shape = _shape(spark, folder)
    means = tiles.patch_channel_mean(fx.stored_cells(spark, folder), ["b2", "b3"], *shape, P, S)
    kept = tiles.tile_valid_fraction(_masked(spark, folder), ["b2", "b3"], *shape, P, S)
    r, c = F.col("r"), F.col("c")
    moved = means.join(kept, ["r", "c"]).select(
        (r + (r * 7 + c) % 3 + P // 2).alias("row"), (c - (r + c * 5) % 4 + P // 2).alias("col"), (F.col("b2") * F.sqrt(F.lit(2.0))).alias("mean"), (F.col("b3") * F.sqrt(F.lit(2.0))).alias("std")
    )
    return round_columns(tiles.tile_overlap_mean(moved, ["mean", "std"], *shape, P, S), ["mean", "std"], 9)


@query(
    "a15_depth_ensemble_mean",
    f"WITH {fx.CELLS_SQL} SELECT row, col, {R('list_avg(list_filter([b2, b3, b4], lambda x: x IS NOT NULL))')} AS mean FROM cells",
)
def a15(spark, folder):
    return fx.cells(spark, folder).select("row", "col", rounded(tiles.depth_ensemble_mean(BANDS)).alias("mean"))


#: Members of three depths: weights of the scaled channel means, and a bias.
_MEMBERS = {d: [([0.3 + 0.2 * k, -0.5 + 0.1 * j, 0.4 - 0.1 * k], 0.1 * j - 0.2) for k in range(4)] for j, d in enumerate(DEPTHS)}


def _depth_sql() -> str:
    tile, names = [], []
    for d, members in _MEMBERS.items():
        each = ", ".join(f"1 / (1 + exp(-({w[0]!r}::DOUBLE * b2 / 350 + {w[1]!r}::DOUBLE * b3 * 10 + {w[2]!r}::DOUBLE * b4 * 10 + {b!r}::DOUBLE)))" for w, b in members)
        tile.append(f'list_avg([{each}]) AS "mean_{d}", list_stddev_samp([{each}]) AS "std_{d}"')
        names += [f"mean_{d}", f"std_{d}"]
    shown = ", ".join(f"""{R(f'avg("{n}")', 9)} AS "{n}\"""" for n in names)
    fused = " + ".join(f'avg("mean_{d}")' for d in _MEMBERS)
    return f"""WITH {TILES_SQL},
    used AS (SELECT s.* FROM tile_stats s, dim WHERE valid >= 0.3 AND r + {P // 2} < h - {P // 2} AND c + {P // 2} < w - {P // 2}),
    scored AS (SELECT r, c, {', '.join(tile)} FROM used)
    SELECT k.row, k.col, count(t.r) AS n_tiles, {shown}, {R(f'({fused}) / {len(_MEMBERS)}', 9)} AS fused
    FROM cells k LEFT JOIN scored t ON k.row >= t.r AND k.row < t.r + {P} AND k.col >= t.c AND k.col < t.c + {P} GROUP BY k.row, k.col"""


@query("m3_depth_maps", _depth_sql())
def m3_depths(spark, folder):
    shape = _shape(spark, folder)
    means = tiles.patch_channel_mean(fx.stored_cells(spark, folder), BANDS, *shape, P, S)
    centred = means.select((F.col("r") + P // 2).alias("row"), (F.col("c") + P // 2).alias("col"), (F.col("b2") / 350).alias("b2"), (F.col("b3") * 10).alias("b3"), (F.col("b4") * 10).alias("b4"))
    used = tiles.inference_tiles(_masked(spark, folder), ["b2", "b3"], *shape, P).select("row", "col")
    out = depth_maps(centred.join(used, ["row", "col"]), BANDS, _MEMBERS, *shape, P, S)
    return round_columns(out, [c for c in out.columns if c not in ("row", "col", "n_tiles")], 9)


_EXCLUDED = f"""test_cols AS (SELECT min(col) AS lo, max(col) AS hi FROM cells WHERE label = 1 AND col >= 40 AND col < 60),
  kept AS (SELECT r, c FROM tile_stats, test_cols WHERE valid >= 0.5 AND NOT (c + {P // 2} BETWEEN lo AND hi))"""


@query("c11_fold_exclusion", f"WITH {TILES_SQL}, {_EXCLUDED} SELECT CAST(r AS BIGINT) AS r, CAST(c AS BIGINT) AS c FROM kept")
def c11(spark, folder):
    kept = tiles.tile_valid_fraction(_masked(spark, folder), ["b2", "b3"], *_shape(spark, folder), P, S)
    positives = fx.stored_cells(spark, folder).where("label = 1 AND col >= 40 AND col < 60")
    return labels.exclude_fold_tiles(kept, positives, P).select("r", "c")


@query("u4_mask_except", f"WITH {TILES_SQL}, {_EXCLUDED} SELECT CAST(r AS BIGINT) AS r, CAST(c AS BIGINT) AS c FROM tile_stats WHERE valid >= 0.5 EXCEPT SELECT CAST(r AS BIGINT), CAST(c AS BIGINT) FROM kept")
def u4(spark, folder):
    all_tiles = tiles.tile_valid_fraction(_masked(spark, folder), ["b2", "b3"], *_shape(spark, folder), P, S)
    positives = fx.stored_cells(spark, folder).where("label = 1 AND col >= 40 AND col < 60")
    return all_tiles.join(labels.exclude_fold_tiles(all_tiles, positives, P).select("r", "c"), ["r", "c"], "left_anti").select("r", "c")


# ---- patches of 8 x 8 ----------------------------------------------------

_TOKENS = "[" + ", ".join("[" + ", ".join(f"patch[{gr * 4 * 8 + r * 8 + gc * 4 + c + 1}]" for r in range(4) for c in range(4)) + "]" for gr in range(2) for gc in range(2)) + "]"


def _exploded_sql(array: str) -> str:
    return f"SELECT vec_id, CAST(i AS BIGINT) AS i, a[i + 1] AS v FROM (SELECT vec_id, {array} AS a FROM patches), (SELECT unnest(range(0, 64)) AS i)"


def _exploded(spark, folder, column):
    base = fx.patches(spark, folder).select("vec_id", F.posexplode(column).alias("i", "v"))
    return base.withColumn("i", F.col("i").cast("bigint"))


@query(
    "v1_patchify",
    f"WITH {fx.PATCHES_SQL} SELECT vec_id, CAST(t AS BIGINT) AS token, CAST(i AS BIGINT) AS i, a[t + 1][i + 1] AS v FROM (SELECT vec_id, {_TOKENS} AS a FROM patches), (SELECT unnest(range(0, 4)) AS t), (SELECT unnest(range(0, 16)) AS i)",
)
def v1(spark, folder):
    tokens = fx.patches(spark, folder).select("vec_id", F.posexplode(patches.patchify(F.col("patch"), 8, 4)).alias("token", "a"))
    flat = tokens.select("vec_id", F.col("token").cast("bigint").alias("token"), F.posexplode("a").alias("i", "v"))
    return flat.withColumn("i", F.col("i").cast("bigint"))


def _list(order) -> str:
    return "[" + ", ".join(f"patch[{k + 1}]" for k in order) + "]"


@query("v3_rotate90", f"WITH {fx.PATCHES_SQL} {_exploded_sql(_list([c * 8 + 7 - r for r in range(8) for c in range(8)]))}")
def v3(spark, folder):
    return _exploded(spark, folder, patches.rotate90(F.col("patch"), 8))


@query("v3_flip_horizontal", f"WITH {fx.PATCHES_SQL} {_exploded_sql(_list([r * 8 + 7 - c for r in range(8) for c in range(8)]))}")
def v3_h(spark, folder):
    return _exploded(spark, folder, patches.flip_horizontal(F.col("patch"), 8))


@query("v3_flip_vertical", f"WITH {fx.PATCHES_SQL} {_exploded_sql(_list([(7 - r) * 8 + c for r in range(8) for c in range(8)]))}")
def v3_v(spark, folder):
    return _exploded(spark, folder, patches.flip_vertical(F.col("patch"), 8))


@query(
    "v2_random_mask",
    """WITH tokens AS (SELECT vec_id, t AS token FROM embeddings, (SELECT unnest(range(0, 16)) AS t))
    SELECT vec_id, CAST(token AS BIGINT) AS token,
           CAST(row_number() OVER (PARTITION BY vec_id ORDER BY md5(vec_id || '-' || token || '-42'), token) > 4 AS BIGINT) AS masked FROM tokens""",
)
def v2(spark, folder):
    tokens = fx.patches(spark, folder).select("vec_id", F.posexplode(patches.patchify(F.col("patch"), 8, 2)).alias("token", "v"))
    masked = tiles.random_token_mask(tokens, "vec_id", "token", 16)
    return masked.select("vec_id", F.col("token").cast("bigint").alias("token"), F.col("masked").cast("bigint").alias("masked"))


_DIGITS = "md5(vec_id || '-42-' || i)"
_NOISY = f"""v + 0.01 * sqrt(-2 * ln((CAST('0x' || substr({_DIGITS}, 1, 6) AS BIGINT) + 0.5) / 16777216.0::DOUBLE))
  * cos(6.283185307179586::DOUBLE * (CAST('0x' || substr({_DIGITS}, 7, 6) AS BIGINT) / 16777216.0::DOUBLE))"""


@query(
    "v4_noise_clip",
    f"""WITH {fx.PATCHES_SQL}, flat AS (SELECT vec_id, i, patch[i + 1] AS v FROM patches, (SELECT unnest(range(0, 64)) AS i))
    SELECT vec_id, CAST(i AS BIGINT) AS i, {R(f'least(greatest({_NOISY}, 0), 1)')} AS v FROM flat""",
)
def v4(spark, folder):
    noisy = fx.patches(spark, folder).select("vec_id", patches.add_noise(F.col("patch"), F.col("vec_id")).alias("patch"))
    flat = noisy.select("vec_id", F.posexplode("patch").alias("i", "v"))
    return flat.select("vec_id", F.col("i").cast("bigint").alias("i"), rounded("v").alias("v"))


@query(
    "a24_masked_mse",
    f"""WITH {fx.PATCHES_SQL}, tok AS (SELECT vec_id, t, {_TOKENS}[t + 1] AS a, {_TOKENS}[(t + 1) % 4 + 1] AS b FROM patches, (SELECT unnest(range(0, 4)) AS t)),
    err AS (SELECT vec_id, t, list_sum(list_transform(range(1, 17), lambda i: (a[i] - b[i]) * (a[i] - b[i]))) / 16 AS e, CASE WHEN (vec_id + t) % 4 <> 0 THEN 1 ELSE 0 END AS m FROM tok)
    SELECT {R('sum(e * m) / (sum(m) + 1e-8)', 9)} AS loss FROM err""",
)
def a24(spark, folder):
    tokens = patches.patchify(F.col("patch"), 8, 4)
    pairs = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda t: F.struct(t.alias("t"), F.get(tokens, t).alias("a"), F.get(tokens, (t + 1) % 4).alias("b")))
    flat = fx.patches(spark, folder).select("vec_id", F.explode(pairs).alias("p")).select("vec_id", "p.*")
    scored = flat.select(patches.token_error(F.col("a"), F.col("b")).alias("error"), ((F.col("vec_id") + F.col("t")) % 4 != 0).cast("int").alias("masked"))
    return round_columns(tiles.masked_mse(scored), ["loss"], 9)


@query(
    "a23_trace_correlation",
    f"""WITH {fx.PATCHES_SQL}, z AS (SELECT d, patch[d + 1] AS a, patch[d + 33] AS b FROM patches, (SELECT unnest(range(0, 32)) AS d)),
    per AS (SELECT d, covar_samp(a, b) AS xy, var_samp(a) AS xx, var_samp(b) AS yy FROM z GROUP BY d)
    SELECT {R('-sum(xy) / (sqrt(sum(xx + 1e-4)) * sqrt(sum(yy + 1e-4)) + 1e-8)', 9)} AS loss FROM per""",
)
def a23(spark, folder):
    halves = fx.patches(spark, folder).select(F.slice("patch", 1, 32).alias("a"), F.slice("patch", 33, 32).alias("b"))
    return round_columns(attribution.trace_correlation(halves, "a", "b"), ["loss"], 9)


# ---- attributions --------------------------------------------------------

FEATURES = ["f1", "f2", "f3"]
WEIGHTS, BIAS = [1.5, -2.0, 0.75], -0.25
_IG_SCALE = "coalesce(b2, 0) / 350.0::DOUBLE AS f1, coalesce(b3, 0) * 10 AS f2, b5 / 10000 AS f3"
_IG_SLOPE = "(SELECT sum(p * (1 - p)) / 20 FROM (SELECT 1 / (1 + exp(-((1.5 * f1 - 2.0 * f2 + 0.75 * f3) * (CASE WHEN i = 19 THEN 1.0::DOUBLE ELSE i * (1.0::DOUBLE / 19) END) - 0.25))) AS p FROM (SELECT unnest(range(0, 20)) AS i)))"
IG_SQL = f"""{fx.CELLS_SQL}, f AS (SELECT row, col, label, {_IG_SCALE} FROM cells), g AS (SELECT *, {_IG_SLOPE} AS s FROM f),
  ig AS (SELECT row, col, label, s * 1.5 * f1 AS f1, s * -2.0 * f2 AS f2, s * 0.75 * f3 AS f3 FROM g)"""


def _attributions(spark, folder):
    base = fx.cells(spark, folder).select(
        "row", "col", "label", (F.coalesce("b2", F.lit(0.0)) / 350.0).alias("f1"), (F.coalesce("b3", F.lit(0.0)) * 10).alias("f2"), (F.col("b5") / 10000).alias("f3")
    )
    given = attribution.integrated_gradients(FEATURES, WEIGHTS, BIAS)
    return base.select("row", "col", "label", *[e.alias(n) for n, e in given.items()])


@query("m5_integrated_gradients", f"WITH {IG_SQL} SELECT row, col, {R('f1')} AS f1, {R('f2')} AS f2, {R('f3')} AS f3 FROM ig")
def m5(spark, folder):
    return round_columns(_attributions(spark, folder).drop("label"), FEATURES)


def _long(spark, folder):
    return _attributions(spark, folder).unpivot(["row", "col", "label"], FEATURES, "channel", "value")


LONG_IG_SQL = f"{IG_SQL}, l AS (SELECT row, col, label, channel, abs(value) AS a FROM ig UNPIVOT (value FOR channel IN (f1, f2, f3)))"


@query(
    "a25_attribution_summary",
    f"""WITH {LONG_IG_SQL} SELECT channel, 'all' AS label_group, {R('avg(a)')} AS importance, count(*) AS n FROM l GROUP BY channel
    UNION ALL SELECT channel, CASE WHEN label = 1 THEN 'positive' ELSE 'unlabeled' END, {R('avg(a)')}, count(*) FROM l GROUP BY channel, label""",
)
def a25(spark, folder):
    return round_columns(attribution.attribution_summary(_long(spark, folder)), ["importance"])


@query(
    "a26_pixel_attr_mean",
    f"WITH {LONG_IG_SQL} SELECT row // 8 AS sample, channel, {R('avg(a)')} AS importance FROM l GROUP BY 1, 2",
)
def a26(spark, folder):
    sampled = _long(spark, folder).withColumn("sample", F.expr("row div 8"))
    return round_columns(attribution.sample_channel_mean(sampled), ["importance"])


@query(
    "a26_mean_attribution_map",
    f"WITH {LONG_IG_SQL} SELECT channel, row % 8 AS row, col, {R('avg(a)')} AS importance FROM l GROUP BY 1, 2, 3",
)
def a26_map(spark, folder):
    folded = _long(spark, folder).withColumn("row", F.col("row") % 8)
    return round_columns(attribution.mean_attribution_map(folded), ["importance"])


@query(
    "t3_top_features",
    f"WITH {LONG_IG_SQL} SELECT channel AS feature, {R('avg(a)')} AS importance FROM l GROUP BY channel ORDER BY 2 DESC, 1 LIMIT 2",
)
def t3(spark, folder):
    from cellweave.operators.models import top_features

    means = _long(spark, folder).groupBy(F.col("channel").alias("feature")).agg(rounded(F.avg(F.abs("value"))).alias("importance"))
    return top_features(means, 2)
