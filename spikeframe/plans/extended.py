"""Registered queries of place maps, field frames, shuffles, spectra and waveforms, and the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalar
from ..functions.lineage import cut
from ..operators import bars as Q
from ..operators import behaviour as B
from ..operators import borders as O
from ..operators import curation as K
from ..operators import field_frames as E
from ..operators import firing_fields as P
from ..operators import joins as J
from ..operators import maps as M
from ..operators import sessions as T
from ..operators import shuffles as H
from ..operators import significance as G
from ..operators import spectra as Z
from ..operators import statistics as S
from ..operators import trials as L
from ..operators import waveforms as V
from .analysis import HALF, RATES, trial_rates
from .fixtures import view, with_views
from .preparation import BINS, BLOCK, FIELDS, fields
from .registry import CELL, JOINED, ORACLES, SESSION, joined, query, r6

FIELD = [*CELL, "field_id"]
BIN, SMOOTH = 20.0, 30.0


def place_map(spark, d):
    """Maps of the place cells, with bins of 20 pixels."""
    return M.rate_map(view(spark, d, "places"), view(spark, d, "position"), CELL, SESSION, BIN, SMOOTH, 1 / 30, 3)


def place_tiles(spark, d, base=None):
    return M.rate_tiles(view(spark, d, "places"), view(spark, d, "position"), CELL, SESSION, BIN, SMOOTH, 1 / 30, 3, base=base)


def place_maps(spark, d):
    """place_tiles where they are made, for on_maps."""
    return M.SessionMaps(view(spark, d, "places"), view(spark, d, "position"), CELL, SESSION, BIN, SMOOTH, 1 / 30, 3)


def place_fields(spark, d):
    return P.map_fields(place_maps(spark, d), CELL, least_bins=12)


def kernel(source: str, keys: str, name: str, bin_px: int, smooth: int) -> str:
    """SQL of kernel sums by bin: every sample by every bin that the kernel reaches."""
    reach = 6 * smooth // bin_px + 1
    return f"""{name} AS (SELECT {keys}, bx + i AS bin_x, by_ + j AS bin_y, sum(exp(-(pow(x_px - (bx + i + 0.5) * {bin_px}, 2) + pow(y_px - (by_ + j + 0.5) * {bin_px}, 2)) / {2 * smooth * smooth}.0)) AS v
 FROM (SELECT *, CAST(floor(x_px / {bin_px}) AS BIGINT) AS bx, CAST(floor(y_px / {bin_px}) AS BIGINT) AS by_ FROM {source}) s, range(-{reach}, {reach + 1}) a(i), range(-{reach}, {reach + 1}) b(j) WHERE bx + i >= 0 AND by_ + j >= 0 GROUP BY ALL)"""


def seen_bins(bin_px: int, smooth: int) -> str:
    reach = smooth // bin_px + 1
    return f"""seen AS (SELECT session_id, bx + i AS bin_x, by_ + j AS bin_y, count(*) AS n FROM (SELECT *, CAST(floor(x_px / {bin_px}) AS BIGINT) AS bx, CAST(floor(y_px / {bin_px}) AS BIGINT) AS by_ FROM position) s, range(-{reach}, {reach + 1}) a(i), range(-{reach}, {reach + 1}) b(j)
 WHERE bx + i >= 0 AND by_ + j >= 0 AND sqrt(pow(x_px - (bx + i + 0.5) * {bin_px}, 2) + pow(y_px - (by_ + j + 0.5) * {bin_px}, 2)) <= {smooth} GROUP BY ALL HAVING count(*) >= 3)"""


def map_sql(start: str, source: str, bin_px: int, smooth: int) -> str:
    """Common table expressions up to map(session_id, cluster_id, bin_x, bin_y, rate) and seen(session_id, bin_x, bin_y, n)."""
    return f"""{start} {kernel(source, "session_id, cluster_id", "top", bin_px, smooth)}, {kernel("position", "session_id", "base", bin_px, smooth)}, {seen_bins(bin_px, smooth)},
 map AS MATERIALIZED (SELECT top.session_id, cluster_id, top.bin_x, top.bin_y, CASE WHEN n IS NULL THEN 0.0 ELSE top.v / (base.v / 30) END AS rate FROM top JOIN base ON top.session_id = base.session_id AND top.bin_x = base.bin_x AND top.bin_y = base.bin_y
  LEFT JOIN seen ON top.session_id = seen.session_id AND top.bin_x = seen.bin_x AND top.bin_y = seen.bin_y)"""


COARSE = map_sql(JOINED + ",", "joined", 40, 60)
PLACE = map_sql("+ p_ AS (SELECT * FROM places ),", "p_", 20, 30)
AUTO = """, up AS (SELECT * FROM map WHERE rate > 0),
 auto AS MATERIALIZED (SELECT a.session_id, a.cluster_id, a.bin_x - b.bin_x AS dx, a.bin_y - b.bin_y AS dy, count(*) AS n, CASE WHEN count(*) > 20 AND var_pop(a.rate) > 1e-20 * pow(avg(a.rate), 2) AND var_pop(b.rate) > 1e-20 * pow(avg(b.rate), 2) THEN corr(a.rate, b.rate) END AS r FROM up a JOIN up b ON a.session_id = b.session_id AND a.cluster_id = b.cluster_id GROUP BY ALL)"""
PEAKS = AUTO + """, high AS MATERIALIZED (SELECT session_id, cluster_id, dx, dy FROM auto WHERE r > 0.2),
 near(session_id, cluster_id, dx, dy, rx, ry) AS (SELECT session_id, cluster_id, dx, dy, dx, dy FROM high UNION SELECT n.session_id, n.cluster_id, n.dx, n.dy, h.dx, h.dy FROM near n JOIN high h ON h.session_id = n.session_id AND h.cluster_id = n.cluster_id AND abs(h.dx - n.rx) <= 1 AND abs(h.dy - n.ry) <= 1),
 root AS (SELECT session_id, cluster_id, dx, dy, min(struct_pack(x := rx, y := ry)) AS root FROM near GROUP BY ALL),
 peaks AS MATERIALIZED (SELECT session_id, cluster_id, dense_rank() OVER (PARTITION BY session_id, cluster_id ORDER BY root) - 1 AS label, cx, cy, area, sqrt(cx * cx + cy * cy) AS distance FROM (SELECT session_id, cluster_id, root, avg(dx) AS cx, avg(dy) AS cy, count(*) AS area FROM root GROUP BY ALL) q),
 ranked AS (SELECT *, row_number() OVER (PARTITION BY session_id, cluster_id ORDER BY distance, label) AS k, count(*) OVER (PARTITION BY session_id, cluster_id) AS many FROM peaks)"""



@query(PLACE + " SELECT session_id, cluster_id, bin_x, bin_y, round(rate, 5) AS rate FROM map")
def a6_place_map(spark, d):
    return place_map(spark, d).select(*CELL, "bin_x", "bin_y", F.round("rate", 5).alias("rate"))


@query(PLACE + AUTO + " SELECT session_id, cluster_id, dx, dy, n, round(r, 5) AS r FROM auto")
def c4_place_autocorrelogram(spark, d):
    return M.map_autocorrelogram(place_maps(spark, d), CELL).select(*CELL, "dx", "dy", "n", F.round("r", 5).alias("r"))


def place_peaks(spark, d):
    return P.map_peaks(place_maps(spark, d), CELL)


@query(PLACE.replace("WITH", "WITH RECURSIVE") + PEAKS + " SELECT session_id, cluster_id, label, round(cx, 5) AS cx, round(cy, 5) AS cy, area, round(distance, 5) AS distance FROM peaks")
def c5_place_peaks(spark, d):
    return place_peaks(spark, d).select(*CELL, "label", *(F.round(c, 5).alias(c) for c in ("cx", "cy")), "area", F.round("distance", 5).alias("distance"))


@query(PLACE + PEAKS + " SELECT session_id, cluster_id, round(median(CASE WHEN k BETWEEN 2 AND 7 AND many > 7 THEN distance * 2.5 END), 5) AS spacing, round(max(CASE WHEN k = 1 AND many > 7 THEN sqrt(area * 2.5) / pi() END), 5) AS field_size FROM ranked GROUP BY 1, 2")
def c6_place_spacing(spark, d):
    return P.grid_spacing(place_peaks(spark, d), CELL).select(*CELL, F.round("spacing", 5).alias("spacing"), F.round("field_size", 5).alias("field_size"))


@query()
def c7_place_grid_score(spark, d):
    return P.map_grid_score(place_maps(spark, d), CELL).select(*CELL, *r6("grid_score"))


@query(PLACE + PEAKS + " SELECT session_id, cluster_id, round(min(CASE WHEN degrees(atan2(cy, cx)) > 0 THEN degrees(atan2(cy, cx)) END), 5) AS orientation FROM ranked WHERE k BETWEEN 2 AND 7 AND many > 7 GROUP BY 1, 2")
def c8_grid_orientation(spark, d):
    return O.map_grid_shape(place_maps(spark, d), CELL).select(*CELL, F.round("orientation", 5).alias("orientation"))


@query()
def c8_grid_shape(spark, d):
    return O.map_grid_shape(place_maps(spark, d), CELL).select(*CELL, *r6("orientation", "ellipticity"))


@query()
def c9_place_fields(spark, d):
    return place_fields(spark, d).select(*FIELD, "bin_x", "bin_y", *r6("max_rate"))


def in_place_fields(spark, d, samples, keys):
    """Samples with the bin of the field they lie in; spikes meet the fields of their own cell only."""
    s = samples.withColumns({"bin_x": F.floor(F.col("x_px") / BIN), "bin_y": F.floor(F.col("y_px") / BIN)})
    return s.join(place_fields(spark, d).select(*FIELD, "bin_x", "bin_y"), [*keys, "bin_x", "bin_y"])


@query()
def c10_place_field_directions(spark, d):
    inside = in_place_fields(spark, d, view(spark, d, "places"), CELL)
    n = inside.groupBy(*FIELD).agg(F.count("*").alias("spikes"))
    return M.hd_score(M.hd_histogram(inside, FIELD), FIELD).join(n, FIELD).select(*FIELD, *r6("hd_score"), "spikes")


@query()
def u5_place_field_frame(spark, d):
    bins = place_fields(spark, d)
    out = E.field_frame(bins, in_place_fields(spark, d, view(spark, d, "places"), CELL), in_place_fields(spark, d, view(spark, d, "position"), SESSION), FIELD)
    return out.select(*FIELD, "n_bins", "width", "height", *r6("max_rate"), "n_spikes", *r6("mean_x", "mean_y", "spike_angle"), "n_samples", *r6("sample_angle"))


BLOCKS = FIELDS + f", spot AS (SELECT j.*, {BINS} FROM joined j), here AS (SELECT session_id, pos_idx, hd, x_px, y_px, synced_time, {BINS} FROM position), inside AS (SELECT s.*, f.field_id FROM spot s JOIN fields f ON f.session_id = s.session_id AND f.cluster_id = s.cluster_id AND f.bin_x = s.bin_x AND f.bin_y = s.bin_y), around AS (SELECT f.session_id, f.cluster_id, f.field_id, h.pos_idx, h.hd, h.synced_time FROM here h JOIN fields f ON f.session_id = h.session_id AND f.bin_x = h.bin_x AND f.bin_y = h.bin_y)"


def with_bins(df):
    return df.withColumns({"bin_x": F.floor(F.col("x_px") / 40), "bin_y": F.floor(F.col("y_px") / 40)})


def inside(spark, d, hits=None):
    """Spikes in the block fields of their own cell. hits: spikes with their samples, where they have more columns."""
    return with_bins(joined(spark, d) if hits is None else hits).join(fields(spark, d, hits).select(*FIELD, "bin_x", "bin_y"), [*CELL, "bin_x", "bin_y"])


def around(spark, d, position=None, hits=None):
    """Samples of the session in the block fields of each cell. position: samples that have more columns; hits: see inside."""
    return with_bins(view(spark, d, "position") if position is None else position).join(fields(spark, d, hits).select(*FIELD, "bin_x", "bin_y"), [*SESSION, "bin_x", "bin_y"])


@query(BLOCKS + """, z AS (SELECT session_id, cluster_id, field_id, count(*) AS n_bins, max(bin_x) - min(bin_x) + 1 AS width, max(bin_y) - min(bin_y) + 1 AS height, max(n) AS max_rate FROM fields GROUP BY ALL),
 f_ AS (SELECT session_id, cluster_id, field_id, count(*) AS n_spikes, round(avg(x_px), 5) AS mean_x, round(avg(y_px), 5) AS mean_y FROM inside GROUP BY ALL), s_ AS (SELECT session_id, cluster_id, field_id, count(*) AS n_samples FROM around GROUP BY ALL)
 SELECT z.*, coalesce(n_spikes, 0) AS n_spikes, mean_x, mean_y, coalesce(n_samples, 0) AS n_samples FROM z LEFT JOIN f_ USING (session_id, cluster_id, field_id) LEFT JOIN s_ USING (session_id, cluster_id, field_id)""")
def u5_field_frame(spark, d):
    out = E.field_frame(fields(spark, d).withColumnRenamed("n", "rate"), inside(spark, d), around(spark, d), FIELD)
    return out.select(*FIELD, "n_bins", "width", "height", "max_rate", "n_spikes", F.round("mean_x", 5).alias("mean_x"), F.round("mean_y", 5).alias("mean_y"), "n_samples")


EXTENT = BLOCKS + ", ex AS (SELECT session_id, max(bin_x) + 1 AS nx, max(bin_y) + 1 AS ny FROM here GROUP BY 1), fb AS (SELECT f.*, nx, ny FROM fields f JOIN ex USING (session_id))"
SCORE = " SELECT session_id, cluster_id, round((max(cm) - avg(dm)) / (max(cm) + avg(dm)), 5) AS {0} FROM per GROUP BY 1, 2"


def bins_on_map(spark, d):
    p = with_bins(view(spark, d, "position"))
    extent = p.groupBy(*SESSION).agg((F.max("bin_x") + 1).alias("nx"), (F.max("bin_y") + 1).alias("ny"))
    return fields(spark, d).withColumnRenamed("n", "rate").join(extent, SESSION)


@query(EXTENT + """, per AS (SELECT session_id, cluster_id, field_id, greatest(count(*) FILTER (bin_x = 0) / max(ny), count(*) FILTER (bin_x = nx - 1) / max(ny), count(*) FILTER (bin_y = 0) / max(nx), count(*) FILTER (bin_y = ny - 1) / max(nx)) AS cm,
 sum(n * (least(bin_x, bin_y, nx - 1 - bin_x, ny - 1 - bin_y) + 0.5::DOUBLE) / (floor((least(nx, ny) - 1) / 2) + 0.5::DOUBLE)) / sum(n) AS dm FROM fb GROUP BY 1, 2, 3)""" + SCORE.format("border_score"))
def c11_border_score(spark, d):
    return O.border_score(bins_on_map(spark, d), CELL).select(*CELL, F.round("border_score", 5).alias("border_score"))


@query(EXTENT + """, w AS (SELECT *, ceil(0.2 * nx) AS a, ceil(0.2 * ny) AS b, nx - 1 - bin_x AS rx, ny - 1 - bin_y AS ry FROM fb),
 per AS (SELECT session_id, cluster_id, field_id, greatest(count(*) FILTER ((bin_y = 0 AND bin_x < a) OR (bin_x = 0 AND bin_y < b)), count(*) FILTER ((bin_y = 0 AND rx < a) OR (rx = 0 AND bin_y < b)), count(*) FILTER ((ry = 0 AND bin_x < a) OR (bin_x = 0 AND ry < b)), count(*) FILTER ((ry = 0 AND rx < a) OR (rx = 0 AND ry < b))) / max(a + b - 1) AS cm,
 sum(n * (sqrt(pow(least(bin_x, rx), 2) + pow(least(bin_y, ry), 2)) + 0.5) / (sqrt(pow(floor((nx - 1) / 2), 2) + pow(floor((ny - 1) / 2), 2)) + 0.5)) / sum(n) AS dm FROM w GROUP BY 1, 2, 3)""" + SCORE.format("corner_score"))
def c11_corner_score(spark, d):
    return O.corner_score(bins_on_map(spark, d), CELL).select(*CELL, F.round("corner_score", 5).alias("corner_score"))


@query(EXTENT + """, w AS (SELECT *, greatest(0, CAST(floor(floor(ny / 2) - ny * 0.375 / 2) AS BIGINT)) AS lo, least(ny - 1, CAST(floor(ceil(ny / 2) + ny * 0.375 / 2) AS BIGINT)) AS hi FROM fb),
 v AS (SELECT *, greatest(lo - bin_y, bin_y - hi, 0) AS u, greatest(lo, ny - 1 - hi, 0) AS far FROM w),
 per AS (SELECT session_id, cluster_id, field_id, count(*) FILTER (bin_x = 0 AND bin_y BETWEEN lo AND hi) / max(ny) AS cm, sum(n * (sqrt(pow(bin_x, 2) + pow(u, 2)) + 0.5) / (sqrt(pow(nx - 1, 2) + pow(far, 2)) + 0.5)) / sum(n) AS dm FROM v GROUP BY 1, 2, 3)""" + SCORE.format("cue_score"))
def c11_cue_score(spark, d):
    return O.cue_score(bins_on_map(spark, d), CELL, 0.375).select(*CELL, F.round("cue_score", 5).alias("cue_score"))


def half_of(spark, d, df):
    return T.halves(view(spark, d, "position"), SESSION, "synced_time").select(*SESSION, "pos_idx", "half").join(df, [*SESSION, "pos_idx"])


MID = ", mid AS (SELECT session_id, (max(synced_time) + min(synced_time)) / 2 AS mid FROM position GROUP BY 1)"
DIR = "least(CAST(floor((hd + 180) / 18.0) AS BIGINT), 19) AS bin"


def ratios(spikes: str, samples: str, keys: str, sample_keys: str) -> str:
    """SQL up to rates(keys, half, bin, ratio)."""
    return f"""{MID}, s_ AS (SELECT {keys}, CASE WHEN synced_time < mid THEN 1 ELSE 2 END AS half, {DIR} FROM {spikes} JOIN mid USING (session_id)), o_ AS (SELECT {sample_keys}, CASE WHEN synced_time < mid THEN 1 ELSE 2 END AS half, {DIR} FROM {samples} JOIN mid USING (session_id)),
 sc AS (SELECT {keys}, half, bin, count(*) AS n FROM s_ GROUP BY ALL), oc AS (SELECT {sample_keys}, half, bin, count(*) AS o FROM o_ GROUP BY ALL), g_ AS (SELECT DISTINCT {keys}, half, r.bin FROM s_, range(20) r(bin)),
 rates AS MATERIALIZED (SELECT g_.*, coalesce(coalesce(n, 0) / o, 0) AS ratio FROM g_ LEFT JOIN sc USING ({keys}, half, bin) LEFT JOIN oc USING ({sample_keys}, half, bin))"""


SAFE = "CASE WHEN var_pop({0}) > 1e-20 * pow(avg({0}), 2) AND var_pop({1}) > 1e-20 * pow(avg({1}), 2) THEN round(corr({0}, {1}), 5) END"
CELLS_, FIELDS_ = "session_id, cluster_id", "session_id, cluster_id, field_id"


def half_rates(spark, d, spikes, samples, keys, sample_keys):
    return E.direction_rates(half_of(spark, d, spikes), half_of(spark, d, samples), [*keys, "half"], [*sample_keys, "half"], 20)


def cell_half_rates(spark, d):
    return half_rates(spark, d, joined(spark, d).drop("synced_time", "x_px", "y_px", "sync_led"), view(spark, d, "position").select(*SESSION, "pos_idx", "hd"), CELL, SESSION)


def field_half_rates(spark, d):
    """Samples have their half before they are repeated for fields."""
    p = T.halves(view(spark, d, "position"), SESSION, "synced_time")
    hits = cut(J.spikes_to_positions(view(spark, d, "spikes"), p))
    keys = [*FIELD, "half"]
    return E.direction_rates(inside(spark, d, hits).select(*keys, "hd"), around(spark, d, p, hits).select(*keys, "hd"), keys, keys, 20)


@query(JOINED + ratios("joined", "position", CELLS_, "session_id") + f" SELECT {CELLS_}, {SAFE.format('a.ratio', 'b.ratio')} AS r FROM rates a JOIN rates b USING ({CELLS_}, bin) WHERE a.half = 1 AND b.half = 2 GROUP BY ALL")
def c3_half_directions(spark, d):
    return E.half_correlation(cell_half_rates(spark, d), CELL).select(*CELL, F.round("r", 5).alias("r"))


@query(BLOCKS + ratios("inside", "around", FIELDS_, FIELDS_) + f" SELECT {FIELDS_}, {SAFE.format('a.ratio', 'b.ratio')} AS r FROM rates a JOIN rates b USING ({FIELDS_}, bin) WHERE a.half = 1 AND b.half = 2 GROUP BY ALL")
def c3_field_half_directions(spark, d):
    return E.half_correlation(field_half_rates(spark, d), FIELD).select(*FIELD, F.round("r", 5).alias("r"))


@query(BLOCKS + ratios("inside", "around", FIELDS_, FIELDS_) + f""", own AS (SELECT {FIELDS_} FROM rates a JOIN rates b USING ({FIELDS_}, bin) WHERE a.half = 1 AND b.half = 2 GROUP BY ALL HAVING var_pop(a.ratio) > 0 AND var_pop(b.ratio) > 0 AND corr(a.ratio, b.ratio) >= 0.1),
 kept AS (SELECT rates.* FROM rates JOIN own USING ({FIELDS_})) SELECT session_id, cluster_id, a.field_id AS a, b.field_id AS b, {SAFE.format('a.ratio', 'b.ratio')} AS r FROM kept a JOIN kept b USING (session_id, cluster_id, bin) WHERE a.half = 1 AND b.half = 2 AND a.field_id <> b.field_id GROUP BY ALL""")
def c30_between_fields(spark, d):
    return E.between_fields(field_half_rates(spark, d), CELL, least=0.1).select(*CELL, "a", "b", F.round("r", 5).alias("r"))


@query(HALF + f", am AS (SELECT session_id, cluster_id, {BINS}, count(*) AS n FROM joined j JOIN mid USING (session_id) WHERE synced_time < mid GROUP BY ALL), bm AS (SELECT session_id, cluster_id, {BINS}, count(*) AS n FROM joined j JOIN mid USING (session_id) WHERE synced_time >= mid GROUP BY ALL) SELECT session_id, cluster_id, {SAFE.format('am.n', 'bm.n')} AS r, count(*) AS n FROM am JOIN bm USING (session_id, cluster_id, bin_x, bin_y) GROUP BY ALL")
def c36_rate_correlation(spark, d):
    maps = with_bins(half_of(spark, d, joined(spark, d))).groupBy(*CELL, "half", "bin_x", "bin_y").agg(F.count("*").alias("rate"))
    side = lambda h: maps.where(F.col("half") == h)
    return E.rate_correlation(side(1), side(2), CELL).select(*CELL, F.round("r", 5).alias("r"), "n")


@query()
def c35_directional_modes(spark, d):
    h = M.hd_histogram(view(spark, d, "places"), CELL, window=None)
    return E.directional_modes(h, CELL, "n", window=23).select(*CELL, "modes", "mode", F.round("angle", 2).alias("angle"), F.round("kappa", 3).alias("kappa"), F.round("share", 4).alias("share"))


DRAW = "CAST('0x' || substr(md5(concat_ws('-', {})), 1, 15) AS BIGINT) % {}"


@query(f"+ c AS (SELECT DISTINCT session_id, cluster_id FROM spikes), o AS (SELECT c.*, CAST(k AS INT) AS shuffle_id, 600000 + {DRAW.format("'shift', session_id, cluster_id, k", 3800000)} AS moved FROM c, range(1000) r(k)), t AS (SELECT o.session_id, o.cluster_id, shuffle_id, (t_sample + moved) % 5000000 AS t FROM spikes JOIN o USING (session_id, cluster_id)) SELECT session_id, cluster_id, shuffle_id, count(*) AS n, min(t) AS first_t, max(t) AS last_t, CAST(sum(t) AS BIGINT) AS total FROM t GROUP BY ALL")
def r1_thousand_shifts(spark, d):
    return H.shift_summaries(view(spark, d, "spikes").withColumnRenamed("t_sample", "t"), 1000, 5000000, 600000, CELL)


SHIFTED = f"""+ span AS (SELECT session_id, (max(synced_time) - min(synced_time)) / (count(*) - 1) AS dt, max(synced_time) AS t_max FROM position GROUP BY 1), c AS (SELECT DISTINCT session_id, cluster_id FROM spikes), o AS (SELECT c.*, CAST(k AS INT) AS shuffle_id, 600000 + {DRAW.format("'shift', session_id, cluster_id, k", 3800000)} AS moved FROM c, range(100) r(k)),
 m AS (SELECT o.session_id, o.cluster_id, shuffle_id, (t_sample + moved) % 5000000 AS t_sample FROM spikes JOIN o USING (session_id, cluster_id)),
 hit AS (SELECT m.*, CAST(round_even(t_sample / (dt * 30000.0::DOUBLE), 0) AS BIGINT) AS pos_idx FROM m JOIN span USING (session_id) WHERE t_sample / 30000.0::DOUBLE < t_max),
 counts AS (SELECT session_id, cluster_id, shuffle_id, least(CAST(floor(hd + 180) AS INT), 359) AS bin, count(*) AS n FROM hit JOIN position USING (session_id, pos_idx) GROUP BY ALL),
 total AS (SELECT session_id, cluster_id, shuffle_id, CAST(sum(n) AS BIGINT) AS n FROM counts GROUP BY ALL),
 hist AS (SELECT session_id, cluster_id, shuffle_id, CAST(((bin + d) % 360 + 360) % 360 AS INT) AS bin, sum(n) AS n FROM counts, range(-11, 12) r(d) GROUP BY ALL)"""


HALVES_SHIFTED = SHIFTED.replace("range(100)", "range(20)") + """, own_ AS (SELECT s.session_id, cluster_id, -1 AS shuffle_id, CAST(round_even(t_sample / (dt * 30000.0::DOUBLE), 0) AS BIGINT) AS pos_idx FROM spikes s JOIN span ON s.session_id = span.session_id WHERE t_sample / 30000.0::DOUBLE < t_max),
 at_ AS (SELECT h.session_id, cluster_id, shuffle_id, hd, synced_time FROM (SELECT session_id, cluster_id, shuffle_id, pos_idx FROM hit UNION ALL SELECT * FROM own_) h JOIN position p ON h.session_id = p.session_id AND h.pos_idx = p.pos_idx)""" + ratios("at_", "position", "session_id, cluster_id, shuffle_id", "session_id")


@query(HALVES_SHIFTED + f""", r AS (SELECT session_id, cluster_id, shuffle_id, {SAFE.replace('round(corr({0}, {1}), 5)', 'corr({0}, {1})').format('a.ratio', 'b.ratio')} AS r FROM rates a JOIN rates b USING (session_id, cluster_id, shuffle_id, bin) WHERE a.half = 1 AND b.half = 2 GROUP BY ALL)
 SELECT o.session_id, o.cluster_id, round(o.r, 6) AS observed, round(avg(v.r), 6) AS mean, round(stddev_pop(v.r), 6) AS sd, round(50.0::DOUBLE * (count(*) FILTER (v.r < o.r) + count(*) FILTER (v.r <= o.r)) / count(*), 6) AS percentile FROM r o JOIN r v ON o.session_id = v.session_id AND o.cluster_id = v.cluster_id WHERE o.shuffle_id = -1 AND v.shuffle_id >= 0 AND v.r IS NOT NULL GROUP BY o.session_id, o.cluster_id, o.r""")
def c36_half_against_shuffles(spark, d):
    p = T.halves(view(spark, d, "position"), SESSION, "synced_time")
    both = H.shuffled_stability(view(spark, d, "spikes").withColumnRenamed("t_sample", "t"), p, 20, 5000000, 600000, SESSION, CELL, 20)
    return E.against_own(both, CELL).select(*CELL, *r6("observed", "mean", "sd", "percentile"))


@query(SHIFTED + " SELECT h.session_id, h.cluster_id, h.shuffle_id, round(sqrt(pow(sum(sin(radians(bin - 179.0)) * h.n), 2) + pow(sum(cos(radians(bin - 179.0)) * h.n), 2)) / sum(h.n), 5) AS hd_score, max(t.n) AS n FROM hist h JOIN total t ON h.session_id = t.session_id AND h.cluster_id = t.cluster_id AND h.shuffle_id = t.shuffle_id GROUP BY ALL")
def r2_shuffled_metrics(spark, d):
    m = H.shuffled_metrics(view(spark, d, "spikes").withColumnRenamed("t_sample", "t"), view(spark, d, "position"), 100, 5000000, 600000, CELL)
    return m.select(*CELL, "shuffle_id", F.round("hd_score", 5).alias("hd_score"), "n")


@query(BLOCKS + f""", s_ AS (SELECT session_id, cluster_id, field_id, pos_idx, hd, row_number() OVER (PARTITION BY session_id, cluster_id, field_id ORDER BY pos_idx) - 1 AS k, count(*) OVER (PARTITION BY session_id, cluster_id, field_id) AS size FROM around),
 c_ AS (SELECT session_id, cluster_id, field_id, count(*) AS n FROM inside GROUP BY ALL), z AS (SELECT session_id, cluster_id, field_id, max(size) AS size FROM s_ GROUP BY ALL),
 draw AS (SELECT c_.session_id, c_.cluster_id, c_.field_id, h AS shuffle_id, {DRAW.format("'field', c_.session_id, c_.cluster_id, c_.field_id, h, i", 'z.size')} AS k FROM c_ JOIN z USING (session_id, cluster_id, field_id), range(20) r(h), range(1, 10000) q(i) WHERE i <= c_.n)
 SELECT session_id, cluster_id, field_id, CAST(shuffle_id AS INT) AS shuffle_id, {DIR}, count(*) AS n FROM draw JOIN s_ USING (session_id, cluster_id, field_id, k) GROUP BY ALL""")
def r5_field_draws(spark, d):
    cells = inside(spark, d).groupBy(*FIELD).agg(F.count("*").alias("n"))
    samples = around(spark, d).select(*FIELD, "pos_idx", "hd")
    return H.direction_histograms(H.drawn_samples(cells, samples, 20, FIELD, FIELD, "n", "field"), FIELD, "hd", 20)


@query()
def r5_weighted_draws(spark, d):
    maps = joined(spark, d)
    rates = with_bins(maps).groupBy(*CELL, "bin_x", "bin_y").agg(F.count("*").cast("double").alias("rate"))
    seen = with_bins(view(spark, d, "position")).groupBy(*SESSION, "bin_x", "bin_y").agg(F.count("*").alias("o"))
    rates = rates.join(seen, [*SESSION, "bin_x", "bin_y"]).withColumn("rate", F.col("rate") / F.col("o")).drop("o")
    samples = with_bins(view(spark, d, "position")).select(*SESSION, "pos_idx", "hd", "bin_x", "bin_y").join(rates, [*SESSION, "bin_x", "bin_y"]).select(*CELL, "pos_idx", "hd", "rate")
    cells = maps.groupBy(*CELL).agg(F.count("*").alias("n"))
    return H.direction_histograms(H.drawn_samples(cells, samples, 5, CELL, CELL, "n", "weighted", F.col("rate")), CELL, "hd", 20)


@query(JOINED + f""", h_ AS (SELECT session_id, pos_idx, coalesce(h, lead(h) OVER (PARTITION BY session_id ORDER BY pos_idx)) - 180 AS hd FROM (SELECT session_id, pos_idx, degrees(atan2(y_px - lag(y_px) OVER w, x_px - lag(x_px) OVER w)) + 180 AS h FROM position WINDOW w AS (PARTITION BY session_id ORDER BY pos_idx)) x),
 s_ AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY pos_idx) - 1 AS k, count(*) OVER (PARTITION BY session_id) AS size FROM h_), z AS (SELECT session_id, max(size) AS size FROM s_ GROUP BY 1), c_ AS (SELECT session_id, cluster_id, count(*) AS n FROM joined GROUP BY ALL),
 draw AS (SELECT c_.session_id, c_.cluster_id, h AS shuffle_id, {DRAW.format("'heading', c_.session_id, c_.cluster_id, h, i", 'z.size')} AS k FROM c_ JOIN z USING (session_id), range(10) r(h), range(1, 100000) q(i) WHERE i <= c_.n)
 SELECT draw.session_id, draw.cluster_id, CAST(shuffle_id AS INT) AS shuffle_id, {DIR}, count(*) AS n FROM draw JOIN s_ ON draw.session_id = s_.session_id AND draw.k = s_.k WHERE hd IS NOT NULL GROUP BY ALL""")
def r6_heading_draws(spark, d):
    p = B.heading(view(spark, d, "position"), SESSION, ["pos_idx"], "x_px", "y_px").withColumn("heading", F.col("heading") - 180)
    return H.drawn_histograms(view(spark, d, "spikes"), p, 10, SESSION, CELL, "heading", "heading", 20)


@query(f"+ s_ AS (SELECT session_id, trial, count(*) FILTER (speed < 3) AS n FROM track GROUP BY ALL), k_ AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY trial) - 1 AS k, count(*) OVER (PARTITION BY session_id) AS size FROM s_), z AS (SELECT session_id, max(size) AS size FROM k_ GROUP BY 1), dr AS (SELECT session_id, h AS shuffle_id, i, {DRAW.format(chr(39) + 'trial' + chr(39) + ', session_id, h, i', 'size')} AS k FROM z, range(100) r(h), range(100) q(i)), st AS (SELECT dr.session_id, shuffle_id, i, {DRAW.format(chr(39) + 'stop' + chr(39) + ', dr.session_id, shuffle_id, i, j', 20)} AS bin FROM dr JOIN k_ ON k_.session_id = dr.session_id AND k_.k = dr.k, range(1, 1000) x(j) WHERE j <= n) SELECT session_id, CAST(shuffle_id AS INT) AS shuffle_id, bin, round(count(DISTINCT i) / 100, 6) AS stops FROM st GROUP BY ALL")
def r10_stop_shuffle(spark, d):
    stops = view(spark, d, "track").groupBy("session_id", "trial").agg(F.count_if(F.col("speed") < 3).alias("n_stops"))
    return H.shuffled_stops(stops, SESSION, 100, 100, 0.0, 200.0, 10.0).select("session_id", "shuffle_id", "bin", *r6("stops"))


@query(BLOCKS + """, f_ AS (SELECT session_id, cluster_id, field_id, count(*) AS n FROM inside GROUP BY ALL), d_ AS (SELECT *, first_value(session_id) OVER w AS first_day, first_value(n) OVER w AS first_n, row_number() OVER w AS k FROM f_ WINDOW w AS (PARTITION BY cluster_id, field_id ORDER BY session_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) SELECT cluster_id, field_id, session_id AS day, CAST(k AS INT) AS day_no, n, first_day, round(n / first_n, 6) AS change FROM d_""")
def r11_fields_by_day(spark, d):
    """Each field's spikes on every day it is seen, by those of its first day; sessions stand for days."""
    n = inside(spark, d).groupBy(*FIELD).agg(F.count("*").alias("n"))
    return H.by_day(n, ["cluster_id", "field_id"], "session_id", "n").select("cluster_id", "field_id", F.col("session_id").alias("day"), "day_no", "n", "first_day", F.round("change", 6).alias("change"))


@query()
def r12_expected_ratio(spark, d):
    return H.drawn_ratios(view(spark, d, "spikes"), view(spark, d, "position"), 100, SESSION, CELL, "expected", "hd", 40, BLOCK).select(*FIELD, "shuffle_id", *r6("ratio"))


@query(RATES + ", g AS (SELECT session_id, trial, trial % 3 AS trial_type, (max(bin) + min(bin)) / 2 * 40.0::DOUBLE AS goal FROM dwell GROUP BY ALL) SELECT r.session_id, r.cluster_id, trial_type, CAST(r.bin - floor(goal / 40) AS BIGINT) AS bin, round(avg(rate), 5) AS rate FROM rates r JOIN g USING (session_id, trial) GROUP BY ALL")
def a23_goal_aligned(spark, d):
    rates = trial_rates(spark, d)
    goals = rates.select("session_id", "trial", "bin").distinct().groupBy("session_id", "trial").agg(((F.max("bin") + F.min("bin")) / 2 * 40.0).alias("goal")).withColumn("trial_type", F.col("trial") % 3)
    return L.goal_aligned(rates, goals, SESSION, CELL, 40.0).select(*CELL, "trial_type", "bin", F.round("rate", 5).alias("rate"))


@query("SELECT session_id, cluster_id, CAST(t_sample AS BIGINT) AS t, cluster_id + 1 AS label FROM spikes")
def u4_labelled_times(spark, d):
    cells = view(spark, d, "spikes").groupBy(*CELL).agg(F.collect_list("t_sample").alias("times")).withColumn("label", F.col("cluster_id") + 1)
    return L.labelled_times(cells, CELL, "times", "label")


@query(FIELDS + " SELECT session_id, cluster_id, bin_x + 2 AS bin_x, bin_y - 1 AS bin_y, n FROM bins WHERE bin_x + 2 BETWEEN 0 AND 9 AND bin_y - 1 BETWEEN 0 AND 9")
def x2_shifted_maps(spark, d):
    bins = with_bins(joined(spark, d)).groupBy(*CELL, "bin_x", "bin_y").agg(F.count("*").alias("n"))
    return L.shifted_bins(bins, 2, 1, 10, 10)


@query("SELECT snippet_id, CAST(pos - 1 AS INT) AS col, CAST(0 AS INT) AS row, CAST(embedding[pos] AS DOUBLE) AS value FROM waves, range(1, 5) r(pos)")
def x7_matrix_rows(spark, d):
    w = view(spark, d, "waves").withColumn("matrix", F.array(F.slice("embedding", 1, 4)))
    rows = w.select("snippet_id", F.explode(scalar.matrix_rows("matrix")).alias("m"))
    return rows.select("snippet_id", F.col("m.col").alias("col"), F.col("m.row").alias("row"), F.col("m.value").cast("double").alias("value"))


@query("SELECT session_id, pos_idx, round(sqrt(x_px * x_px + y_px * y_px), 6) AS rho, round(atan2(y_px, x_px), 6) AS phi FROM position")
def x1_polar(spark, d):
    rho, phi = scalar.to_polar("x_px", "y_px")
    return view(spark, d, "position").select("session_id", "pos_idx", F.round(rho, 6).alias("rho"), F.round(phi, 6).alias("phi"))


THETA_INDEX = """+ k_ AS (SELECT d, 1.0::DOUBLE AS one, exp(-d * d / 50.0::DOUBLE) AS k FROM range(-20, 21) r(d)), kernel AS (SELECT d, k / (SELECT sum(k) FROM k_) AS k FROM k_),
 g AS (SELECT d, sum(k) AS g FROM (SELECT d, k FROM kernel UNION ALL SELECT d + 1, k FROM kernel) GROUP BY 1),
 f AS (SELECT k FROM range(30, 131) r(k) WHERE k BETWEEN 60 AND 100 OR k <= 50 OR k >= 110),
 tap AS (SELECT tau, sum(g * w * cos(2 * pi() * k * i / 10000)) AS re, sum(g * w * sin(2 * pi() * k * i / 10000)) AS im, k FROM (SELECT tau, tau + d AS i, g, 0.5 - 0.5 * cos(2 * pi() * (tau + d) / 10000) AS w FROM range(-21, 10021) r(tau), g WHERE tau + d BETWEEN 0 AND 9999), f GROUP BY tau, k),
 c AS (SELECT session_id, cluster_id, t_sample // 30 AS ms, count(*) AS n FROM spikes GROUP BY ALL),
 e AS (SELECT session_id, cluster_id, segment, ms - 5000 * segment AS tau, n FROM c, range(0, 32) r(segment) WHERE ms - 5000 * segment BETWEEN -21 AND 10020),
 p AS (SELECT session_id, cluster_id, segment, k, pow(sum(n * re), 2) + pow(sum(n * im), 2) AS p FROM e JOIN tap USING (tau) GROUP BY ALL),
 h AS (SELECT session_id, cluster_id, k, sum(p) * k AS p FROM p GROUP BY session_id, cluster_id, k),
 b AS (SELECT session_id, cluster_id, avg(p) FILTER (k BETWEEN 60 AND 100) AS theta, avg(p) FILTER (k NOT BETWEEN 60 AND 100) AS base FROM h GROUP BY ALL)
 SELECT session_id, cluster_id, round((theta - base) / nullif(theta + base, 0), 6) AS theta_index FROM b"""


@query(THETA_INDEX)
def c21_theta_index(spark, d):
    s = view(spark, d, "spikes").withColumn("ms", F.floor(F.col("t_sample") / 30))
    return Z.theta_index(s, CELL, "ms", 166_667).select(*CELL, *r6("theta_index"))


CORRELOGRAM_THETA = """+ c AS (SELECT a.session_id, a.cluster_id, CAST(floor((b.t_sample - a.t_sample) / 30) AS BIGINT) AS lag, count(*)::DOUBLE AS n FROM spikes a JOIN spikes b ON a.session_id = b.session_id AND a.cluster_id = b.cluster_id AND abs(b.t_sample - a.t_sample) <= 30000 AND b.t_sample <> a.t_sample GROUP BY ALL),
 v AS (SELECT session_id, cluster_id, lag + 1000 AS i, CASE WHEN lag = 0 THEN 0 ELSE n END AS v FROM c), m AS (SELECT session_id, cluster_id, sum(v) / 2001 AS mean FROM v GROUP BY ALL),
 tap AS (SELECT i, k, (0.5 - 0.5 * cos(2 * pi() * i / 2001)) * cos(2 * pi() * k * i / 2001) AS re, (0.5 - 0.5 * cos(2 * pi() * i / 2001)) * sin(2 * pi() * k * i / 2001) AS im FROM range(0, 2001) a(i), range(1, 251) b(k)),
 d AS (SELECT session_id, cluster_id, k, sum(v * re) AS re, sum(v * im) AS im FROM v JOIN tap USING (i) GROUP BY ALL),
 p AS (SELECT session_id, cluster_id, k, pow(re + CASE WHEN k = 1 THEN mean * 2001 / 4 ELSE 0 END, 2) + pow(im, 2) AS p FROM d JOIN m USING (session_id, cluster_id)),
 t AS (SELECT session_id, cluster_id, arg_max(k, (p, -k)) AS peak FROM p WHERE k * 1000 / 2001 BETWEEN 4 AND 11 GROUP BY ALL)
 SELECT session_id, cluster_id, round(peak * 1000 / 2001, 6) AS peak_freq, avg(p) FILTER (abs(k - peak) <= 2) > 5 * avg(p) AS modulated FROM p JOIN t USING (session_id, cluster_id) GROUP BY session_id, cluster_id, peak"""


@query(CORRELOGRAM_THETA)
def c22_correlogram_theta(spark, d):
    from ..operators import joins as J

    s = view(spark, d, "spikes")
    c = J.correlogram(s.selectExpr("session_id", "cluster_id", "t_sample AS ta"), s.selectExpr("session_id", "cluster_id", "t_sample AS tb"), CELL, 30_000, 30)
    return Z.correlogram_theta(c, CELL, "lag_bin", "n", 1000).select(*CELL, *r6("peak_freq"), "modulated")


def signal_size(spark, d):
    return view(spark, d, "signal").agg(F.max("t")).first()[0] or 0


SPECTRUM = """+ z AS (SELECT max(t) + 1 AS size FROM signal), s AS (SELECT session_id, channel, segment, t - 30 * segment AS i, value::DOUBLE AS v, size FROM signal, z, range(-1, 1) r(b), LATERAL (SELECT t // 30 + b AS segment) WHERE segment BETWEEN 0 AND (size - 60) // 30),
 tap AS (SELECT i, k, (0.5 - 0.5 * cos(2 * pi() * i / 60)) * cos(2 * pi() * k * i / 60) AS re, (0.5 - 0.5 * cos(2 * pi() * i / 60)) * sin(2 * pi() * k * i / 60) AS im FROM range(0, 60) a(i), range(0, 29, 4) b(k)),
 d AS (SELECT session_id, channel, segment, k, max(size) AS size, sum(v * re) - CASE WHEN k = 0 THEN sum(v) / 2 ELSE 0 END AS re, sum(v * im) AS im FROM s JOIN tap USING (i) GROUP BY session_id, channel, segment, k)
 SELECT session_id, channel, CAST(k // 4 AS INT) AS hz, round(sum(CASE WHEN k = 0 THEN 1 ELSE 2 END * (re * re + im * im) / (15 * 22.5::DOUBLE)) / ((max(size) - 60) // 30 + 1), 6) AS power FROM d GROUP BY session_id, channel, k"""


@query(SPECTRUM)
def c23_channel_spectrum(spark, d):
    s = view(spark, d, "signal")
    w = Z.welch(s, ["session_id", "channel"], "t", "value", 15.0, 60, signal_size(spark, d) + 1)
    return Z.interpolated_spectrum(w, ["session_id", "channel"], 7).select("session_id", "channel", "hz", *r6("power"))


EPOCH_BANDS = """+ s AS (SELECT session_id, channel, t // 30 AS epoch, t % 30 AS i, value::DOUBLE AS v FROM signal), w AS (SELECT session_id, channel, epoch FROM s GROUP BY ALL HAVING count(*) = 30),
 tap AS (SELECT i, k, (0.5 - 0.5 * cos(2 * pi() * i / 30)) * cos(2 * pi() * k * i / 30) AS re, (0.5 - 0.5 * cos(2 * pi() * i / 30)) * sin(2 * pi() * k * i / 30) AS im FROM range(0, 30) a(i), range(1, 15) b(k) WHERE k <= 4 OR k >= 8),
 d AS (SELECT session_id, channel, epoch, k, sum(v * re) + CASE WHEN k = 1 THEN sum(v) / 4 ELSE 0 END AS re, sum(v * im) AS im FROM s JOIN w USING (session_id, channel, epoch) JOIN tap USING (i) GROUP BY session_id, channel, epoch, k),
 b AS (SELECT session_id, channel, epoch, avg(2 * (re * re + im * im) / (15 * 11.25::DOUBLE)) FILTER (k <= 4) AS slow, avg(2 * (re * re + im * im) / (15 * 11.25::DOUBLE)) FILTER (k >= 8) AS fast FROM d GROUP BY ALL),
 m AS (SELECT session_id, channel, t // 30 AS epoch, avg(speed) AS mean_speed, median(speed) AS median_speed, max(speed) AS max_speed FROM signal GROUP BY ALL)
 SELECT session_id, channel, epoch, round(slow, 6) AS slow, round(fast, 6) AS fast, round(mean_speed, 6) AS mean_speed, round(median_speed, 6) AS median_speed, round(max_speed, 6) AS max_speed FROM b JOIN m USING (session_id, channel, epoch)"""


@query(EPOCH_BANDS)
def c24_epoch_bands(spark, d):
    s = view(spark, d, "signal")
    bands = Z.epoch_bands(s, ["session_id", "channel"], "t", "value", 15.0, 30, {"slow": (0.5, 2), "fast": (4, 7)})
    speed = s.groupBy("session_id", "channel", F.floor(F.col("t") / 30).alias("epoch")).agg(F.avg("speed").alias("mean_speed"), F.percentile("speed", F.lit(0.5)).alias("median_speed"), F.max("speed").alias("max_speed"))
    return bands.join(speed, ["session_id", "channel", "epoch"]).select("session_id", "channel", "epoch", *r6("slow", "fast", "mean_speed", "median_speed", "max_speed"))


@query()
def c25_theta_phase(spark, d):
    return Z.theta_phase(view(spark, d, "signal"), ["session_id", "channel"], "t", "value", 30.0).select("session_id", "channel", "t", F.round("phase", 4).alias("phase"))


@query("""+ s_ AS (SELECT session_id, cluster_id, spike_idx, 1 AS tetrode, t_sample // 30000 AS t FROM spikes), w_ AS (SELECT s_.session_id, cluster_id, spike_idx, tetrode, CAST(ch AS INT) AS channel, pos, s_.t - 10 + pos AS tt FROM s_, range(1, 5) c(ch), range(30) p(pos))
 SELECT w_.session_id, cluster_id, spike_idx, tetrode, w_.channel, list(round(coalesce(value, 0), 4) ORDER BY pos) AS waveform FROM w_ LEFT JOIN signal g ON g.session_id = w_.session_id AND g.channel = w_.channel AND g.t = w_.tt GROUP BY ALL""".replace(", list(round(coalesce(value, 0), 4) ORDER BY pos) AS waveform", ", round(sum(coalesce(value, 0) * (pos + 1)), 4) AS weighted"))
def c27_snippets(spark, d):
    s = view(spark, d, "spikes").select("session_id", "cluster_id", "spike_idx", F.lit(1).alias("tetrode"), F.floor(F.col("t_sample") / 30000).alias("t"))
    w = V.snippets(s, view(spark, d, "signal"), SESSION)
    total = F.aggregate(F.transform("waveform", lambda v, i: v * (i + 1)), F.lit(0.0), lambda a, v: a + v)
    return w.select("session_id", "cluster_id", "spike_idx", "tetrode", "channel", F.round(total, 4).alias("weighted"))


WAVEFORM_SHAPE = """+ u AS (SELECT cluster_id, unnest(range(len(embedding))) AS pos, unnest(embedding)::DOUBLE AS v FROM waves), m AS (SELECT cluster_id, CAST(pos AS INT) AS pos, avg(v) AS v FROM u GROUP BY ALL),
 t AS (SELECT cluster_id, pos AS peak, v AS height FROM m QUALIFY row_number() OVER (PARTITION BY cluster_id ORDER BY abs(v) DESC, pos) = 1),
 x AS (SELECT m.cluster_id, pos, peak, v * sign(height) AS y, CASE WHEN v * sign(height) >= abs(height) / 2 THEN 1 ELSE -1 END AS side FROM m JOIN t ON m.cluster_id = t.cluster_id),
 o AS (SELECT *, side <> lag(side) OVER (PARTITION BY cluster_id ORDER BY pos) AS crosses FROM x), g AS (SELECT cluster_id, pos - lag(pos) OVER (PARTITION BY cluster_id ORDER BY pos) AS gap FROM o WHERE crosses),
 h AS (SELECT cluster_id, max(gap) AS half_width FROM g GROUP BY 1), r AS (SELECT cluster_id, any_value(peak) AS peak_pos, arg_min(pos, (y, pos)) FILTER (pos > peak) AS trough_pos FROM x GROUP BY 1)
 SELECT r.cluster_id, peak_pos, trough_pos, trough_pos - peak_pos AS peak_to_trough, half_width FROM r LEFT JOIN h ON r.cluster_id = h.cluster_id"""


@query(WAVEFORM_SHAPE)
def c26_waveform_shape(spark, d):
    u = view(spark, d, "waves").select("cluster_id", F.posexplode("embedding").alias("pos", "v"))
    return V.shape(u, ["cluster_id"], "pos", "v")


@query()
def c28_waveform_components(spark, d):
    pc = V.principal_components(view(spark, d, "waves"), ["cluster_id"], "snippet_id", "embedding")
    return pc.select("cluster_id", "snippet_id", F.round(pc.pc[0], 4).alias("pc1"), F.round(pc.pc[1], 4).alias("pc2"))



def two(spark, d):
    from .registry import two_samples

    return two_samples(spark, d)


VALUES = "+ q AS (SELECT session_id, CAST(cluster_id % 2 AS INT) AS s, floor(value)::DOUBLE AS v FROM spikes)"


@query(VALUES + ", m AS (SELECT session_id, count(*) FILTER (s = 0)::DOUBLE AS n0, count(*) FILTER (s = 1)::DOUBLE AS n1, avg(v) FILTER (s = 0) AS m0, avg(v) FILTER (s = 1) AS m1, var_samp(v) FILTER (s = 0) AS v0, var_samp(v) FILTER (s = 1) AS v1 FROM q GROUP BY 1) SELECT session_id, round((m0 - m1) / sqrt(v0 / n0 + v1 / n1), 5) AS t, round(pow(v0 / n0 + v1 / n1, 2) / (pow(v0 / n0, 2) / (n0 - 1) + pow(v1 / n1, 2) / (n1 - 1)), 4) AS df FROM m")
def c32_welch(spark, d):
    return G.t_test(two(spark, d), SESSION, "sample", "v").select("session_id", F.round("t", 5).alias("t"), F.round("df", 4).alias("df"))


@query(VALUES + ", k AS (SELECT session_id, s, median(v) AS m FROM q GROUP BY 1, 2), z AS (SELECT q.session_id, q.s, abs(v - m) AS z FROM q JOIN k ON q.session_id = k.session_id AND q.s = k.s), g AS (SELECT session_id, avg(z) AS grand, count(*)::DOUBLE AS total FROM z GROUP BY 1), p AS (SELECT session_id, s, count(*)::DOUBLE AS n, avg(z) AS mean, var_pop(z) AS var FROM z GROUP BY 1, 2) SELECT p.session_id, CASE WHEN count(*) = 2 THEN round((max(total) - 2) * sum(n * pow(mean - grand, 2)) / nullif(sum(n * var), 0), 5) END AS levene FROM p JOIN g ON p.session_id = g.session_id GROUP BY 1")
def c32_levene(spark, d):
    return G.levene(two(spark, d), SESSION, "sample", "v").select("session_id", F.round("levene", 5).alias("levene"))


@query(VALUES + ", c AS (SELECT session_id, v, count(*) FILTER (s = 0)::DOUBLE AS a, count(*)::DOUBLE AS t FROM q GROUP BY 1, 2), r AS (SELECT *, coalesce(sum(t) OVER (PARTITION BY session_id ORDER BY v ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + (t + 1) / 2 AS rk FROM c), k AS (SELECT session_id, sum(a * rk) AS r, sum(a) AS n, sum(t) AS total, sum(t * t * t - t) AS ties FROM r GROUP BY 1) SELECT session_id, round(r - n * (n + 1) / 2, 3) AS u, round((r - n * (n + 1) / 2 - n * (total - n) / 2) / sqrt(n * (total - n) / 12 * (total + 1 - ties / (total * (total - 1)))), 5) AS z FROM k")
def c32_rank_sum(spark, d):
    return G.rank_sum(two(spark, d), SESSION, "sample", "v").select("session_id", F.round("u", 3).alias("u"), F.round("z", 5).alias("z"))


@query("+ d_ AS (SELECT session_id, y_px - x_px AS d FROM position WHERE y_px <> x_px), c AS (SELECT session_id, abs(d) AS v, count(*) FILTER (d > 0)::DOUBLE AS up, count(*)::DOUBLE AS t FROM d_ GROUP BY 1, 2), r AS (SELECT *, coalesce(sum(t) OVER (PARTITION BY session_id ORDER BY v ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + (t + 1) / 2 AS rk FROM c) SELECT session_id, round(least(sum(up * rk), sum((t - up) * rk)), 3) AS w FROM r GROUP BY 1")
def c32_signed_rank(spark, d):
    return G.signed_rank(view(spark, d, "position"), SESSION, "y_px", "x_px").select("session_id", F.round("w", 3).alias("w"))


UNIT = "+ u AS (SELECT session_id, cluster_id, t_sample / 5000000.0::DOUBLE AS u FROM spikes), i AS (SELECT *, row_number() OVER (PARTITION BY session_id, cluster_id ORDER BY u) AS i, count(*) OVER (PARTITION BY session_id, cluster_id)::DOUBLE AS n FROM u)"


@query(UNIT + " SELECT session_id, cluster_id, round(max(i / n - u) + max(u - (i - 1) / n), 6) AS kuiper FROM i GROUP BY 1, 2")
def c13_kuiper_one_sample(spark, d):
    return G.kuiper_one(view(spark, d, "spikes"), CELL, F.col("t_sample") / 5000000.0).select(*CELL, *r6("kuiper"))


@query(UNIT + " SELECT session_id, cluster_id, round(sum(pow(u - (2 * i - 1) / (2 * n), 2)) + 1 / (12 * max(n)) - max(n) * pow(avg(u) - 0.5, 2), 6) AS u2 FROM i GROUP BY 1, 2")
def c14_watson_one_sample(spark, d):
    return G.watson_one(view(spark, d, "spikes"), CELL, F.col("t_sample") / 5000000.0).select(*CELL, *r6("u2"))


@query()
def c32_p_values(spark, d):
    t = two(spark, d)
    tests = {"welch": G.t_test, "levene": G.levene, "rank_sum": G.rank_sum, "ks": G.kolmogorov_two, "kuiper": G.kuiper_two}
    out = None
    for name, f in tests.items():
        part = f(t, SESSION, "sample", "v").select("session_id", F.lit(name).alias("test"), F.round("p", 6).alias("p"))
        out = part if out is None else out.union(part)
    return out


@query("+ f AS (SELECT session_id, t_sample / 1000000.0::DOUBLE AS a, t_sample / 1000000.0::DOUBLE + value / 100 AS b FROM spikes), e AS (SELECT session_id, 0.0::DOUBLE AS x, ceil(b) - floor(a) - 1 AS w FROM f UNION ALL SELECT session_id, a - floor(a), 1 FROM f UNION ALL SELECT session_id, b - floor(b), CASE WHEN b > floor(b) THEN -1 ELSE 0 END FROM f), g AS (SELECT session_id, x, sum(w) AS w FROM e GROUP BY 1, 2) SELECT session_id, round(x, 6) AS start, round(coalesce(lead(x) OVER (PARTITION BY session_id ORDER BY x), 1), 6) AS stop, round(sum(w) OVER (PARTITION BY session_id ORDER BY x), 6)::DOUBLE AS weight FROM g")
def x8_folded_intervals(spark, d):
    s = view(spark, d, "spikes").select("session_id", (F.col("t_sample") / 1000000.0).alias("a"), F.lit(1.0).alias("w"), (F.col("t_sample") / 1000000.0 + F.col("value") / 100).alias("b"))
    return G.folded(s, SESSION, "a", "b", "w").select("session_id", *r6("start", "stop", "weight"))



@query("SELECT cluster_id, session_id, (coalesce(isolation > 0.9 AND noise_overlap < 0.05 AND peak_snr > 1 AND mean_firing_rate > 0, false) OR grp = 'BUILDING') AS is_good FROM cells")
def f1_curation_with_bypass(spark, d):
    c = view(spark, d, "cells").withColumn("by_hand", F.col("grp") == "BUILDING")
    return K.curated(c, manual="by_hand").select("cluster_id", "session_id", "is_good")


SHUFFLED_SCORE = SHIFTED + ", sc AS (SELECT h.session_id, h.cluster_id, h.shuffle_id, sqrt(pow(sum(sin(radians(bin - 179.0)) * h.n), 2) + pow(sum(cos(radians(bin - 179.0)) * h.n), 2)) / sum(h.n) AS hd_score FROM hist h GROUP BY ALL)"


@query(SHUFFLED_SCORE + " SELECT session_id, cluster_id, round(avg(hd_score) + 2.326 * stddev_pop(hd_score), 5) AS cutoff, count(hd_score) AS n_shuffles FROM sc GROUP BY 1, 2")
def r3_shuffled_cutoffs(spark, d):
    m = H.shuffled_metrics(view(spark, d, "spikes").withColumnRenamed("t_sample", "t"), view(spark, d, "position"), 100, 5000000, 600000, CELL)
    return S.shuffle_cutoffs(m, CELL, "hd_score", 2.326).select(*CELL, F.round("cutoff", 5).alias("cutoff"), "n_shuffles")


@query()
def r4_spatial_labels(spark, d):
    m = H.shuffled_metrics(view(spark, d, "spikes").withColumnRenamed("t_sample", "t"), view(spark, d, "position"), 100, 5000000, 600000, CELL, own=True)
    own = lambda c: F.max(F.when(F.col("shuffle_id") < 0, F.col(c)))
    of = lambda f, c: f(F.when(F.col("shuffle_id") >= 0, F.col(c)))
    scores = {"hd_score": own("hd_score"), "rayleigh_p": own("p"), "hd_score_cutoff": of(F.avg, "hd_score") + 2.326 * of(F.stddev_pop, "hd_score"), "rayleigh_p_cutoff": of(F.avg, "p") - 2.326 * of(F.stddev_pop, "p")}
    none = {c: F.lit(None).cast("double") for c in ("grid_score", "border_score", "spatial_information", "speed_score", "grid_score_cutoff", "border_score_cutoff", "spatial_information_cutoff", "speed_score_cutoff")}
    both = m.groupBy(*CELL).agg(*(v.alias(c) for c, v in scores.items())).where("hd_score is not null").withColumns(none)
    return K.labelled(both).select(*CELL, "hd", "hd_rayleigh", "label")


@query(SHUFFLED_SCORE + JOINED.replace("+ span AS", ", span0 AS").replace("JOIN span ", "JOIN span0 ").replace(" hit AS", " hit0 AS").replace("FROM hit h", "FROM hit0 h") + ", c0 AS (SELECT session_id, cluster_id, least(CAST(floor(hd + 180) AS INT), 359) AS bin, count(*) AS n FROM joined GROUP BY ALL), h0 AS (SELECT session_id, cluster_id, CAST(((bin + d) % 360 + 360) % 360 AS INT) AS bin, sum(n) AS n FROM c0, range(-11, 12) r(d) GROUP BY ALL), o0 AS (SELECT session_id, cluster_id, sqrt(pow(sum(sin(radians(bin - 179.0)) * n), 2) + pow(sum(cos(radians(bin - 179.0)) * n), 2)) / sum(n) AS hd FROM h0 GROUP BY ALL) SELECT o0.session_id, o0.cluster_id, round(50.0 * (sum(CAST(hd_score < hd AS INT)) + sum(CAST(hd_score <= hd AS INT))) / count(*), 4) AS percentile, 50.0 * (sum(CAST(hd_score < hd AS INT)) + sum(CAST(hd_score <= hd AS INT))) / count(*) > 95 AS directional FROM o0 JOIN sc ON o0.session_id = sc.session_id AND o0.cluster_id = sc.cluster_id GROUP BY 1, 2")
def r9_directional_cells(spark, d):
    m = H.shuffled_metrics(view(spark, d, "spikes").withColumnRenamed("t_sample", "t"), view(spark, d, "position"), 100, 5000000, 600000, CELL, own=True)
    p = Q.directional_tests(m, CELL, "hd_score")
    return p.select(*CELL, F.round("percentile", 4).alias("percentile"), "directional")



@query("+ t AS (SELECT session_id, median(sync_led) + 1 * stddev_pop(sync_led) AS level FROM position GROUP BY 1), o AS (SELECT p.session_id, pos_idx, CAST(sync_led > level AS INT) AS ison FROM position p JOIN t ON p.session_id = t.session_id), e AS (SELECT session_id, pos_idx, coalesce(ison - lag(ison) OVER (PARTITION BY session_id ORDER BY pos_idx), 0) AS edge FROM o) SELECT * FROM e WHERE edge <> 0")
def w10_led_edges(spark, d):
    p = B.led_threshold(view(spark, d, "position"), SESSION, "sync_led", 1.0)
    return B.edges(p, SESSION, ["pos_idx"], "sync_led", F.col("threshold")).where("edge <> 0").select("session_id", "pos_idx", "edge")


@query("""+ n AS (SELECT session_id, pos_idx, CASE WHEN x_px - lag(x_px) OVER (PARTITION BY session_id ORDER BY pos_idx) < -200 THEN 1 ELSE 0 END AS new FROM position),
 m AS (SELECT *, min(CASE WHEN new = 1 THEN pos_idx END) OVER (PARTITION BY session_id ORDER BY pos_idx ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS nxt FROM n),
 k AS (SELECT session_id, pos_idx, CASE WHEN new = 1 AND (nxt IS NULL OR nxt - pos_idx >= 4) THEN 1 ELSE 0 END AS new FROM m)
 SELECT session_id, pos_idx, CAST(sum(new) OVER (PARTITION BY session_id ORDER BY pos_idx) + 1 AS BIGINT) AS trial FROM k""")
def w15_spaced_trials(spark, d):
    return B.trials(view(spark, d, "position"), SESSION, ["pos_idx"], "x_px", 200.0, "pos_idx", 4).select("session_id", "pos_idx", "trial")


@query("""+ s AS (SELECT session_id, pos_idx, x_px, CASE WHEN x_px - lag(x_px) OVER w < -300 THEN pos_idx END AS st, x_px - lag(x_px, 6) OVER w AS v FROM position WINDOW w AS (PARTITION BY session_id ORDER BY pos_idx)),
 b AS (SELECT *, max(st) OVER (PARTITION BY session_id ORDER BY pos_idx) AS before, min(st) OVER (PARTITION BY session_id ORDER BY pos_idx ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS after FROM s),
 k AS (SELECT session_id, pos_idx, CASE WHEN coalesce(pos_idx - before <= 2, false) OR coalesce(after - pos_idx <= 2, false) THEN NULL ELSE v END AS v FROM b),
 g AS (SELECT *, max(CASE WHEN v IS NOT NULL THEN pos_idx END) OVER (PARTITION BY session_id ORDER BY pos_idx) AS ia, min(CASE WHEN v IS NOT NULL THEN pos_idx END) OVER (PARTITION BY session_id ORDER BY pos_idx ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS ib FROM k)
 SELECT g.session_id, g.pos_idx, round(5 * CASE WHEN g.v IS NOT NULL THEN g.v WHEN ib IS NULL THEN a.v ELSE a.v + (b.v - a.v) * (g.pos_idx - ia) / (ib - ia) END, 5) AS velocity FROM g LEFT JOIN k a ON a.session_id = g.session_id AND a.pos_idx = ia LEFT JOIN k b ON b.session_id = g.session_id AND b.pos_idx = ib""")
def w17_velocity(spark, d):
    return B.velocity(view(spark, d, "position"), SESSION, ["pos_idx"], "x_px", "pos_idx", 6, 2, 300.0).select("session_id", "pos_idx", F.round("velocity", 5).alias("velocity"))


@query("""+ o AS (SELECT session_id, pos_idx, pos_idx - row_number() OVER (PARTITION BY session_id ORDER BY pos_idx) AS g FROM position WHERE sync_led > 5.5),
 r AS (SELECT session_id, min(pos_idx) AS s, max(pos_idx) + 1 AS e FROM o GROUP BY session_id, g), q AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY s) AS k, count(*) OVER (PARTITION BY session_id) AS c, lead(s) OVER (PARTITION BY session_id ORDER BY s) AS n FROM r),
 z AS (SELECT session_id, CAST(floor((e - s) * 1000 / 30.0) AS BIGINT) AS width, CAST(floor((n - e) * 1000 / 30.0) AS BIGINT) AS gap FROM q WHERE c > 50 AND k BETWEEN 2 AND 51),
 w AS (SELECT session_id, min_by(width, struct_pack(a := -c, b := width)) AS width FROM (SELECT session_id, width, count(*) AS c FROM z WHERE width IS NOT NULL GROUP BY 1, 2) x GROUP BY 1), h AS (SELECT session_id, min_by(gap, struct_pack(a := -c, b := gap)) AS gap FROM (SELECT session_id, gap, count(*) AS c FROM z WHERE gap IS NOT NULL GROUP BY 1, 2) x GROUP BY 1)
 SELECT w.session_id, width, gap, round(1000.0::DOUBLE / (width + gap), 1) AS frequency, CASE WHEN round(1000.0::DOUBLE / (width + gap), 1) > 5 AND round(1000.0::DOUBLE / (width + gap), 1) % 2 = 0 THEN 1000 / round(1000.0::DOUBLE / (width + gap), 1) ELSE 200.0::DOUBLE END AS "window" FROM w JOIN h ON w.session_id = h.session_id""")
def w13_pulse_statistics(spark, d):
    runs = B.runs(view(spark, d, "position").where("sync_led > 5.5"), SESSION, "pos_idx").withColumn("end", F.col("end") + 1)
    return T.pulse_statistics(runs, SESSION, "start", "end", 30.0)


@query("+ c AS (SELECT a.session_id, a.cluster_id, CAST(floor((b.t_sample - a.t_sample) / 600) AS BIGINT) AS lag_bin, count(*) AS n FROM spikes a JOIN spikes b ON a.session_id = b.session_id AND a.cluster_id = b.cluster_id AND abs(b.t_sample - a.t_sample) <= 15000 AND b.t_sample <> a.t_sample GROUP BY 1, 2, 3), r AS (SELECT session_id, cluster_id, count(*) AS r FROM spikes GROUP BY 1, 2) SELECT c.session_id, c.cluster_id, lag_bin, n, round(n / sum(n) OVER (PARTITION BY c.session_id, c.cluster_id), 6) AS share, round(n / (r * 0.02::DOUBLE), 6) AS rate FROM c JOIN r ON c.session_id = r.session_id AND c.cluster_id = r.cluster_id")
def c19_normalised_correlogram(spark, d):
    from ..operators import joins as J

    s = view(spark, d, "spikes")
    c = J.correlogram(s.selectExpr("session_id", "cluster_id", "t_sample AS ta"), s.selectExpr("session_id", "cluster_id", "t_sample AS tb"), CELL, 15000, 600)
    return J.correlogram_rates(J.normalised(c, CELL), s, CELL, 0.02).select(*CELL, "lag_bin", "n", *r6("share", "rate"))


@query("+ b AS (SELECT session_id, trial, CAST(floor(x / 20) AS BIGINT) AS bin, avg(speed) AS v FROM track GROUP BY 1, 2, 3), s AS (SELECT session_id, trial, (bin + 0.5::DOUBLE) * 20 AS x FROM b WHERE v < 4.7) SELECT session_id, trial, count(*) FILTER (x > 90 AND x < 110) AS rewarded_stops, bool_or(x > 90 AND x < 110) AS rewarded FROM s GROUP BY 1, 2")
def a15_rewarded_stops(spark, d):
    b = view(spark, d, "track").groupBy("session_id", "trial", F.floor(F.col("x") / 20).alias("bin")).agg(F.avg("speed").alias("v")).where("v < 4.7")
    x = (F.col("bin") + 0.5) * 20
    inside = (x > 90) & (x < 110)
    return b.groupBy("session_id", "trial").agg(F.count_if(inside).alias("rewarded_stops"), F.bool_or(inside).alias("rewarded"))


@query("SELECT trial_type, CAST(floor(x / 10) AS BIGINT) AS bin, round(avg(speed), 6) AS speed FROM track GROUP BY ROLLUP (trial_type, CAST(floor(x / 10) AS BIGINT))")
def a11_type_speeds(spark, d):
    t = view(spark, d, "track").withColumn("bin", F.floor(F.col("x") / 10))
    return t.rollup("trial_type", "bin").agg(F.round(F.avg("speed"), 6).alias("speed"))


@query(JOINED + ", c AS (SELECT session_id, cluster_id, least(CAST(floor((hd + 180) / 18.0) AS BIGINT), 19) AS bin, count(*) AS n FROM joined GROUP BY ALL), o AS (SELECT session_id, least(CAST(floor((hd + 180) / 18.0) AS BIGINT), 19) AS bin, count(*) AS o FROM position GROUP BY ALL), g AS (SELECT DISTINCT session_id, cluster_id, r.bin FROM joined, range(20) r(bin)) SELECT g.session_id, g.cluster_id, g.bin, round(coalesce(coalesce(n, 0) / o, 0), 6) AS ratio FROM g LEFT JOIN c USING (session_id, cluster_id, bin) LEFT JOIN o USING (session_id, bin)")
def a2_direction_rates(spark, d):
    return E.direction_rates(joined(spark, d), view(spark, d, "position"), CELL, SESSION, 20).select(*CELL, "bin", *r6("ratio"))


# SQL for the queries on the coarse map, by the same expressions as for the map of place cells
ORACLES |= {
    name: with_views(COARSE + sql)
    for name, sql in {
        "a6_rate_map": " SELECT session_id, cluster_id, bin_x, bin_y, round(rate, 5) AS rate FROM map",
        "a7_peak_of_map": " SELECT session_id, cluster_id, round(max(rate), 5) AS max_rate FROM map GROUP BY 1, 2",
        "a8_spatial_information": ", p_ AS (SELECT *, n / sum(n) OVER (PARTITION BY session_id) AS p FROM seen), m_ AS (SELECT map.session_id, cluster_id, p, rate, sum(p * rate) OVER (PARTITION BY map.session_id, cluster_id) AS mean FROM map JOIN p_ ON p_.session_id = map.session_id AND p_.bin_x = map.bin_x AND p_.bin_y = map.bin_y) SELECT session_id, cluster_id, round(sum(CASE WHEN rate > 0 THEN p * rate * log2(rate / mean) ELSE 0 END) / nullif(max(mean), 0), 5) AS information FROM m_ GROUP BY 1, 2",
        "c4_autocorrelogram": AUTO + " SELECT session_id, cluster_id, dx, dy, n, round(r, 5) AS r FROM auto",
        "c5_correlogram_peaks": PEAKS + " SELECT session_id, cluster_id, label, round(cx, 5) AS cx, round(cy, 5) AS cy, area, round(distance, 5) AS distance FROM peaks",
        "c6_grid_spacing": PEAKS + " SELECT session_id, cluster_id, round(median(CASE WHEN k BETWEEN 2 AND 7 AND many > 7 THEN distance * 2.5 END), 5) AS spacing, round(max(CASE WHEN k = 1 AND many > 7 THEN sqrt(area * 2.5) / pi() END), 5) AS field_size FROM ranked GROUP BY 1, 2",
    }.items()
}
