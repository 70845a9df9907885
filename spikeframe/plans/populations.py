"""Registered queries of tracking, light response, fields and populations by their whole rules, and the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalar
from ..functions.lineage import cut
from ..operators import behaviour as B
from ..operators import curation as K
from ..operators import field_frames as E
from ..operators import firing_fields as P
from ..operators import joins as J
from ..operators import responses as R
from ..operators import sessions as T
from ..operators import shuffles as H
from ..operators import significance as G
from ..operators import similarity as Y
from ..operators import statistics as S
from ..operators import waveforms as V
from .extended import BLOCKS, CELLS_, DIR, DRAW, FIELD, FIELDS_, PEAKS, PLACE, around, field_half_rates, inside, place_maps, ratios, with_bins
from .fixtures import view, with_views
from .preparation import BLOCK, fields
from .registry import CELL, HIST, JOINED, ORACLES, ORDER, SESSION, joined, query, r6


def r5(*names):
    return [F.round(n, 5).alias(n) for n in names]


# Tracking

@query("""+ b AS (SELECT session_id, pos_idx, x_px AS xl, y_px AS yl, x_px + sync_led * 3 - 8 AS xr, y_px + 20 - pos_idx % 41 AS yr FROM position),
 c AS (SELECT *, sqrt(pow(xl - xr, 2) + pow(yl - yr, 2)) <= 15.3 AS near FROM b),
 m AS (SELECT session_id, pos_idx, near, CASE WHEN near THEN struct_pack(x := (xl + xr) / 2, y := (yl + yr) / 2, h := degrees(atan2(yr - yl, xr - xl))) END AS v FROM c),
 g AS (SELECT *, max(CASE WHEN near THEN pos_idx END) OVER (PARTITION BY session_id ORDER BY pos_idx) AS ia, min(CASE WHEN near THEN pos_idx END) OVER (PARTITION BY session_id ORDER BY pos_idx ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS ib FROM m),
 f AS (SELECT g.session_id, g.pos_idx, a.v AS a, b.v AS b, CASE WHEN ib IS NULL OR ib = ia THEN 0 ELSE (g.pos_idx - ia) / (ib - ia) END AS part FROM g LEFT JOIN m a ON a.session_id = g.session_id AND a.pos_idx = ia LEFT JOIN m b ON b.session_id = g.session_id AND b.pos_idx = coalesce(ib, ia))
 SELECT session_id, pos_idx, round(a.x + (b.x - a.x) * part, 5) AS x, round(a.y + (b.y - a.y) * part, 5) AS y, round(a.h + (b.h - a.h) * part, 5) AS hd FROM f""")
def w2_bead_tracking(spark, d):
    p = view(spark, d, "position").selectExpr("session_id", "pos_idx", "x_px AS x_left", "y_px AS y_left", "x_px + sync_led * 3 - 8 AS x_right", "y_px + 20 - pos_idx % 41 AS y_right")
    return B.bead_tracking(B.remove_far_beads(p, 15.3), SESSION, ORDER, "pos_idx").select("session_id", "pos_idx", *r5("x", "y", "hd"))


@query("""+ e AS (SELECT session_id, (max(synced_time) - min(synced_time)) / (count(*) - 1) AS e, count(*) AS n FROM position GROUP BY 1),
 v AS (SELECT session_id, (max(synced_time * 0.985::DOUBLE) - min(synced_time * 0.985::DOUBLE)) / (count(*) - 1) AS v FROM position WHERE pos_idx % 7 = 0 GROUP BY 1),
 f AS (SELECT session_id, v / e AS ratio, unnest(range(CAST(floor(n / (v / e)) AS BIGINT))) AS frame FROM e JOIN v USING (session_id))
 SELECT p.session_id, frame, pos_idx, round(sync_led, 4) AS sync FROM f JOIN position p ON p.session_id = f.session_id AND p.pos_idx = CAST(floor(frame * ratio) AS BIGINT)""")
def w9_sync_resampled(spark, d):
    p = view(spark, d, "position")
    frames = p.where("pos_idx % 7 = 0").select("session_id", (F.col("synced_time") * 0.985).alias("frame_t"))
    return T.resampled_sync(p, frames, SESSION, "pos_idx", "synced_time", "frame_t").select("session_id", "frame", "pos_idx", F.round("sync_led", 4).alias("sync"))


@query("""+ g AS (SELECT *, CAST(speed > 5 AS INT) AS i_, max(CASE WHEN speed > 5 THEN x END) OVER t AS hi, min(CASE WHEN speed > 5 THEN x END) OVER t AS lo FROM track WINDOW t AS (PARTITION BY session_id, trial))
 SELECT session_id, trial, sample, part, round(coalesce((hi + lo) / 2, 0), 6) AS goal, round(x - coalesce((hi + lo) / 2, 0), 6) AS "offset", coalesce(abs(i_ - lag(i_) OVER (PARTITION BY session_id, trial ORDER BY sample, part)), 0) AS edge FROM g""")
def w22_goal_offset(spark, d):
    out = T.goal_offset(view(spark, d, "track"), ["session_id", "trial"], ["sample", "part"], "x", F.col("speed") > 5)
    return out.select("session_id", "trial", "sample", "part", *r6("goal", "offset"), "edge")


@query("""+ o AS (SELECT session_id, pos_idx, x_px < 30 AS ison, coalesce(lag(x_px) OVER (PARTITION BY session_id ORDER BY pos_idx) < 30, false) AS was FROM position), s AS (SELECT session_id, pos_idx FROM o WHERE ison AND NOT was),
 k AS (SELECT session_id, pos_idx FROM (SELECT *, pos_idx - lag(pos_idx) OVER (PARTITION BY session_id ORDER BY pos_idx) AS gap FROM s) q WHERE gap IS NULL OR gap > 5)
 SELECT b.session_id, b.pos_idx, min(k.pos_idx) AS stop FROM position b JOIN k ON k.session_id = b.session_id AND k.pos_idx >= b.pos_idx WHERE b.pos_idx % 50 = 0 GROUP BY 1, 2""")
def w23_first_stops(spark, d):
    p = view(spark, d, "position")
    stops = T.spaced_stops(T.run_starts(p, SESSION, ORDER, F.col("x_px") < 30), SESSION, "pos_idx", 5)
    return T.first_stops(p.where("pos_idx % 50 = 0"), stops, SESSION, "pos_idx")


ARENA = """+ px AS MATERIALIZED (SELECT session_id, x_px AS x, y_px AS y FROM position),
 st(session_id, i, x0, x1, y0, y1) AS (SELECT session_id, 0, -1e9::DOUBLE, 1e9::DOUBLE, -1e9::DOUBLE, 1e9::DOUBLE FROM px GROUP BY 1 UNION ALL
  SELECT session_id, i + 1, CASE WHEN r - l > t - b AND nl <= nr THEN l + 1 ELSE x0 END, CASE WHEN r - l > t - b AND nl > nr THEN r - 1 ELSE x1 END, CASE WHEN r - l < t - b AND nt > nb THEN b + 1 ELSE y0 END, CASE WHEN r - l < t - b AND nt <= nb THEN t - 1 ELSE y1 END
  FROM (SELECT e.session_id, i, x0, x1, y0, y1, l, r, b, t, count(*) FILTER (x < l + 1) AS nl, count(*) FILTER (x > r - 1) AS nr, count(*) FILTER (y < b + 1) AS nb, count(*) FILTER (y > t - 1) AS nt
   FROM (SELECT st.session_id, i, x0, x1, y0, y1, round_even(min(x), 0) AS l, round_even(max(x), 0) AS r, round_even(min(y), 0) AS b, round_even(max(y), 0) AS t FROM st JOIN px ON px.session_id = st.session_id AND x >= x0 AND x <= x1 AND y >= y0 AND y <= y1 GROUP BY ALL) e
   JOIN px ON px.session_id = e.session_id AND x >= x0 AND x <= x1 AND y >= y0 AND y <= y1 WHERE r - l <> t - b GROUP BY ALL) c),
 box AS (SELECT session_id, max(x0) AS x0, min(x1) AS x1, max(y0) AS y0, min(y1) AS y1 FROM st GROUP BY 1)
 SELECT px.session_id, count(*) AS n, min(x) AS x0, max(x) AS x1 FROM px JOIN box ON px.session_id = box.session_id AND x >= box.x0 AND x <= box.x1 AND y >= box.y0 AND y <= box.y1 GROUP BY 1"""
ORACLES["f6_square_arena"] = with_views(ARENA)


@query("+ z AS (SELECT session_id, max(t) + 1 AS size FROM signal GROUP BY 1), o AS (SELECT session_id, coalesce(sum(size) OVER (PARTITION BY session_id % 2 ORDER BY session_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off FROM z) SELECT s.session_id % 2 AS animal, s.session_id, channel, CAST(t + off AS BIGINT) AS t_global, round(value, 4) AS value FROM signal s JOIN o ON s.session_id = o.session_id")
def u1_stitched_signals(spark, d):
    s = view(spark, d, "signal")
    r = s.groupBy("session_id").agg((F.max("t") + 1).alias("size")).withColumn("animal", F.col("session_id") % 2)
    return T.stitched_signals(s, r, ["animal"], "session_id", "size").select("animal", "session_id", "channel", "t_global", F.round("value", 4).alias("value"))


NAME = "CASE WHEN cluster_id % 7 = 0 THEN concat('M', session_id, '-2018') ELSE concat('M', session_id, '_2018-03-', lpad(CAST(cluster_id % 33 AS {0}), 2, '0'), '_', lpad(CAST(cluster_id % 24 AS {0}), 2, '0'), '-34-44_of') END AS name"


@query(f"""+ n AS (SELECT cluster_id, {NAME.format("VARCHAR")} FROM cells), p AS (SELECT cluster_id, string_split(name, '_') AS part, CASE WHEN name LIKE '%\\_of' ESCAPE '\\' THEN try_strptime(string_split(name, '_')[2] || ' ' || string_split(name, '_')[3], '%Y-%m-%d %H-%M-%S') END AS stamp FROM n)
 SELECT cluster_id, CASE WHEN stamp IS NOT NULL THEN part[1] END AS animal, CAST(stamp AS DATE) AS day, strftime(stamp, '%Y-%m-%d %H:%M:%S') AS stamp FROM p""")
def x5_session_stamps(spark, d):
    c = view(spark, d, "cells").selectExpr("cluster_id", NAME.format("STRING"))
    return c.withColumns(scalar.session_parts("name")).select("cluster_id", "animal", "day", F.date_format("stamp", "yyyy-MM-dd HH:mm:ss").alias("stamp"))


# Spikes in time

STEP = "sqrt(pow(x_px - lag(x_px) OVER w, 2) + pow(y_px - lag(y_px) OVER w, 2)) / 20"


@query(f"""+ v AS (SELECT session_id, pos_idx, {STEP} AS speed FROM position WINDOW w AS (PARTITION BY session_id ORDER BY pos_idx)), z AS (SELECT session_id, floor(min(speed)) AS low, ceil(max(speed)) AS top, count(speed) AS size FROM v GROUP BY 1),
 o AS (SELECT session_id, CAST(least(floor(speed), top - 1) AS BIGINT) AS bin, count(*) AS o FROM v JOIN z USING (session_id) WHERE speed IS NOT NULL GROUP BY session_id, size, 2 HAVING count(*) > 0.005 * size),
 j AS (SELECT j.session_id, cluster_id, CAST(least(floor(speed), top - 1) AS BIGINT) AS bin, count(*) AS n FROM (SELECT * FROM joined) j JOIN v ON v.session_id = j.session_id AND v.pos_idx = j.pos_idx JOIN z ON z.session_id = j.session_id WHERE speed IS NOT NULL GROUP BY 1, 2, 3)
 SELECT c.session_id, c.cluster_id, o.bin, coalesce(n, 0) AS n, round(coalesce(n, 0) / o * 30, 5) AS rate FROM (SELECT DISTINCT session_id, cluster_id FROM joined) c JOIN o ON o.session_id = c.session_id LEFT JOIN j ON j.session_id = c.session_id AND j.cluster_id = c.cluster_id AND j.bin = o.bin""".replace("+ v AS", JOINED + ", v AS", 1))
def a19_speed_rates(spark, d):
    w = B.over(SESSION, ORDER)
    step = F.sqrt(F.pow(F.col("x_px") - F.lag("x_px").over(w), F.lit(2)) + F.pow(F.col("y_px") - F.lag("y_px").over(w), F.lit(2))) / 20
    p = view(spark, d, "position").withColumn("speed", step)
    return Y.speed_rates(J.spikes_to_positions(view(spark, d, "spikes"), p), p, SESSION, CELL, "speed").select(*CELL, "bin", "n", *r5("rate"))


def light(half: int) -> str:
    return f"""+ a AS (SELECT s.session_id, s.cluster_id, s.t_sample - p.pulse AS off FROM pulses p JOIN spikes s ON s.session_id = p.session_id AND s.t_sample >= p.pulse - 3000 AND s.t_sample < p.pulse + 3000),
 c AS (SELECT session_id, cluster_id, CAST(floor((off + {half}) / {half / 50}) AS BIGINT) AS bin, count(*) AS n FROM a WHERE off >= -{half} AND off < {half} GROUP BY ALL), k AS (SELECT session_id, count(*) AS k FROM pulses GROUP BY 1), g AS (SELECT DISTINCT session_id, cluster_id, r.bin FROM a, range(100) r(bin))
 SELECT g.session_id, g.cluster_id, g.bin, coalesce(n, 0) AS n, round(coalesce(n, 0) / ({half / 50} / 30000) / k, 5) AS hz FROM g JOIN k USING (session_id) LEFT JOIN c USING (session_id, cluster_id, bin)"""


def light_rates(spark, d, half):
    pulses = view(spark, d, "pulses")
    near = R.around_pulses(view(spark, d, "spikes").withColumnRenamed("t_sample", "t"), pulses, SESSION, 3000)
    return R.peristimulus_rates(near, pulses, SESSION, CELL, half).select(*CELL, "bin", "n", *r5("hz"))


@query(light(3000))
def a24_peristimulus_rates(spark, d):
    return light_rates(spark, d, 3000)


@query(light(600))
def a24_peristimulus_zoom(spark, d):
    """20 ms before and after a pulse."""
    return light_rates(spark, d, 600)


@query("""+ s AS (SELECT session_id, cluster_id % 2 AS tetrode, cluster_id, t_sample FROM spikes), m AS (SELECT session_id, tetrode, cluster_id AS a, count(*) AS m FROM s GROUP BY ALL),
 c AS (SELECT x.session_id, x.tetrode, x.cluster_id AS a, y.cluster_id AS b, CAST(floor((y.t_sample - x.t_sample) / 600) AS BIGINT) AS lag_bin, count(*) AS n FROM s x JOIN s y ON x.session_id = y.session_id AND x.tetrode = y.tetrode AND abs(y.t_sample - x.t_sample) <= 15000 AND y.t_sample <> x.t_sample GROUP BY ALL)
 SELECT c.*, round(n / (m * 0.02::DOUBLE), 6) AS rate FROM c JOIN m USING (session_id, tetrode, a)""")
def c20_tetrode_correlograms(spark, d):
    """Lags of half a second in bins of 20 ms."""
    s = view(spark, d, "spikes").withColumn("tetrode", F.col("cluster_id") % 2)
    return J.tetrode_correlograms(s, SESSION, "tetrode", "cluster_id", "t_sample", 15000, 600).select("session_id", "tetrode", "a", "b", "lag_bin", "n", *r6("rate"))


@query("""+ s_ AS (SELECT session_id, cluster_id, spike_idx, t_sample // 30000 AS t, row_number() OVER (PARTITION BY session_id, cluster_id ORDER BY t_sample, spike_idx) AS k, count(*) OVER (PARTITION BY session_id, cluster_id) AS m FROM spikes),
 d_ AS (SELECT *, k BETWEEN 17 AND m - 16 AS mid, row_number() OVER (PARTITION BY session_id, cluster_id ORDER BY CASE WHEN k BETWEEN 17 AND m - 16 THEN 0 ELSE 1 END, md5(concat_ws('-', session_id, cluster_id, k))) AS r FROM s_),
 w_ AS (SELECT session_id, cluster_id, spike_idx, CAST(ch AS INT) AS channel, pos, d_.t - 10 + pos AS tt FROM d_, range(1, 5) c(ch), range(30) p(pos) WHERE m < 20 OR (mid AND r <= 20))
 SELECT w_.session_id, cluster_id, spike_idx, w_.channel, round(sum(coalesce(value, 0) * (pos + 1)), 4) AS weighted FROM w_ LEFT JOIN signal g ON g.session_id = w_.session_id AND g.channel = w_.channel AND g.t = w_.tt GROUP BY ALL""")
def c27_chosen_snippets(spark, d):
    """Twenty spikes of each cell, none of the 16 at either end."""
    s = V.chosen_spikes(view(spark, d, "spikes"), CELL, ["t_sample", "spike_idx"], 20)
    s = s.select(*CELL, "spike_idx", F.lit(1).alias("tetrode"), F.floor(F.col("t_sample") / 30000).alias("t"))
    total = F.aggregate(F.transform("waveform", lambda v, i: v * (i + 1)), F.lit(0.0), lambda a, v: a + v)
    return V.snippets(s, view(spark, d, "signal"), SESSION).select(*CELL, "spike_idx", "channel", F.round(total, 4).alias("weighted"))


# Cell types and populations of fields

GRID = PEAKS + """, ring AS (SELECT session_id, cluster_id, avg(distance) AS d FROM ranked WHERE k BETWEEN 2 AND 7 AND many > 7 GROUP BY ALL),
 m_ AS MATERIALIZED (SELECT a.session_id, a.cluster_id, dx, dy, CASE WHEN r > 0.2 THEN 1.0 ELSE 0.0 END::DOUBLE AS u FROM auto a JOIN ring USING (session_id, cluster_id) WHERE r IS NOT NULL AND sqrt(dx * dx + dy * dy) BETWEEN 0.25 * d AND 1.25 * d),
 turn_ AS (SELECT session_id, cluster_id, angle, CAST(round_even(dx * cos(radians(angle)) - dy * sin(radians(angle)), 0) AS BIGINT) AS dx, CAST(round_even(dx * sin(radians(angle)) + dy * cos(radians(angle)), 0) AS BIGINT) AS dy, u AS v FROM m_, (VALUES (30), (60), (90), (120), (150)) t(angle)),
 r_ AS (SELECT session_id, cluster_id, angle, CASE WHEN var_pop(u) > 1e-20 AND var_pop(v) > 1e-20 THEN corr(u, v) END AS r FROM turn_ JOIN m_ USING (session_id, cluster_id, dx, dy) GROUP BY ALL),
 grid AS (SELECT session_id, cluster_id, least(max(r) FILTER (angle = 60), max(r) FILTER (angle = 120)) - greatest(max(r) FILTER (angle = 30), max(r) FILTER (angle = 90), max(r) FILTER (angle = 150)) AS grid_score FROM r_ GROUP BY 1, 2)"""
ORACLES["c7_place_grid_score"] = with_views(PLACE + GRID + " SELECT session_id, cluster_id, round(grid_score, 6) AS grid_score FROM grid")
TYPES = PLACE + GRID + ", joined AS (SELECT * FROM places )" + HIST[len(JOINED) :] + """,
 hd_ AS (SELECT session_id, cluster_id, sqrt(pow(sum(sin(radians(bin - 179.0)) * n), 2) + pow(sum(cos(radians(bin - 179.0)) * n), 2)) / sum(n) AS hd_score FROM hist GROUP BY 1, 2),
 types AS (SELECT session_id, cluster_id, hd_score, CASE WHEN hd_score >= 0.5 AND grid_score >= 0.4 THEN 'conjunctive' WHEN hd_score >= 0.5 THEN 'hd' WHEN grid_score >= 0.4 THEN 'grid' ELSE 'na' END AS cell_type FROM hd_ LEFT JOIN grid USING (session_id, cluster_id))"""


def place_types(spark, d):
    return K.cell_types(P.cell_scores(place_maps(spark, d), CELL))


@query(TYPES + " SELECT session_id, cluster_id, round(hd_score, 6) AS hd_score, cell_type FROM types")
def f14_place_cell_types(spark, d):
    return place_types(spark, d).select(*CELL, *r6("hd_score"), "cell_type")


@query(TYPES + """, b_ AS (SELECT session_id, cluster_id, CAST(floor(x_px / 120) AS BIGINT) AS bx, CAST(floor(y_px / 120) AS BIGINT) AS by_, count(*) AS n_spikes FROM places GROUP BY ALL)
 SELECT session_id, cluster_id, bx * 4 + by_ AS field_id, n_spikes, cell_type FROM b_ JOIN types USING (session_id, cluster_id) WHERE (bx * 4 + by_) % 3 <> 1 AND cell_type = 'grid' AND n_spikes > 40 AND NOT (bx IN (0, 3) OR by_ IN (0, 3))""")
def f17_population_fields(spark, d):
    """Squares of 120 pixels stand for fields; two of three are accepted."""
    f = view(spark, d, "places").groupBy(*CELL, F.floor(F.col("x_px") / 120).alias("bx"), F.floor(F.col("y_px") / 120).alias("by_")).agg(F.count("*").alias("n_spikes"))
    f = f.withColumns({"field_id": F.col("bx") * 4 + F.col("by_"), "border": F.col("bx").isin(0, 3) | F.col("by_").isin(0, 3)}).withColumn("accepted", F.col("field_id") % 3 != 1)
    return K.population_fields(f, place_types(spark, d), CELL, least=40, border=False).select(*FIELD, "n_spikes", "cell_type")


# Fields

HEAD = ", h_ AS (SELECT session_id, pos_idx, coalesce(h, lead(h) OVER (PARTITION BY session_id ORDER BY pos_idx)) AS heading FROM (SELECT session_id, pos_idx, degrees(atan2(y_px - lag(y_px) OVER w, x_px - lag(x_px) OVER w)) + 180 AS h FROM position WINDOW w AS (PARTITION BY session_id ORDER BY pos_idx)) x)"
BY_BIN = "least(CAST(floor(heading / 18.0) AS BIGINT), 19) AS bin"


def headings(spark, d):
    return B.heading(view(spark, d, "position"), SESSION, ORDER, "x_px", "y_px")


@query(BLOCKS + HEAD + " SELECT i.session_id, cluster_id, field_id, spike_idx, round(heading, 4) AS heading FROM inside i JOIN h_ ON h_.session_id = i.session_id AND h_.pos_idx = i.pos_idx")
def j11_field_spike_headings(spark, d):
    s = with_bins(J.spikes_to_positions(view(spark, d, "spikes"), headings(spark, d)))
    return s.join(fields(spark, d).select(*FIELD, "bin_x", "bin_y"), [*CELL, "bin_x", "bin_y"]).select(*FIELD, "spike_idx", F.round("heading", 4).alias("heading"))


@query(BLOCKS + HEAD + f" SELECT a.session_id, cluster_id, field_id, {BY_BIN}, count(*) AS n FROM around a JOIN h_ ON h_.session_id = a.session_id AND h_.pos_idx = CAST(round_even(a.synced_time * 30.0::DOUBLE, 0) AS BIGINT) WHERE heading IS NOT NULL GROUP BY ALL")
def j11_field_path_headings(spark, d):
    path = J.at_index(around(spark, d).select(*FIELD, "synced_time"), headings(spark, d).select(*SESSION, "pos_idx", "heading"), SESSION, "synced_time", 30.0)
    return path.where("heading is not null").groupBy(*FIELD, F.least(F.floor(F.col("heading") / 18), F.lit(19)).alias("bin")).agg(F.count("*").alias("n"))


def drawn(samples: str, seed: str, shuffles: int) -> str:
    """SQL up to draw: samples (FIELD, pos_idx, hd) of a field drawn by keys, as often as it has spikes."""
    return f""", q_ AS (SELECT *, row_number() OVER (PARTITION BY {FIELDS_} ORDER BY pos_idx) - 1 AS k, count(*) OVER (PARTITION BY {FIELDS_}) AS size FROM ({samples}) x), c_ AS (SELECT {FIELDS_}, count(*) AS n FROM inside GROUP BY ALL), z AS (SELECT {FIELDS_}, max(size) AS size FROM q_ GROUP BY ALL),
 e_ AS (SELECT c_.*, z.size, h, unnest(range(1, n + 1)) AS i FROM c_ JOIN z USING ({FIELDS_}), range({shuffles}) r(h)), draw AS (SELECT {FIELDS_}, CAST(h AS INT) AS shuffle_id, {DRAW.format(f"'{seed}', session_id, cluster_id, field_id, h, i", "size")} AS k FROM e_)"""


@query(BLOCKS + HEAD + drawn("SELECT a.session_id, cluster_id, field_id, a.pos_idx, heading AS hd FROM around a JOIN h_ ON h_.session_id = a.session_id AND h_.pos_idx = a.pos_idx", "field heading", 10) + f" SELECT {FIELDS_}, shuffle_id, {BY_BIN}, count(*) AS n FROM (SELECT {FIELDS_}, shuffle_id, hd AS heading FROM draw JOIN q_ USING ({FIELDS_}, k) WHERE hd IS NOT NULL) x GROUP BY ALL")
def r6_field_heading_draws(spark, d):
    cells = inside(spark, d).groupBy(*FIELD).agg(F.count("*").alias("n"))
    path = around(spark, d).select(*FIELD, "pos_idx").join(headings(spark, d).select(*SESSION, "pos_idx", (F.col("heading") - 180).alias("heading")), [*SESSION, "pos_idx"])
    return H.direction_histograms(H.drawn_samples(cells, path, 10, FIELD, FIELD, "n", "field heading"), FIELD, "heading", 20)


ORACLES["r12_expected_ratio"] = with_views(
    BLOCKS + drawn(f"SELECT {FIELDS_}, pos_idx, hd FROM around", "expected", 100) + f""", b_ AS (SELECT {FIELDS_}, shuffle_id, least(CAST(floor((hd + 180) / 9.0) AS BIGINT), 39) AS bin, count(*) AS n FROM draw JOIN q_ USING ({FIELDS_}, k) GROUP BY ALL),
 o_ AS (SELECT {FIELDS_}, shuffle_id, bin, n / sum(n) OVER (PARTITION BY {FIELDS_}, shuffle_id) AS o FROM b_), w_ AS (SELECT {FIELDS_}, least(CAST(floor((hd + 180) / 9.0) AS BIGINT), 39) AS bin, count(*) AS n FROM around GROUP BY ALL),
 x_ AS (SELECT {FIELDS_}, CAST(h AS INT) AS shuffle_id, bin, n / sum(n) OVER (PARTITION BY {FIELDS_}, h) AS e FROM w_, range(100) r(h))
 SELECT {FIELDS_}, shuffle_id, round(avg(abs(ln((coalesce(o, 0) + 1e-5) / (coalesce(e, 0) + 1e-5)))), 6) AS ratio FROM o_ FULL JOIN x_ USING ({FIELDS_}, shuffle_id, bin) GROUP BY ALL""")


@query(BLOCKS + drawn(f"SELECT {FIELDS_}, pos_idx, hd FROM around", "spread", 20) + f""", b_ AS (SELECT {FIELDS_}, shuffle_id, {DIR}, count(*) AS n FROM draw JOIN q_ USING ({FIELDS_}, k) GROUP BY ALL), o_ AS (SELECT {FIELDS_}, {DIR}, count(*) AS o FROM around GROUP BY ALL),
 v_ AS (SELECT g.*, o_.bin, coalesce(n, 0) / o * 30 AS v FROM (SELECT DISTINCT {FIELDS_}, shuffle_id FROM draw) g JOIN o_ USING ({FIELDS_}) LEFT JOIN b_ USING ({FIELDS_}, shuffle_id, bin)),
 s_ AS (SELECT {FIELDS_}, bin, avg(v) AS mean, stddev_pop(v) AS sd, quantile_cont(v, 0.05) AS low, quantile_cont(v, 0.95) AS high FROM v_ GROUP BY ALL)
 SELECT {FIELDS_}, bin, round(mean, 5) AS mean, round(sd, 5) AS sd, round(low, 5) AS low, round(high, 5) AS high, round(high - mean, 5) AS up, round(mean - low, 5) AS down FROM s_""")
def a27_field_bar_spread(spark, d):
    spread = H.drawn_spread(view(spark, d, "spikes"), view(spark, d, "position"), 20, SESSION, CELL, "spread", "hd", 20, 30.0, BLOCK)
    return spread.select(*FIELD, "bin", *r5("mean", "sd", "low", "high", "up", "down"))


@query(BLOCKS + f""", c_ AS (SELECT {FIELDS_}, {DIR}, count(*) AS n FROM inside GROUP BY ALL), t_ AS (SELECT *, max(n) OVER (PARTITION BY {FIELDS_}) AS top FROM c_), a_ AS (SELECT {FIELDS_}, radians(bin * 18 - 171.0::DOUBLE) AS a FROM t_ WHERE n = top)
 SELECT session_id, cluster_id, count(DISTINCT field_id) AS items, CASE WHEN count(DISTINCT field_id) > 1 THEN abs(round(degrees(sqrt(-2 * ln(least(1.0, greatest(1e-12, sqrt(pow(avg(sin(a)), 2) + pow(avg(cos(a)), 2))))))), 4)) END AS sd FROM a_ GROUP BY 1, 2""")
def c16_modes_spread(spark, d):
    """The fullest direction bins of a field are its modes."""
    n = inside(spark, d).groupBy(*FIELD, F.least(F.floor((F.col("hd") + 180) / 18), F.lit(19)).alias("bin")).agg(F.count("*").alias("n"))
    top = n.groupBy(*FIELD).agg(F.max("n").alias("n"))
    modes = n.join(top, [*FIELD, "n"]).withColumn("angle", F.col("bin") * 18 - 171.0)
    return S.modes_spread(modes, CELL, "field_id", "angle").select(*CELL, "items", F.round("sd", 4).alias("sd"))


SAFE6 = "CASE WHEN var_pop({0}) > 1e-20 * pow(avg({0}), 2) AND var_pop({1}) > 1e-20 * pow(avg({1}), 2) THEN round(corr({0}, {1}), 6) END"
PAIRS = BLOCKS + f""", sc AS (SELECT {FIELDS_}, {DIR}, count(*) AS n FROM inside GROUP BY ALL), oc AS (SELECT {FIELDS_}, {DIR}, count(*) AS o FROM around GROUP BY ALL), g_ AS (SELECT DISTINCT {FIELDS_}, r.bin FROM inside, range(20) r(bin)),
 rates AS MATERIALIZED (SELECT g_.*, coalesce(coalesce(n, 0) / o, 0) AS ratio FROM g_ LEFT JOIN sc USING ({FIELDS_}, bin) LEFT JOIN oc USING ({FIELDS_}, bin)),
 turns AS (SELECT a.session_id, a.cluster_id, a.field_id AS a, b.field_id AS b, CAST(k AS INT) AS turn, {SAFE6.format("a.ratio", "b.ratio")} AS r, corr(a.ratio, b.ratio) AS raw FROM rates a JOIN rates b ON a.session_id = b.session_id AND a.cluster_id = b.cluster_id AND a.field_id < b.field_id JOIN range(20) t(k) ON a.bin = (b.bin + k) % 20 GROUP BY ALL),
 best AS (SELECT *, row_number() OVER (PARTITION BY {CELLS_}, a, b ORDER BY r DESC NULLS LAST, turn) AS k FROM turns), own AS (SELECT {CELLS_}, a, b, CASE WHEN r IS NOT NULL THEN raw END AS r FROM turns WHERE turn = 0),
 mid AS (SELECT {FIELDS_}, floor(median(DISTINCT bin_x)) AS x, floor(median(DISTINCT bin_y)) AS y FROM fields GROUP BY ALL),
 pairs AS (SELECT {CELLS_}, a, b, own.r, sqrt(pow(p.x - q.x, 2) + pow(p.y - q.y, 2)) AS distance, CASE WHEN best.r IS NOT NULL THEN turn END AS turn FROM own JOIN best USING ({CELLS_}, a, b) JOIN mid p USING ({CELLS_}) JOIN mid q USING ({CELLS_}) WHERE best.k = 1 AND p.field_id = a AND q.field_id = b)"""


def place_pairs(spark, d):
    hits = cut(joined(spark, d))
    rates = E.direction_rates(inside(spark, d, hits).select(*FIELD, "hd"), around(spark, d, hits=hits).select(*FIELD, "hd"), FIELD, FIELD, 20)
    return E.field_pairs(rates, fields(spark, d, hits), CELL, "field_id", 20)


@query(PAIRS + f" SELECT {CELLS_}, a, b, round(r, 4) AS r, round(distance, 5) AS distance, turn FROM pairs")
def c29_field_pairs(spark, d):
    return place_pairs(spark, d).select(*CELL, "a", "b", F.round("r", 4).alias("r"), *r5("distance"), "turn")


@query(PAIRS + """, k_ AS (SELECT session_id % 2 AS animal, r, distance, cos(radians(turn * 18.0::DOUBLE)) AS c, sin(radians(turn * 18.0::DOUBLE)) AS s FROM pairs WHERE r IS NOT NULL AND turn IS NOT NULL),
 s_ AS (SELECT animal, count(*) AS n, corr(distance, r) AS r, corr(c, distance) AS rc, corr(s, distance) AS rs, corr(c, s) AS cs FROM k_ GROUP BY 1), w_ AS (SELECT *, sqrt((rc * rc + rs * rs - 2 * rc * rs * cs) / (1 - cs * cs)) AS rho FROM s_)
 SELECT animal, n, round(r, 4) AS r, round(rho, 5) AS rho, round(exp(-n * rho * rho / 2), 5) AS rho_p FROM w_""")
def c29_distance_trend(spark, d):
    p = place_pairs(spark, d).withColumn("animal", F.col("session_id") % 2)
    return E.pair_trends(p, ["animal"], 20).select("animal", "n", F.round("r", 4).alias("r"), *r5("rho", "rho_p"))


@query(BLOCKS + ratios("inside", "around", FIELDS_, FIELDS_) + f""", own AS (SELECT {FIELDS_}, {SAFE6.format("a.ratio", "b.ratio")} AS r FROM rates a JOIN rates b USING ({FIELDS_}, bin) WHERE a.half = 1 AND b.half = 2 GROUP BY ALL), good AS (SELECT * FROM own WHERE r >= 0.2), kept AS (SELECT rates.* FROM rates JOIN good USING ({FIELDS_})),
 btw AS (SELECT session_id, {SAFE6.format("a.ratio", "b.ratio")} AS r FROM kept a JOIN kept b USING (session_id, cluster_id, bin) WHERE a.half = 1 AND b.half = 2 AND a.field_id <> b.field_id GROUP BY session_id, cluster_id, a.field_id, b.field_id),
 v_ AS (SELECT session_id % 2 AS animal, 0 AS sample, r FROM good UNION ALL SELECT session_id % 2, 1, r FROM btw WHERE r IS NOT NULL), w_ AS (SELECT animal, r, count(*) FILTER (sample = 0) AS a, count(*) FILTER (sample = 1) AS b FROM v_ GROUP BY ALL),
 d_ AS (SELECT animal, abs(sum(a) OVER o / sum(a) OVER p - sum(b) OVER o / sum(b) OVER p) AS d FROM w_ WINDOW o AS (PARTITION BY animal ORDER BY r), p AS (PARTITION BY animal)),
 u_ AS (SELECT x.animal, sum(CASE WHEN x.r > y.r THEN 1.0 WHEN x.r = y.r THEN 0.5 ELSE 0.0 END)::DOUBLE AS u FROM v_ x JOIN v_ y ON x.animal = y.animal WHERE x.sample = 0 AND y.sample = 1 GROUP BY 1)
 SELECT animal, round(max(d), 6) AS ks, max(u) AS u FROM d_ JOIN u_ USING (animal) GROUP BY 1""")
def c30_population_tests(spark, d):
    """Correlations within fields against those between fields; 0.2 instead of 0.4 lets fields of these tables through."""
    v = E.within_and_between(field_half_rates(spark, d), CELL, least=0.2).select((F.col("session_id") % 2).alias("animal"), "sample", *r6("r"))
    return G.kolmogorov_two(v, ["animal"], "sample", "r").join(G.rank_sum(v, ["animal"], "sample", "r"), "animal").select("animal", *r6("ks"), "u")
