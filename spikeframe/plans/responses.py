"""Registered queries of firing fields, correlogram peaks, responses and rotations, and the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import firing_fields as P
from ..operators import joins as J
from ..operators import maps as M
from ..operators import responses as R
from .fixtures import view
from .registry import CELL, HIST, ORDER, SESSION, coarse_maps, hist, joined, query, r6


def peaks(spark, d):
    return P.map_peaks(coarse_maps(spark, d), CELL)


@query()
def c5_correlogram_peaks(spark, d):
    return peaks(spark, d).select(*CELL, "label", *(F.round(c, 5).alias(c) for c in ("cx", "cy")), "area", F.round("distance", 5).alias("distance"))


@query()
def c6_grid_spacing(spark, d):
    return P.grid_spacing(peaks(spark, d), CELL).select(*CELL, F.round("spacing", 5).alias("spacing"), F.round("field_size", 5).alias("field_size"))


@query()
def c7_grid_score(spark, d):
    return P.map_grid_score(coarse_maps(spark, d), CELL).select(*CELL, *r6("grid_score"))


def found_fields(spark, d):
    """Fields of the coarse maps of these tables, whose bins are 40 pixels wide."""
    return P.map_fields(coarse_maps(spark, d), CELL, least_bins=2)


@query()
def c9_firing_fields(spark, d):
    return found_fields(spark, d).select(*CELL, "field_id", "bin_x", "bin_y", *r6("max_rate"))


@query()
def c10_field_directions(spark, d):
    inside = J.in_field_bins(joined(spark, d), found_fields(spark, d), 40.0, keys=CELL)
    keys = [*CELL, "field_id"]
    n = inside.groupBy(*keys).agg(F.count("*").alias("spikes"))
    return M.hd_score(M.hd_histogram(inside, keys), keys).join(n, keys).select(*keys, *r6("hd_score"), "spikes")


#: SQL up to d, the distances of windows wa and wb, and t, a cell's median distance of the window after pulses.
LATENCY = """+ pu AS (SELECT DISTINCT session_id, pulse FROM pulses ), s AS (SELECT session_id, cluster_id, t_sample AS t FROM spikes ),
 f AS (SELECT s.session_id, s.cluster_id, pulse, w, min(t - (pulse + (w - 10) * 3000)) AS first_t FROM s JOIN pu ON s.session_id = pu.session_id AND t > pulse - 30000 AND t < pulse + 3000, range(11) q(w) WHERE t > pulse + (w - 10) * 3000 AND t < pulse + (w - 9) * 3000 GROUP BY ALL),
 who AS (SELECT DISTINCT session_id, cluster_id FROM f), tr AS (SELECT session_id, count(*) AS trials FROM pu GROUP BY 1), c AS (SELECT session_id, cluster_id, w, first_t * 20 // 3000 AS step, count(*) AS c FROM f GROUP BY ALL),
 z AS (SELECT who.session_id, who.cluster_id, w, -1 AS step, trials - coalesce((SELECT sum(c) FROM c WHERE c.session_id = who.session_id AND c.cluster_id = who.cluster_id AND c.w = q.w), 0) AS c FROM who JOIN tr USING (session_id), range(11) q(w)),
 h AS MATERIALIZED (SELECT x.session_id, x.cluster_id, w, step, c / trials AS p FROM (SELECT * FROM c UNION ALL SELECT * FROM z WHERE c > 0) x JOIN tr USING (session_id)),
 g AS (SELECT a.session_id, a.cluster_id, a.w AS wa, q.w AS wb, a.step, a.p, (a.p + coalesce(b.p, 0)) / 2 AS m FROM h a CROSS JOIN range(11) q(w) LEFT JOIN h b ON b.session_id = a.session_id AND b.cluster_id = a.cluster_id AND b.w = q.w AND b.step = a.step WHERE a.w <> q.w),
 kl AS (SELECT session_id, cluster_id, wa, wb, sum(p * ln(p / m)) + ln(sum(m)) AS kl FROM g GROUP BY ALL),
 d AS (SELECT x.session_id, x.cluster_id, x.wa, x.wb, round(sqrt(2 * greatest(0, (x.kl + y.kl) / 2)), 9) AS d FROM kl x JOIN kl y ON x.session_id = y.session_id AND x.cluster_id = y.cluster_id AND x.wa = y.wb AND x.wb = y.wa WHERE x.wa < x.wb),
 t AS (SELECT session_id, cluster_id, median(d) AS distance FROM d WHERE wb = 10 GROUP BY 1, 2)"""


@query(LATENCY + " SELECT d.session_id, d.cluster_id, round(max(distance), 6) AS distance, round(avg(CASE WHEN d >= distance THEN 1.0 ELSE 0.0 END), 6) AS p FROM d JOIN t ON d.session_id = t.session_id AND d.cluster_id = t.cluster_id WHERE wb < 10 GROUP BY 1, 2")
def c17_latency_test(spark, d):
    s = view(spark, d, "spikes").withColumnRenamed("t_sample", "t")
    return R.latency_test(s, view(spark, d, "pulses").distinct(), SESSION, CELL, 3000, 10).select(*CELL, *r6("distance", "p"))


@query(HIST + """, h AS (SELECT session_id, cluster_id, bin // 10 AS bin, sum(n) AS n FROM hist GROUP BY 1, 2, 3),
 r AS (SELECT a.session_id, a.cluster_id AS a, b.cluster_id AS b, CAST(k AS INT) AS turn, round(corr(a.n, b.n), 6) AS r FROM h b, range(36) t(k), h a WHERE a.session_id = b.session_id AND a.cluster_id < b.cluster_id AND a.bin = (b.bin + k) % 36 GROUP BY 1, 2, 3, 4)
 SELECT session_id, a, b, turn, round(r, 4) AS r FROM (SELECT *, row_number() OVER (PARTITION BY session_id, a, b ORDER BY r DESC NULLS LAST, turn) AS k FROM r) x WHERE k = 1""")
def c29_best_rotation(spark, d):
    h = hist(spark, d).groupBy(*CELL, F.floor(F.col("bin") / 10).alias("bin")).agg(F.sum("n").alias("n"))
    return R.best_rotation(h, SESSION, "cluster_id", "bin", 36, "n").select("session_id", "a", "b", "turn", F.round("r", 4).alias("r"))


@query("+ r AS (SELECT session_id, list(pos_idx ORDER BY pos_idx) AS i, list_reduce(list(struct_pack(x := x_px::DOUBLE, y := y_px::DOUBLE, t := synced_time, l := [true]) ORDER BY pos_idx), lambda p, v: CASE WHEN sqrt((v.x - p.x) * (v.x - p.x) + (v.y - p.y) * (v.y - p.y)) <= 4400 * (v.t - p.t) THEN struct_pack(x := v.x, y := v.y, t := v.t, l := list_append(p.l, true)) ELSE struct_pack(x := p.x, y := p.y, t := p.t, l := list_append(p.l, false)) END) AS r FROM position GROUP BY 1) SELECT session_id, unnest(i) AS pos_idx, unnest(r.l) AS accepted FROM r")
def f4_sequential_jumps(spark, d):
    p = view(spark, d, "position").select("session_id", "pos_idx", "synced_time", "x_px", "y_px")
    return R.sequential_jumps(p, SESSION, "pos_idx", "x_px", "y_px", "synced_time", 4400.0).select("session_id", "pos_idx", "accepted")


@query("+ c AS (SELECT a.session_id, b.pos_idx - a.pos_idx AS lag, count(*) AS n FROM position a JOIN position b ON a.session_id = b.session_id AND abs(b.pos_idx - a.pos_idx) <= 60 WHERE a.sync_led > 7.5 AND b.x_px > 380 GROUP BY 1, 2) SELECT session_id, min_by(lag, struct_pack(a := -n, b := lag)) AS lag, max(n) AS n FROM c GROUP BY 1")
def w11_stream_lag(spark, d):
    p = view(spark, d, "position")
    return R.best_lag(p.where("sync_led > 7.5"), p.where("x_px > 380"), SESSION, "pos_idx", 60)
