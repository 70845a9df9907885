"""Registered queries and the SQL that gives the same rows. Names start with the operator's id."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import functions as F

from ..functions import scalar
from ..operators import behaviour as B
from ..operators import joins as J
from ..operators import maps as M
from ..operators import statistics as S
from ..streaming import rates
from .fixtures import view, with_views

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}
SESSION, ORDER, CELL = ["session_id"], ["pos_idx"], ["session_id", "cluster_id"]


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = with_views(sql)
        return f

    return add


def r6(*names):
    return [F.round(n, 6).alias(n) for n in names]


JOINED = """+ span AS (SELECT session_id, (max(synced_time) - min(synced_time)) / (count(*) - 1) AS dt, max(synced_time) AS t_max FROM position GROUP BY 1),
 hit AS (SELECT s.*, CAST(round_even(t_sample / (dt * 30000.0::DOUBLE), 0) AS BIGINT) AS pos_idx FROM spikes s JOIN span USING (session_id) WHERE t_sample / 30000.0::DOUBLE < t_max),
 joined AS (SELECT h.cluster_id, h.t_sample, h.spike_idx, p.* FROM hit h JOIN position p ON h.session_id = p.session_id AND h.pos_idx = p.pos_idx)"""
HIST = JOINED + """,
 counts AS (SELECT session_id, cluster_id, least(CAST(floor(hd + 180) AS INT), 359) AS bin, count(*) AS n FROM joined GROUP BY 1, 2, 3),
 hist AS (SELECT session_id, cluster_id, CAST(((bin + d) % 360 + 360) % 360 AS INT) AS bin, sum(n) AS n FROM counts, range(-11, 12) r(d) GROUP BY 1, 2, 3)"""


def joined(spark, d):
    return J.spikes_to_positions(view(spark, d, "spikes"), view(spark, d, "position"))


def hist(spark, d):
    return M.hd_histogram(joined(spark, d), CELL)


@query(JOINED + " SELECT session_id, cluster_id, spike_idx, pos_idx, round(x_px, 6) AS x_px, round(y_px, 6) AS y_px, round(hd, 6) AS hd FROM joined")
def j1_spike_positions(spark, d):
    return joined(spark, d).select("session_id", "cluster_id", "spike_idx", "pos_idx", *r6("x_px", "y_px", "hd"))


@query(HIST + " SELECT session_id, cluster_id, bin, CAST(n AS BIGINT) AS n FROM hist")
def a2_hd_histogram(spark, d):
    return hist(spark, d)


@query(HIST + ", top AS (SELECT session_id, cluster_id, max(n) AS m FROM hist GROUP BY 1, 2) SELECT session_id, cluster_id, round(CAST(min(m) AS DOUBLE) / 1000, 6) AS max_rate, string_agg(bin, ',' ORDER BY bin) AS preferred FROM hist JOIN top USING (session_id, cluster_id) WHERE n = m GROUP BY 1, 2")
def a3_peak_rate(spark, d):
    return M.peak_rate(hist(spark, d), CELL).select(*CELL, *r6("max_rate"), "preferred")


@query(HIST + " SELECT session_id, cluster_id, round(sqrt(pow(sum(sin(radians(bin - 179.0)) * n), 2) + pow(sum(cos(radians(bin - 179.0)) * n), 2)) / sum(n), 6) AS hd_score FROM hist GROUP BY 1, 2")
def a4_hd_score(spark, d):
    return M.hd_score(hist(spark, d), CELL).select(*CELL, *r6("hd_score"))


@query(HIST + ", s AS (SELECT session_id, cluster_id, CAST(sum(n) AS DOUBLE) AS n, pow(sum(sin(radians(bin - 179.0)) * n), 2) + pow(sum(cos(radians(bin - 179.0)) * n), 2) AS r2 FROM hist GROUP BY 1, 2) SELECT session_id, cluster_id, round(exp(sqrt(1 + 4 * n + 4 * (n * n - r2)) - (1 + 2 * n)), 6) AS p FROM s")
def c12_rayleigh(spark, d):
    return S.rayleigh(hist(spark, d), CELL).select(*CELL, *r6("p"))


@query("SELECT session_id, cluster_id, count(*) AS n_spikes, round(count(*) / (5000000 / 30000.0::DOUBLE), 6) AS mean_rate FROM spikes GROUP BY 1, 2")
def a1_firing_rate(spark, d):
    n = view(spark, d, "spikes").groupBy(*CELL).agg(F.count("*").alias("n_spikes"))
    return n.withColumn("mean_rate", F.round(F.col("n_spikes") / (5000000 / 30000.0), 6))


@query("SELECT session_id, pos_idx, round(sqrt(pow(x_px - lag(x_px) OVER w, 2) + pow(y_px - lag(y_px) OVER w, 2)) / (synced_time - lag(synced_time) OVER w), 4) AS speed FROM position WINDOW w AS (PARTITION BY session_id ORDER BY pos_idx)")
def w1_speed(spark, d):
    return B.speed(view(spark, d, "position"), SESSION, ORDER, "x_px", "y_px", "synced_time").select("session_id", "pos_idx", F.round("speed", 4).alias("speed"))


@query("+ v AS (SELECT *, sqrt(pow(x_px - lag(x_px) OVER w, 2) + pow(y_px - lag(y_px) OVER w, 2)) / (synced_time - lag(synced_time) OVER w) AS speed FROM position WINDOW w AS (PARTITION BY session_id ORDER BY pos_idx)) SELECT session_id, count(*) AS n, round(avg(CASE WHEN speed > 4400 THEN 0 ELSE 1 END) * 100, 6) AS kept FROM v GROUP BY 1")
def f3_jump_removal(spark, d):
    p = B.remove_jumps(B.speed(view(spark, d, "position"), SESSION, ORDER, "x_px", "y_px", "synced_time"), 4400.0, ("x_px", "y_px"))
    return p.groupBy("session_id").agg(F.count("*").alias("n"), F.round(F.avg(F.col("x_px").isNotNull().cast("double")) * 100, 6).alias("kept"))


@query("+ b AS (SELECT session_id, pos_idx, CASE WHEN sqrt(pow(x_px - y_px, 2) + pow(y_px - x_px, 2)) <= 40 THEN x_px END AS x_left FROM position) SELECT session_id, count(x_left) AS kept, round(sum(x_left), 4) AS total FROM b GROUP BY 1")
def f5_bead_distance(spark, d):
    p = view(spark, d, "position").selectExpr("session_id", "x_px AS x_left", "y_px AS y_left", "y_px AS x_right", "x_px AS y_right")
    return B.remove_far_beads(p).groupBy("session_id").agg(F.count("x_left").alias("kept"), F.round(F.sum("x_left"), 4).alias("total"))


@query("SELECT session_id, pos_idx, coalesce((sqrt(pow(x_px - lag(x_px) OVER w, 2) + pow(y_px - lag(y_px) OVER w, 2)) + sqrt(pow(lead(x_px) OVER w - x_px, 2) + pow(lead(y_px) OVER w - y_px, 2))) / 2 > 150, false) AS running FROM position WINDOW w AS (PARTITION BY session_id ORDER BY pos_idx)")
def f9_running(spark, d):
    return B.running(view(spark, d, "position"), SESSION, ORDER, 150.0, "x_px", "y_px").select("session_id", "pos_idx", "running")


@query("""+ k AS (SELECT session_id, pos_idx, CASE WHEN x_px > 40 AND x_px < 360 THEN x_px END AS v FROM position),
 g AS (SELECT *, max(CASE WHEN v IS NOT NULL THEN pos_idx END) OVER (PARTITION BY session_id ORDER BY pos_idx) AS ia, min(CASE WHEN v IS NOT NULL THEN pos_idx END) OVER (PARTITION BY session_id ORDER BY pos_idx ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS ib FROM k)
 SELECT g.session_id, g.pos_idx, round(CASE WHEN g.v IS NOT NULL THEN g.v WHEN ib IS NULL THEN a.v ELSE a.v + (b.v - a.v) * (g.pos_idx - ia) / (ib - ia) END, 6) AS v
 FROM g LEFT JOIN k a ON a.session_id = g.session_id AND a.pos_idx = ia LEFT JOIN k b ON b.session_id = g.session_id AND b.pos_idx = ib""")
def w2_interpolation(spark, d):
    p = view(spark, d, "position").withColumn("v", F.when((F.col("x_px") > 40) & (F.col("x_px") < 360), F.col("x_px")))
    return B.interpolate(p, SESSION, ORDER, "v", "pos_idx").select("session_id", "pos_idx", *r6("v"))


@query("SELECT session_id, pos_idx, round(degrees(atan2(y_px - 200, x_px - 200)), 6) AS hd FROM position")
def w3_head_direction(spark, d):
    return view(spark, d, "position").select("session_id", "pos_idx", F.round(F.degrees(F.atan2(F.col("y_px") - 200, F.col("x_px") - 200)), 6).alias("hd"))


@query("SELECT session_id, pos_idx, round((x_px - min(x_px) OVER (PARTITION BY session_id)) / 440.0 * 100, 6) AS x, round((y_px - min(y_px) OVER (PARTITION BY session_id)) / 440.0 * 100, 6) AS y FROM position")
def w6_to_origin(spark, d):
    return B.to_origin(view(spark, d, "position"), SESSION, 440.0).select("session_id", "pos_idx", *r6("x", "y"))


@query("+ l AS (SELECT *, coalesce(lead(x_px) OVER (PARTITION BY session_id ORDER BY pos_idx), x_px) AS nx FROM position) SELECT session_id, pos_idx, CAST(sub AS INT) AS sub, round(x_px + (nx - x_px) * sub / 4, 6) AS x_px FROM l, range(4) r(sub)")
def w8_upsample(spark, d):
    return B.upsample(view(spark, d, "position"), SESSION, ORDER, ["x_px"], 4).select("session_id", "pos_idx", "sub", *r6("x_px"))


@query("SELECT session_id, pos_idx, round(x_px, 6) AS x_px FROM position WHERE pos_idx % 30 = 0")
def w9_decimate(spark, d):
    return view(spark, d, "position").where("pos_idx % 30 = 0").select("session_id", "pos_idx", *r6("x_px"))


@query("+ o AS (SELECT *, CAST(sync_led > 5.5 AS INT) AS ison FROM position), e AS (SELECT session_id, pos_idx, coalesce(ison - lag(ison) OVER (PARTITION BY session_id ORDER BY pos_idx), 0) AS edge FROM o) SELECT session_id, pos_idx, edge FROM e WHERE edge <> 0")
def w10_edges(spark, d):
    return B.edges(view(spark, d, "position"), SESSION, ORDER, "sync_led", F.lit(5.5)).where("edge <> 0").select("session_id", "pos_idx", "edge")


@query("""+ o AS (SELECT session_id, pos_idx, pos_idx - row_number() OVER (PARTITION BY session_id ORDER BY pos_idx) AS g FROM position WHERE sync_led > 3.5)
 SELECT session_id, min(pos_idx) AS start, max(pos_idx) AS "end" FROM o GROUP BY session_id, g""")
def w12_pulse_runs(spark, d):
    return B.runs(view(spark, d, "position").where("sync_led > 3.5"), SESSION, "pos_idx")


@query("+ n AS (SELECT session_id, pos_idx, CASE WHEN x_px - lag(x_px) OVER (PARTITION BY session_id ORDER BY pos_idx) < -200 THEN 1 ELSE 0 END AS new FROM position) SELECT session_id, pos_idx, CAST(sum(new) OVER (PARTITION BY session_id ORDER BY pos_idx) + 1 AS BIGINT) AS trial FROM n")
def w15_trials(spark, d):
    return B.trials(view(spark, d, "position"), SESSION, ORDER, "x_px", 200.0).select("session_id", "pos_idx", "trial")


@query("SELECT session_id, pos_idx, round(CASE WHEN row_number() OVER w < 10 THEN x_px ELSE avg(x_px) OVER (PARTITION BY session_id ORDER BY pos_idx ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) END, 6) AS smooth FROM position WINDOW w AS (PARTITION BY session_id ORDER BY pos_idx)")
def w17_running_mean(spark, d):
    return B.running_mean(view(spark, d, "position"), SESSION, ORDER, "x_px", 10, "smooth").select("session_id", "pos_idx", *r6("smooth"))


@query("+ h AS (SELECT session_id, pos_idx, degrees(atan2(y_px - lag(y_px) OVER w, x_px - lag(x_px) OVER w)) + 180 AS h FROM position WINDOW w AS (PARTITION BY session_id ORDER BY pos_idx)) SELECT session_id, pos_idx, round(coalesce(h, lead(h) OVER (PARTITION BY session_id ORDER BY pos_idx)), 6) AS heading FROM h")
def w18_heading(spark, d):
    return B.heading(view(spark, d, "position"), SESSION, ORDER, "x_px", "y_px").select("session_id", "pos_idx", *r6("heading"))


@query("+ c AS (SELECT session_id, CAST(floor(t_sample / 50000) AS BIGINT) AS bin, count(*) AS n FROM spikes GROUP BY 1, 2) SELECT a.session_id, a.bin, round(sum(b.n * exp(-pow(a.bin - b.bin, 2) / 8.0)) / sum(exp(-pow(a.bin - b.bin, 2) / 8.0)), 6) AS smooth FROM c a JOIN c b ON a.session_id = b.session_id AND abs(a.bin - b.bin) <= 8 GROUP BY 1, 2")
def w21_gaussian_smooth(spark, d):
    c = view(spark, d, "spikes").groupBy("session_id", F.floor(F.col("t_sample") / 50000).alias("bin")).agg(F.count("*").alias("n"))
    return B.gaussian_smooth(c, SESSION, "bin", "n", 2.0).select("session_id", "bin", *r6("smooth"))


@query("SELECT cluster_id, session_id, coalesce(isolation > 0.4 AND noise_overlap < 0.09 AND peak_snr > 1 AND mean_firing_rate > 0, false) AS is_good FROM cells")
def f1_curation(spark, d):
    good = F.expr("isolation > 0.4 AND noise_overlap < 0.09 AND peak_snr > 1 AND mean_firing_rate > 0")
    return view(spark, d, "cells").select("cluster_id", "session_id", F.coalesce(good, F.lit(False)).alias("is_good"))


@query("""+ m AS (SELECT session_id, median(metric) AS med FROM cells GROUP BY 1), dd AS (SELECT c.*, abs(metric - med) AS dev FROM cells c JOIN m USING (session_id)), mm AS (SELECT session_id, median(dev) AS mad FROM dd GROUP BY 1)
 SELECT cluster_id, round(CASE WHEN mad = 0 THEN NULL ELSE 0.6745 * dev / mad END, 6) AS z, coalesce(0.6745 * dev / nullif(mad, 0) > 1.5, false) AS outlier FROM dd JOIN mm USING (session_id)""")
def f12_mad_outliers(spark, d):
    return S.mad_outliers(view(spark, d, "cells"), SESSION, "metric", 1.5).select("cluster_id", *r6("z"), "outlier")


@query("SELECT cluster_id, CASE WHEN isolation >= 0.5 AND peak_snr >= 4 THEN 'conjunctive' WHEN peak_snr >= 4 THEN 'grid' WHEN isolation >= 0.5 THEN 'hd' ELSE 'na' END AS cell_type FROM cells")
def f14_cell_type(spark, d):
    g, h = F.col("peak_snr") >= 4, F.col("isolation") >= 0.5
    return view(spark, d, "cells").select("cluster_id", F.when(g & h, "conjunctive").when(g, "grid").when(h, "hd").otherwise("na").alias("cell_type"))


@query("SELECT p.session_id, p.pulse, s.spike_idx, s.t_sample - (p.pulse - 3000) AS \"offset\" FROM pulses p JOIN spikes s ON s.session_id = p.session_id AND s.t_sample > p.pulse - 3000 AND s.t_sample < p.pulse + 3000")
def j4_peristimulus(spark, d):
    s = view(spark, d, "spikes").withColumnRenamed("t_sample", "t")
    return J.peristimulus(s, view(spark, d, "pulses"), 6000).select("session_id", "pulse", "spike_idx", "offset")


@query("+ n AS (SELECT p.session_id, p.pulse, min(s.t_sample) AS t FROM pulses p LEFT JOIN spikes s ON s.session_id = p.session_id AND s.t_sample > p.pulse GROUP BY 1, 2) SELECT session_id, pulse, CASE WHEN t - pulse <= 3000 THEN t END AS spike, CASE WHEN t - pulse <= 3000 THEN t - pulse END AS latency FROM n")
def j5_first_spike(spark, d):
    s = view(spark, d, "spikes").withColumnRenamed("t_sample", "t")
    return J.first_after(s, view(spark, d, "pulses").distinct(), 3000)


@query("+ n AS (SELECT p.session_id, p.pulse, min(s.t_sample) - p.pulse AS t FROM pulses p JOIN spikes s ON s.session_id = p.session_id AND s.t_sample > p.pulse GROUP BY 1, 2) SELECT session_id, round(avg(t / 30.0), 6) AS mean_ms, round(stddev_pop(t / 30.0), 6) AS sd_ms FROM n WHERE t <= 3000 GROUP BY 1")
def a25_latencies(spark, d):
    s = view(spark, d, "spikes").withColumnRenamed("t_sample", "t")
    x = J.first_after(s, view(spark, d, "pulses").distinct(), 3000).where("latency is not null").withColumn("ms", F.col("latency") / 30.0)
    return x.groupBy("session_id").agg(F.round(F.avg("ms"), 6).alias("mean_ms"), F.round(F.stddev_pop("ms"), 6).alias("sd_ms"))


@query("SELECT p.session_id, p.pulse, min_by(s.t_sample, struct_pack(a := abs(s.t_sample - p.pulse), b := s.t_sample)) AS nearest FROM (SELECT DISTINCT * FROM pulses ) p JOIN spikes s USING (session_id) GROUP BY 1, 2")
def j3_nearest(spark, d):
    near = J.nearest(view(spark, d, "pulses").distinct(), view(spark, d, "spikes"), SESSION, "pulse", "t_sample")
    return near.where("nearest is not null").select("session_id", "pulse", F.col("nearest").cast("long").alias("nearest"))


@query("SELECT a.session_id, a.cluster_id AS a, b.cluster_id AS b, CAST(floor((b.t_sample - a.t_sample) / 600) AS BIGINT) AS lag_bin, count(*) AS n FROM spikes a JOIN spikes b ON a.session_id = b.session_id AND abs(b.t_sample - a.t_sample) <= 6000 AND b.t_sample <> a.t_sample GROUP BY 1, 2, 3, 4")
def c20_cross_correlogram(spark, d):
    s = view(spark, d, "spikes")
    a, b = s.selectExpr("session_id", "cluster_id AS a", "t_sample AS ta"), s.selectExpr("session_id", "cluster_id AS b", "t_sample AS tb")
    bb = b.withColumn("bucket", F.explode(F.array(*(F.floor(F.col("tb") / 6000) + k for k in (-1, 0, 1)))))
    hit = a.withColumn("bucket", F.floor(F.col("ta") / 6000)).join(bb, ["session_id", "bucket"]).where("abs(tb - ta) <= 6000 AND tb <> ta")
    return hit.groupBy("session_id", "a", "b", F.floor((F.col("tb") - F.col("ta")) / 600).alias("lag_bin")).agg(F.count("*").alias("n"))


@query("SELECT a.session_id, a.cluster_id, CAST(floor((b.t_sample - a.t_sample) / 600) AS BIGINT) AS lag_bin, count(*) AS n FROM spikes a JOIN spikes b ON a.session_id = b.session_id AND a.cluster_id = b.cluster_id AND abs(b.t_sample - a.t_sample) <= 15000 AND b.t_sample <> a.t_sample GROUP BY 1, 2, 3")
def c19_auto_correlogram(spark, d):
    s = view(spark, d, "spikes")
    return J.correlogram(s.selectExpr("session_id", "cluster_id", "t_sample AS ta"), s.selectExpr("session_id", "cluster_id", "t_sample AS tb"), CELL, 15000, 600)


@query("+ px AS (SELECT session_id, CAST(floor(x_px / 40) AS BIGINT) AS bx, CAST(floor(y_px / 40) AS BIGINT) AS by_, x_px, y_px FROM position), n AS (SELECT session_id, bx + i AS bin_x, by_ + j AS bin_y, count(*) AS n FROM px, range(-2, 3) a(i), range(-2, 3) b(j) WHERE bx + i >= 0 AND by_ + j >= 0 AND sqrt(pow(x_px - (bx + i + 0.5) * 40, 2) + pow(y_px - (by_ + j + 0.5) * 40, 2)) <= 60 GROUP BY 1, 2, 3) SELECT session_id, bin_x, bin_y, CASE WHEN n >= 3 THEN n END AS occupancy FROM n")
def a5_occupancy(spark, d):
    return M.occupancy(view(spark, d, "position"), SESSION, 40.0, 60.0, 3)


def coarse_maps(spark, d):
    """coarse_tiles where they are made, for on_maps."""
    return M.SessionMaps(view(spark, d, "spikes"), view(spark, d, "position"), CELL, SESSION, 40.0, 60.0, 1 / 30, 3, 30000.0)


def coarse_tiles(spark, d):
    return M.spike_rate_tiles(view(spark, d, "spikes"), view(spark, d, "position"), CELL, SESSION, 40.0, 60.0, 1 / 30, 3)


def coarse_map(spark, d):
    return M.bins_of_tiles(coarse_tiles(spark, d), CELL, "rate")


@query()
def a6_rate_map(spark, d):
    return coarse_map(spark, d).select(*CELL, "bin_x", "bin_y", F.round("rate", 5).alias("rate"))


@query()
def a8_spatial_information(spark, d):
    seen = M.occupancy_tiles(view(spark, d, "position"), SESSION, 40.0, 60.0)
    return M.map_information(coarse_tiles(spark, d), seen, CELL, SESSION, 3).select(*CELL, F.round("information", 5).alias("information"))


@query()
def c4_autocorrelogram(spark, d):
    return M.map_autocorrelogram(coarse_maps(spark, d), CELL).select(*CELL, "dx", "dy", "n", F.round("r", 5).alias("r"))


@query("SELECT session_id, trial_type, CAST(floor(x / 10) AS BIGINT) AS bin, round(avg(speed), 6) AS speed, count(*) AS samples FROM track GROUP BY 1, 2, 3")
def a10_binned_speed(spark, d):
    return view(spark, d, "track").groupBy("session_id", "trial_type", F.floor(F.col("x") / 10).alias("bin")).agg(F.round(F.avg("speed"), 6).alias("speed"), F.count("*").alias("samples"))


@query("SELECT trial_type, session_id, count(DISTINCT trial) AS trials FROM track GROUP BY ROLLUP (trial_type, session_id)")
def a11_trial_totals(spark, d):
    return view(spark, d, "track").rollup("trial_type", "session_id").agg(F.countDistinct("trial").alias("trials"))


@query("+ b AS (SELECT session_id, trial, CAST(floor(x / 20) AS BIGINT) AS bin, avg(speed) AS v FROM track GROUP BY 1, 2, 3) SELECT session_id, trial, count(*) AS stops, min((bin + 0.5) * 20) AS first_stop, round(avg((bin + 0.5) * 20), 6) AS mean_stop FROM b WHERE v < 4.7 GROUP BY 1, 2")
def a15_stops(spark, d):
    b = view(spark, d, "track").groupBy("session_id", "trial", F.floor(F.col("x") / 20).alias("bin")).agg(F.avg("speed").alias("v")).where("v < 4.7")
    x = (F.col("bin") + 0.5) * 20
    return b.groupBy("session_id", "trial").agg(F.count("*").alias("stops"), F.min(x).alias("first_stop"), F.round(F.avg(x), 6).alias("mean_stop"))


@query("+ e AS (SELECT session_id, bin, speed FROM (SELECT session_id, x, speed FROM track ) t, range(0, 100, 2) r(bin) WHERE x / 2 >= bin AND x / 2 < bin + 6) SELECT session_id, CAST(bin AS INT) AS bin, quantile_cont(speed, 0.25) AS q25, quantile_cont(speed, 0.5) AS q50, quantile_cont(speed, 0.75) AS q75 FROM e GROUP BY 1, 2")
def a20_binned_quartiles(spark, d):
    t = view(spark, d, "track").withColumn("v", F.col("x") / 2)
    t = t.withColumn("bin", F.explode(F.filter(F.sequence(F.lit(0), F.lit(98), F.lit(2)), lambda b: (F.col("v") >= b) & (F.col("v") < b + 6))))
    return t.groupBy("session_id", "bin").agg(*(F.percentile("speed", F.lit(q / 100)).alias(f"q{q}") for q in (25, 50, 75)))


@query("+ b AS (SELECT grp, CAST(floor(metric / 500) AS BIGINT) AS bin, count(*) AS n FROM cells GROUP BY 1, 2) SELECT grp, bin, round(sum(n) OVER (PARTITION BY grp ORDER BY bin) / sum(n) OVER (PARTITION BY grp), 6) AS cdf FROM b")
def a21_cdf(spark, d):
    from pyspark.sql import Window

    b = view(spark, d, "cells").groupBy("grp", F.floor(F.col("metric") / 500).alias("bin")).agg(F.count("*").alias("n"))
    w = Window.partitionBy("grp")
    return b.select("grp", "bin", F.round(F.sum("n").over(w.orderBy("bin")) / F.sum("n").over(w), 6).alias("cdf"))


@query("SELECT session_id, grp, count(*) AS cells, round(avg(metric), 6) AS mean, median(metric) AS median, min(metric) AS low, max(metric) AS high FROM cells GROUP BY CUBE (session_id, grp)")
def a26_dataset_description(spark, d):
    return view(spark, d, "cells").cube("session_id", "grp").agg(F.count("*").alias("cells"), F.round(F.avg("metric"), 6).alias("mean"), F.percentile("metric", F.lit(0.5)).alias("median"), F.min("metric").alias("low"), F.max("metric").alias("high"))


@query("SELECT session_id, round(degrees(atan2(avg(sin(radians(hd))), avg(cos(radians(hd))))), 5) AS mean_angle, round(sqrt(-2 * ln(sqrt(pow(avg(sin(radians(hd))), 2) + pow(avg(cos(radians(hd))), 2)))), 6) AS circular_sd FROM position GROUP BY 1")
def c16_circular_mean(spark, d):
    return S.circular_mean(view(spark, d, "position"), SESSION, "hd").select("session_id", F.round("mean_angle", 5).alias("mean_angle"), *r6("circular_sd"))


STEPS = """+ c AS (SELECT session_id, CAST(floor(value) AS BIGINT) AS v, count(*) FILTER (cluster_id % 2 = 0) AS a, count(*) FILTER (cluster_id % 2 = 1) AS b FROM spikes GROUP BY 1, 2),
 s AS (SELECT session_id, v, a, b, sum(a) OVER g AS n, sum(b) OVER g AS m, sum(a) OVER w / sum(a) OVER g - sum(b) OVER w / sum(b) OVER g AS d FROM c WINDOW w AS (PARTITION BY session_id ORDER BY v), g AS (PARTITION BY session_id))"""


def two_samples(spark, d):
    return view(spark, d, "spikes").select("session_id", (F.col("cluster_id") % 2).alias("sample"), F.floor("value").alias("v"))


@query(STEPS + " SELECT session_id, round(greatest(max(d), 0) + greatest(max(-d), 0), 6) AS kuiper FROM s GROUP BY 1")
def c13_kuiper(spark, d):
    return S.kuiper(two_samples(spark, d), SESSION, "sample", "v").select("session_id", *r6("kuiper"))


@query(STEPS + " SELECT session_id, round(min(n) * min(m) / pow(min(n) + min(m), 2) * (sum((a + b) * d * d) - pow(sum((a + b) * d), 2) / sum(a + b)), 6) AS u2 FROM s GROUP BY 1")
def c14_watson(spark, d):
    return S.watson_u2(two_samples(spark, d), SESSION, "sample", "v").select("session_id", *r6("u2"))


@query(STEPS + " SELECT session_id, round(max(abs(d)), 6) AS ks FROM s GROUP BY 1")
def c32_kolmogorov_smirnov(spark, d):
    return S.kolmogorov_smirnov(two_samples(spark, d), SESSION, "sample", "v").select("session_id", *r6("ks"))


@query(STEPS + ", r AS (SELECT *, coalesce(sum(a + b) OVER (PARTITION BY session_id ORDER BY v ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + (a + b + 1) / 2.0::DOUBLE AS rk FROM s) SELECT session_id, round(sum(a * rk) - min(n) * (min(n) + 1) / 2.0, 3) AS u FROM r GROUP BY 1")
def c32_mann_whitney(spark, d):
    return S.mann_whitney(two_samples(spark, d), SESSION, "sample", "v").select("session_id", F.round("u", 3).alias("u"))


@query("SELECT session_id, cluster_id, spike_idx, CAST(k AS INT) AS shuffle_id, (t_sample + 600000 + (session_id * 48271 + cluster_id * 56190 + k * 2201717) % 3800000) % 5000000 AS t FROM spikes, range(5) r(k)")
def r1_time_shift(spark, d):
    s = view(spark, d, "spikes").withColumnRenamed("t_sample", "t")
    return S.time_shift_shuffle(s, 5, 5000000, 600000, CELL).select(*CELL, "spike_idx", "shuffle_id", "t")


@query("SELECT grp, round(avg(metric) + 2.326 * stddev_pop(metric), 5) AS cutoff, count(metric) AS n_shuffles FROM cells GROUP BY 1")
def r3_cutoffs(spark, d):
    return S.shuffle_cutoffs(view(spark, d, "cells"), ["grp"], "metric", 2.326).select("grp", F.round("cutoff", 5).alias("cutoff"), "n_shuffles")


@query("+ o AS (SELECT grp, max(metric) / 2 AS v FROM cells GROUP BY 1) SELECT c.grp, round(50.0 * (sum(CAST(metric < v AS INT)) + sum(CAST(metric <= v AS INT))) / count(*), 6) AS percentile FROM cells c JOIN o USING (grp) GROUP BY 1")
def r9_percentile_of_score(spark, d):
    c = view(spark, d, "cells")
    o = c.groupBy("grp").agg((F.max("metric") / 2).alias("metric"))
    return S.percentile_of_score(o, c, ["grp"], "metric").select("grp", *r6("percentile"))


@query("""+ q AS (SELECT cluster_id, grp, abs(metric) / 20000 AS p FROM cells), r AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY p, cluster_id) AS k, count(*) OVER (PARTITION BY grp) AS m FROM q)
 SELECT cluster_id, round(least(1.0, min(p * m / k) OVER (PARTITION BY grp ORDER BY p, cluster_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)), 6) AS bh, round(least(1.0, max(p * (m - k + 1)) OVER (PARTITION BY grp ORDER BY p, cluster_id ROWS UNBOUNDED PRECEDING)), 6) AS holm FROM r""")
def r7_corrections(spark, d):
    q = view(spark, d, "cells").select("cluster_id", "grp", (F.abs("metric") / 20000).alias("p"))
    return S.corrected_p(q, ["grp"], "p", ["cluster_id"]).select("cluster_id", *r6("bh", "holm"))


@query("+ u AS (SELECT cluster_id, snippet_id, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) - 1 AS pos FROM waves), m AS (SELECT cluster_id, pos, avg(v) AS v FROM u GROUP BY 1, 2) SELECT cluster_id, count(*) AS samples, round(max(abs(v)), 5) AS peak FROM m GROUP BY 1")
def c26_waveform_peak(spark, d):
    u = view(spark, d, "waves").select("cluster_id", F.posexplode("embedding").alias("pos", "v"))
    m = u.groupBy("cluster_id", "pos").agg(F.avg(F.col("v").cast("double")).alias("v"))
    return m.groupBy("cluster_id").agg(F.count("*").alias("samples"), F.round(F.max(F.abs("v")), 5).alias("peak"))


@query("SELECT session_id, cluster_id, CAST(floor((spike_idx % 16) / 4) + 1 AS INT) AS tetrode, CAST(spike_idx % 16 % 4 + 1 AS INT) AS channel, count(*) AS n FROM spikes GROUP BY 1, 2, 3, 4")
def x4_tetrode(spark, d):
    s = view(spark, d, "spikes").withColumn("ch", F.col("spike_idx") % 16 + 1)
    return s.groupBy(*CELL, scalar.tetrode("ch").alias("tetrode"), scalar.channel_in_tetrode("ch").alias("channel")).agg(F.count("*").alias("n"))


@query("SELECT session_id, cluster_id, spike_idx FROM (SELECT *, row_number() OVER (PARTITION BY session_id, cluster_id ORDER BY t_sample, spike_idx) AS k, count(*) OVER (PARTITION BY session_id, cluster_id) AS n FROM spikes ) s WHERE k <= floor(0.2 * n)")
def u7_keep_first(spark, d):
    from pyspark.sql import Window

    w = Window.partitionBy(*CELL)
    s = view(spark, d, "spikes").withColumns({"k": F.row_number().over(w.orderBy("t_sample", "spike_idx")), "n": F.count("*").over(w)})
    return s.where(F.col("k") <= F.floor(0.2 * F.col("n"))).select(*CELL, "spike_idx")


@query("SELECT user_id, to_timestamp_start AS start, n FROM (SELECT user_id, date_trunc('hour', ts) AS to_timestamp_start, count(*) AS n FROM events GROUP BY 1, 2)".join(["+ z AS (SELECT 1 AS one FROM cells LIMIT 1) ", ""]))
def st2_windowed_counts(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    return rates.windowed_counts(e, ["user_id"], "1 hour").withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("+ z AS (SELECT 1 AS one FROM cells LIMIT 1), e AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) <= INTERVAL 6 HOURS THEN 0 ELSE 1 END AS new FROM events WHERE event_type = 'purchase'), s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM e) SELECT user_id, min(ts) AS start, max(ts) AS \"end\", count(*) AS n FROM s GROUP BY user_id, k")
def st3_pulse_sessions(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet").where("event_type = 'purchase'").withColumn("ts", F.col("ts").cast("timestamp"))
    out = rates.pulse_sessions(e, ["user_id"], "6 hours")
    return out.select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), F.col("end").cast("timestamp_ntz").alias("end"), "n")
