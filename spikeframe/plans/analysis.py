"""Registered queries of maps, trials, similarity and significance, and the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import joins as J
from ..operators import maps as M
from ..operators import sessions as T
from ..operators import similarity as Y
from ..operators import trials as L
from .fixtures import view
from .preparation import BINS, FIELDS, fields
from .registry import CELL, HIST, JOINED, SESSION, coarse_map, hist, joined, query, r6

TRIAL = [*CELL, "trial", "bin"]
RATES = JOINED + """, dwell AS (SELECT session_id, pos_idx // 200 AS trial, CAST(floor(x_px / 40) AS BIGINT) AS bin, count(*) / 30.0::DOUBLE AS dwell FROM position GROUP BY 1, 2, 3),
 fired AS (SELECT session_id, cluster_id, pos_idx // 200 AS trial, CAST(floor(x_px / 40) AS BIGINT) AS bin, count(*) AS n FROM joined GROUP BY 1, 2, 3, 4),
 who AS (SELECT DISTINCT session_id, cluster_id FROM joined),
 rates AS (SELECT who.session_id, who.cluster_id, dwell.trial, dwell.bin, coalesce(n, 0) AS n, dwell, coalesce(n, 0) / dwell AS rate FROM who JOIN dwell ON who.session_id = dwell.session_id LEFT JOIN fired f ON f.session_id = who.session_id AND f.cluster_id = who.cluster_id AND f.trial = dwell.trial AND f.bin = dwell.bin)"""


def with_bins(df):
    return df.withColumns({"trial": F.floor(F.col("pos_idx") / 200), "bin": F.floor(F.col("x_px") / 40)})


def trial_rates(spark, d):
    return L.trial_rates(with_bins(joined(spark, d)), with_bins(view(spark, d, "position")), SESSION, CELL, 1 / 30.0)


@query()
def a7_peak_of_map(spark, d):
    return coarse_map(spark, d).groupBy(*CELL).agg(F.round(F.max("rate"), 5).alias("max_rate"))


@query(FIELDS + " SELECT session_id, cluster_id, round(pow(avg(n), 2) / avg(n * n), 6) AS sparsity FROM bins GROUP BY 1, 2")
def a9_sparsity(spark, d):
    bins = joined(spark, d).groupBy(*CELL, F.floor(F.col("x_px") / 40).alias("bin_x"), F.floor(F.col("y_px") / 40).alias("bin_y")).agg(F.count("*").alias("rate"))
    return M.sparsity(bins, CELL).select(*CELL, *r6("sparsity"))


@query(RATES + " SELECT session_id, cluster_id, trial, bin, round(rate, 6) AS rate FROM rates")
def a12_trial_rates(spark, d):
    return trial_rates(spark, d).select(*TRIAL, *r6("rate"))


@query(RATES + " SELECT session_id, cluster_id, trial % 3 AS trial_type, bin, round(sum(n) / sum(dwell), 6) AS rate, round(stddev_samp(rate) / sqrt(count(rate)), 6) AS sem FROM rates GROUP BY 1, 2, 3, 4")
def a13_track_maps(spark, d):
    r = trial_rates(spark, d).withColumn("trial_type", F.col("trial") % 3)
    return L.track_maps(r, [*CELL, "trial_type", "bin"]).select(*CELL, "trial_type", "bin", *r6("rate", "sem"))


@query(JOINED + " SELECT session_id, cluster_id, (pos_idx // 200) % 3 AS trial_type, count(*) AS n, min(t_sample) AS first_t FROM joined GROUP BY 1, 2, 3")
def a14_spikes_by_type(spark, d):
    s = joined(spark, d).withColumn("trial_type", F.floor(F.col("pos_idx") / 200) % 3)
    return s.groupBy(*CELL, "trial_type").agg(F.count("*").alias("n"), F.min("t_sample").alias("first_t"))


@query("SELECT session_id, trial, CAST(floor(x / 10) AS BIGINT) AS bin, count(*) AS n, CAST(1 AS INT) AS seen FROM track WHERE speed < 5 GROUP BY 1, 2, 3")
def a16_trial_histogram(spark, d):
    t = view(spark, d, "track").where("speed < 5").groupBy("session_id", "trial", F.floor(F.col("x") / 10).alias("bin")).agg(F.count("*").alias("n"))
    return t.withColumn("seen", F.least(F.lit(1), F.col("n")).cast("int"))


@query(RATES + " SELECT session_id, cluster_id, bin, round(avg(rate), 6) AS rate FROM rates GROUP BY 1, 2, 3")
def a17_trial_average(spark, d):
    return trial_rates(spark, d).groupBy(*CELL, "bin").agg(F.round(F.avg("rate"), 6).alias("rate"))


@query(JOINED + " SELECT session_id, cluster_id, t_sample // 7500 AS bin, count(*) AS n, round(avg(x_px), 6) AS x_px FROM joined GROUP BY 1, 2, 3")
def a18_counts_in_time(spark, d):
    return joined(spark, d).groupBy(*CELL, F.floor(F.col("t_sample") / 7500).alias("bin")).agg(F.count("*").alias("n"), F.round(F.avg("x_px"), 6).alias("x_px"))


@query("SELECT session_id, cluster_id, t_sample // 150000 AS bin, count(*) AS n FROM spikes GROUP BY 1, 2, 3")
def a19_session_histogram(spark, d):
    return view(spark, d, "spikes").groupBy(*CELL, F.floor(F.col("t_sample") / 150000).alias("bin")).agg(F.count("*").alias("n"))


@query("+ s AS (SELECT trial_type, CAST(floor((x - 100) / 20) AS BIGINT) AS bin, count(*) AS n FROM track WHERE speed < 3 GROUP BY 1, 2), m AS (SELECT trial_type, count(DISTINCT trial) AS trials FROM track GROUP BY 1) SELECT s.trial_type, bin, round(n / trials, 6) AS stops, round(sum(n) OVER (PARTITION BY s.trial_type ORDER BY bin) / trials, 6) AS cumulative FROM s JOIN m ON s.trial_type = m.trial_type")
def a22_stops_to_goal(spark, d):
    t = view(spark, d, "track")
    s = t.where("speed < 3").groupBy("trial_type", F.floor((F.col("x") - 100) / 20).alias("bin")).agg(F.count("*").alias("n"))
    s = s.join(t.groupBy("trial_type").agg(F.countDistinct("trial").alias("trials")), "trial_type")
    total = F.sum("n").over(Window.partitionBy("trial_type").orderBy("bin"))
    return s.select("trial_type", "bin", F.round(F.col("n") / F.col("trials"), 6).alias("stops"), F.round(total / F.col("trials"), 6).alias("cumulative"))


@query("+ p AS (SELECT s.session_id, s.cluster_id, s.t_sample - (p.pulse - 3000) AS off FROM pulses p JOIN spikes s ON s.session_id = p.session_id AND s.t_sample > p.pulse - 3000 AND s.t_sample < p.pulse + 3000) SELECT session_id, cluster_id, off // 60 AS bin, count(*) AS n FROM p GROUP BY 1, 2, 3")
def a24_peristimulus_histogram(spark, d):
    p = J.peristimulus(view(spark, d, "spikes").withColumnRenamed("t_sample", "t"), view(spark, d, "pulses"), 6000)
    return p.groupBy(*CELL, F.floor(F.col("offset") / 60).alias("bin")).agg(F.count("*").alias("n"))


@query("SELECT session_id, round(avg(metric), 6) AS mean, round(stddev_pop(metric), 6) AS sd, round(quantile_cont(metric, 0.05), 6) AS low, round(quantile_cont(metric, 0.95), 6) AS high FROM cells GROUP BY 1")
def a27_shuffle_spread(spark, d):
    q = {n: F.round(F.percentile("metric", F.lit(p)), 6).alias(n) for n, p in (("low", 0.05), ("high", 0.95))}
    return view(spark, d, "cells").groupBy("session_id").agg(F.round(F.avg("metric"), 6).alias("mean"), F.round(F.stddev_pop("metric"), 6).alias("sd"), q["low"], q["high"])


@query("SELECT grp, count(*) FILTER (isolation > 0.4 AND noise_overlap < 0.09) AS passing, count(*) AS clusters FROM cells GROUP BY 1")
def a28_sorting_comparison(spark, d):
    return view(spark, d, "cells").groupBy("grp").agg(F.count_if(F.expr("isolation > 0.4 AND noise_overlap < 0.09")).alias("passing"), F.count("*").alias("clusters"))


@query(JOINED + ", v AS (SELECT session_id, pos_idx, sqrt(pow(x_px - lag(x_px) OVER w, 2) + pow(y_px - lag(y_px) OVER w, 2)) AS speed FROM position WINDOW w AS (PARTITION BY session_id ORDER BY pos_idx)), n AS (SELECT session_id, cluster_id, pos_idx, count(*) AS n FROM joined GROUP BY 1, 2, 3), c AS (SELECT DISTINCT session_id, cluster_id FROM joined) SELECT c.session_id, c.cluster_id, round(corr(v.speed, coalesce(n.n, 0)), 5) AS speed_score FROM c JOIN v ON c.session_id = v.session_id LEFT JOIN n ON n.session_id = c.session_id AND n.cluster_id = c.cluster_id AND n.pos_idx = v.pos_idx WHERE v.speed IS NOT NULL GROUP BY 1, 2")
def c1_speed_score(spark, d):
    p, w = view(spark, d, "position"), Window.partitionBy("session_id").orderBy("pos_idx")
    v = p.select("session_id", "pos_idx", F.hypot(F.col("x_px") - F.lag("x_px").over(w), F.col("y_px") - F.lag("y_px").over(w)).alias("speed"))
    return Y.speed_score(joined(spark, d), v, SESSION, CELL, "pos_idx").select(*CELL, F.round("speed_score", 5).alias("speed_score"))


HALF = JOINED + f""", mid AS (SELECT session_id, (max(synced_time) + min(synced_time)) / 2 AS mid FROM position GROUP BY 1),
 o AS (SELECT p.session_id, CASE WHEN synced_time < mid THEN 1 ELSE 2 END AS half, {BINS}, count(*) AS o FROM position p JOIN mid ON p.session_id = mid.session_id GROUP BY 1, 2, 3, 4),
 s AS (SELECT j.session_id, cluster_id, CASE WHEN synced_time < mid THEN 1 ELSE 2 END AS half, {BINS}, count(*) AS n FROM joined j JOIN mid ON j.session_id = mid.session_id GROUP BY 1, 2, 3, 4, 5),
 who AS (SELECT DISTINCT session_id, cluster_id FROM joined),
 m AS (SELECT who.session_id, who.cluster_id, o.bin_x, o.bin_y, max(CASE WHEN o.half = 1 THEN coalesce(n, 0) / o END) AS a, max(CASE WHEN o.half = 2 THEN coalesce(n, 0) / o END) AS b FROM who JOIN o ON who.session_id = o.session_id LEFT JOIN s ON s.session_id = who.session_id AND s.cluster_id = who.cluster_id AND s.half = o.half AND s.bin_x = o.bin_x AND s.bin_y = o.bin_y GROUP BY 1, 2, 3, 4)"""


@query(HALF + " SELECT session_id, cluster_id, round(corr(a, b), 5) AS r, round(avg(CASE WHEN a IS NULL OR b IS NULL THEN 100.0 ELSE 0.0 END), 6) AS excluded FROM m GROUP BY 1, 2")
def c2_half_stability(spark, d):
    p = T.halves(view(spark, d, "position"), SESSION, "synced_time").withColumns({"bin_x": F.floor(F.col("x_px") / 40), "bin_y": F.floor(F.col("y_px") / 40)})
    s = J.spikes_to_positions(view(spark, d, "spikes"), p)
    return Y.half_stability(s, p, SESSION, CELL, ["bin_x", "bin_y"]).select(*CELL, F.round("r", 5).alias("r"), *r6("excluded"))


@query("+ p AS (SELECT session_id, hd, x_px FROM position), c AS (SELECT session_id, corr(cos(radians(hd)), x_px) AS rc, corr(sin(radians(hd)), x_px) AS rs, corr(cos(radians(hd)), sin(radians(hd))) AS cs, count(*) AS n FROM p GROUP BY 1), q AS (SELECT session_id, n, sqrt((rc * rc + rs * rs - 2 * rc * rs * cs) / (1 - cs * cs)) AS rho FROM c) SELECT session_id, round(rho, 6) AS rho, round(exp(-n * rho * rho / 2), 6) AS p FROM q")
def c15_circular_linear(spark, d):
    return Y.circular_linear(view(spark, d, "position"), SESSION, "hd", "x_px").select("session_id", *r6("rho", "p"))


@query("+ n AS (SELECT p.session_id, p.pulse, s.cluster_id, count(*) FILTER (s.t_sample < p.pulse) AS before, count(*) FILTER (s.t_sample > p.pulse) AS after FROM (SELECT DISTINCT * FROM pulses ) p JOIN spikes s ON s.session_id = p.session_id AND s.t_sample > p.pulse - 30000 AND s.t_sample < p.pulse + 30000 GROUP BY 1, 2, 3) SELECT session_id, cluster_id, CAST(sum(before) AS BIGINT) AS before, CAST(sum(after) AS BIGINT) AS after, sum(after) < sum(before) AS reduced FROM n GROUP BY 1, 2")
def c18_inhibition(spark, d):
    p = J.peristimulus(view(spark, d, "spikes").withColumnRenamed("t_sample", "t"), view(spark, d, "pulses").distinct(), 60000)
    n = p.groupBy(*CELL).agg(F.count_if(F.col("offset") < 30000).alias("before"), F.count_if(F.col("offset") > 30000).alias("after"))
    return n.withColumn("reduced", F.col("after") < F.col("before"))


@query(HIST + ", h AS (SELECT * FROM hist), k AS (SELECT a.session_id, a.cluster_id AS a, b.cluster_id AS b, round(corr(a.n, b.n), 5) AS r FROM h a JOIN h b ON a.session_id = b.session_id AND a.bin = b.bin AND a.cluster_id < b.cluster_id GROUP BY 1, 2, 3) SELECT * FROM k")
def c31_correlation_matrix(spark, d):
    return Y.pairwise_correlation(hist(spark, d), SESSION, "cluster_id", "bin", "n").select("session_id", "a", "b", F.round("r", 5).alias("r"))


@query(HIST + ", m AS (SELECT session_id, cluster_id, CAST(round_even(degrees(atan2(sum(sin(radians(bin - 179.0)) * n), sum(cos(radians(bin - 179.0)) * n))), 0) AS BIGINT) AS shift FROM hist GROUP BY 1, 2) SELECT session_id, CAST(((bin - shift) % 360 + 360) % 360 AS INT) AS bin, CAST(sum(n) AS BIGINT) AS n FROM hist JOIN m USING (session_id, cluster_id) GROUP BY 1, 2")
def c34_aligned_population(spark, d):
    return Y.aligned_histogram(hist(spark, d), CELL, SESSION)


@query(FIELDS + ", dirs AS (SELECT session_id, CAST(floor(x_px / 40) AS BIGINT) AS bin_x, CAST(floor(y_px / 40) AS BIGINT) AS bin_y, least(CAST(floor((hd + 180) / 9) AS BIGINT), 39) AS dir, count(*) AS c FROM position GROUP BY 1, 2, 3, 4) SELECT f.session_id, cluster_id, field_id, dir, CAST(sum(n * c) AS BIGINT) AS expected FROM fields f JOIN dirs q ON f.session_id = q.session_id AND f.bin_x = q.bin_x AND f.bin_y = q.bin_y GROUP BY 1, 2, 3, 4")
def c33_expected_direction(spark, d):
    p = view(spark, d, "position")
    dirs = p.groupBy("session_id", F.floor(F.col("x_px") / 40).alias("bin_x"), F.floor(F.col("y_px") / 40).alias("bin_y"), F.least(F.floor((F.col("hd") + 180) / 9), F.lit(39)).alias("dir")).agg(F.count("*").alias("c"))
    return fields(spark, d).join(dirs, ["session_id", "bin_x", "bin_y"]).groupBy(*CELL, "field_id", "dir").agg(F.sum(F.col("n") * F.col("c")).alias("expected"))


@query("SELECT cluster_id, coalesce(peak_snr > 5, false) AS grid, coalesce(isolation > 0.5, false) AS border, coalesce(mean_firing_rate > 3, false) AS hd, CASE WHEN peak_snr > 5 AND isolation > 0.5 THEN 'G' WHEN isolation > 0.5 THEN 'B' WHEN mean_firing_rate > 3 THEN 'HD' WHEN noise_overlap < 0.05 THEN 'NG' ELSE 'NS' END AS label FROM cells")
def r4_classifiers(spark, d):
    flag = lambda e: F.coalesce(F.expr(e), F.lit(False))
    grid, border, hd, spatial = map(flag, ("peak_snr > 5", "isolation > 0.5", "mean_firing_rate > 3", "noise_overlap < 0.05"))
    label = F.when(grid & border, "G").when(border, "B").when(hd, "HD").when(spatial, "NG").otherwise("NS")
    return view(spark, d, "cells").select("cluster_id", grid.alias("grid"), border.alias("border"), hd.alias("hd"), label.alias("label"))


@query("+ n AS (SELECT session_id, count(*) AS n FROM position GROUP BY 1), u AS (SELECT s.session_id, cluster_id, k AS shuffle_id, (spike_idx * 48271 + k * 2654435) % 1000003 * n // 1000003 AS pos_idx FROM spikes s JOIN n ON s.session_id = n.session_id, range(3) r(k)) SELECT u.session_id, u.cluster_id, CAST(u.shuffle_id AS INT) AS shuffle_id, least(CAST(floor((hd + 180) / 18) AS BIGINT), 19) AS bin, count(*) AS n FROM u JOIN position p ON u.session_id = p.session_id AND u.pos_idx = p.pos_idx GROUP BY 1, 2, 3, 4")
def r5_resampled_directions(spark, d):
    return L.resampled_directions(view(spark, d, "spikes"), view(spark, d, "position"), SESSION, CELL, 3, 20)


@query("SELECT cluster_id, round(percent_rank() OVER (PARTITION BY grp ORDER BY metric), 6) AS share, percent_rank() OVER (PARTITION BY grp ORDER BY metric) > 0.95 AS beyond FROM cells")
def r8_shuffle_ranks(spark, d):
    rank = F.percent_rank().over(Window.partitionBy("grp").orderBy("metric"))
    return view(spark, d, "cells").select("cluster_id", F.round(rank, 6).alias("share"), (rank > 0.95).alias("beyond"))


@query("SELECT cluster_id, part[1] AS animal, CAST(part[2] AS DATE) AS day FROM (SELECT cluster_id, string_split('M' || session_id || '_2018-03-' || lpad(CAST(cluster_id % 28 + 1 AS VARCHAR), 2, '0') || '_15-34-44_of', '_') AS part FROM cells) x")
def x5_session_ids(spark, d):
    name = F.concat(F.lit("M"), F.col("session_id"), F.lit("_2018-03-"), F.lpad((F.col("cluster_id") % 28 + 1).cast("string"), 2, "0"), F.lit("_15-34-44_of"))
    part = F.split(name, "_")
    return view(spark, d, "cells").select("cluster_id", part[0].alias("animal"), part[1].cast("date").alias("day"))


@query("+ e AS (SELECT session_id, t_sample % 10000 AS edge, 1 AS w FROM spikes UNION ALL SELECT session_id, t_sample % 10000 + value, -1 FROM spikes ), b AS (SELECT session_id, edge, sum(w) AS w FROM e GROUP BY 1, 2) SELECT session_id, round(edge, 6) AS edge, CAST(sum(w) OVER (PARTITION BY session_id ORDER BY edge) AS BIGINT) AS weight FROM b")
def x8_interval_sweep(spark, d):
    s = view(spark, d, "spikes").withColumn("lo", (F.col("t_sample") % 10000).cast("double")).withColumn("hi", F.col("lo") + F.col("value"))
    return L.interval_sweep(s, SESSION, "lo", "hi").select("session_id", *r6("edge"), "weight")
