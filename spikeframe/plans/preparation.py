"""Registered queries of curation, joins, stitching and sequences, and the SQL that gives the same rows."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..operators import behaviour as B
from ..operators import curation as K
from ..operators import joins as J
from ..operators import sessions as T
from .fixtures import view
from .registry import CELL, JOINED, ORDER, SESSION, joined, query, r6

ROW = ["session_id", "trial", "sample", "part"]
PULSE = "+ b AS (SELECT session_id, min(pulse) AS lo, max(pulse) AS hi FROM pulses GROUP BY 1)"
#: Track zones in cm, half-open.
ZONES = {"outbound": (30, 90), "pre_reward": (70, 90), "reward": (90, 110), "post_reward": (110, 130)}


@query("SELECT cluster_id, coalesce(grp = 'BUILDING', false) AS good FROM cells")
def f2_manual_curation(spark, d):
    good, rest = K.split(view(spark, d, "cells"), F.col("grp") == "BUILDING")
    return good.select("cluster_id", F.lit(True).alias("good")).union(rest.select("cluster_id", F.lit(False)))


@query()
def f6_square_arena(spark, d):
    return K.square_arena(view(spark, d, "position"), SESSION, "x_px", "y_px").groupBy("session_id").agg(F.count("*").alias("n"), F.min("x_px").alias("x0"), F.max("x_px").alias("x1"))


@query(PULSE + " SELECT s.session_id, spike_idx, coalesce(t_sample >= lo, false) AS during, coalesce(t_sample BETWEEN lo + 29970 AND hi - 29970, false) AS near FROM spikes s LEFT JOIN b ON s.session_id = b.session_id")
def f7_opto_epoch(spark, d):
    return K.pulse_epoch(view(spark, d, "spikes"), view(spark, d, "pulses"), SESSION, "t_sample", "pulse", -29970).select("session_id", "spike_idx", "during", "near")


@query("SELECT session_id, count(*) AS n FROM track WHERE speed <> 0 AND x <> 0 GROUP BY 1")
def f8_paired_values(spark, d):
    return K.paired(view(spark, d, "track"), "speed", "x", zeros=False).groupBy("session_id").agg(F.count("*").alias("n"))


@query("SELECT session_id, trial, sample, part, coalesce(speed >= 3, false) AS moving FROM track")
def f10_movement(spark, d):
    moving, still = K.split(view(spark, d, "track"), F.col("speed") >= 3)
    return moving.select(*ROW, F.lit(True).alias("moving")).union(still.select(*ROW, F.lit(False)))


@query("+ u AS (SELECT cluster_id, snippet_id, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) AS pos FROM waves), m AS (SELECT cluster_id, pos, avg(v) + 3 * stddev_pop(v) AS most FROM u GROUP BY 1, 2) SELECT DISTINCT u.cluster_id, snippet_id FROM u JOIN m ON u.cluster_id = m.cluster_id AND u.pos = m.pos WHERE v > most")
def f11_outlier_snippets(spark, d):
    return K.outlier_snippets(view(spark, d, "waves"), ["cluster_id"], "snippet_id", "embedding")


@query("+ u AS (SELECT snippet_id, unnest(embedding) AS v FROM waves) SELECT snippet_id FROM u GROUP BY 1 HAVING max(abs(v))::DOUBLE <= 0.3::DOUBLE")
def f13_quiet_snippets(spark, d):
    return K.quiet_snippets(view(spark, d, "waves"), "embedding", 0.3).select("snippet_id")


@query("SELECT cluster_id, metric < 0 AS false_positive FROM cells")
def f15_listed_cells(spark, d):
    c, parts = view(spark, d, "cells"), [F.col("grp"), F.col("session_id"), F.col("cluster_id")]
    listed = c.where("metric < 0").select(F.concat_ws("-", *parts).alias("name"))
    return K.tag_listed(c, listed, parts, "name", "false_positive").select("cluster_id", "false_positive")


BINS = "CAST(floor(x_px / 40) AS BIGINT) AS bin_x, CAST(floor(y_px / 40) AS BIGINT) AS bin_y"
FIELDS = JOINED + f""", bins AS (SELECT session_id, cluster_id, {BINS}, count(*) AS n FROM joined GROUP BY 1, 2, 3, 4),
 fields AS (SELECT *, CAST(floor(bin_x / 3) * 4 + floor(bin_y / 3) AS BIGINT) AS field_id FROM bins WHERE n >= 2)"""


def fields(spark, d, hits=None):
    """Bins with two spikes or more; blocks of three by three bins stand for fields. hits: spikes with their samples, where they are known."""
    bins = (joined(spark, d) if hits is None else hits).groupBy(*CELL, F.floor(F.col("x_px") / 40).alias("bin_x"), F.floor(F.col("y_px") / 40).alias("bin_y")).agg(F.count("*").alias("n"))
    return bins.where("n >= 2").withColumn("field_id", F.floor(F.col("bin_x") / 3) * 4 + F.floor(F.col("bin_y") / 3))


#: The rule of fields where a session's spikes and samples meet: the size of a bin, and the field of each bin.
BLOCK = 40, lambda x, y, n: np.where(n >= 2, x // 3 * 4 + y // 3, -1)


@query(FIELDS + f", seen AS (SELECT session_id, {BINS} FROM position), e AS (SELECT session_id, max(bin_x) + 1 AS nx, max(bin_y) + 1 AS ny FROM seen GROUP BY 1) SELECT f.session_id, cluster_id, field_id, bool_or(bin_x = 0 OR bin_y = 0 OR bin_x = nx - 1 OR bin_y = ny - 1) AS border FROM fields f JOIN e ON f.session_id = e.session_id GROUP BY 1, 2, 3")
def f16_border_fields(spark, d):
    extent = view(spark, d, "position").groupBy("session_id").agg((F.floor(F.max("x_px") / 40) + 1).alias("nx"), (F.floor(F.max("y_px") / 40) + 1).alias("ny"))
    return K.border_fields(fields(spark, d), [*CELL, "field_id"], extent, SESSION)


@query("SELECT session_id, cluster_id, count(*) AS n FROM spikes GROUP BY 1, 2 HAVING count(*) > 80")
def f17_minimum_spikes(spark, d):
    return view(spark, d, "spikes").groupBy(*CELL).agg(F.count("*").alias("n")).where("n > 80")


@query("+ z AS (SELECT * FROM (VALUES ('outbound', 30, 90), ('pre_reward', 70, 90), ('reward', 90, 110), ('post_reward', 110, 130)) t(zone, lo, hi)) SELECT session_id, trial, sample, part, zone FROM track JOIN z ON x >= lo AND x < hi")
def f18_track_zones(spark, d):
    return K.zones(view(spark, d, "track"), "x", ZONES).select(*ROW, "zone")


@query("SELECT s.session_id, spike_idx, s.t_sample % 6000 AS pos_idx, round(x_px, 6) AS x_px FROM spikes s JOIN position p ON s.session_id = p.session_id AND s.t_sample % 6000 = p.pos_idx")
def j2_spike_samples(spark, d):
    s = view(spark, d, "spikes").withColumn("pos_idx", F.col("t_sample") % 6000)
    return s.join(view(spark, d, "position"), ["session_id", "pos_idx"]).select("session_id", "spike_idx", "pos_idx", *r6("x_px"))


@query(FIELDS + f", s AS (SELECT session_id, pos_idx, {BINS} FROM position WHERE x_px % 40 <> 0 AND y_px % 40 <> 0) SELECT s.session_id, cluster_id, field_id, count(*) AS samples FROM s JOIN fields f ON s.session_id = f.session_id AND s.bin_x = f.bin_x AND s.bin_y = f.bin_y GROUP BY 1, 2, 3")
def j6_samples_in_fields(spark, d):
    return J.in_field_bins(view(spark, d, "position"), fields(spark, d), 40.0).groupBy(*CELL, "field_id").agg(F.count("*").alias("samples"))


@query(FIELDS + f", s AS (SELECT session_id, cluster_id, spike_idx, {BINS} FROM joined) SELECT s.session_id, s.cluster_id, spike_idx, n AS rate FROM s JOIN bins b ON s.session_id = b.session_id AND s.cluster_id = b.cluster_id AND s.bin_x = b.bin_x AND s.bin_y = b.bin_y")
def j7_map_lookup(spark, d):
    s = joined(spark, d).withColumns({"bin_x": F.floor(F.col("x_px") / 40), "bin_y": F.floor(F.col("y_px") / 40)})
    maps = s.groupBy(*CELL, "bin_x", "bin_y").agg(F.count("*").alias("rate"))
    return s.join(maps, [*CELL, "bin_x", "bin_y"]).select(*CELL, "spike_idx", "rate")


TETRODES = "+ t AS (SELECT session_id, cluster_id, cluster_id % 4 AS tetrode FROM cells) SELECT a.session_id, a.tetrode, a.cluster_id AS a, b.cluster_id AS b FROM t a JOIN t b ON a.session_id = b.session_id AND a.tetrode = b.tetrode"


def tetrode_pairs(spark, d):
    t = view(spark, d, "cells").select("session_id", (F.col("cluster_id") % 4).alias("tetrode"), "cluster_id")
    return t.withColumnRenamed("cluster_id", "a").join(t.withColumnRenamed("cluster_id", "b"), ["session_id", "tetrode"])


@query(TETRODES)
def j8_tetrode_pairs(spark, d):
    return tetrode_pairs(spark, d)


@query(TETRODES + " AND a.cluster_id < b.cluster_id")
def j9_field_pairs(spark, d):
    return tetrode_pairs(spark, d).where("a < b")


@query("SELECT c.cluster_id, h.n_nationkey AS animal, h.n_name AS location FROM cells c FULL OUTER JOIN nation h ON c.session_id = h.n_nationkey")
def j10_histology(spark, d):
    h = spark.read.parquet(f"{d}/nation.parquet").select(F.col("n_nationkey").alias("animal"), F.col("n_name").alias("location"))
    c = view(spark, d, "cells")
    return c.join(h, c.session_id == h.animal, "full_outer").select("cluster_id", "animal", "location")


@query("+ r AS (SELECT session_id, count(*) * 1000 AS len FROM position GROUP BY 1), o AS (SELECT session_id, coalesce(sum(len) OVER (PARTITION BY session_id % 2 ORDER BY session_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off FROM r) SELECT s.session_id, spike_idx, CAST(t_sample + off AS BIGINT) AS t FROM spikes s JOIN o ON s.session_id = o.session_id")
def u1_stitch(spark, d):
    r = view(spark, d, "position").groupBy("session_id").agg((F.count("*") * 1000).alias("len")).withColumn("animal", F.col("session_id") % 2)
    o = T.stitched(r, ["animal"], "session_id", "len").select("session_id", "offset")
    return view(spark, d, "spikes").join(o, "session_id").select("session_id", "spike_idx", (F.col("t_sample") + F.col("offset")).alias("t"))


@query("SELECT session_id, spike_idx, r AS recording, t_sample - r * 500000 AS t_local FROM spikes, range(10) x(r) WHERE t_sample > r * 500000 AND t_sample <= (r + 1) * 500000")
def u2_split_stitched(spark, d):
    stitches = spark.range(10).select(F.col("id").alias("recording"), (F.col("id") * 500000).alias("lo"), ((F.col("id") + 1) * 500000).alias("hi"))
    return J.split_stitched(view(spark, d, "spikes").withColumnRenamed("t_sample", "t"), stitches).select("session_id", "spike_idx", "recording", "t_local")


@query("SELECT session_id // 2 AS pair, cluster_id, count(*) AS n, min(t_sample + session_id % 2 * 5000000) AS first_t, max(t_sample + session_id % 2 * 5000000) AS last_t FROM spikes GROUP BY 1, 2")
def u3_combined_clusters(spark, d):
    s = view(spark, d, "spikes").select(F.floor(F.col("session_id") / 2).alias("pair"), "cluster_id", (F.col("t_sample") + F.col("session_id") % 2 * 5000000).alias("t"))
    return s.groupBy("pair", "cluster_id").agg(F.count("*").alias("n"), F.min("t").alias("first_t"), F.max("t").alias("last_t"))


@query("+ r AS (SELECT session_id, count(*) * 1000 AS len FROM position GROUP BY 1), o AS (SELECT session_id, coalesce(sum(len) OVER (PARTITION BY session_id % 2 ORDER BY session_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off FROM r) SELECT s.session_id % 2 AS animal, cluster_id, count(*) AS n, CAST(min(t_sample + off) AS BIGINT) AS first_t, CAST(max(t_sample + off) AS BIGINT) AS last_t FROM spikes s JOIN o ON s.session_id = o.session_id GROUP BY 1, 2")
def u3_all_combined_clusters(spark, d):
    s = u1_stitch(spark, d).join(view(spark, d, "spikes").select("session_id", "spike_idx", "cluster_id"), ["session_id", "spike_idx"])
    return s.groupBy((F.col("session_id") % 2).alias("animal"), "cluster_id").agg(F.count("*").alias("n"), F.min("t").alias("first_t"), F.max("t").alias("last_t"))


@query("+ u AS (SELECT session_id, cluster_id FROM cells UNION SELECT session_id, cluster_id FROM spikes), q AS (SELECT DISTINCT u.*, pulse FROM u JOIN pulses p ON u.session_id = p.session_id) SELECT q.session_id, q.cluster_id, q.pulse, s.spike_idx, s.t_sample - (q.pulse - 3000) AS \"offset\" FROM q LEFT JOIN spikes s ON s.session_id = q.session_id AND s.cluster_id = q.cluster_id AND s.t_sample > q.pulse - 3000 AND s.t_sample < q.pulse + 3000")
def j4_all_pairs(spark, d):
    s, p = view(spark, d, "spikes").withColumnRenamed("t_sample", "t"), view(spark, d, "pulses").select("session_id", "pulse").distinct()
    pairs = view(spark, d, "cells").select(*CELL).union(s.select(*CELL)).distinct().join(p, "session_id")
    found = J.peristimulus(s, p, 6000).select(*CELL, "pulse", "spike_idx", "offset")
    return pairs.join(found, [*CELL, "pulse"], "left").select(*CELL, "pulse", "spike_idx", "offset")


@query("+ m AS (SELECT session_id, (max(synced_time) + min(synced_time)) / 2 AS mid FROM position GROUP BY 1) SELECT p.session_id, pos_idx, CAST(CASE WHEN synced_time < mid THEN 1 ELSE 2 END AS INT) AS half FROM position p JOIN m ON p.session_id = m.session_id")
def u6_halves(spark, d):
    return T.halves(view(spark, d, "position"), SESSION, "synced_time").select("session_id", "pos_idx", "half")


@query("+ k AS (SELECT session_id, pulse, row_number() OVER (PARTITION BY session_id ORDER BY pulse) AS k, count(*) OVER (PARTITION BY session_id) AS c FROM pulses) SELECT session_id, pulse, 'first' AS position FROM k WHERE c > 50 AND k <= 20 UNION ALL SELECT session_id, pulse, 'last' FROM k WHERE c > 50 AND k > c - 20".replace("AS position", 'AS "position"'))
def u8_first_and_last_pulses(spark, d):
    return T.ends(view(spark, d, "pulses"), SESSION, ["pulse"], 20, 50)


@query("+ c AS (SELECT DISTINCT session_id, cluster_id FROM spikes), e AS (SELECT session_id, cluster_id, spike_idx % 10 AS k FROM spikes WHERE value > 300) SELECT session_id, cluster_id, CAST(k AS INT) AS shuffle_id FROM (SELECT c.*, r.k FROM c, range(1000) r(k)) w WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.session_id = w.session_id AND e.cluster_id = w.cluster_id AND e.k = w.k)")
def u9_remaining_shuffles(spark, d):
    s = view(spark, d, "spikes")
    return T.remaining(s, s.where("value > 300").withColumn("shuffle_id", (F.col("spike_idx") % 10).cast("int")), CELL, 1000)


KNOWN = """+ k AS (SELECT session_id, pos_idx, CASE WHEN x_px > 40 AND x_px < 360 THEN hd END AS v FROM position),
 g AS (SELECT *, max(CASE WHEN v IS NOT NULL THEN pos_idx END) OVER (PARTITION BY session_id ORDER BY pos_idx) AS ia, min(CASE WHEN v IS NOT NULL THEN pos_idx END) OVER (PARTITION BY session_id ORDER BY pos_idx ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS ib FROM k),
 j AS (SELECT g.*, a.v AS va, b.v AS vb FROM g LEFT JOIN k a ON a.session_id = g.session_id AND a.pos_idx = ia LEFT JOIN k b ON b.session_id = g.session_id AND b.pos_idx = ib),
 l AS (SELECT *, va + ((vb - va + 540) % 360 - 180) * (pos_idx - ia) / (ib - ia) AS line FROM j)"""


@query(KNOWN + " SELECT session_id, pos_idx, round(coalesce(v, (line + 540) % 360 - 180, va, vb), 5) AS hd FROM l")
def w4_circular_interpolation(spark, d):
    p = view(spark, d, "position").withColumn("hd", F.when((F.col("x_px") > 40) & (F.col("x_px") < 360), F.col("hd")))
    return T.interpolate_circular(p, SESSION, ORDER, "hd", "pos_idx").select("session_id", "pos_idx", F.round("hd", 5).alias("hd"))


FOLD = "(CASE WHEN ({0} + 180) % 360 < 0 THEN (({0} + 180) % 360 + 360) % 360 ELSE ({0} + 180) % 360 END - 180)"
CHANGE = FOLD.format("(v.a - p.a - 180.0::DOUBLE * p.s)")
TURN = f"CASE WHEN abs({CHANGE}) / (v.t - p.t) > 3600 AND abs({FOLD.format(f'({CHANGE} + 180)')}) < abs({CHANGE}) THEN 1 ELSE 0 END"


@query(f"+ r AS (SELECT session_id, list(pos_idx ORDER BY pos_idx) AS i, list(hd ORDER BY pos_idx) AS h, list_reduce(list(struct_pack(a := hd, t := synced_time, s := 0, l := [0]) ORDER BY pos_idx), lambda p, v: struct_pack(a := v.a, t := v.t, s := {TURN}, l := list_append(p.l, {TURN}))) AS r FROM position GROUP BY 1), o AS (SELECT session_id, unnest(i) AS pos_idx, unnest(h) AS hd, unnest(r.l) AS s FROM r) SELECT session_id, pos_idx, pos_idx / 30.0::DOUBLE AS synced_time, round(CASE WHEN s = 1 THEN {FOLD.format('(hd + 180)')} ELSE hd END, 6) AS hd FROM o")
def w5_direction_repair(spark, d):
    p = view(spark, d, "position").select("session_id", "pos_idx", "synced_time", "hd")
    return T.repaired_direction(p, SESSION, "pos_idx", "hd", "synced_time", 3600.0).select("session_id", "pos_idx", "synced_time", *r6("hd"))


@query("+ e AS (SELECT session_id, max(synced_time) AS t_end FROM position GROUP BY 1), g AS (SELECT session_id, step, step / 12.0::DOUBLE AS t FROM (SELECT session_id, t_end, unnest(range(0, CAST(ceil(t_end * 12) AS BIGINT) + 1)) AS step FROM e) x WHERE step / 12.0::DOUBLE < t_end), a AS (SELECT g.*, p.synced_time AS ta, p.x_px AS va FROM g ASOF JOIN position p ON g.session_id = p.session_id AND g.t >= p.synced_time), b AS (SELECT a.*, p.synced_time AS tb, p.x_px AS vb FROM a ASOF JOIN position p ON a.session_id = p.session_id AND a.t <= p.synced_time) SELECT session_id, step, round(va + (vb - va) * CASE WHEN tb = ta THEN 0 ELSE (t - ta) / (tb - ta) END, 5) AS x_px FROM b")
def w7_resample(spark, d):
    return T.resample(view(spark, d, "position"), SESSION, "synced_time", "x_px", 12.0).select("session_id", "step", F.round("x_px", 5).alias("x_px"))


@query("""+ o AS (SELECT session_id, pos_idx, pos_idx - row_number() OVER (PARTITION BY session_id ORDER BY pos_idx) AS g FROM position WHERE sync_led > 3.5),
 r AS (SELECT session_id, min(pos_idx) AS s, max(pos_idx) - min(pos_idx) + 1 AS width FROM o GROUP BY session_id, g), n AS (SELECT session_id, width, count(*) AS c FROM r GROUP BY 1, 2)
 SELECT session_id, min_by(width, struct_pack(a := -c, b := width)) AS width FROM n GROUP BY 1""")
def w13_pulse_width(spark, d):
    runs = B.runs(view(spark, d, "position").where("sync_led > 3.5"), SESSION, "pos_idx")
    return T.modal(runs.withColumn("width", F.col("end") - F.col("start") + 1), SESSION, "width")


@query("+ l AS (SELECT session_id, pos_idx, x_px, min(x_px) OVER (PARTITION BY session_id ORDER BY pos_idx) AS low FROM position), m AS (SELECT session_id, median(low) AS med FROM l GROUP BY 1), c AS (SELECT l.session_id, pos_idx, greatest(x_px, med) AS v FROM l JOIN m ON l.session_id = m.session_id) SELECT session_id, pos_idx, round((v - min(v) OVER (PARTITION BY session_id)) / ((max(v) OVER (PARTITION BY session_id) - min(v) OVER (PARTITION BY session_id)) / 200), 6) AS x_cm FROM c")
def w14_track_location(spark, d):
    from pyspark.sql import Window

    p, w = B.restart_floor(view(spark, d, "position"), SESSION, ORDER, "x_px"), Window.partitionBy("session_id")
    cm = F.try_divide(F.col("x_px") - F.min("x_px").over(w), (F.max("x_px").over(w) - F.min("x_px").over(w)) / 200)
    return p.select("session_id", "pos_idx", F.round(cm, 6).alias("x_cm"))


MODE = "(SELECT session_id, trial, min_by(v, struct_pack(a := -c, b := v)) AS v FROM (SELECT session_id, trial, {} AS v, count(*) AS c FROM track GROUP BY 1, 2, 3) q GROUP BY 1, 2)"


@query(f"+ a AS {MODE.format('part % 5')}, b AS {MODE.format('sample % 4')} SELECT a.session_id, a.trial, CAST(CASE WHEN a.v < 2 AND b.v < 2 THEN 0 WHEN a.v < 2 AND b.v > 2 THEN 1 WHEN a.v > 2 AND b.v > 2 THEN 2 END AS INT) AS trial_type FROM a JOIN b ON a.session_id = b.session_id AND a.trial = b.trial")
def w16_trial_types(spark, d):
    t, keys = view(spark, d, "track").withColumns({"ch1": F.col("part") % 5, "ch2": F.col("sample") % 4}), ["session_id", "trial"]
    both = T.modal(t, keys, "ch1").join(T.modal(t, keys, "ch2"), keys)
    kind = F.when((F.col("ch1") < 2) & (F.col("ch2") < 2), 0).when((F.col("ch1") < 2) & (F.col("ch2") > 2), 1).when((F.col("ch1") > 2) & (F.col("ch2") > 2), 2)
    return both.select(*keys, kind.alias("trial_type"))


@query("SELECT session_id, pos_idx, round(pos_idx / 30.0, 6) AS time_seconds, round(1 / 30.0, 6)::DOUBLE AS dwell FROM position")
def w19_time_and_dwell(spark, d):
    return view(spark, d, "position").select("session_id", "pos_idx", F.round(F.col("pos_idx") / 30.0, 6).alias("time_seconds"), F.round(F.lit(1) / 30.0, 6).alias("dwell"))


@query("SELECT session_id, trial, coalesce((max(CASE WHEN speed > 5 THEN x END) + min(CASE WHEN speed > 5 THEN x END)) / 2, 0) AS goal FROM track GROUP BY 1, 2")
def w22_goal_location(spark, d):
    return T.goal_location(view(spark, d, "track"), ["session_id", "trial"], "x", F.col("speed") > 5)


@query("+ o AS (SELECT session_id, pos_idx, x_px < 100 AS ison, coalesce(lag(x_px) OVER (PARTITION BY session_id ORDER BY pos_idx) < 100, false) AS was FROM position) SELECT session_id, pos_idx FROM o WHERE ison AND NOT was")
def w23_stop_starts(spark, d):
    return T.run_starts(view(spark, d, "position"), SESSION, ORDER, F.col("x_px") < 100).select("session_id", "pos_idx")


@query("SELECT session_id, bool_and(ok) AS is_sorted FROM (SELECT session_id, t_sample >= lag(t_sample, 1, t_sample) OVER (PARTITION BY session_id ORDER BY spike_idx) AS ok FROM spikes) x GROUP BY 1")
def x6_sorted_check(spark, d):
    s = view(spark, d, "spikes").withColumn("ok", F.coalesce(F.col("t_sample") >= F.lag("t_sample").over(B.over(SESSION, ["spike_idx"])), F.lit(True)))
    return s.groupBy("session_id").agg(F.bool_and("ok").alias("is_sorted"))
