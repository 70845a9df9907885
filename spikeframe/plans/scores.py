"""Registered queries of smoothed series, and of all scores of cells and of their shuffles, and the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import bars as Q
from ..operators import behaviour as B
from ..operators import curation as K
from ..operators import maps as M
from ..operators import responses as R
from ..operators import sessions as T
from ..operators import shuffles as H
from ..operators import significance as G
from ..operators import similarity as Y
from ..operators import trials as L
from ..operators import waveforms as V
from .analysis import RATES, trial_rates
from .extended import PLACE, SHIFTED, kernel, place_tiles, seen_bins
from .fixtures import view
from .registry import CELL, SESSION, joined, query, r6
from .responses import LATENCY

SD, BIN, SMOOTH, GUARD = 2.0, 40, 40, 20_000
MAP_SCORES = ("spatial_information", "speed_score", "stability")


def weights(sd: float) -> str:
    """SQL of the kernel: k(d, w)."""
    reach = int(4 * sd + 0.5)
    return f"k AS (SELECT d, exp(-d * d / {2 * sd * sd}::DOUBLE) / sum(exp(-d * d / {2 * sd * sd}::DOUBLE)) OVER () AS w FROM range(-{reach}, {reach + 1}) q(d))"


MIRROR = "CASE WHEN {0} < 0 THEN -1 - ({0}) WHEN {0} >= n THEN 2 * n - 1 - ({0}) ELSE {0} END"
SIZE = "size_ AS (SELECT session_id, count(*) AS n, max(synced_time) AS t_end FROM position GROUP BY 1)"


@query(f"+ {weights(3.0)}, {SIZE} SELECT p.session_id, p.pos_idx, round(sum(w * q.x_px) / sum(w), 5) AS smooth FROM position p JOIN size_ ON p.session_id = size_.session_id, k JOIN position q ON q.session_id = p.session_id AND q.pos_idx = {MIRROR.format('p.pos_idx + d')} GROUP BY 1, 2")
def w21_reflected_smoothing(spark, d):
    out = B.smoothed(view(spark, d, "position"), SESSION, "pos_idx", "x_px", 3.0, chunk=1000)
    return out.select("session_id", "pos_idx", F.round("smooth", 5).alias("smooth"))


@query(f"+ {weights(3.0)}, {SIZE}, v AS (SELECT session_id, pos_idx, CASE WHEN x_px > 150 THEN x_px END AS x FROM position) SELECT p.session_id, p.pos_idx, round(sum(w * coalesce(q.x, 0)) / sum(CASE WHEN p.pos_idx + d < 0 OR p.pos_idx + d >= n OR q.x IS NOT NULL THEN w END), 5) AS smooth FROM v p JOIN size_ ON p.session_id = size_.session_id CROSS JOIN k LEFT JOIN v q ON q.session_id = p.session_id AND q.pos_idx = p.pos_idx + d GROUP BY 1, 2")
def w21_zero_edges(spark, d):
    p = view(spark, d, "position").select("session_id", "pos_idx", F.when(F.col("x_px") > 150, F.col("x_px")).alias("x"))
    return B.smoothed(p, SESSION, "pos_idx", "x", 3.0, "zero", chunk=1000).select("session_id", "pos_idx", F.round("smooth", 5).alias("smooth"))


def moving(spark, d):
    """Position with half and speed, the distance to the sample before."""
    whole = Window.partitionBy("session_id")
    w = whole.orderBy("pos_idx")
    mid = (F.max("synced_time").over(whole) + F.min("synced_time").over(whole)) / 2
    p = view(spark, d, "position").withColumn("half", F.when(F.col("synced_time") < mid, 1).otherwise(2))
    return p.withColumn("speed", F.hypot(F.col("x_px") - F.lag("x_px").over(w), F.col("y_px") - F.lag("y_px").over(w)))


#: The smoothed speed a, and the sums that a correlation with it needs.
SPEED = f"""{weights(SD)}, {SIZE}, raw AS (SELECT session_id, pos_idx, sqrt(pow(x_px - lag(x_px) OVER o, 2) + pow(y_px - lag(y_px) OVER o, 2)) AS v FROM position WINDOW o AS (PARTITION BY session_id ORDER BY pos_idx)),
 sa AS MATERIALIZED (SELECT p.session_id, p.pos_idx, sum(w * q.v) / sum(CASE WHEN q.v IS NOT NULL THEN w END) AS a FROM raw p JOIN size_ ON p.session_id = size_.session_id, k JOIN raw q ON q.session_id = p.session_id AND q.pos_idx = {MIRROR.format('p.pos_idx + d')} GROUP BY 1, 2),
 am AS (SELECT session_id, avg(a) AS mean, var_pop(a) AS var FROM sa GROUP BY 1)"""


def speed_scores(source: str, keys: str) -> str:
    """SQL of sp(keys, r, n) from spikes source(keys, t_sample)."""
    own = ", ".join(f"f.{c}" for c in keys.split(", "))
    return f"""f AS (SELECT {keys}, n, least(CAST(floor(t_sample * n / (t_end * 30000)) AS BIGINT), n - 1) AS j, count(*) AS c FROM {source} JOIN size_ USING (session_id) WHERE t_sample BETWEEN 0 AND t_end * 30000 GROUP BY ALL),
 h_ AS (SELECT {own}, f.n, {MIRROR.format('f.j + d')} AS i, sum(c * w) AS h FROM f, k GROUP BY ALL),
 sp AS (SELECT {keys.replace('session_id', 'h_.session_id')}, max(n) AS n, (sum(h * a) - sum(h) * max(mean)) / sqrt((sum(h * h) - sum(h) * sum(h) / max(n)) * max(n) * max(var)) AS r FROM h_ JOIN sa ON sa.session_id = h_.session_id AND sa.pos_idx = h_.i JOIN am ON am.session_id = h_.session_id GROUP BY ALL)"""


@query(f"+ s_ AS (SELECT * FROM spikes ), {SPEED}, {speed_scores('s_', 'session_id, cluster_id')} SELECT session_id, cluster_id, round(r, 5) AS speed_score FROM sp")
def c1_smoothed_speed_score(spark, d):
    s = Y.smoothed_speed_score(view(spark, d, "spikes"), moving(spark, d), SESSION, CELL, "pos_idx", "synced_time", "speed", SD)
    return s.select(*CELL, F.round("speed_score", 5).alias("speed_score"))


@query()
def c1_speed_score_p(spark, d):
    s = Y.smoothed_speed_score(view(spark, d, "spikes"), moving(spark, d), SESSION, CELL, "pos_idx", "synced_time", "speed", SD)
    return s.select(*CELL, F.round("speed_score", 5).alias("speed_score"), F.round("p", 8).alias("p"))


def shuffled(spark, d, n, own=False, only=None):
    """Scores of the place cells' shuffles; a session's length is 1000 samples for each of its positions."""
    spikes = view(spark, d, "places").select(*CELL, F.col("t_sample").alias("t"))
    return H.shuffled_scores(spikes, moving(spark, d), n, 1000, GUARD, SESSION, CELL, BIN, SMOOTH, 1 / 30, 3, SD, 4, own=own, only=only, per_sample=True)


def scored(n: int) -> str:
    """SQL of the shuffles' speed (sp), information (info) and stability (stab) by session, cluster and shuffle."""
    keys = "session_id, cluster_id, shuffle_id"
    draw = f"CAST('0x' || substr(md5(concat_ws('-', 'shift', session_id, cluster_id, h)), 1, 15) AS BIGINT) % (len - {2 * GUARD})"
    half = seen_bins(BIN, SMOOTH).replace("seen AS", "seen2 AS").replace("SELECT session_id,", "SELECT session_id, half,").replace("FROM position)", "FROM pos2)")
    return f"""+ len_ AS (SELECT session_id, count(*) * 1000 AS len FROM position GROUP BY 1), span AS (SELECT session_id, (max(synced_time) - min(synced_time)) / (count(*) - 1) AS dt, max(synced_time) AS t_max, (max(synced_time) + min(synced_time)) / 2 AS mid FROM position GROUP BY 1),
 pos2 AS (SELECT p.*, CASE WHEN synced_time < mid THEN 1 ELSE 2 END AS half FROM position p JOIN span ON p.session_id = span.session_id),
 o AS (SELECT session_id, cluster_id, len, CAST(h AS INT) AS shuffle_id, {GUARD} + {draw} AS moved FROM (SELECT DISTINCT session_id, cluster_id FROM places ) c JOIN len_ USING (session_id), range({n}) r(h)),
 m AS MATERIALIZED (SELECT o.session_id, o.cluster_id, shuffle_id, (t_sample + moved) % len AS t_sample FROM (SELECT session_id, cluster_id, t_sample FROM places ) c JOIN o USING (session_id, cluster_id)),
 hit AS (SELECT m.*, CAST(round_even(t_sample / (dt * 30000.0::DOUBLE), 0) AS BIGINT) AS pos_idx FROM m JOIN span USING (session_id) WHERE t_sample / 30000.0::DOUBLE < t_max),
 at_ AS MATERIALIZED (SELECT hit.*, half, x_px, y_px FROM hit JOIN pos2 USING (session_id, pos_idx)),
 {kernel("at_", keys, "top", BIN, SMOOTH)}, {kernel("position", "session_id", "base", BIN, SMOOTH)}, {seen_bins(BIN, SMOOTH)},
 map AS MATERIALIZED (SELECT top.*, CASE WHEN n IS NULL THEN 0.0 ELSE top.v / (base.v / 30) END AS rate, n FROM top JOIN base USING (session_id, bin_x, bin_y) LEFT JOIN seen USING (session_id, bin_x, bin_y)),
 tot AS (SELECT session_id, sum(n) AS total FROM seen GROUP BY 1), pr AS (SELECT {keys}, rate, n / total AS p FROM map JOIN tot USING (session_id) WHERE n IS NOT NULL), mean AS (SELECT {keys}, sum(p * rate) AS mean FROM pr GROUP BY ALL),
 info AS (SELECT {keys}, sum(CASE WHEN rate > 0 THEN p * rate * log2(rate / mean) ELSE 0 END) / max(mean) AS information FROM pr JOIN mean USING ({keys}) GROUP BY ALL),
 {kernel("at_", keys + ", half", "top2", BIN, SMOOTH)}, {kernel("pos2", "session_id, half", "base2", BIN, SMOOTH)}, {half},
 both_ AS (SELECT session_id, bin_x, bin_y FROM seen2 GROUP BY ALL HAVING count(*) = 2), map2 AS (SELECT {keys}, half, bin_x, bin_y, top2.v / (base2.v / 30) AS rate FROM top2 JOIN base2 USING (session_id, half, bin_x, bin_y)),
 pair AS (SELECT o.session_id, o.cluster_id, o.shuffle_id, bin_x, bin_y, coalesce(max(CASE WHEN half = 1 THEN rate END), 0) AS a, coalesce(max(CASE WHEN half = 2 THEN rate END), 0) AS b FROM o JOIN both_ USING (session_id) LEFT JOIN map2 USING (session_id, cluster_id, shuffle_id, bin_x, bin_y) GROUP BY ALL),
 stab AS (SELECT {keys}, corr(a, b) AS stability FROM pair GROUP BY ALL), {SPEED}, {speed_scores('m', keys)}"""


@query(scored(6) + " SELECT o.session_id, o.cluster_id, o.shuffle_id, round(information, 5) AS spatial_information, round(r, 5) AS speed_score, round(stability, 5) AS stability FROM o LEFT JOIN info USING (session_id, cluster_id, shuffle_id) LEFT JOIN sp USING (session_id, cluster_id, shuffle_id) LEFT JOIN stab USING (session_id, cluster_id, shuffle_id)")
def r2_shuffled_map_scores(spark, d):
    return shuffled(spark, d, 6, only=MAP_SCORES).select(*CELL, "shuffle_id", *(F.round(c, 5).alias(c) for c in MAP_SCORES))


@query(scored(6) + " SELECT o.session_id, o.cluster_id, round(avg(information) + 2.326 * stddev_pop(information), 5) AS information_cutoff, round(avg(r) + CASE WHEN avg(r) < 0 THEN -2.326 ELSE 2.326 END * stddev_pop(r), 5) AS speed_cutoff, round(avg(stability) + 2.326 * stddev_pop(stability), 5) AS stability_cutoff FROM o LEFT JOIN info USING (session_id, cluster_id, shuffle_id) LEFT JOIN sp USING (session_id, cluster_id, shuffle_id) LEFT JOIN stab USING (session_id, cluster_id, shuffle_id) GROUP BY 1, 2")
def r3_map_score_cutoffs(spark, d):
    cut = H.score_cutoffs(shuffled(spark, d, 6, only=MAP_SCORES), CELL)
    return cut.select(*CELL, *(F.round(f"{c}_cutoff", 5).alias(f"{name}_cutoff") for c, name in (("spatial_information", "information"), ("speed_score", "speed"), ("stability", "stability"))))


@query()
def r2_shuffled_scores(spark, d):
    return shuffled(spark, d, 20).select(*CELL, "shuffle_id", *(F.round(c, 5).alias(c) for c in H.SCORES))


@query()
def r4_cell_labels(spark, d):
    """All six flags from the cells' own scores and the cutoffs of their shuffles."""
    labels = K.labelled(H.score_cutoffs(shuffled(spark, d, 20, own=True), CELL, own=True))
    return labels.select(*CELL, "grid", "border", "hd", "hd_rayleigh", "spatial", "speed", "label")


HALVES = f""", span2 AS (SELECT session_id, (max(synced_time) + min(synced_time)) / 2 AS mid FROM position GROUP BY 1), pos2 AS (SELECT p.*, CASE WHEN synced_time < mid THEN 1 ELSE 2 END AS half FROM position p JOIN span2 USING (session_id)),
 at_ AS (SELECT p.session_id, p.cluster_id, x_px, y_px, CASE WHEN synced_time < mid THEN 1 ELSE 2 END AS half FROM places p JOIN span2 ON p.session_id = span2.session_id),
 {kernel("at_", "session_id, cluster_id, half", "top2", BIN, SMOOTH)}, {kernel("pos2", "session_id, half", "base2", BIN, SMOOTH)}, {seen_bins(BIN, SMOOTH).replace("seen AS", "seen2 AS").replace("SELECT session_id,", "SELECT session_id, half,").replace("FROM position)", "FROM pos2)")},
 both_ AS (SELECT session_id, bin_x, bin_y, count(*) AS halves FROM seen2 GROUP BY ALL), lost AS (SELECT session_id, 100.0 * count(*) FILTER (halves < 2) / count(*) AS excluded FROM both_ GROUP BY 1), map2 AS (SELECT session_id, cluster_id, half, bin_x, bin_y, top2.v / (base2.v / 30) AS rate FROM top2 JOIN base2 USING (session_id, half, bin_x, bin_y)),
 pair AS (SELECT o.session_id, o.cluster_id, bin_x, bin_y, coalesce(max(CASE WHEN half = 1 THEN rate END), 0) AS a, coalesce(max(CASE WHEN half = 2 THEN rate END), 0) AS b FROM (SELECT DISTINCT session_id, cluster_id FROM at_) o JOIN both_ USING (session_id) LEFT JOIN map2 USING (session_id, cluster_id, bin_x, bin_y) WHERE halves = 2 GROUP BY ALL)"""


@query(HALVES.replace(", span2", "+ span2", 1) + " SELECT session_id, cluster_id, round(corr(a, b), 5) AS r, round(max(excluded), 5) AS excluded FROM pair JOIN lost USING (session_id) GROUP BY 1, 2")
def c2_map_stability(spark, d):
    p = T.halves(view(spark, d, "position"), SESSION, "synced_time")
    s = view(spark, d, "places").select(*CELL, "pos_idx", "x_px", "y_px").join(p.select(*SESSION, "pos_idx", "half"), [*SESSION, "pos_idx"])
    return Y.map_stability(s, p, SESSION, CELL, BIN, SMOOTH, 1 / 30, 3).select(*CELL, F.round("r", 5).alias("r"), F.round("excluded", 5).alias("excluded"))


NEAR = """, occ AS (SELECT session_id, bin_x, bin_y, n FROM seen), cell AS MATERIALIZED (SELECT m.session_id, cluster_id, m.bin_x, m.bin_y, rate, n FROM map m JOIN occ o ON m.session_id = o.session_id AND m.bin_x = o.bin_x AND m.bin_y = o.bin_y),
 w_ AS (SELECT a.session_id, a.bin_x, a.bin_y, sum(b.n) AS w FROM occ a JOIN occ b ON a.session_id = b.session_id AND abs(a.bin_x - b.bin_x) <= 1 AND abs(a.bin_y - b.bin_y) <= 1 AND (a.bin_x <> b.bin_x OR a.bin_y <> b.bin_y) GROUP BY ALL),
 s_ AS (SELECT a.session_id, a.cluster_id, a.bin_x, a.bin_y, sum(b.rate * b.n) AS s FROM cell a JOIN cell b ON a.session_id = b.session_id AND a.cluster_id = b.cluster_id AND abs(a.bin_x - b.bin_x) <= 1 AND abs(a.bin_y - b.bin_y) <= 1 AND (a.bin_x <> b.bin_x OR a.bin_y <> b.bin_y) GROUP BY ALL),
 co AS (SELECT c.session_id, c.cluster_id, corr(rate, coalesce(s / w, 0)) AS r, count(*) AS n FROM cell c LEFT JOIN s_ USING (session_id, cluster_id, bin_x, bin_y) LEFT JOIN w_ ON w_.session_id = c.session_id AND w_.bin_x = c.bin_x AND w_.bin_y = c.bin_y GROUP BY 1, 2)"""


@query(PLACE + NEAR + " SELECT session_id, cluster_id, round(r, 5) AS r, round(0.5 * ln((1 + r) / (1 - r)) * sqrt(n - 3), 4) AS z FROM co")
def a9_coherence(spark, d):
    seen = M.occupancy_tiles(view(spark, d, "position"), SESSION, 20.0, 30.0, 30.0)
    return M.map_coherence(place_tiles(spark, d, seen), seen, CELL, SESSION, 3).select(*CELL, F.round("r", 5).alias("r"), F.round("z", 4).alias("z"))


@query(PLACE + NEAR + ", h AS (SELECT session_id, cluster_id, avg(rate) AS m, avg(CASE WHEN rate > 0.0001 THEN rate * log2(rate) ELSE 0 END) AS h FROM cell GROUP BY 1, 2) SELECT session_id, cluster_id, round((h - m * log2(m)) / m, 5) AS information FROM h")
def a9_uniform_information(spark, d):
    seen = M.occupancy_tiles(view(spark, d, "position"), SESSION, 20.0, 30.0, 30.0)
    return M.map_uniform_information(place_tiles(spark, d, seen), seen, CELL, SESSION, 3).select(*CELL, F.round("information", 5).alias("information"))


#: A sparse pulse, and the light that follows it some samples later with a level of its own.
STREAMS = """+ a AS (SELECT session_id, pos_idx, pos_idx / 30.0::DOUBLE AS t, CASE WHEN sync_led > 7.5 AND x_px >= 360 THEN 5.0 ELSE 0.0 END AS level FROM position), b AS (SELECT session_id, pos_idx + 70 + 13 * session_id AS pos_idx, (pos_idx + 70 + 13 * session_id) / 30.0::DOUBLE AS t, CASE WHEN sync_led > 7.5 AND x_px >= 360 THEN 20.0 ELSE (y_px % 1)::DOUBLE END AS level FROM position)"""


@query(STREAMS + """, th AS (SELECT session_id, (max(t) - min(t)) / (count(*) - 1) AS dt, median(level) + 6 * stddev_pop(level) AS top FROM b GROUP BY 1),
 oa AS (SELECT session_id, pos_idx FROM a WHERE level >= 2), ob AS (SELECT b.session_id, pos_idx FROM b JOIN th USING (session_id) WHERE level >= top),
 c AS (SELECT oa.session_id, ob.pos_idx - oa.pos_idx AS lag, count(*) AS n FROM oa JOIN ob ON oa.session_id = ob.session_id GROUP BY 1, 2), l AS (SELECT session_id, min_by(lag, struct_pack(x := -n, y := lag)) AS lag FROM c GROUP BY 1),
 st AS (SELECT session_id, min(t) AS t0 FROM a WHERE t >= 1 GROUP BY 1),
 ai AS (SELECT a.session_id, min(pos_idx) FILTER (level >= 2) AS i FROM a JOIN st ON a.session_id = st.session_id WHERE t >= t0 GROUP BY 1), ta AS (SELECT a.session_id, a.t AS ta FROM a JOIN ai ON a.session_id = ai.session_id AND a.pos_idx = ai.i - 1 JOIN st ON st.session_id = a.session_id WHERE a.t >= t0),
 e AS (SELECT b.session_id, pos_idx, t - lag * dt AS t, level >= top AS ison, t0 FROM b JOIN th USING (session_id) JOIN l USING (session_id) JOIN st USING (session_id)), b0 AS (SELECT session_id, min_by(pos_idx, struct_pack(x := abs(t - t0), y := pos_idx)) AS i0 FROM e GROUP BY 1),
 bi AS (SELECT e.session_id, max(i0) AS i0, min(pos_idx) FILTER (ison) AS i FROM e JOIN b0 USING (session_id) WHERE pos_idx >= i0 GROUP BY 1), tb AS (SELECT e.session_id, e.t AS tb FROM e JOIN bi ON e.session_id = bi.session_id AND e.pos_idx = bi.i - 1 WHERE pos_idx >= i0)
 SELECT l.session_id, lag, round(lag * dt, 6) AS coarse, round(ta - tb, 6) AS fine, coalesce(abs(ta - tb) < 2.5, false) AS ok FROM l JOIN th USING (session_id) LEFT JOIN ta USING (session_id) LEFT JOIN tb USING (session_id)""")
def w11_synchronised(spark, d):
    p = view(spark, d, "position")
    on = (F.col("sync_led") > 7.5) & (F.col("x_px") >= 360)
    late = F.col("pos_idx") + 70 + 13 * F.col("session_id")
    a = p.select("session_id", "pos_idx", (F.col("pos_idx") / 30.0).alias("t"), F.when(on, 5.0).otherwise(0.0).alias("level"))
    b = p.select("session_id", late.alias("pos_idx"), (late / 30.0).alias("t"), F.when(on, 20.0).otherwise((F.col("y_px") % 1).cast("double")).alias("level"))
    out = R.synchronised(a, b, SESSION, "pos_idx", "t", "level", skip=1.0)
    return out.groupBy("session_id", "lag", "ok").agg(F.round(F.first("coarse"), 6).alias("coarse"), F.round(F.first("fine"), 6).alias("fine")).select("session_id", "lag", "coarse", "fine", "ok")


@query("""+ pu AS (SELECT DISTINCT session_id, pulse FROM pulses ), s AS (SELECT session_id, cluster_id, t_sample AS t FROM spikes ), ar AS (SELECT s.session_id, s.cluster_id, pulse, t - pulse AS o FROM s JOIN pu ON s.session_id = pu.session_id AND t >= pulse - 90000 AND t < pulse + 90000),
 who AS (SELECT DISTINCT session_id, cluster_id FROM ar), tr AS (SELECT who.*, pulse FROM who JOIN pu USING (session_id)),
 n AS (SELECT tr.session_id, tr.cluster_id, tr.pulse, count(*) FILTER (o >= -18000 AND o < 0) AS before, count(*) FILTER (o >= 0 AND o < 18000) AS after FROM tr LEFT JOIN ar USING (session_id, cluster_id, pulse) GROUP BY ALL),
 v AS (SELECT session_id, cluster_id, 0 AS side, before AS v FROM n UNION ALL SELECT session_id, cluster_id, 1, after FROM n), c AS (SELECT session_id, cluster_id, v, count(*) FILTER (side = 0) AS a, count(*) AS t FROM v GROUP BY ALL),
 k AS (SELECT *, coalesce(sum(t) OVER (PARTITION BY session_id, cluster_id ORDER BY v ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + (t + 1) / 2 AS rank FROM c),
 r AS (SELECT session_id, cluster_id, sum(a * rank) - CAST(sum(a) AS DOUBLE) * (sum(a) + 1) / 2 AS u, CAST(sum(a) AS DOUBLE) AS n, sum(CAST(t AS DOUBLE) * t * t - t) AS ties FROM k GROUP BY ALL), su AS (SELECT session_id, cluster_id, CAST(sum(before) AS BIGINT) AS before, CAST(sum(after) AS BIGINT) AS after FROM n GROUP BY ALL)
 SELECT session_id, cluster_id, before, after, round(CASE WHEN after < before THEN u END, 3) AS u, round(CASE WHEN after < before THEN greatest(0, abs(u - n * n / 2) - 0.5) / sqrt(n * n / 12 * (2 * n + 1 - ties / (2 * n * (2 * n - 1)))) END, 5) AS z FROM r JOIN su USING (session_id, cluster_id)""")
def c18_inhibition_u(spark, d):
    """Windows of 600 ms, since the spikes of these tables are sparse."""
    return inhibited(spark, d).select(*CELL, "before", "after", F.round("u", 3).alias("u"), F.round("z", 5).alias("z"))


def inhibited(spark, d, latency=None):
    return R.inhibition(view(spark, d, "spikes").select(*CELL, F.col("t_sample").alias("t")), view(spark, d, "pulses").distinct(), SESSION, CELL, latency, 600, 3000)


@query()
def c18_inhibition_p(spark, d):
    s = view(spark, d, "spikes").withColumnRenamed("t_sample", "t")
    latency = R.latency_test(s, view(spark, d, "pulses").distinct(), SESSION, CELL, 3000, 10)
    return inhibited(spark, d, latency).select(*CELL, "before", "after", "shift", F.round("u", 3).alias("u"), *r6("p"))


@query(LATENCY + """
 SELECT d.session_id, d.cluster_id, round(max(distance), 5) AS distance, round(max(distance) - median(d), 5) AS information, round(avg(CASE WHEN d >= distance THEN 1.0 ELSE 0.0 END), 6) AS p FROM d JOIN t ON d.session_id = t.session_id AND d.cluster_id = t.cluster_id WHERE wb < 10 GROUP BY 1, 2""")
def c17_latency_distances(spark, d):
    s = view(spark, d, "spikes").withColumnRenamed("t_sample", "t")
    out = R.latency_test(s, view(spark, d, "pulses").distinct(), SESSION, CELL, 3000, 10)
    return out.select(*CELL, F.round("distance", 5).alias("distance"), F.round("information", 5).alias("information"), *r6("p"))


BARS = SHIFTED + """, o20 AS (SELECT session_id, least(CAST(floor((hd + 180) / 18.0) AS BIGINT), 19) AS bin, count(*) AS o FROM position GROUP BY ALL), q20 AS (SELECT session_id, cluster_id, shuffle_id, least(CAST(floor((hd + 180) / 18.0) AS BIGINT), 19) AS bin, count(*) AS n FROM hit JOIN position USING (session_id, pos_idx) GROUP BY ALL),
 rs AS MATERIALIZED (SELECT w.session_id, w.cluster_id, w.shuffle_id, o20.bin, coalesce(n, 0) / o AS rate FROM (SELECT DISTINCT session_id, cluster_id, shuffle_id FROM o) w JOIN o20 USING (session_id) LEFT JOIN q20 USING (session_id, cluster_id, shuffle_id, bin)),
 own_ AS (SELECT s.session_id, cluster_id, CAST(round_even(t_sample / (dt * 30000.0::DOUBLE), 0) AS BIGINT) AS pos_idx FROM spikes s JOIN span ON s.session_id = span.session_id WHERE t_sample / 30000.0::DOUBLE < t_max), q0 AS (SELECT session_id, cluster_id, least(CAST(floor((hd + 180) / 18.0) AS BIGINT), 19) AS bin, count(*) AS n FROM own_ JOIN position USING (session_id, pos_idx) GROUP BY ALL),
 ro AS MATERIALIZED (SELECT w.session_id, w.cluster_id, o20.bin, coalesce(n, 0) / o AS rate FROM (SELECT DISTINCT session_id, cluster_id FROM spikes ) w JOIN o20 USING (session_id) LEFT JOIN q0 USING (session_id, cluster_id, bin)),
 po AS (SELECT ro.session_id, ro.cluster_id, ro.bin, (count(*) FILTER (rs.rate < ro.rate) + count(*) FILTER (rs.rate <= ro.rate)) / (2.0::DOUBLE * count(*)) AS f, max(ro.rate) < quantile_cont(rs.rate, 0.05) OR max(ro.rate) > quantile_cont(rs.rate, 0.95) AS outside FROM ro JOIN rs ON ro.session_id = rs.session_id AND ro.cluster_id = rs.cluster_id AND ro.bin = rs.bin GROUP BY ALL),
 p0 AS (SELECT session_id, cluster_id, bin, outside, least(1.0::DOUBLE, 2 * least(f, 1 - f)) AS p FROM po),
 ps AS (SELECT session_id, cluster_id, shuffle_id, bin, least(1.0::DOUBLE, 2 * least(f, 1 - f)) AS p FROM (SELECT a.session_id, a.cluster_id, a.shuffle_id, a.bin, (count(*) FILTER (b.rate < a.rate) + count(*) FILTER (b.rate <= a.rate)) / (2.0::DOUBLE * count(*)) AS f FROM rs a JOIN rs b ON a.session_id = b.session_id AND a.cluster_id = b.cluster_id AND a.bin = b.bin AND a.shuffle_id <> b.shuffle_id GROUP BY ALL) x),
 al AS (SELECT session_id, cluster_id, -1 AS shuffle_id, bin, p FROM p0 UNION ALL SELECT * FROM ps), rk AS (SELECT *, row_number() OVER (PARTITION BY session_id, cluster_id, shuffle_id ORDER BY p, bin) AS k, count(*) OVER (PARTITION BY session_id, cluster_id, shuffle_id) AS m FROM al),
 ad AS (SELECT session_id, cluster_id, shuffle_id, min(p * m / k) OVER (PARTITION BY session_id, cluster_id, shuffle_id ORDER BY p, bin ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS bh, max(p * (m - k + 1)) OVER (PARTITION BY session_id, cluster_id, shuffle_id ORDER BY p, bin ROWS UNBOUNDED PRECEDING) AS holm FROM rk),
 sg AS MATERIALIZED (SELECT session_id, cluster_id, shuffle_id, count(*) FILTER (bh < 0.05) AS n_bh, count(*) FILTER (holm < 0.05) AS n_holm FROM ad GROUP BY ALL)"""


def bars(spark, d):
    """Direction bars of 18 degrees of the cells and of 100 shuffles."""
    p = view(spark, d, "position").withColumn("bin", F.least(F.floor((F.col("hd") + 180) / 18.0), F.lit(19)))
    return H.shuffled_rates(view(spark, d, "spikes").withColumnRenamed("t_sample", "t"), p, 100, 5000000, 600000, SESSION, CELL, "bin", 20)


@query(BARS + " SELECT session_id, cluster_id, n_bh, n_holm, CAST((SELECT count(*) FROM p0 WHERE p0.session_id = sg.session_id AND p0.cluster_id = sg.cluster_id AND outside) AS BIGINT) AS n_outside FROM sg WHERE shuffle_id = -1")
def r7_significant_bars(spark, d):
    return Q.bar_tests(bars(spark, d), CELL, shuffles=False).select(*CELL, "n_bh", "n_holm", "n_outside")


@query(BARS + " SELECT * FROM sg WHERE shuffle_id >= 0")
def r8_shuffled_significant_bars(spark, d):
    return Q.bar_tests(bars(spark, d), CELL).where("shuffle_id >= 0").select(*CELL, "shuffle_id", "n_bh", "n_holm")


@query(BARS + ", dr AS (SELECT a.session_id, a.cluster_id, max(a.n_bh) AS n_bh, 50.0 * (count(*) FILTER (b.n_bh < a.n_bh) + count(*) FILTER (b.n_bh <= a.n_bh)) / count(*) AS percentile FROM sg a JOIN sg b ON a.session_id = b.session_id AND a.cluster_id = b.cluster_id WHERE a.shuffle_id = -1 AND b.shuffle_id >= 0 GROUP BY 1, 2) SELECT session_id, cluster_id, n_bh, round(percentile, 4) AS percentile, percentile > 95 AS directional FROM dr")
def r9_directional_bars(spark, d):
    out = Q.directional_tests(Q.bar_tests(bars(spark, d), CELL), CELL)
    return out.select(*CELL, "n_bh", F.round("percentile", 4).alias("percentile"), "directional")


#: Rates by trial and bin smoothed over bins, with zeros outside the track; bins that a trial has no time in are left out.
TRACK = RATES + f""", {weights(1.0)}, top_ AS (SELECT session_id, cluster_id, trial, max(bin) + 1 AS n FROM rates GROUP BY ALL),
 sm AS (SELECT p.session_id, p.cluster_id, p.trial, p.bin, sum(w * coalesce(q.rate, 0)) / sum(CASE WHEN p.bin + d < 0 OR p.bin + d >= t.n OR q.rate IS NOT NULL THEN w END) AS rate FROM rates p JOIN top_ t USING (session_id, cluster_id, trial) CROSS JOIN k LEFT JOIN rates q ON q.session_id = p.session_id AND q.cluster_id = p.cluster_id AND q.trial = p.trial AND q.bin = p.bin + d GROUP BY ALL)"""


def smoothed_rates(spark, d):
    out = B.smoothed(trial_rates(spark, d), [*CELL, "trial"], "bin", "rate", 1.0, "zero")
    return out.withColumn("rate", F.col("smooth")).drop("smooth")


@query(TRACK + " SELECT session_id, cluster_id, trial, bin, round(rate, 5) AS rate FROM sm")
def a12_smoothed_trial_rates(spark, d):
    return smoothed_rates(spark, d).select(*CELL, "trial", "bin", F.round("rate", 5).alias("rate"))


@query(TRACK + " SELECT session_id, cluster_id, trial % 3 AS trial_type, bin, round(avg(rate), 5) AS rate, round(stddev_samp(rate) / sqrt(count(rate)), 5) AS sem FROM sm GROUP BY 1, 2, 3, 4")
def a13_smoothed_track_maps(spark, d):
    r = smoothed_rates(spark, d).groupBy(*CELL, (F.col("trial") % 3).alias("trial_type"), "bin")
    return r.agg(F.round(F.avg("rate"), 5).alias("rate"), F.round(F.stddev_samp("rate") / F.sqrt(F.count("rate")), 5).alias("sem"))


@query(f"""+ {weights(2.0)}, sp_ AS (SELECT session_id, pos_idx, x_px, sqrt(pow(x_px - lag(x_px) OVER w, 2) + pow(y_px - lag(y_px) OVER w, 2)) AS v FROM position WINDOW w AS (PARTITION BY session_id ORDER BY pos_idx)), b_ AS (SELECT session_id, pos_idx // 8 AS bin, avg(x_px) AS x_px, avg(v) AS speed FROM sp_ GROUP BY 1, 2), n_ AS (SELECT session_id, max(bin) + 1 AS n FROM b_ GROUP BY 1),
 c_ AS (SELECT session_id, cluster_id, t_sample // 8000 AS bin, count(*) AS c FROM places GROUP BY ALL), g_ AS (SELECT w.session_id, w.cluster_id, b_.bin, b_.x_px, speed, coalesce(c, 0) AS c FROM (SELECT DISTINCT session_id, cluster_id FROM c_) w JOIN b_ ON b_.session_id = w.session_id LEFT JOIN c_ ON c_.session_id = w.session_id AND c_.cluster_id = w.cluster_id AND c_.bin = b_.bin)
 SELECT p.session_id, p.cluster_id, p.bin, max(p.c) AS n, round(max(p.x_px), 5) AS x_px, round(max(p.speed), 5) AS speed, round(sum(w * q.c) / sum(w), 5) AS smooth FROM g_ p JOIN n_ ON n_.session_id = p.session_id, k JOIN g_ q ON q.session_id = p.session_id AND q.cluster_id = p.cluster_id AND q.bin = {MIRROR.format('p.bin + d')} GROUP BY 1, 2, 3""")
def a18_smoothed_counts_in_time(spark, d):
    """Spikes, mean place and mean speed in bins of 8 samples (some 250 ms), and the smoothed spikes."""
    bins = moving(spark, d).groupBy("session_id", F.floor(F.col("pos_idx") / 8).alias("bin")).agg(F.avg("x_px").alias("x_px"), F.avg("speed").alias("speed"))
    n = view(spark, d, "places").groupBy(*CELL, F.floor(F.col("t_sample") / 8000).alias("bin")).agg(F.count("*").alias("n"))
    grid = n.select(*CELL).distinct().join(bins, SESSION).join(n, [*CELL, "bin"], "left").na.fill(0, ["n"])
    return B.smoothed(grid, CELL, "bin", "n", 2.0).select(*CELL, "bin", "n", *(F.round(c, 5).alias(c) for c in ("x_px", "speed", "smooth")))


@query("""+ f AS (SELECT session_id, t_sample / 1000000.0::DOUBLE AS a, t_sample / 1000000.0::DOUBLE + value / 100 AS b FROM spikes), ex AS (SELECT session_id, 0.0::DOUBLE AS x, ceil(b) - floor(a) - 1 AS w FROM f UNION ALL SELECT session_id, a - floor(a), 1 FROM f UNION ALL SELECT session_id, b - floor(b), CASE WHEN b - floor(b) > 0 THEN -1 ELSE 0 END FROM f),
 br AS (SELECT session_id, x, sum(w) AS w FROM ex GROUP BY 1, 2), pc AS (SELECT session_id, x AS lo, coalesce(lead(x) OVER o, 1.0) AS hi, sum(w) OVER o AS w FROM br WINDOW o AS (PARTITION BY session_id ORDER BY x)),
 al AS (SELECT session_id, sum(w * (hi - lo)) AS total FROM pc GROUP BY 1), v AS (SELECT session_id, spike_idx, t_sample / 700000.0::DOUBLE - floor(t_sample / 700000.0::DOUBLE) AS x FROM spikes ),
 u AS (SELECT v.session_id, v.spike_idx, sum(w * greatest(0, least(hi, x) - lo)) / max(total) AS u FROM v JOIN pc ON pc.session_id = v.session_id AND lo <= x JOIN al ON al.session_id = v.session_id GROUP BY 1, 2),
 i AS (SELECT session_id, u, row_number() OVER (PARTITION BY session_id ORDER BY u) AS i, count(*) OVER (PARTITION BY session_id) AS n FROM u) SELECT session_id, round(max(i / n - u) + max(u - (i - 1) / n), 5) AS kuiper FROM i GROUP BY 1""")
def x8_kuiper_against_exposure(spark, d):
    s = view(spark, d, "spikes")
    pieces = G.folded(s.select("session_id", (F.col("t_sample") / 1000000.0).alias("a"), F.lit(1.0).alias("w"), (F.col("t_sample") / 1000000.0 + F.col("value") / 100).alias("b")), SESSION, "a", "b", "w")
    values = G.exposure_share(s.select("session_id", "spike_idx", (F.col("t_sample") / 700000.0).alias("x")), pieces, SESSION, "x")
    return G.kuiper_one(values, SESSION, F.col("share")).select("session_id", F.round("kuiper", 5).alias("kuiper"))


@query()
def c28_matched_clusters(spark, d):
    """Clusters of the snippets of even and of odd number, which stand for two sessions."""
    s = view(spark, d, "waves").select(F.lit(1).alias("tetrode"), (F.col("snippet_id") % 2).cast("int").alias("day"), "cluster_id", "snippet_id", "embedding")
    pairs = s.select(F.lit(0).alias("a"), F.lit(1).alias("b")).limit(1)
    return V.matched_clusters(s, pairs, ["tetrode"], "day", "cluster_id", "snippet_id", "embedding").select("cluster_a", "cluster_b", F.round("distance", 4).alias("distance"))
