"""Canonical tables as views over the driver's tables, in Spark and in SQL with the same arithmetic.

Sessions keep their size and grow in number with the tables: some 6000 positions, 400 events that are spikes, and 60 cells each.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A position's session, as it stands in the views.
NUMBER = "CAST(floor(l_suppkey / 10) AS BIGINT)"
POSITION = """
  SELECT session_id, pos_idx, pos_idx / 30.0D0 AS synced_time, x_px, y_px, hd, sync_led FROM (
    SELECT CAST(floor(l_suppkey / 10) AS BIGINT) AS session_id,
           row_number() OVER (PARTITION BY CAST(floor(l_suppkey / 10) AS BIGINT) ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 AS pos_idx,
           l_quantity * 8 AS x_px, l_extendedprice % 400 AS y_px, l_extendedprice % 360 - 180 AS hd, l_tax * 100 AS sync_led
    FROM lineitem) p"""
SPIKES = """
  SELECT CAST(floor(user_id / 15) AS BIGINT) AS session_id, user_id % 5 AS cluster_id, (event_id * 997) % 5000000 AS t_sample, event_id AS spike_idx, value
  FROM events WHERE event_type IN ('click', 'view')"""
PULSES = """
  SELECT CAST(floor(user_id / 15) AS BIGINT) AS session_id, (event_id * 997) % 5000000 AS pulse FROM events WHERE event_type = 'purchase'"""
TRACK = """
  SELECT CAST(floor(l_suppkey / 10) AS BIGINT) AS session_id, l_orderkey AS trial, l_linenumber AS sample, l_partkey AS part, l_quantity * 4 AS x, l_discount * 100 AS speed,
         CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS trial_type
  FROM lineitem"""
CELLS = """
  SELECT c_custkey AS cluster_id, CAST(floor(c_custkey / 60) AS BIGINT) AS session_id, c_acctbal AS metric, c_acctbal / 10000 AS isolation, abs(c_acctbal) / 100000 AS noise_overlap,
         c_acctbal / 1000 AS peak_snr, CAST(c_custkey % 7 AS DOUBLE) AS mean_firing_rate, c_mktsegment AS grp
  FROM customer"""
WAVES = """
  SELECT vec_id AS snippet_id, label AS cluster_id, embedding FROM embeddings"""
#: Cells 0 to 3 fire around a place of their own, cell 4 on a hexagonal grid of 120 pixels.
PLACES = f"""
  SELECT session_id, cluster_id, pos_idx, pos_idx * 1000 AS t_sample, synced_time, x_px, y_px, hd FROM ({POSITION}
  ) q, (SELECT 0 AS cluster_id UNION ALL SELECT 1 UNION ALL SELECT 2 UNION ALL SELECT 3 UNION ALL SELECT 4) c
  WHERE CASE WHEN cluster_id < 4 THEN (x_px - 110 - 60 * cluster_id) * (x_px - 110 - 60 * cluster_id) + (y_px - 280 + 50 * cluster_id) * (y_px - 280 + 50 * cluster_id) < 3600
        ELSE cos((x_px - 200) * 0.06045997880780726D0) + cos((x_px - 200) * 0.03022998940390363D0 + (y_px - 200) * 0.05235987755982988D0) + cos((x_px - 200) * 0.03022998940390363D0 - (y_px - 200) * 0.05235987755982988D0) > 1.2 END
     OR pos_idx % 61 = cluster_id * 7"""
#: One sample of a channel for each line of an order: price steps stand for a signal.
SIGNAL = """
  SELECT session_id, CAST(1 AS INT) + CAST(pos_idx % 2 AS INT) AS channel, CAST(floor(pos_idx / 2) AS BIGINT) AS t, y_px AS value, sync_led AS speed FROM (""" + POSITION + """) q"""
VIEWS = {"places": PLACES, "signal": SIGNAL, "position": POSITION, "spikes": SPIKES, "pulses": PULSES, "track": TRACK, "cells": CELLS, "waves": WAVES}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    sql = re.sub(r"(\d\.\d+)D0", r"\1D", VIEWS[name])
    source = "lineitem" if name in ("position", "places", "signal") else sql.rsplit("FROM", 1)[1].split()[0].strip("()")
    src = spark.read.parquet(f"{sf_dir}/{source}.parquet")
    if name in ("position", "places", "signal"):
        # the session as a column of the source: a shuffle for the numbering is then known to be by session, and what follows by session needs no other
        src, sql = src.withColumn("session_id", F.expr(NUMBER)), sql.replace(f"{NUMBER} AS session_id", "session_id").replace(NUMBER, "session_id")
    return spark.sql(sql.replace(f"FROM {source}", "FROM {src}"), src=src)


def with_views(body: str) -> str:
    """SQL that starts with the views its body names."""
    used = [n for n in VIEWS if f" {n} " in f" {body} ".replace("\n", " ").replace(")", " ").replace(",", " ")]
    ctes = re.sub(r"(\d\.\d+)D0", r"\1::DOUBLE", ", ".join(f"{n} AS ({VIEWS[n]})" for n in used))
    # recursive expressions name their columns; elsewhere the keyword would tie the types of all unions to their first part
    recursive = "RECURSIVE " if re.search(r"\b\w+\(\w+(, \w+)*\) AS \(SELECT", body) else ""
    return f"WITH {recursive}{ctes}{', ' if body.lstrip().startswith('+') else ' '}{body.lstrip().lstrip('+')}"
