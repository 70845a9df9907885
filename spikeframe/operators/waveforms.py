"""Waveform snippets, their shape and their principal components."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


#: Times of a chunk of samples that snippets meet at once.
CHUNK = 64


def snippets(spikes: DataFrame, samples: DataFrame, session_keys, before: int = 10, after: int = 19) -> DataFrame:
    """Each spike (session_keys, tetrode, spike_idx, t) on the four channels of its tetrode: waveform, the samples from t - before to t + after in order.

    samples: session_keys, channel (from 1), t, value. Channels without samples (dead ones) and missing samples count as 0. Samples come in chunks of time that reach as far beyond their
    ends as a snippet, so a spike's channel is one row that meets one chunk.
    """
    span = before + after + 1
    wanted = spikes.withColumn("channel", F.explode(F.sequence((F.col("tetrode") - 1) * 4 + 1, F.col("tetrode") * 4))).withColumn("__c", F.floor(F.col("t") / CHUNK))
    chunks = F.sequence(F.floor((F.col("t") - after) / CHUNK), F.floor((F.col("t") + before) / CHUNK))
    held = samples.where("t is not null").select(*session_keys, "channel", F.explode(chunks).alias("__c"), F.struct(F.col("t").cast("long").alias("t"), F.coalesce(F.col("value").cast("double"), F.lit(0.0)).alias("v")).alias("__s"))
    held = held.groupBy(*session_keys, "channel", "__c").agg(F.array_sort(F.collect_list("__s")).alias("__s"))
    held = held.withColumns({"__from": F.col("__s")[0]["t"], "__dense": F.size(F.array_distinct(F.transform("__s", lambda s: s["t"]))) == F.size("__s")})
    held = held.withColumn("__dense", F.col("__dense") & (F.element_at("__s", -1)["t"] - F.col("__from") + 1 == F.size("__s")))
    low, high = F.col("t") - before, F.col("t") + after
    first = F.greatest(low - F.col("__from"), F.lit(0)).cast("int")
    last = F.least(high - F.col("__from") + 1, F.size("__s").cast("long")).cast("int")
    near = F.when(F.col("__dense"), F.slice("__s", first + 1, F.greatest(last - first, F.lit(0)))).otherwise(F.filter("__s", lambda s: (s["t"] >= low) & (s["t"] <= high)))
    hit = wanted.join(held, [*session_keys, "channel", "__c"], "left").withColumn("__n", F.coalesce(near, F.array().cast("array<struct<t:bigint,v:double>>")))
    missing = F.array_except(F.sequence(low.cast("long"), high.cast("long")), F.transform("__n", lambda s: s["t"]))
    filled = F.array_sort(F.concat("__n", F.transform(missing, lambda t: F.struct(t.alias("t"), F.lit(0.0).alias("v")))))
    whole = F.when(F.col("__dense") & (F.size("__n") == span), F.col("__n")).otherwise(filled)
    keys = [c for c in spikes.columns if c != "t"]
    return hit.select(*keys, "channel", F.coalesce(F.transform(whole, lambda s: s["v"]), F.array_repeat(F.lit(0.0), span)).alias("waveform"))


def chosen_spikes(spikes: DataFrame, keys, order: list[str], n: int = 50, guard: int = 16) -> DataFrame:
    """n spikes of each cell that has n or more, drawn by a hash of the key without those within guard of its first and last; all spikes of other cells."""
    w = Window.partitionBy(*keys)
    df = spikes.withColumns({"__k": F.row_number().over(w.orderBy(*order)), "__n": F.count("*").over(w)})
    inner = F.col("__k").between(guard + 1, F.col("__n") - guard)
    draw = F.md5(F.concat_ws("-", *keys, F.col("__k").cast("string")))
    df = df.withColumn("__r", F.row_number().over(w.orderBy((~inner).cast("int"), draw)))
    return df.where((F.col("__n") < n) | (inner & (F.col("__r") <= n))).drop("__k", "__n", "__r")


def shape(samples: DataFrame, keys, pos: str, value: str) -> DataFrame:
    """(keys, peak_pos, trough_pos, peak_to_trough, half_width) of mean waveforms.

    The peak is the largest deflection, the trough the opposite extreme after it (null where the peak is last). The
    half width is the longest gap between two neighbouring crossings of half the peak's height.
    """
    mean = samples.groupBy(*keys, F.col(pos).alias("pos")).agg(F.avg(F.col(value).cast("double")).alias("v"))
    top = mean.groupBy(*keys).agg(F.max_by(F.struct("pos", "v"), F.struct(F.abs("v"), -F.col("pos"))).alias("__p"))
    df = mean.join(top, list(keys)).withColumn("u", F.col("v") * F.signum("__p.v"))  # upright
    after = F.col("pos") > F.col("__p.pos")
    trough = F.min_by(F.when(after, F.col("pos")), F.when(after, F.struct("u", "pos")))
    w = Window.partitionBy(*keys).orderBy("pos")
    side = F.when(F.col("u") >= F.abs("__p.v") / 2, 1).otherwise(-1)
    df = df.withColumn("__s", side).withColumn("__x", F.when(F.col("__s") != F.lag("__s").over(w), F.col("pos")))
    crossings = df.where("__x is not null").withColumn("__gap", F.col("pos") - F.lag("pos").over(w)).groupBy(*keys).agg(F.max("__gap").alias("half_width"))
    out = df.groupBy(*keys).agg(F.first("__p.pos").alias("peak_pos"), trough.alias("trough_pos"))
    return out.join(crossings, list(keys), "left").select(*keys, "peak_pos", "trough_pos", (F.col("trough_pos") - F.col("peak_pos")).alias("peak_to_trough"), "half_width")


def principal_components(df: DataFrame, keys, item: str, waveform: str, n: int = 2) -> DataFrame:
    """(keys, item, pc array) of standardised waveforms of a key: projections on the n largest components.

    Sums of products are made by batch and added, so only a dims by dims matrix of each key comes together. A component's largest loading is
    positive; constant samples get 0; keys of one waveform get zeros. Waveforms of a key must have one length.
    """
    key_of = F.to_json(F.struct(*keys))

    def sums(batches):
        for batch in batches:
            for k, g in batch.groupby("__k", sort=False):
                x = np.stack(g["__w"].to_numpy()).astype(float)
                x1 = np.concatenate([x, np.ones((len(x), 1))], 1)
                yield pd.DataFrame({"__k": [k], "__s": [(x1.T @ x1).ravel()]})

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.asarray(s) for s in pdf["__s"])
        d = int(np.sqrt(len(total)))
        total = total.reshape(d, d)
        count, mean = total[-1, -1], total[-1, :-1] / total[-1, -1]
        cov = total[:-1, :-1] / count - np.outer(mean, mean)
        sd = np.sqrt(np.maximum(np.diag(cov), 0))
        scale = np.where(sd > 1e-12 * np.maximum(1, np.abs(mean)), 1 / np.where(sd > 0, sd, 1), 0)
        _, vectors = np.linalg.eigh(cov * np.outer(scale, scale))
        top = vectors[:, ::-1][:, :n].T
        top = top * np.sign(top[np.arange(len(top)), np.abs(top).argmax(1)])[:, None]
        axes = top * scale
        return pd.DataFrame({"__k": [pdf["__k"].iloc[0]], "__axes": [axes.ravel().tolist()], "__zero": [(axes @ mean).tolist()]})

    rows = df.select(*keys, item, key_of.alias("__k"), F.transform(waveform, lambda v: v.cast("double")).alias("__w"))
    found = rows.select("__k", "__w").mapInPandas(sums, "__k string, __s array<double>").groupBy("__k").applyInPandas(add, "__k string, __axes array<double>, __zero array<double>")
    at = lambda i: F.aggregate(F.zip_with("__w", F.slice("__axes", i * F.size("__w") + 1, F.size("__w")), lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v) - F.get("__zero", F.lit(i))
    return rows.join(found, "__k").select(*keys, item, F.array(*(at(i) for i in range(n))).alias("pc"))


def matched_clusters(snippets: DataFrame, pairs: DataFrame, keys, session: str, cluster: str, item: str, waveform: str, n: int = 2) -> DataFrame:
    """(keys, a, b, cluster_a, cluster_b, distance): clusters of session a and of session b that are one, for the rows (a, b) of pairs.

    All sessions of a key (a tetrode) share one basis of principal components, and a cluster stands at the mean of its snippets. The nearest two clusters of both sessions
    are matched first, then the nearest of those left, and so on, so each is matched once at most and the order of the sessions doesn't matter; equal
    distances go by cluster. One key's clusters in two sessions are one group.
    """
    keys = list(keys)
    pc = principal_components(snippets.withColumn("__id", F.struct(session, cluster, item)), keys, "__id", waveform, n)
    place = pc.groupBy(*keys, F.col("__id")[session].alias("s"), F.col("__id")[cluster].alias("c")).agg(F.array(*(F.avg(F.col("pc")[i]) for i in range(n))).alias("at"))
    left = pairs.select("a", "b").join(place.select(*keys, F.col("s").alias("a"), F.col("c").alias("cluster_a"), F.col("at").alias("__u")), "a")
    both = left.join(place.select(*keys, F.col("s").alias("b"), F.col("c").alias("cluster_b"), F.col("at").alias("__v")), [*keys, "b"])
    apart = F.sqrt(F.aggregate(F.zip_with("__u", "__v", lambda u, v: (u - v) * (u - v)), F.lit(0.0), lambda s, v: s + v))
    near = both.select(*keys, "a", "b", "cluster_a", "cluster_b", apart.alias("distance"))

    def match(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.assign(__lo=pdf[["cluster_a", "cluster_b"]].min(axis=1), __hi=pdf[["cluster_a", "cluster_b"]].max(axis=1)).sort_values(["distance", "__lo", "__hi"], kind="stable")
        kept, taken_a, taken_b = [], set(), set()
        for i, (ca, cb) in enumerate(zip(pdf["cluster_a"], pdf["cluster_b"], strict=True)):
            if ca not in taken_a and cb not in taken_b:
                kept.append(i)
                taken_a.add(ca)
                taken_b.add(cb)
        return pdf.iloc[kept].drop(columns=["__lo", "__hi"])

    return near.groupBy(*keys, "a", "b").applyInPandas(match, near.schema)
