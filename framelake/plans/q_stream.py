"""Queries of scripts, relational extensions and event windows (batch form of the streams)."""

from __future__ import annotations

from pyspark.sql import functions as F

from framelake.plans import script, views
from framelake.plans.registry import query
from framelake.streaming import incremental

PX = views.PX


@query("running_stack", f"WITH {PX} SELECT x, y, c, round(avg(v), 9) AS v, count(*) AS n FROM px WHERE v <> 0 GROUP BY x, y, c")
def running_stack(spark, d):
    return incremental.running_stack(views.px(spark, d)).withColumn("v", F.round("v", 9))


@query("event_windows", """SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, time_bucket(INTERVAL 1 HOUR, ts) + INTERVAL 1 HOUR AS stop, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY 1, 2, 3""")
def event_windows(spark, d):
    return incremental.windowed(views.table(spark, d, "events")).withColumn("total", F.round("total", 6))


@query("event_sessions", """WITH e AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS first FROM events),
s AS (SELECT *, sum(first) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM e)
SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS stop, count(*) AS n, round(sum(value), 6) AS total FROM s GROUP BY user_id, k""")
def event_sessions(spark, d):
    return incremental.sessions(views.table(spark, d, "events")).withColumn("total", F.round("total", 6))


SCRIPT = """
# stack the frames, stretch the result
set low 0.45
stack lights --method=median -nonorm --out=result
thresh ${low} 0.6
neg
offset 0.1
fmul 0.5
mirrory
crop 1 1 6 6
"""


@query("script_stack", f"""WITH {PX}, m AS (SELECT x, y, median(nullif(v, 0)) AS v FROM px GROUP BY x, y),
t AS (SELECT 7 - x AS x, y, (1 - CASE WHEN v < 0.45::DOUBLE THEN 0.0::DOUBLE WHEN v > 0.6::DOUBLE THEN 1.0::DOUBLE ELSE v END + 0.1::DOUBLE) * 0.5::DOUBLE AS v FROM m)
SELECT x - 1 AS x, y - 1 AS y, round(v, 9) AS v FROM t WHERE x BETWEEN 1 AND 6 AND y BETWEEN 1 AND 6""")
def script_stack(spark, d):
    s = script.Session(spark)
    s.sequences["lights"] = views.px(spark, d).drop("label")
    return script.run(SCRIPT, s).current.select("x", "y", F.round("v", 9).alias("v"))


@query("script_pixelmath", f"""WITH {PX}, a AS (SELECT x, y, v FROM px WHERE frame_id = 0), b AS (SELECT x, y, v FROM px WHERE frame_id = 1)
SELECT x, y, round(1 - (1 - a.v * 0.5::DOUBLE) * (1 - b.v), 9) AS v FROM a JOIN b USING (x, y)""")
def script_pixelmath(spark, d):
    s = script.Session(spark)
    for k, name in enumerate(("first", "second")):
        s.sequences[name] = views.px(spark, d).where(F.col("frame_id") == k).drop("label")
    return script.run('pm "~((~($first$ * 0.5)) * ~$second$)"', s).current.select("x", "y", F.round("v", 9).alias("v"))


@query("script_linear_match")
def script_linear_match(spark, d):
    s = script.Session(spark)
    for k, name in enumerate(("first", "second")):
        s.sequences[name] = views.px(spark, d).where(F.col("frame_id") == k).drop("label")
    return script.run("linear_match first second", s).current.select("x", "y", F.round("v", 9).alias("v"))


# ---- relational operations that come with the platform ----

@query("delta_pixels", f"WITH {PX}, s AS (SELECT label, x, y, round(avg(v), 6) AS v FROM px GROUP BY 1, 2, 3) SELECT x, y, v FROM s WHERE label = 1 EXCEPT SELECT x, y, v FROM s WHERE label = 2")
def delta_pixels(spark, d):
    s = views.px(spark, d).groupBy("label", "x", "y").agg(F.round(F.avg("v"), 6).alias("v"))
    return s.where("label = 1").select("x", "y", "v").exceptAll(s.where("label = 2").select("x", "y", "v"))


@query("frame_cube", f"WITH {PX} SELECT label, y, count(*) AS n, round(avg(v), 9) AS v FROM px GROUP BY CUBE (label, y)")
def frame_cube(spark, d):
    return views.px(spark, d).cube("label", "y").agg(F.count("*").alias("n"), F.round(F.avg("v"), 9).alias("v"))


@query("asof_events", """WITH p AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'purchase'), v AS (SELECT user_id, ts, max(event_id) AS id FROM events WHERE event_type = 'view' GROUP BY 1, 2)
SELECT p.event_id, v.id AS view_id FROM p ASOF LEFT JOIN v ON p.user_id = v.user_id AND p.ts >= v.ts""")
def asof_events(spark, d):
    """The last view at or before each purchase of a user: one union and one window, no range join."""
    from pyspark.sql import Window

    e = views.table(spark, d, "events").where("event_type IN ('purchase', 'view')")
    w = Window.partitionBy("user_id").orderBy("ts", F.col("event_type").desc(), "event_id").rowsBetween(Window.unboundedPreceding, 0)
    last = F.last(F.when(F.col("event_type") == "view", F.col("event_id")), ignorenulls=True).over(w)
    return e.withColumn("view_id", last).where("event_type = 'purchase'").select("event_id", "view_id")
