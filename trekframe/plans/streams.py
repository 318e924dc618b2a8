"""Queries of the streaming operators: run once over what is there, then read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from trekframe.functions.timefn import as_timestamp, millis
from trekframe.sources import snapshots as SN
from trekframe.streaming import cards as CA
from trekframe.streaming import operators as O

from .base import query, read
from .sources_sinks import folder


def _once(spark, stream, mode: str):
    """Runs a stream over what is there, into files of the shared folder: in complete mode the last batch's, else all batches'."""
    out = folder(spark)
    where = (lambda n: f"{out}/rows") if mode == "complete" else (lambda n: f"{out}/rows/batch={n}")
    write = lambda batch, n: batch.write.mode("overwrite").parquet(where(n))
    stream.writeStream.outputMode(mode).option("checkpointLocation", f"{out}/checkpoint").foreachBatch(write).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{out}/rows").select(*stream.columns)


def _stream(spark, d, name: str):
    """One table's file as a stream."""
    return spark.readStream.schema(read(spark, d, name).schema).option("pathGlobFilter", f"*{name}.parquet" if not _is_folder(spark, d, name) else "*.parquet").parquet(d if not _is_folder(spark, d, name) else f"{d}/{name}.parquet")


def _is_folder(spark, d, name: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{d}/{name}.parquet")
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(p).isDirectory()


@query("stream_tumbling_windows", "SELECT epoch_ms(time_bucket(INTERVAL 1 HOUR, ts)) AS start_ms, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def tumbling(spark, d):
    e = _stream(spark, d, "events").withColumn("ts", as_timestamp(millis("ts")))
    return _once(spark, O.hourly(e), "complete").select(F.unix_millis("start").alias("start_ms"), "event_type", "n", F.round("total", 4).alias("total"))


@query("stream_sessions", "WITH f AS (SELECT user_id, epoch_us(ts) AS t, coalesce(epoch_us(ts) - lag(epoch_us(ts)) OVER w > 7200000000, true) AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT user_id, t, sum(CAST(new AS INT)) OVER (PARTITION BY user_id ORDER BY t) AS s FROM f) SELECT user_id, min(t) // 1000 AS start_ms, count(*) AS n FROM s GROUP BY user_id, s")
def stream_sessions(spark, d):
    e = _stream(spark, d, "events").withColumn("ts", F.timestamp_micros(millis("ts") * 1000 + F.pmod(F.floor(F.extract(F.lit("SECOND"), "ts") * 1_000_000), F.lit(1000)).cast("bigint")))
    return _once(spark, O.user_sessions(e), "complete").select("user_id", F.unix_millis("start").alias("start_ms"), "n")


def _frames(e):
    k = F.col("event_id")
    return e.select((F.col("user_id") % 20).alias("player"), k.alias("n"), ((k % 97) / 97).cast("double").alias("progress"), (k % 53).cast("bigint").alias("episode"), (40 + k % 7).cast("double").alias("lat"), F.lit(-74.0).alias("lng"), F.lit(False).alias("scrubbing"))


@query("stream_continuity", """WITH f AS (SELECT user_id % 20 AS player, event_id AS n, event_id % 97 AS p, event_id % 53 AS e, event_id % 7 AS y FROM events), l AS (SELECT *, lag(p) OVER w AS p0, lag(e) OVER w AS e0, lag(y) OVER w AS y0, max(e) OVER (PARTITION BY player ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top, row_number() OVER w AS r FROM f WINDOW w AS (PARTITION BY player ORDER BY n)),
  d AS (SELECT a.player, a.n, bool_or(b.e = a.e) AS again FROM l a JOIN l b ON a.player = b.player AND b.r < a.r - 1 AND b.e = a.e JOIN l c ON c.player = b.player AND c.r = b.r + 1 AND c.e > b.e GROUP BY a.player, a.n)
  SELECT l.player, count(*) AS frames, count(*) FILTER (p < p0) AS progress_back, count(*) FILTER (e < e0) AS episode_back, count(d.n) AS reactivated, count(*) FILTER (e >= e0 AND abs(y - y0) >= 2) AS jumps FROM l LEFT JOIN d ON d.player = l.player AND d.n = l.n GROUP BY l.player""")
def stream_continuity(spark, d):
    out = _once(spark, O.continuity(_frames(_stream(spark, d, "events"))), "update")
    return out.groupBy("player").agg(F.max_by(F.struct("frames", "progress_back", "episode_back", "reactivated", "jumps"), "frames").alias("c")).select("player", "c.*")


_ACTIONS = ["start", "pause", "speed", "seek", "resume"]
_CLOCK = """WITH RECURSIVE e AS (SELECT user_id AS player, event_id AS n, event_id / 10 AS at_s, ['start', 'pause', 'speed', 'seek', 'resume'][CAST(event_id % 5 AS INT) + 1] AS action, CASE WHEN event_id % 5 = 2 THEN 2.0::DOUBLE ELSE 0.25::DOUBLE END AS value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS r FROM events),
  g AS (SELECT player, n, r, at_s AS t, 0::DOUBLE AS q, CASE WHEN action = 'seek' THEN value ELSE 0 END::DOUBLE AS p, CASE WHEN action = 'speed' THEN value ELSE 1 END::DOUBLE AS speed, action IN ('start', 'resume') AS running FROM e WHERE r = 1
  UNION ALL SELECT x.player, x.n, x.r, x.at_s, x.q, CASE WHEN action = 'seek' THEN value ELSE x.q END, CASE WHEN action = 'speed' THEN value ELSE x.speed END, CASE WHEN x.q >= 1 THEN false WHEN action IN ('start', 'resume') THEN true WHEN action = 'pause' THEN false ELSE x.running END
    FROM (SELECT e.player, e.n, e.r, e.at_s, e.action, e.value, g.speed, g.running, least(1.0::DOUBLE, g.p + CASE WHEN g.running THEN (e.at_s - g.t) * g.speed / 600 ELSE 0 END) AS q FROM g JOIN e ON e.player = g.player AND e.r = g.r + 1) x)
  SELECT player, n, round(p, 6) AS progress FROM g"""


def _actions(e):
    k = F.col("event_id")
    action = F.element_at(F.array(*map(F.lit, _ACTIONS)), (k % 5 + 1).cast("int"))
    return e.select(F.col("user_id").alias("player"), k.alias("n"), (k / 10).alias("at_s"), action.alias("action"), F.when(k % 5 == 2, 2.0).otherwise(0.25).alias("value"))


@query("playback_clock", _CLOCK)
def playback_clock(spark, d):
    return O.clock(_actions(read(spark, d, "events")), 600.0).select("player", "n", F.round("progress", 6).alias("progress"))


@query("stream_clock", _CLOCK)
def stream_clock(spark, d):
    return _once(spark, O.clock_stream(_actions(_stream(spark, d, "events")), 600.0), "append").select("player", "n", F.round("progress", 6).alias("progress"))


@query("import_eta", "WITH t AS (SELECT user_id AS job, row_number() OVER w AS at_s, cume_dist() OVER w AS share FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) SELECT job, at_s::DOUBLE AS at_s, CASE WHEN share >= 0.12 AND at_s >= 4 THEN round(at_s * (1 - share) / share, 6) END AS eta_s FROM t")
def import_eta(spark, d):
    from pyspark.sql.window import Window

    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    t = read(spark, d, "events").select(F.col("user_id").alias("job"), F.row_number().over(w).cast("double").alias("at_s"), F.cume_dist().over(w).alias("share"))
    return O.eta(t).select("job", "at_s", F.round("eta_s", 6).alias("eta_s"))


def _changes(spark, d):
    """Orders as a stream of changes in three arrivals: first versions; corrections and deletions; rows that come too late."""
    k = F.col("o_orderkey")
    o = read(spark, d, "orders").select((F.col("o_custkey") % 200).alias("trip_id"), k.alias("id"), F.col("o_orderstatus").alias("name"), F.col("o_orderdate").cast("date").alias("day"))
    made = lambda v, gone=False: (F.lit(v).cast("bigint").alias("version"), F.lit(gone).alias("deleted"))
    arrivals = [
        o.where("id % 10 <> 7").select("*", *made(1)),
        o.where("id % 10 = 7 AND id % 4 <> 0").select("*", *made(2)).unionByName(o.where("id % 4 = 0").withColumn("name", F.lit("corrected")).select("*", *made(3))).unionByName(o.where("id % 9 = 0 AND id % 4 <> 0").select("*", *made(5, True))),
        o.where("trip_id % 10 = 3").withColumn("name", F.lit("late")).select("*", *made(0)),
    ]
    out = folder(spark)
    for rows in arrivals:
        rows.repartition(4).write.mode("append").parquet(out)
    return spark.readStream.schema(arrivals[0].schema).option("maxFilesPerTrigger", 4).parquet(out)


def _cards(rows):
    return rows.groupBy("trip_id").agg(F.count("*").alias("visits"), F.min("day").alias("first_day"), F.max("day").alias("last_day"), F.count_if(F.col("name") == "corrected").alias("corrected"), F.sum("id").alias("ids"))


@query("stream_trip_cards", """WITH o AS (SELECT o_custkey % 200 AS trip_id, o_orderkey AS id, CAST(o_orderdate AS DATE) AS day FROM orders)
  SELECT trip_id, count(*) AS visits, min(day) AS first_day, max(day) AS last_day, count(*) FILTER (id % 4 = 0) AS corrected, CAST(sum(id) AS BIGINT) AS ids FROM o WHERE id % 4 = 0 OR id % 9 <> 0 GROUP BY trip_id""")
def stream_cards(spark, d):
    """Cards kept by the stream, trip by trip, after corrected, deleted and late rows: those of the whole table."""
    store = SN.Snapshots(spark, folder(spark), buckets=8)
    CA.follow(_changes(spark, d), store, "visits", "cards", _cards, ["id"], f"{store.root}/checkpoint", deleted=F.col("deleted")).awaitTermination()
    return store.read("cards")
