"""Sketches, samples and event-time windows; batch forms have an oracle, stateful ones are compared in the tests."""

from __future__ import annotations

from pyspark.sql import functions as F

from tarnfold import sources as S
from tarnfold import streaming as T
from tarnfold.functions import universal_hash
from tarnfold.operators import mining as M
from tarnfold.plans.registry import query

FM_GROUPS = [[(7, 13), (11, 29), (23, 5)], [(31, 17), (43, 3), (59, 41)], [(61, 19), (73, 37), (97, 53)]]
BLOOM = [(101, 7), (211, 13), (307, 29)]
BITS = 69_997


@query("SELECT event_id // 100 AS batch, count(DISTINCT user_id) AS n_users, count(*) AS n FROM events GROUP BY 1")
def tumbling_exact_distinct(spark, sf):
    e = S.table(spark, sf, "events")
    return e.groupBy(F.expr("event_id div 100").alias("batch")).agg(F.countDistinct("user_id").alias("n_users"), F.count(F.lit(1)).alias("n"))


def _fm_sql() -> str:
    maps = ", ".join(f"bit_or(1 << (9 - length(bin((user_id * {a} + {b}) % 512)))) AS m{g}_{h}" for g, group in enumerate(FM_GROUPS) for h, (a, b) in enumerate(group))
    est = lambda c: "power(2.0, list_position(list_transform(range(0, 10), lambda i: (" + c + " & (1 << i)) = 0), true) - 1) / 0.77351"
    medians = " + ".join(f"list_sort([{', '.join(est(f'm{g}_{h}') for h in range(3))}])[2]" for g in range(3))
    return f"WITH m AS (SELECT event_id // 300 AS batch, count(DISTINCT user_id) AS truth, {maps} FROM events GROUP BY 1) SELECT batch, truth, round(({medians}) / 3, 4) AS estimate FROM m"


@query(_fm_sql())
def fm_estimate(spark, sf):
    e = S.table(spark, sf, "events")
    batch = F.expr("event_id div 300")
    made = M.distinct_estimate(e, batch, "user_id", FM_GROUPS)
    truth = e.groupBy(batch.alias("key")).agg(F.countDistinct("user_id").alias("truth"))
    return made.join(truth, "key").select(F.col("key").alias("batch"), "truth", F.round("estimate", 4).alias("estimate"))


@query(f"""WITH seen AS (SELECT user_id AS v, min(event_id) AS first FROM events GROUP BY 1), spots AS (SELECT DISTINCT v, first, unnest([{", ".join(f"({a} * v + {b}) % {BITS}" for a, b in BLOOM)}]) AS spot FROM seen),
since AS (SELECT v, first, min(first) OVER (PARTITION BY spot) AS since FROM spots), f AS (SELECT v, first, max(CASE WHEN since < first THEN 0 ELSE 1 END) AS fresh FROM since GROUP BY 1, 2)
SELECT first // 100 AS batch, count(*) AS n_new, sum(1 - fresh)::BIGINT AS n_false, round(sum(1 - fresh) / count(*), 6) AS rate FROM f GROUP BY 1""")
def bloom_fpr(spark, sf):
    r = M.bloom_rates(S.table(spark, sf, "events"), "event_id", "user_id", 100, BITS, BLOOM)
    return r.select("batch", "n_new", "n_false", F.round("rate", 6).alias("rate"))


@query("SELECT event_type, user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY (event_id * 2654435761 + 12345) % 4294967291, event_id) AS i FROM events) WHERE i <= 100")
def bottomk_sample(spark, sf):
    e = S.table(spark, sf, "events").select("event_type", "user_id", "event_id")
    return M.bottom_k(e, ["event_type"], F.struct(universal_hash(F.col("event_id"), 2654435761, 12345, 4294967291), "event_id"), 100)


@query("SELECT event_id, user_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM events) WHERE i = 1")
def first_seen(spark, sf):
    return S.table(spark, sf, "events").groupBy("user_id").agg(F.min("event_id").alias("event_id")).select("event_id", "user_id")


@query("""WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS starts FROM events), s AS (SELECT *, sum(starts) OVER (PARTITION BY user_id ORDER BY ts) AS session FROM g)
SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS "end", count(*) AS n, round(sum(value), 4) AS total FROM s GROUP BY user_id, session""")
def session_windows(spark, sf):
    return T.sessions(S.table(spark, sf, "events"), "30 minutes", ["user_id"]).withColumn("total", F.round("total", 4))


@query("WITH w AS (SELECT unnest([time_bucket(INTERVAL 1 HOUR, ts, TIMESTAMP '2024-01-01'), time_bucket(INTERVAL 1 HOUR, ts, TIMESTAMP '2024-01-01') - INTERVAL 1 HOUR]) AS start, event_type, value FROM events) SELECT start, event_type, count(*) AS n, round(avg(value), 6) AS mean FROM w GROUP BY 1, 2")
def sliding_windows(spark, sf):
    return T.sliding(S.table(spark, sf, "events"), "2 hours", "1 hour", ["event_type"]).withColumn("mean", F.round("mean", 6))


@query("SELECT count(DISTINCT (user_id, event_type)) AS n FROM events")
def watermark_dedup(spark, sf):
    return T.unique_within(S.table(spark, sf, "events"), ["user_id", "event_type"]).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT user_id, count(*) AS n FROM events GROUP BY 1")
def stream_event_counts(spark, sf):
    """A stream drained in complete mode equals the batch sum, so SQL can check it."""
    e = T.events_stream(spark, sf).groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
    got = {}
    work = S.Workspace(spark, "stream")

    def keep(df, epoch):
        got["path"] = work.path(f"counts-{epoch}")
        df.write.mode("overwrite").parquet(got["path"])

    e.writeStream.outputMode("complete").foreachBatch(keep).option("checkpointLocation", work.path("log")).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema("user_id bigint, n bigint").parquet(got["path"])


@query("WITH w AS (SELECT unnest([time_bucket(INTERVAL 1 HOUR, ts, TIMESTAMP '2024-01-01'), time_bucket(INTERVAL 1 HOUR, ts, TIMESTAMP '2024-01-01') - INTERVAL 1 HOUR]) AS start, event_type, value FROM events) SELECT start, event_type, count(*) AS n, round(avg(value), 6) AS mean FROM w GROUP BY 1, 2 HAVING start + INTERVAL 2 HOUR <= (SELECT date_trunc('millisecond', max(ts)) - INTERVAL 10 MINUTE FROM events)")
def stream_windows(spark, sf):
    """Append mode: a window comes out once the watermark passes its end, so the last ones are withheld."""
    return T.drain(T.sliding(T.events_stream(spark, sf), "2 hours", "1 hour", ["event_type"]), S.Workspace(spark, "stream"), "windows").withColumn("mean", F.round("mean", 6))


@query()
def reservoir_stateful(spark, sf):
    return T.drain(T.reservoir_state(T.events_stream(spark, sf), "event_type", "user_id", every=100), S.Workspace(spark, "stream"), "reservoir")


@query(f"""WITH seen AS (SELECT event_type AS key, user_id AS v, min(event_id) AS first FROM events GROUP BY 1, 2), spots AS (SELECT DISTINCT key, v, first, unnest([{", ".join(f"({a} * v + {b}) % {BITS}" for a, b in BLOOM)}]) AS spot FROM seen),
since AS (SELECT key, v, first, min(first) OVER (PARTITION BY key, spot) AS since FROM spots), f AS (SELECT key, v, first, max(CASE WHEN since < first THEN 0 ELSE 1 END) AS fresh FROM since GROUP BY 1, 2, 3), e AS (SELECT event_type AS key, count(*) AS events FROM events GROUP BY 1)
SELECT key, any_value(events) AS events, count(*) AS new, sum(1 - fresh)::BIGINT AS taken_for_seen FROM f JOIN e USING (key) GROUP BY 1""")
def bloom_stateful(spark, sf):
    """The stream's filter by key; what is truly new comes from the drained events, beside the filter."""
    told = T.drain(T.bloom_state(T.events_stream(spark, sf), "event_type", "user_id", BITS, BLOOM), S.Workspace(spark, "stream"), "bloom")
    first = told.groupBy("key", "value").agg(F.min_by("taken_for_seen", "event_id").alias("taken"), F.count(F.lit(1)).alias("n"))
    return first.groupBy("key").agg(F.sum("n").alias("events"), F.count(F.lit(1)).alias("new"), F.sum(F.col("taken").cast("long")).alias("taken_for_seen"))


@query("WITH l AS (SELECT user_id, row_number() OVER (ORDER BY event_id) - 1 AS line, count(*) OVER () AS n FROM events) SELECT d.range AS draw, user_id AS value FROM range(3000) d JOIN l ON line = (((d.range + 1) * 2654435761 + 12345) % 4294967291) % n")
def stream_source_draws(spark, sf):
    """Thirty requests of a hundred users each, drawn with replacement."""
    return T.draws(S.table(spark, sf, "events"), "event_id", "user_id", spark.range(3000), S.Workspace(spark, "draws"))
