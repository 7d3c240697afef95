"""Traffic at a junction."""

from __future__ import annotations

from pyspark.sql import functions as F

from tarnfold import sources as S
from tarnfold.operators import traffic
from tarnfold.plans.registry import query

_VALUES = ", ".join(f"({a}, {b}, {s})" for (a, b), s in traffic.TURNS.items())


@query(f"SELECT src, dst, frac::DOUBLE AS frac FROM (VALUES {_VALUES}) v(src, dst, frac)")
def traffic_turns(spark, sf):
    return S.read_rows(spark, [(a, b, s) for (a, b), s in traffic.TURNS.items()], "src int, dst int, frac double")


@query(f"""WITH v(src, dst, frac) AS (VALUES {_VALUES}), d AS (SELECT src, max(frac) AS hi FROM v GROUP BY 1), o AS (SELECT src, least(0.5 * (src / 32.0), min(0.25 / frac)) AS out FROM v GROUP BY 1)
SELECT dst AS road, round(sum(frac * out), 6) AS inflow FROM v JOIN o USING (src) GROUP BY 1""")
def traffic_step(spark, sf):
    """Inflow of each road behind a junction for densities road / 32, all lights green: limits, then sums over turns."""
    turns = S.read_rows(spark, [(a, b, s) for (a, b), s in traffic.TURNS.items()], "src int, dst int, frac double")
    out = turns.groupBy("src").agg(F.least(F.first(F.col("src") / 32.0 * traffic.SPEED), F.min(F.lit(traffic.SPEED * traffic.BEST) / F.col("frac"))).alias("out"))
    return turns.join(F.broadcast(out), "src").groupBy(F.col("dst").alias("road")).agg(F.round(F.sum(F.col("frac") * F.col("out")), 6).alias("inflow"))


@query()
def traffic_run(spark, sf):
    return traffic.simulate(spark.range(4).withColumnRenamed("id", "scenario"), steps=2000, every=100)
