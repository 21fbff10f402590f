"""From forces to the next state."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def move(state: DataFrame, forces: DataFrame, max_force: float = 10.0, slow_down: float = 1.0, adjust_sizes: bool = False) -> DataFrame:
    """Clamps the force, weighs it by how much it swings against the last displacement, and moves the nodes.

    state.dx, dy are the last displacement, after speed. Convergence uses the unclamped force and stays as it is with sizes.
    """
    s = state.join(forces, "id", "left").withColumn("fx", F.coalesce("fx", F.lit(0.0))).withColumn("fy", F.coalesce("fy", F.lit(0.0)))
    s = s.withColumn("f2", F.col("fx") * F.col("fx") + F.col("fy") * F.col("fy"))
    f = F.sqrt("f2")
    scale = F.when(f > max_force, F.lit(float(max_force)) / f).otherwise(1.0)
    s = s.withColumn("k", scale).withColumn("nx", F.col("fx") * F.col("k")).withColumn("ny", F.col("fy") * F.col("k"))
    length = lambda a, b: F.sqrt(a * a + b * b)
    s = s.withColumn("swing", F.col("mass") * length(F.col("dx") - F.col("nx"), F.col("dy") - F.col("ny"))).withColumn("traction", length(F.col("dx") + F.col("nx"), F.col("dy") + F.col("ny")) / 2.0)
    s = s.withColumn("steady", 1.0 / (1.0 + F.sqrt("swing")))
    pace = (F.lit(0.1) if adjust_sizes else F.col("convergence")) * F.log(1.0 + F.col("traction")) * F.col("steady")
    s = s.withColumn("speed", pace)
    convergence = F.col("convergence") if adjust_sizes else F.least(F.lit(1.0), F.sqrt(F.col("speed") * F.col("f2") * F.col("steady")))
    s = s.withColumn("mx", F.col("nx") * (F.col("speed") / slow_down)).withColumn("my", F.col("ny") * (F.col("speed") / slow_down))
    return s.select("id", (F.col("x") + F.col("mx")).alias("x"), (F.col("y") + F.col("my")).alias("y"), "mass", "size", F.col("mx").alias("dx"), F.col("my").alias("dy"), convergence.alias("convergence"))
