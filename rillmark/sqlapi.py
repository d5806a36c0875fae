"""The sketches in SQL: functions of their hashes and estimates, and views of their rows.

``register_functions(spark)`` defines SQL functions (expressions that the optimiser inlines, no Python):

    SELECT sketch_register(h, 12) AS idx, max(sketch_rank(h, 12)) AS rho
    FROM (SELECT sketch_hash(CAST(user_id AS STRING)) AS h FROM events) GROUP BY idx

``register_views(sketch, "users")`` makes the view ``users`` of a sketch's rows, and views of its answers that need no
probes (``users_estimate``, ``users_stats``, ``users_totals``, ``users_sample``, ...).
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from rillmark.functions.bounds import Z_SCORES
from rillmark.operators.core import Sketch

FUNCTIONS = {
    "sketch_hash": ("item STRING", "BIGINT", "CAST(conv(substring(md5(CAST(item AS BINARY)), 1, 16), 16, -10) AS BIGINT)"),
    "sketch_hash_fast": ("item STRING", "BIGINT", "CASE WHEN item IS NOT NULL THEN xxhash64(item) END"),
    "sketch_register": ("h BIGINT, bits INT", "INT", "CAST(shiftrightunsigned(h, 64 - bits) AS INT)"),
    "sketch_rank": ("h BIGINT, bits INT", "INT", "CASE WHEN shiftleft(h, bits) < 0 THEN 1 WHEN shiftleft(h, bits) = 0 THEN 65 - bits ELSE 65 - length(bin(shiftleft(h, bits))) END"),
    "sketch_cell": ("item STRING, line INT, width BIGINT", "BIGINT", "CAST(conv(substring(md5(CAST(concat(CAST(line AS STRING), ':', item) AS BINARY)), 1, 15), 16, 10) AS BIGINT) % width"),
    "sketch_z_score": ("confidence DOUBLE", "DOUBLE", "CASE " + " ".join(f"WHEN confidence >= {level} THEN {z}D" for level, z in Z_SCORES) + " ELSE 1D END"),
    "sketch_precision_for_error": ("error DOUBLE", "INT", "CAST(least(greatest(ceil(log2(pow(1.04D / error, 2))), 4), 18) AS INT)"),
}
ANSWERS = ("estimate", "stats", "totals", "error_bound", "extremes", "num_centroids", "median", "sample", "sizes", "probability", "items_seen")


def register_functions(spark: SparkSession) -> list[str]:
    """Defines the functions for the session; their names."""
    for name, (arguments, kind, body) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({arguments}) RETURNS {kind} RETURN {body}")
    return [*FUNCTIONS]


def register_views(sketch: Sketch, name: str) -> list[str]:
    """Makes temporary views of the sketch's rows and of what it answers without probes; their names."""
    sketch.table.createOrReplaceTempView(name)
    made = [name]
    for answer in ANSWERS:
        method = getattr(sketch, answer, None)
        if method is None or answer == "estimate" and hasattr(sketch, "exceeding"):  # frequencies need probes
            continue
        method().createOrReplaceTempView(f"{name}_{answer}")
        made.append(f"{name}_{answer}")
    return made
