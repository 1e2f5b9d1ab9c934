"""The scalars as SQL functions, and signal framing as a table function."""

from __future__ import annotations

from pyspark.sql import SparkSession

# Temporary SQL functions over built-ins: they are inlined by the analyzer, no Python runs.
SQL_FUNCTIONS = {
    "mean_square": (
        "x ARRAY<FLOAT>",
        "DOUBLE",
        "CASE WHEN size(x) > 0 THEN aggregate(x, 0D, (a, v) -> a + double(v) * double(v)) / size(x) END",
    ),
    "rms_db": ("x ARRAY<FLOAT>", "DOUBLE", "20D * log10(sqrt(mean_square(x) + 1e-8D))"),
    "rms_amp": ("x ARRAY<FLOAT>", "DOUBLE", "sqrt(mean_square(x))"),
    "loudness_gap_db": (
        "p ARRAY<FLOAT>, r ARRAY<FLOAT>",
        "DOUBLE",
        "pow(greatest(rms_db(p), -80D) - greatest(rms_db(r), -80D), 2D)",
    ),
    "md5_uniform": (
        "seed INT, k STRING",
        "DOUBLE",
        "double(conv(substr(md5(concat_ws(':', string(seed), k)), 1, 8), 16, 10)) / 4294967296D",
    ),
    "sample_key": ("n BIGINT", "STRING", "format_string('%08d', n)"),
}


# One row per complete or partial frame of a signal with its root mean square; nothing for a missing or empty one.
SIGNAL_FRAMES = """
CREATE OR REPLACE TEMPORARY FUNCTION signal_frames(x ARRAY<FLOAT>, frame INT)
RETURNS TABLE (frame_idx INT, rms DOUBLE)
RETURN SELECT f.i, rms_amp(slice(x, f.i * frame + 1, frame))
FROM (SELECT explode(CASE WHEN size(x) > 0 THEN sequence(0, int((size(x) - 1) DIV frame)) END) AS i) f
"""


def register(spark: SparkSession) -> None:
    """Make the functions known to ``spark.sql``."""
    for name, (arguments, returns, body) in SQL_FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({arguments}) RETURNS {returns} RETURN {body}")
    spark.sql(SIGNAL_FRAMES)
