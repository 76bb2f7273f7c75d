"""Rounding as Python's round() has it."""

import math
import random

import pytest
from pyspark.sql import functions as F

from orderly.functions.scalar import python_round


@pytest.mark.parametrize("places", [0, 1, 2, 3, 6])
def test_python_round(spark, places):
    rng = random.Random(places)
    values = [2.675, 0.125, 0.375, 2.5, 3.5, -2.5, 1.005, 1e15 + 0.3, 1e300, -0.0, 0.0, 5e-324, 0.5, 1.5, 0.0005, 8.345, 1e-7]
    values += [rng.uniform(-1000, 1000) for _ in range(3000)] + [k / 2**j for k in range(-200, 200) for j in (1, 3, 4)]
    values += [float(f"{rng.randint(0, 10**5)}.{rng.randint(0, 10**places):0{places + 1}d}5") for _ in range(3000)]  # look like halves
    rows = spark.createDataFrame([(v,) for v in [*values, None, math.nan, math.inf]], "v double").select("v", python_round(F.col("v"), places).alias("r")).collect()
    for row in rows:
        if row.v is None or not math.isfinite(row.v):
            assert row.r is None if row.v is None else math.isnan(row.r) == math.isnan(row.v)
        else:
            assert row.r == round(row.v, places), row.v
