"""C's %g as an expression, on ties, borders and random single-precision values."""

import math
import struct

import numpy as np
from pyspark.sql import functions as F

from locusframe.functions.exact import g_format
from locusframe.sources.sinks import g_text


def test_g_text(spark):
    rng = np.random.default_rng(4)
    bits = rng.integers(0, 2**32, 4000, dtype=np.uint32)
    values = [float(x) for x in bits.view(np.float32) if np.isfinite(x)]
    values += [float(np.float32(x)) for x in (rng.integers(0, 20_000_000, 3000) / 8).tolist()]  # many exact ties at the sixth digit
    values += [0.0, -0.0, 1.0, 100000.0, 999999.0, 999999.5, 1000000.0, 0.0001, 0.00009999995, 123456.5, 123457.5, 0.5, 1.5, 2.5, 1e-30, -2.25, 29.3, 0.1, 1234565.0, 0.000123456500000000001]
    values += [struct.unpack("<f", struct.pack("<f", 10.0**e))[0] for e in range(-30, 30)]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    got = df.select("x", g_text(F.col("x")).alias("g"), g_text(F.col("x").cast("float")).alias("f")).collect()
    assert [(r.x, r.g) for r in got if r.g != g_format(r.x)] == []
    odd = spark.createDataFrame([(math.nan,), (math.inf,), (-math.inf,), (None,)], "x double").select(g_text(F.col("x")).alias("g")).collect()
    assert [r.g for r in odd] == [None, "inf", "-inf", None]
    assert "ArrowEvalPython" not in df.select(g_text(F.col("x")))._jdf.queryExecution().toString()
