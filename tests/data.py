"""Small tables of the store for tests."""

from plausia import schema

DELTA = {"id": None, "dimension_id": "A.x", "entity": None, "attribute": None, "prior": None, "posterior": [("v", 1.0)], "surprise": 0.0, "evidence": None, "source": None, "source_reliability": 0.9, "ts": 1_750_000_000.0, "valid_time": None, "cascaded_from": None, "seq": None}


def deltas(spark, rows, **extra):
    full = [DELTA | {"seq": i} | r for i, r in enumerate(rows, 1)]
    df = spark.createDataFrame([tuple(r[c] for c in DELTA) for r in full], schema.DELTAS)
    from pyspark.sql import functions as F

    for name, value in extra.items():
        df = df.withColumn(name, F.lit(value))
    return df


def dimensions(spark, rows):
    return spark.createDataFrame([(i, None, None, d, t) for i, d, t in rows], schema.DIMENSIONS)


def got(df):
    return sorted(map(tuple, df.collect()), key=repr)
