"""Small helpers to write fixtures as plain rows."""

from pyspark.sql import functions as F


def frame(spark, schema, rows):
    """Rows as a typed frame; columns declared ``time`` take text."""
    fields = [part.strip().rsplit(" ", 1) for part in schema.split(",")]
    raw = ", ".join(f"{n} {'string' if t == 'time' else t}" for n, t in fields)
    df = spark.createDataFrame([tuple(r) for r in rows], raw)
    return df.select(
        *[F.col(n).cast("timestamp_ntz").alias(n) if t == "time" else F.col(n) for n, t in fields]
    )


def records(df, *order):
    rows = [r.asDict() for r in df.collect()]
    return sorted(rows, key=lambda r: tuple(str(r[k]) for k in order)) if order else rows
