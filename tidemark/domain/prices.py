"""Price glitches: wrong units and spikes that come back."""

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

UNIT, UNIT_TOLERANCE = 100.0, 0.10
SPIKE, BACK, SPIKE_DAYS = 0.30, 0.15, 3


def unit_factors(df: DataFrame, key: str = "ticker", order: str = "date", value: str = "close") -> DataFrame:
    """df with unit_factor: what brings a value into the unit of the key's latest ones (1, 100 or 1/100).

    Each jump of about 100 to one flips the days before it; the factor of a day is the product of the flips after it, and 1
    where that product is none of the three.
    """
    w = Window.partitionBy(key).orderBy(order)
    r = F.try_divide(F.lead(value).over(w), F.col(value))
    good = (F.col(value) > 0) & (F.lead(value).over(w) > 0)
    flip = F.when(good & (F.abs(r / UNIT - 1) <= UNIT_TOLERANCE), 1).when(good & (F.abs(r * UNIT - 1) <= UNIT_TOLERANCE), -1).otherwise(0)
    out = df.withColumn("__flip", flip)
    power = F.sum("__flip").over(Window.partitionBy(key).orderBy(F.desc(order)).rowsBetween(Window.unboundedPreceding, 0))
    out = out.withColumn("__power", power)
    return out.withColumn("unit_factor", F.when(F.abs("__power") <= 1, F.pow(F.lit(UNIT), F.col("__power"))).otherwise(1.0)).drop("__flip", "__power")


def _spikes(values: list) -> list[bool]:
    n, out, at = len(values), [False] * len(values), 1
    fine = [v is not None and v == v and v > 0 for v in values]
    while at < n:
        step = 1
        if fine[at - 1] and fine[at] and abs(values[at] / values[at - 1] - 1) > SPIKE:
            level = values[at - 1]
            for back in range(at + 1, min(n, at + SPIKE_DAYS + 1)):
                if not fine[back]:
                    break
                off = abs(values[back] / level - 1)
                if off < BACK:
                    out[at:back] = [True] * (back - at)
                    step = back - at
                    break
                if off <= SPIKE:
                    break
        at += step
    return out


def spike_days(df: DataFrame, key: str = "ticker", order: str = "date", value: str = "close") -> DataFrame:
    """df with spike: days of a move that is undone within three days. Skipping ahead is sequential, so a key is one group."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order)
        return pdf.assign(spike=_spikes(pdf[value].tolist()))

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return df.groupBy(key).applyInPandas(run, fields + ", spike boolean")


def corrected(df: DataFrame, columns=("open", "high", "low", "close", "adj_close"), currencies=("GBp", "GBX")) -> DataFrame:
    """Prices in one unit, with price_corrected; only quotes in the given currencies are touched."""
    out = unit_factors(df)
    use = F.col("currency").isin(*currencies) & (F.col("unit_factor") != 1.0)
    for c in (c for c in columns if c in df.columns):
        out = out.withColumn(c, F.when(use, F.col(c) * F.col("unit_factor")).otherwise(F.col(c)))
    return out.withColumn("price_corrected", use).drop("unit_factor")
