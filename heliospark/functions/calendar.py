"""Calendar features of a slot."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heliospark.schema import FECHA, SLOT

# Months to shift by, so that the season holding December starts at month 0.
_SEASON_SHIFT = {"north": 0, "south": 6}


def hora(ts: str = SLOT) -> Column:
    return F.hour(ts)


def dia_semana(ts: str = SLOT) -> Column:
    """Monday is 0."""
    return F.weekday(ts)


def es_fin_semana(ts: str = SLOT) -> Column:
    return (F.weekday(ts) >= 5).cast("int")


def mes(ts: str = SLOT) -> Column:
    return F.month(ts)


def estacion(ts: str = SLOT, hemisphere: str = "north") -> Column:
    """Meteorological season: 0 is winter, 1 spring, 2 summer, 3 autumn."""
    if hemisphere not in _SEASON_SHIFT:
        raise ValueError(f"hemisphere must be one of {sorted(_SEASON_SHIFT)}")
    shifted = F.month(ts) + F.lit(_SEASON_SHIFT[hemisphere])
    return F.floor((shifted % 12) / 3).cast("int")


def minute_of_day(ts: str = SLOT) -> Column:
    return F.hour(ts) * 60 + F.minute(ts)


def feat_hora(df: DataFrame, ts: str = SLOT) -> DataFrame:
    return df.withColumn("hora", hora(ts))


def feat_dia_semana(df: DataFrame, ts: str = SLOT) -> DataFrame:
    return df.withColumn("dia_semana", dia_semana(ts))


def feat_es_fin_semana(df: DataFrame, ts: str = SLOT) -> DataFrame:
    return df.withColumn("es_fin_semana", es_fin_semana(ts))


def feat_mes(df: DataFrame, ts: str = SLOT) -> DataFrame:
    return df.withColumn("mes", mes(ts))


def feat_estacion(df: DataFrame, ts: str = SLOT, hemisphere: str = "north") -> DataFrame:
    return df.withColumn("estacion", estacion(ts, hemisphere))


def features_all(df: DataFrame, ts: str = SLOT, hemisphere: str = "north") -> DataFrame:
    """All five features in one projection."""
    return df.withColumns(
        {
            "hora": hora(ts),
            "dia_semana": dia_semana(ts),
            "es_fin_semana": es_fin_semana(ts),
            "mes": mes(ts),
            "estacion": estacion(ts, hemisphere),
        }
    )


def with_fecha(df: DataFrame, ts: str = SLOT) -> DataFrame:
    return df.withColumn(FECHA, F.to_date(ts))
