"""Column names, file schemas and the model's input list."""

from __future__ import annotations

from pyspark.sql import types as T

# Field names of the files and of the homogenised dataset.
PLANT = "plant_id"
SLOT = "slot"
FECHA = "fecha"
#: Column of a series' latest slot.
END = "_end"
E_TODAY = "eToday (kWh)"
E_TOTAL = "eTotal (kWh)"
POWER = "power (kW)"

ENERGY = [E_TODAY, E_TOTAL, POWER]
WEATHER = [
    "air_temp",
    "relative_humidity",
    "ghi",
    "dni",
    "gti",
    "wind_speed_10m",
    "wind_direction_10m",
]
CALENDAR = ["hora", "dia_semana", "es_fin_semana", "mes", "estacion"]
FEATURES = ENERGY + WEATHER + CALENDAR
CIRCULAR = ["wind_direction_10m"]

RAW_SCALARS = ["nominalPower", "eToday", "eTotal"]
RAW_SERIES = "invPacData"
RAW_PERIOD_END = "period_end"

KEYS = (PLANT,)
STEP = "5 minutes"
STEP_MINUTES = 5
DEFAULT_PLANT = "P0"
CORRUPT = "_corrupt"

# Every field is text at first: a quoted number read as double would be NULL.
GENERATION_FILE = T.StructType(
    [T.StructField(c, T.StringType()) for c in [*RAW_SCALARS, RAW_SERIES, CORRUPT]]
)
WEATHER_FILE = T.StructType(
    [T.StructField(c, T.StringType()) for c in [RAW_PERIOD_END, *WEATHER, CORRUPT]]
)
