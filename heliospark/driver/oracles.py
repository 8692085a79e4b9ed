"""The registered queries once more, in SQL, worked out from the tables alone."""

from __future__ import annotations

from heliospark.driver.present import present_sql

ORACLES: dict[str, str] = {}

_FIVE = "5 MINUTE"
_HOUR = "60 MINUTE"
_WX = "air_temp:f|relative_humidity:f|ghi:f|dni:f|gti:f|wind_speed_10m:f|wind_direction_10m:f"
_WX_NAMES = [part.split(":")[0] for part in _WX.split("|")]
_ENERGY = "eToday (kWh):f|eTotal (kWh):f|power (kW):f"
_CAL = "hora:i|dia_semana:i|es_fin_semana:i|mes:i|estacion:i"
_KEY = "plant_id:s|slot:t"
_KEY_CAL = (
    "CAST(hour(slot) AS INTEGER) AS hora, CAST(isodow(slot) - 1 AS INTEGER) AS dia_semana, "
    "CASE WHEN isodow(slot) >= 6 THEN 1 ELSE 0 END AS es_fin_semana, month(slot) AS mes, "
    "CASE WHEN month(slot) IN (12, 1, 2) THEN 0 WHEN month(slot) <= 5 THEN 1 "
    "WHEN month(slot) <= 8 THEN 2 ELSE 3 END AS estacion"
)


def _plant(many: bool) -> str:
    return "'P' || CAST(user_id % 4 AS VARCHAR)" if many else "'P0'"


def gen(many: bool = True, step: str = _FIVE) -> str:
    minutes = int(step.split()[0])
    return f"""
power AS (
  SELECT {_plant(many)} AS plant_id, time_bucket(INTERVAL {step}, ts) AS slot,
         avg(value) AS "power (kW)"
  FROM events WHERE event_type = 'purchase' GROUP BY 1, 2),
day_kwh AS (
  SELECT plant_id, CAST(slot AS DATE) AS fecha,
         sum("power (kW)") * {minutes} / 60.0 AS "eToday (kWh)"
  FROM power GROUP BY 1, 2),
counters AS (
  SELECT *, sum("eToday (kWh)") OVER (PARTITION BY plant_id ORDER BY fecha) AS "eTotal (kWh)"
  FROM day_kwh),
gen AS (
  SELECT p.plant_id, p.slot, 500.0 AS "nominalPower", c."eToday (kWh)", c."eTotal (kWh)",
         p."power (kW)", c.fecha
  FROM power p JOIN counters c ON p.plant_id = c.plant_id AND CAST(p.slot AS DATE) = c.fecha)"""


def _direction(degrees: str) -> str:
    east, north = f"avg(sin(radians({degrees})))", f"avg(cos(radians({degrees})))"
    angle = f"ROUND(degrees(atan2({east}, {north})), 9)"
    return (
        f"CASE WHEN sqrt(pow({east}, 2) + pow({north}, 2)) > 1e-9 THEN "
        f"CASE WHEN {angle} < 0 THEN {angle} + 360 ELSE {angle} END END"
    )


def wx(many: bool = True, step: str = _FIVE) -> str:
    def mean(kind: str, value: str) -> str:
        return f"avg({value}) FILTER (WHERE event_type = '{kind}')"

    k = "CAST(json_extract_string(props, '$.k') AS DOUBLE)"
    wind = f"CASE WHEN event_type = 'error' THEN {k} * 3.6 END"
    return f"""
wx AS (
  SELECT {_plant(many)} AS plant_id, time_bucket(INTERVAL {step}, ts) AS slot,
         {mean('click', 'value')} AS air_temp, {mean('error', 'value')} AS relative_humidity,
         {mean('view', 'value')} AS ghi, {mean('view', k)} AS dni,
         {mean('signup', 'value')} AS gti, {mean('click', k)} AS wind_speed_10m,
         {_direction(wind)} AS wind_direction_10m
  FROM events WHERE event_type <> 'purchase' GROUP BY 1, 2)"""


def hom(many: bool = False, step: str = _FIVE) -> str:
    return f"""{gen(many, step)},{wx(many, step)},
hom AS (
  SELECT g.*, {', '.join('w.' + c for c in _WX_NAMES)}
  FROM gen g JOIN wx w ON g.plant_id = w.plant_id AND g.slot = w.slot)"""


_ORDERS = """
readings AS (
  SELECT 'P' || CAST(o_custkey % 4 AS VARCHAR) AS plant_id, o_orderkey, o_orderdate AS slot,
         o_totalprice / 1000 AS "power (kW)" FROM orders)"""

_BETWEEN = "slot >= TIMESTAMP '2024-01-08' AND slot < TIMESTAMP '2024-01-22'"

# The hours after each series' latest one, and the recent mean at their time of day.
_PROVISIONAL = """
future AS (
  SELECT plant_id, unnest(generate_series(m + INTERVAL 1 HOUR, m + INTERVAL {days} DAY,
                                          INTERVAL 1 HOUR)) AS slot
  FROM (SELECT plant_id, max(slot) AS m FROM {history} GROUP BY 1)),
ends AS (SELECT plant_id, max(slot) AS m FROM {history} GROUP BY 1),
pattern AS (
  SELECT g.plant_id, hour(slot) AS h, avg("power (kW)") AS prediccion
  FROM {history} g JOIN ends e ON g.plant_id = e.plant_id
  WHERE slot > e.m - INTERVAL 7 DAY GROUP BY 1, 2),
prov AS (
  SELECT f.plant_id, f.slot, p.prediccion, 'provisional' AS modo
  FROM future f LEFT JOIN pattern p ON f.plant_id = p.plant_id AND hour(f.slot) = p.h)"""

_FORECAST = gen(step=_HOUR) + "," + _PROVISIONAL.format(days=3, history="gen")
_FORECAST_COLUMNS = f"{_KEY}|prediccion:f|modo:s"


def oracle(name: str, ctes: str, body: str, columns: str) -> None:
    ORACLES[name] = present_sql(ctes.strip(), body, columns)


# --- Sources and sinks ---

oracle(
    "src_generation_json",
    gen(),
    'SELECT plant_id, 500.0 AS "nominalPower", max("eToday (kWh)") AS "eToday", '
    'max("eTotal (kWh)") AS "eTotal", count(*) AS records, sum("power (kW)") AS total, '
    "string_agg(strftime(slot, '%Y-%m-%d %H:%M'), ',' ORDER BY slot) AS times FROM gen GROUP BY plant_id, fecha",
    "plant_id:s|nominalPower:f|eToday:f|eTotal:f|records:i|times:s|total:f",
)
oracle(
    "src_weather_json",
    wx(),
    "SELECT *, strftime(slot + INTERVAL 5 MINUTE, '%Y-%m-%dT%H:%M:%SZ') AS period_end FROM wx",
    f"plant_id:s|period_end:s|{_WX}",
)
oracle(
    "src_explode_series",
    gen(),
    "SELECT plant_id, strftime(slot, '%Y-%m-%d %H:%M') AS time, \"power (kW)\" AS pac FROM power",
    "plant_id:s|time:s|pac:f",
)
oracle(
    "src_broadcast_scalars",
    gen(),
    "SELECT plant_id, strftime(slot, '%Y-%m-%d %H:%M') AS time, \"power (kW)\" AS pac, "
    '"nominalPower", "eToday (kWh)" AS "eToday", "eTotal (kWh)" AS "eTotal" FROM gen',
    "plant_id:s|time:s|pac:f|nominalPower:f|eToday:f|eTotal:f",
)
oracle("src_homogenised", hom(), f"SELECT *, {_KEY_CAL} FROM hom", f"{_KEY}|{_ENERGY}|{_WX}|{_CAL}")
oracle("src_intermediate", wx(), "SELECT * FROM wx", f"{_KEY}|{_WX}")
oracle(
    "sink_homogenised",
    hom(True),
    f"SELECT *, CAST(slot AS DATE) AS fecha, {_KEY_CAL} FROM hom",
    f"plant_id:s|fecha:t|slot:t|{_ENERGY}|{_WX}|{_CAL}",
)
oracle("sink_intermediate", gen(), "SELECT * FROM gen", f"{_KEY}|nominalPower:f|{_ENERGY}")
oracle(
    "export_history_csv",
    gen(),
    f"SELECT * FROM gen WHERE {_BETWEEN} AND hour(slot) BETWEEN 6 AND 18",
    f"{_KEY}|{_ENERGY}",
)
oracle(
    "export_climate_csv",
    wx(),
    f"SELECT plant_id, slot, gti AS valor FROM wx WHERE {_BETWEEN}",
    f"{_KEY}|valor:f",
)
for _name in ("export_forecast_csv", "forecast_table", "forecast_fallback"):
    oracle(_name, _FORECAST, "SELECT * FROM prov", _FORECAST_COLUMNS)

# --- Cleaning ---

_TEXT = """
texts AS (
  SELECT event_id, event_id % 17 = 0 AS broken, event_id % 2 = 0 AS zoned,
         date_trunc('second', ts) AS wall,
         CASE WHEN event_id % 13 = 0 THEN NULL ELSE value END AS lectura FROM events)"""

oracle(
    "parse_timestamps",
    _TEXT,
    "SELECT event_id, CASE WHEN broken THEN NULL WHEN zoned THEN wall - INTERVAL 6 HOUR "
    "ELSE wall END AS ts FROM texts",
    "event_id:i|ts:t",
)
oracle(
    "clean_rows",
    _TEXT,
    "SELECT event_id, wall AS ts, lectura FROM texts WHERE NOT broken",
    "event_id:i|ts:t|lectura:f",
)
oracle("select_variables", hom(), "SELECT * FROM hom", f"{_KEY}|ghi:f|air_temp:f|power (kW):f")
oracle(
    "dedupe_slots",
    "",
    f"""SELECT plant_id, slot, value AS "power (kW)" FROM (
  SELECT {_plant(True)} AS plant_id, time_bucket(INTERVAL 5 MINUTE, ts) AS slot, value,
         row_number() OVER (
           PARTITION BY user_id % 4, time_bucket(INTERVAL 5 MINUTE, ts)
           ORDER BY ts DESC, event_type DESC, value DESC) AS r
  FROM events) WHERE r = 1""",
    f"{_KEY}|power (kW):f",
)
oracle(
    "rename_units",
    gen(),
    "SELECT plant_id, strftime(slot, '%Y-%m-%d %H:%M') AS time, \"eToday (kWh)\", "
    '"eTotal (kWh)", "power (kW)" * 0.001 AS "power (kW)" FROM gen',
    f"plant_id:s|time:s|{_ENERGY}",
)

# --- Filters, tables, views ---

_POWER = f"{_KEY}|power (kW):f"
_TRAILING = (
    "SELECT gen.* FROM gen JOIN (SELECT plant_id, max(slot) AS m FROM gen GROUP BY 1) e "
    "ON gen.plant_id = e.plant_id WHERE slot > e.m - INTERVAL {days} DAY"
)

oracle("filter_dates", gen(), f"SELECT * FROM gen WHERE {_BETWEEN}", _POWER)
oracle("filter_hours", gen(), "SELECT * FROM gen WHERE hour(slot) BETWEEN 6 AND 18", _POWER)
oracle("filter_dates_climate", wx(), f"SELECT * FROM wx WHERE {_BETWEEN}", f"{_KEY}|{_WX}")
oracle("climate_variable", wx(), "SELECT plant_id, slot, ghi AS valor FROM wx", f"{_KEY}|valor:f")
oracle(
    "history_table",
    gen(),
    f"SELECT * FROM gen WHERE {_BETWEEN} AND hour(slot) BETWEEN 8 AND 17",
    f"{_KEY}|{_ENERGY}",
)
oracle(
    "climate_table",
    wx(),
    f"SELECT plant_id, slot, wind_direction_10m AS valor FROM wx WHERE {_BETWEEN}",
    f"{_KEY}|valor:f",
)
oracle("view_full", gen(), "SELECT * FROM gen", _POWER)
for _name, _days in {"view_last7": 7, "view_last30": 30, "history_days": 3}.items():
    oracle(_name, gen(), _TRAILING.format(days=_days), _POWER)

# --- Alignment and join ---

oracle("align_generation", gen(), "SELECT * FROM power", _POWER)
oracle("align_weather", wx(), "SELECT * FROM wx", f"{_KEY}|{_WX}")
oracle("homogenise", hom(many=True), "SELECT * FROM hom", f"{_KEY}|power (kW):f|{_WX}")
oracle(
    "history_vs_forecast",
    _FORECAST,
    """SELECT gen.plant_id, slot, "power (kW)" AS valor, 'historico' AS serie
FROM gen JOIN ends e ON gen.plant_id = e.plant_id WHERE slot > e.m - INTERVAL 7 DAY
UNION ALL SELECT plant_id, slot, prediccion, 'prediccion' FROM prov""",
    f"{_KEY}|valor:f|serie:s",
)

# --- Calendar features ---

oracle("feat_hora", "", "SELECT event_id, ts, hour(ts) AS hora FROM events", "event_id:i|ts:t|hora:i")
oracle(
    "feat_dia_semana",
    "",
    "SELECT event_id, ts, isodow(ts) - 1 AS dia_semana FROM events",
    "event_id:i|ts:t|dia_semana:i",
)
oracle(
    "feat_es_fin_semana",
    "",
    "SELECT event_id, ts, CASE WHEN isodow(ts) IN (6, 7) THEN 1 ELSE 0 END AS es_fin_semana "
    "FROM events",
    "event_id:i|ts:t|es_fin_semana:i",
)
oracle(
    "feat_mes",
    _ORDERS,
    "SELECT *, month(slot) AS mes FROM readings",
    "o_orderkey:i|slot:t|mes:i",
)
for _name, _columns in {"feat_estacion": "estacion:i", "features_all": _CAL}.items():
    oracle(_name, _ORDERS, f"SELECT *, {_KEY_CAL} FROM readings", f"o_orderkey:i|slot:t|{_columns}")
oracle(
    "model_input_schema",
    hom(step=_HOUR),
    f"""SELECT h.plant_id, h.slot, b."eToday (kWh)", b."eTotal (kWh)", b."power (kW)",
       {', '.join('h.' + c for c in _WX_NAMES)}, {_KEY_CAL.replace('slot', 'h.slot')},
       h."power (kW)" AS objetivo
FROM hom h LEFT JOIN hom b ON h.plant_id = b.plant_id AND h.slot = b.slot + INTERVAL 1 DAY""",
    f"{_KEY}|{_ENERGY}|{_WX}|{_CAL}|objetivo:f",
)

# --- Aggregations ---

for _name, _body, _column in (
    ("summary_count", "SELECT count(*) AS total_registros FROM gen", "total_registros:i"),
    ("summary_first_date", "SELECT min(slot) AS fecha_inicial FROM gen", "fecha_inicial:t"),
    ("summary_last_date", "SELECT max(slot) AS fecha_final FROM gen", "fecha_final:t"),
    ("summary_max", 'SELECT max("power (kW)") AS valor_maximo FROM gen', "valor_maximo:f"),
):
    oracle(_name, gen(), _body, _column)
for _name, _agg in {"daily_mean": "avg", "daily_max": "max"}.items():
    oracle(
        _name,
        gen(),
        f'SELECT plant_id, fecha, {_agg}("power (kW)") AS "power (kW)" FROM gen GROUP BY 1, 2',
        "plant_id:s|fecha:t|power (kW):f",
    )
oracle(
    "daily_generation",
    gen(),
    'SELECT *, "eToday (kWh)" AS kwh FROM counters',
    "plant_id:s|fecha:t|kwh:f|eToday (kWh):f",
)
oracle(
    "forecast_daily",
    _FORECAST,
    "SELECT plant_id, CAST(slot AS DATE) AS fecha, avg(prediccion) AS media, "
    "max(prediccion) AS maximo, sum(prediccion) AS kwh FROM prov GROUP BY 1, 2",
    "plant_id:s|fecha:t|media:f|maximo:f|kwh:f",
)
_PROFILE = (
    'SELECT plant_id, {part}(slot) AS {name}, count("power (kW)") AS n, '
    'avg("power (kW)") AS media, stddev_samp("power (kW)") AS desviacion FROM {source} GROUP BY 1, 2'
)
oracle(
    "profile_hourly",
    gen(),
    _PROFILE.format(part="hour", name="hora", source="gen"),
    "plant_id:s|hora:i|n:i|media:f|desviacion:f",
)
oracle(
    "profile_monthly",
    _ORDERS,
    _PROFILE.format(part="month", name="mes", source="readings"),
    "plant_id:s|mes:i|n:i|media:f|desviacion:f",
)

# --- Regressions: the normal equations, eliminated one column per step ---


def _least_squares(
    rows: str, xs: list[str], y: str, tag: str, ridge: list[float] | None = None, by: str = "plant_id"
) -> str:
    """CTEs that end in ``{tag}_fit`` with the columns ``by``, n and b0, b1, ...

    ``rows`` is a relation with those columns; ridge is in units of n.
    """
    size = len(xs)
    ridge = ridge or [0.0] * size
    cells = []
    for i, a in enumerate(xs):
        for j, b in enumerate([*xs, y]):
            extra = f" + count(*) * {ridge[i]!r}" if i == j else ""
            cells.append(f"sum(({a}) * ({b})){extra} AS c{i}_{j}")
    steps = [f"{tag}_0 AS (SELECT {by}, count(*) AS n, {', '.join(cells)} FROM {rows} GROUP BY {by})"]
    for pivot in range(size):
        out = []
        for i in range(size):
            for j in range(pivot + 1, size + 1):
                if i == pivot:
                    cell = f"c{i}_{j} / c{i}_{i}"
                else:
                    cell = f"c{i}_{j} - c{i}_{pivot} * c{pivot}_{j} / c{pivot}_{pivot}"
                out.append(f"{cell} AS c{i}_{j}")
            # Columns left of the pivot are already eliminated.
        steps.append(f"{tag}_{pivot + 1} AS (SELECT {by}, n, {', '.join(out)} FROM {tag}_{pivot})")
    names = ", ".join(f"c{i}_{size} AS b{i}" for i in range(size))
    steps.append(f"{tag}_fit AS (SELECT {by}, n, {names} FROM {tag}_{size})")
    return ",\n".join(steps)


def _arima_sql() -> str:
    def back(alias: str, k: int, source: str) -> str:
        return (
            f"LEFT JOIN {source} {alias} ON {alias}.plant_id = r.plant_id "
            f"AND {alias}.slot = r.slot - INTERVAL {3 * k} HOUR"
        )

    lags = "\n".join(back(f"l{k}", k, "gen") for k in (1, 2, 3, 4))
    values = ", ".join(f'l{k}."power (kW)" AS a{k}' for k in (1, 2, 3, 4))
    return f"""{gen(step="180 MINUTE")},
lagged AS (SELECT r.plant_id, r."power (kW)" AS y, {values} FROM gen r {lags}),
whole AS (SELECT * FROM lagged WHERE a1 + a2 + a3 + a4 IS NOT NULL),
{_least_squares("whole", ["1.0", "a1", "a2", "a3"], "y", "long")},
paired AS (
  SELECT w.plant_id, w.y, w.a1,
         w.a1 - (f.b0 + f.b1 * w.a2 + f.b2 * w.a3 + f.b3 * w.a4) AS e1
  FROM whole w JOIN long_fit f ON w.plant_id = f.plant_id),
{_least_squares("paired", ["1.0", "a1", "e1"], "y", "short")}"""


oracle(
    "fit_arima",
    _arima_sql(),
    "SELECT s.plant_id, s.n, s.b0 AS const, s.b1 AS phi_1, s.b2 AS theta_1, l.b0 AS ar_0, "
    "l.b1 AS ar_1, l.b2 AS ar_2, l.b3 AS ar_3 "
    "FROM short_fit s JOIN long_fit l ON s.plant_id = l.plant_id",
    "plant_id:s|n:i|const:f|phi_1:f|theta_1:f|ar_0:f|ar_1:f|ar_2:f|ar_3:f",
)


def _additive_sql() -> str:
    trend = "epoch(slot - t0) / epoch(t1 - t0)"
    phase = "2 * pi() * epoch(slot - date_trunc('day', slot)) / 86400"
    fit = _least_squares(
        "design",
        ["1.0", "trend", "bend", "s1", "c1", "ghi"],
        "y",
        "add",
        [0.0, 0.01, 0.01, 0.01, 0.01, 0.01],
    )
    return f"""{hom(True, _HOUR)},
bounded AS (
  SELECT *, min(slot) OVER w AS t0, max(slot) OVER w AS t1
  FROM hom WHERE ghi IS NOT NULL WINDOW w AS (PARTITION BY plant_id)),
design AS (
  SELECT plant_id, {trend} AS trend, greatest({trend} - 0.5, 0) AS bend, sin({phase}) AS s1,
         cos({phase}) AS c1, ghi, "power (kW)" AS y
  FROM bounded),
{fit}"""


oracle(
    "fit_additive",
    _additive_sql(),
    "SELECT plant_id, n, b0 AS const, b1 AS trend, b2 AS bend_1, b3 AS day_sin_1, "
    "b4 AS day_cos_1, b5 AS ghi FROM add_fit",
    "plant_id:s|n:i|const:f|trend:f|bend_1:f|day_sin_1:f|day_cos_1:f|ghi:f",
)

# --- Splits and metrics ---

oracle(
    "split_holdout",
    gen(),
    "SELECT *, CASE WHEN slot < TIMESTAMP '2024-01-24' THEN 'train' ELSE 'test' END AS rol FROM gen",
    f"{_POWER}|rol:s",
)


def _folds_sql(source: str, k: int, h: int, window: int | None) -> str:
    start = f"slot > origin - INTERVAL {window} DAY AND " if window else ""
    return f"""SELECT r.*, f.fold, f.origin,
         CASE WHEN slot > origin THEN 'test' ELSE 'train' END AS rol
  FROM {source} r JOIN (
    SELECT plant_id, i AS fold, m - to_days(CAST(({k} - i + 1) * {h} AS INTEGER)) AS origin,
           m - to_days(CAST(({k} - i) * {h} AS INTEGER)) AS test_to
    FROM (SELECT plant_id, max(slot) AS m FROM {source} GROUP BY 1), (SELECT unnest(range(1, {k} + 1)) AS i)) f
    ON r.plant_id = f.plant_id
  WHERE (slot > origin AND slot <= test_to) OR ({start}slot <= origin)"""


for _name, _window in {"split_expanding": None, "split_sliding": 10}.items():
    oracle(
        _name, gen(), _folds_sql("gen", 3, 4, _window), f"{_POWER}|fold:i|origin:t|rol:s"
    )

# --- The three forecasters: ARIMA(2, 0, 1) after an autoregression of 20 lags, the additive
# model, and of the forest what can be told without growing it ---

_FIT = "strategy, fold, plant_id"
_SIX = _WX_NAMES[:-1]
_LONG = 20


def _fold_table_sql() -> str:
    parts = [
        f"SELECT plant_id, '{s}' AS strategy, {i} AS fold, {start} AS train_from, "
        f"m - INTERVAL {2 * back} DAY AS origin, m - INTERVAL {2 * back - 2} DAY AS test_to FROM ends"
        for s, k in (("holdout", 1), ("expanding", 3), ("sliding", 3))
        for i in range(1, k + 1)
        for back in (k - i + 1,)
        for start in (f"m - INTERVAL {2 * back + 60} DAY" if s == "sliding" else "CAST(NULL AS TIMESTAMP)",)
    ]
    return f"""
ends AS (SELECT plant_id, max(slot) AS m FROM hom GROUP BY 1),
fold_table AS ({' UNION ALL '.join(parts)}),
train AS (
  SELECT f.strategy, f.fold, h.* FROM hom h JOIN fold_table f ON h.plant_id = f.plant_id
  WHERE slot <= origin AND (train_from IS NULL OR slot > train_from)),
tests AS (
  SELECT f.strategy, f.fold, f.origin, f.test_to, h.plant_id, h.slot, h."power (kW)" AS actual
  FROM hom h JOIN fold_table f ON h.plant_id = f.plant_id WHERE slot > origin AND slot <= test_to)"""


def _arima_answers_sql() -> str:
    lags = range(1, _LONG + 2)
    own = ", ".join(f"lag(y, {k}) OVER w AS a{k}" for k in lags)
    innovation = " + ".join(f"f.b{k} * w.a{k + 1}" for k in range(1, _LONG + 1))
    last = ", ".join(f"max(v) FILTER (WHERE i = b - {k}) AS v{k}" for k in range(_LONG + 1))
    ahead = " + ".join(f"l.b{k} * t.v{k}" for k in range(1, _LONG + 1))
    return f"""
readings AS (SELECT {_FIT}, CAST(epoch(slot) AS BIGINT) // 21600 AS i, "power (kW)" AS y FROM train),
spans AS (SELECT {_FIT}, min(i) AS a, max(i) AS b FROM readings GROUP BY ALL),
grid AS (SELECT {_FIT}, b, unnest(range(a, b + 1)) AS i FROM spans),
filled AS (SELECT g.*, r.y FROM grid g LEFT JOIN readings r USING ({_FIT}, i)),
lagged AS (SELECT {_FIT}, y, {own} FROM filled WINDOW w AS (PARTITION BY {_FIT} ORDER BY i)),
whole AS (SELECT * FROM lagged WHERE y + {' + '.join(f'a{k}' for k in lags)} IS NOT NULL),
{_least_squares("whole", ["1.0", *(f"a{k}" for k in range(1, _LONG + 1))], "y", "long", by=_FIT)},
paired AS (
  SELECT {', '.join('w.' + c for c in _FIT.split(', '))}, w.y, w.a1, w.a2, w.a1 - (f.b0 + {innovation}) AS e1
  FROM whole w JOIN long_fit f USING ({_FIT})),
{_least_squares("paired", ["1.0", "a1", "a2", "e1"], "y", "short", by=_FIT)},
carried AS (
  SELECT {_FIT}, i, b, last_value(y IGNORE NULLS) OVER (PARTITION BY {_FIT} ORDER BY i) AS v
  FROM filled WHERE i > b - {_LONG + 2}),
tails AS (SELECT {_FIT}, b, {last} FROM carried GROUP BY ALL),
steps AS (
  SELECT {_FIT}, b AS i, v0 AS y, coalesce(v1, 0) AS y1, coalesce(t.v0 - (l.b0 + {ahead}), 0) AS e,
         s.b0 AS c, s.b1 AS phi1, s.b2 AS phi2, s.b3 AS theta, CAST(epoch(test_to) AS BIGINT) // 21600 AS stop
  FROM tails t JOIN long_fit l USING ({_FIT}) JOIN short_fit s USING ({_FIT}) JOIN fold_table USING ({_FIT})
  WHERE s.n > {_LONG + 2}
  UNION ALL
  SELECT {_FIT}, i + 1, c + phi1 * y + phi2 * y1 + theta * e, y, 0.0, c, phi1, phi2, theta, stop
  FROM steps WHERE i < stop)"""


def _additive_answers_sql() -> str:
    trend = "(epoch(slot) - epoch(t0)) / (epoch(t1) - epoch(t0))"
    phase = "2 * pi() * epoch(slot - date_trunc('day', slot)) / 86400"
    terms = [f"greatest({trend} - {j} / 6.0, 0) AS bend{j}" for j in range(1, 6)]
    terms += [f"{f}({phase} * {k}) AS {f}{k}" for k in range(1, 5) for f in ("sin", "cos")]
    names = ["trend", *(f"bend{j}" for j in range(1, 6)), *(f"{f}{k}" for k in range(1, 5) for f in ("sin", "cos")), *_SIX]
    means = ", ".join(f"avg({c}) AS {c}" for c in _SIX)
    fill = ", ".join(f"coalesce(r.{c}, u.{c}, m.{c}) AS {c}" for c in _SIX)
    answer = " + ".join(f"f.b{i} * x.{n}" for i, n in enumerate(names, 1))
    return f"""
usable AS (SELECT * FROM train WHERE {' + '.join(_SIX)} IS NOT NULL),
bounds AS (SELECT {_FIT}, min(slot) AS t0, max(slot) AS t1 FROM usable GROUP BY ALL),
design AS (
  SELECT {_FIT}, {trend} AS trend, {', '.join(terms)}, {', '.join(_SIX)}, "power (kW)" AS y
  FROM usable JOIN bounds USING ({_FIT})),
{_least_squares("design", ["1.0", *names], "y", "add", [0.0] + [1e-6] * len(names), by=_FIT)},
latest AS (SELECT {_FIT}, max(slot) AS m FROM train GROUP BY ALL),
recent AS (
  SELECT {_FIT}, hour(slot) AS h, {means} FROM train JOIN latest USING ({_FIT})
  WHERE slot > m - INTERVAL 7 DAY GROUP BY ALL),
usual AS (SELECT {_FIT}, hour(slot) AS h, {means} FROM train GROUP BY ALL),
overall AS (SELECT {_FIT}, {means} FROM train GROUP BY ALL),
weathered AS (
  SELECT t.*, {fill} FROM (SELECT *, hour(slot) AS h FROM tests) t
  LEFT JOIN recent r USING ({_FIT}, h) LEFT JOIN usual u USING ({_FIT}, h) LEFT JOIN overall m USING ({_FIT})),
placed AS (
  SELECT {_FIT}, slot, {trend} AS trend, {', '.join(terms)}, {', '.join(_SIX)}
  FROM weathered JOIN bounds USING ({_FIT})),
additive AS (SELECT {_FIT}, slot, f.b0 + {answer} AS p FROM placed x JOIN add_fit f USING ({_FIT}))"""


def _predictions_sql() -> str:
    told = (("arima", "arima", "arima IS NOT NULL"), ("additive", "additive", "additive IS NOT NULL"), ("random_forest", "CAST(NULL AS DOUBLE)", "true"))
    each = " UNION ALL ".join(
        f"SELECT '{m}' AS model, strategy, fold, origin, slot, actual, shared, {given} AS given, {p} - actual AS err, "
        "CAST(ceil(epoch(slot - origin) / 86400) AS INTEGER) AS lead_day FROM judged"
        for m, p, given in told
    )
    return f"""RECURSIVE {hom(True, "360 MINUTE").strip()},{_fold_table_sql()},{_arima_answers_sql()},{_additive_answers_sql()},
judged AS (
  SELECT t.*, s.y AS arima, a.p AS additive, s.y IS NOT NULL AND a.p IS NOT NULL AS shared
  FROM tests t
  LEFT JOIN steps s ON s.strategy = t.strategy AND s.fold = t.fold AND s.plant_id = t.plant_id
    AND s.i = CAST(epoch(t.slot) AS BIGINT) // 21600
  LEFT JOIN additive a ON a.strategy = t.strategy AND a.fold = t.fold AND a.plant_id = t.plant_id AND a.slot = t.slot),
each AS ({each}),
results AS (SELECT model, strategy, fold, {_METRICS} FROM each GROUP BY 1, 2, 3),
compared AS (
  SELECT model, strategy, count(*) AS folds, avg(mae) AS mae, avg(rmse) AS rmse,
         stddev_samp(rmse) AS rmse_std, avg(r2) AS r2, avg(bias) AS bias, 1 AS sound,
         sum(n) AS n, sum(slots) AS slots, sum(answered) AS answered
  FROM results WHERE n > 0 GROUP BY 1, 2)"""


_METRICS = (
    "count(*) AS slots, count(*) FILTER (given) AS answered, count(*) FILTER (shared) AS n, "
    "avg(abs(err)) FILTER (shared) AS mae, sqrt(avg(err * err) FILTER (shared)) AS rmse, "
    "CASE WHEN var_pop(actual) FILTER (shared) > 0 "
    "THEN 1 - avg(err * err) FILTER (shared) / var_pop(actual) FILTER (shared) END AS r2, "
    "avg(err) FILTER (shared) AS bias, CASE WHEN count(*) FILTER (shared) > 0 THEN 1 ELSE 0 END AS sound"
)
_COUNTS = "n:i|slots:i|answered:i|sound:i"
_SCORES = f"{_COUNTS}|mae:f|rmse:f|r2:f|bias:f"

for _name in ("eval_metrics", "sink_results"):
    oracle(
        _name, _predictions_sql(), "SELECT * FROM results", f"model:s|strategy:s|fold:i|{_SCORES}"
    )
oracle(
    "compare_models",
    _predictions_sql(),
    "SELECT * FROM compared",
    f"model:s|strategy:s|folds:i|{_SCORES}|rmse_std:f",
)
oracle(
    "horizon_decay",
    _predictions_sql(),
    f"SELECT model, lead_day, {_METRICS} FROM each GROUP BY 1, 2",
    f"model:s|lead_day:i|{_SCORES}",
)
oracle(
    "select_final",
    _predictions_sql(),
    """SELECT *, 1 AS final_no_worse FROM (
  SELECT model, avg(rmse) AS rmse, avg(rmse_std) AS rmse_std, avg(mae) AS mae
  FROM compared WHERE model <> 'random_forest' GROUP BY 1)
ORDER BY rmse, rmse_std NULLS LAST, model LIMIT 1""",
    "model:s|rmse:f|rmse_std:f|mae:f|final_no_worse:i",
)
oracle(
    "compare_candidates",
    hom(True, "360 MINUTE") + "," + _fold_table_sql(),
    """SELECT m.model, strategy, fold, count(*) AS slots, 1 AS same_slots
FROM tests, (VALUES ('arima'), ('additive'), ('random_forest')) m(model) GROUP BY ALL""",
    "model:s|strategy:s|fold:i|slots:i|same_slots:i",
)

# --- Forecast and economics ---

oracle(
    "future_horizon",
    gen(),
    "SELECT plant_id, unnest(generate_series(m + INTERVAL 5 MINUTE, m + INTERVAL 2 DAY, "
    "INTERVAL 5 MINUTE)) AS slot FROM (SELECT plant_id, max(slot) AS m FROM gen GROUP BY 1)",
    _KEY,
)


def _inputs_sql() -> str:
    usual = ", ".join(f"avg({c}) AS {c}" for c in _WX_NAMES[:-1])
    return f"""{hom(True, _HOUR)},{_PROVISIONAL.format(days=2, history="hom")},
usual AS (
  SELECT g.plant_id, hour(slot) AS h, {usual}, {_direction('wind_direction_10m')} AS wind_direction_10m
  FROM hom g JOIN ends e ON g.plant_id = e.plant_id WHERE slot > e.m - INTERVAL 7 DAY GROUP BY 1, 2)"""


oracle(
    "inference_inputs",
    _inputs_sql(),
    f"""SELECT f.plant_id, f.slot, b."eToday (kWh)", b."eTotal (kWh)", b."power (kW)",
       {', '.join('u.' + c for c in _WX_NAMES)}, {_KEY_CAL.replace('slot', 'f.slot')}
FROM future f
LEFT JOIN hom b ON f.plant_id = b.plant_id AND f.slot = b.slot + INTERVAL 2 DAY
LEFT JOIN usual u ON f.plant_id = u.plant_id AND hour(f.slot) = u.h""",
    f"{_KEY}|{_ENERGY}|{_WX}|{_CAL}",
)
oracle(
    "forecast_or_fallback",
    hom(True, _HOUR) + "," + _PROVISIONAL.format(days=1, history="hom"),
    """SELECT plant_id, slot, CASE WHEN plant_id = 'P3' THEN modo ELSE 'modelo' END AS modo,
       CASE WHEN plant_id = 'P3' THEN prediccion END AS prediccion, 1 AS inside FROM prov""",
    f"{_KEY}|modo:s|prediccion:f|inside:i",
)
oracle(
    "economic_estimate",
    gen(),
    'SELECT plant_id, fecha, "eToday (kWh)" AS kwh, 2.5 AS tarifa, "eToday (kWh)" * 2.5 AS valor '
    "FROM counters",
    "plant_id:s|fecha:t|kwh:f|tarifa:f|valor:f",
)
oracle(
    "consumption_cost",
    _ORDERS,
    """SELECT plant_id, CAST(date_trunc('month', slot) AS DATE) AS periodo,
       sum("power (kW)") AS kwh,
       sum("power (kW)" * (1 + CAST(substr(plant_id, 2, 1) AS INTEGER) * 0.5)) AS valor
FROM readings GROUP BY 1, 2""",
    "plant_id:s|periodo:t|kwh:f|valor:f",
)
# The forest's own answers are beyond SQL; which slots they cover, and between
# which values they must lie, is not.
_FACTS = f"{_KEY}|actual:f|answered:i|inside:i"
oracle(
    "fit_random_forest",
    hom(True, _HOUR),
    """SELECT plant_id, slot, "power (kW)" AS actual, 1 AS answered, 1 AS inside, 1 AS same_seed
FROM hom JOIN (SELECT plant_id, max(slot) AS m FROM hom GROUP BY 1) e USING (plant_id)
WHERE slot > m - INTERVAL 6 DAY""",
    f"{_FACTS}|same_seed:i",
)
oracle(
    "model_save",
    hom(True, _HOUR),
    "SELECT plant_id, slot, 1 AS agrees, 1 AS lag_days FROM hom",
    f"{_KEY}|agrees:i|lag_days:i",
)
oracle(
    "model_load",
    hom(True, _HOUR),
    'SELECT plant_id, slot, "power (kW)" AS actual, 1 AS answered, 1 AS inside FROM hom',
    _FACTS,
)
oracle(
    "forecast",
    hom(True, _HOUR) + "," + _PROVISIONAL.format(days=1, history="hom"),
    "SELECT plant_id, slot, 1 AS answered, 1 AS inside FROM future",
    f"{_KEY}|answered:i|inside:i",
)
oracle(
    "model_status",
    hom(True, _HOUR) + ",ends AS (SELECT plant_id, max(slot) AS m FROM hom GROUP BY 1)",
    """SELECT m.modo, m.motivo, count(*) * 24 * m.days AS slots, min(e.m) + INTERVAL 1 HOUR AS desde,
       max(e.m) + m.days * INTERVAL 24 HOUR AS hasta
FROM ends e, (VALUES ('modelo', NULL, 1),
                     ('provisional', 'model not usable: AnalysisException', 1),
                     ('provisional', 'model trained for 1 days, asked for 3', 3)) m(modo, motivo, days)
GROUP BY m.modo, m.motivo, m.days""",
    "modo:s|motivo:s|slots:i|desde:t|hasta:t",
)
