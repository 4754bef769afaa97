"""Queries: local time, interpolation, hourly grids, pivots, zero-day runs (T-*, J4-J6)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import calendar as cal
from ..functions.numeric import rnd, rnd_sql
from ..operators import profile as pf
from ..operators import timeseries as tsx
from ..operators import zerodays as zd
from ..sources import roles
from ..sources.roles import with_roles
from . import forecast
from .registry import query

W = roles.weather_sql()
WCOLS = ["air_temperature", "dew_temperature", "wind_speed"]


def _rounded(df, cols):
    return df.select(*[rnd(c, 6).alias(c) if c in cols else F.col(c) for c in df.columns])


@query("local_time_shift", sql=with_roles(
    "SELECT w.site_id, w.ts AS ts_gmt, w.ts + to_hours(o.offset_h) AS ts, air_temperature, dew_temperature, wind_speed "
    "FROM w LEFT JOIN o USING (site_id)", w=W, o=roles.site_offsets_sql()))
def local_time_shift(spark, sf_dir):
    w = roles.weather(spark, sf_dir).withColumn("ts_gmt", F.col("ts"))
    return tsx.local_time_shift(w, roles.site_offsets(spark, sf_dir))


def _interp_sql(rel: str, cols, by: str = "site_id", order: str = "ts", fill_edges: bool = False) -> str:
    """Positional interpolation in SQL over relation ``rel`` (all other columns kept)."""
    exprs = []
    for c in cols:
        pv = f"last_value({c} IGNORE NULLS) OVER (PARTITION BY {by} ORDER BY {order} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
        pp = f"last_value(CASE WHEN {c} IS NOT NULL THEN rn END IGNORE NULLS) OVER (PARTITION BY {by} ORDER BY {order} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
        nv = f"first_value({c} IGNORE NULLS) OVER (PARTITION BY {by} ORDER BY {order} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"
        np_ = f"first_value(CASE WHEN {c} IS NOT NULL THEN rn END IGNORE NULLS) OVER (PARTITION BY {by} ORDER BY {order} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"
        exprs.append(f"{pv} AS pv_{c}, {pp} AS pp_{c}, {nv} AS nv_{c}, {np_} AS np_{c}")
    inner = f"SELECT *, {', '.join(exprs)} FROM (SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY {order}) AS rn FROM {rel})"
    outs = []
    for c in cols:
        interp = f"CASE WHEN pv_{c} IS NOT NULL AND nv_{c} IS NOT NULL THEN pv_{c} + (nv_{c} - pv_{c}) * (rn - pp_{c}) / (np_{c} - pp_{c}) END"
        edge = f", nv_{c}" if fill_edges else ""
        outs.append(f"coalesce({c}, {interp}, pv_{c}{edge}) AS {c}")
    return inner, outs


def _interp_select(rel: str, keep, cols, fill_edges=False, digits=6) -> str:
    inner, outs = _interp_sql(rel, cols, fill_edges=fill_edges)
    rounded = ", ".join(f"{rnd_sql(c, digits)} AS {c}" if digits is not None else c for c in cols)
    return f"SELECT {', '.join(keep)}, {rounded} FROM (SELECT {', '.join(keep)}, {', '.join(outs)} FROM ({inner}))"


@query("interpolate_linear", sql=with_roles(_interp_select("w", ["site_id", "ts"], WCOLS), w=W))
def interpolate_linear(spark, sf_dir):
    out = tsx.interpolate_linear(roles.weather(spark, sf_dir), ["site_id"], "ts", WCOLS)
    return _rounded(out, WCOLS)


@query("back_forward_fill", sql=with_roles(
    "SELECT site_id, ts, " + ", ".join(
        f"coalesce({c}, first_value({c} IGNORE NULLS) OVER (PARTITION BY site_id ORDER BY ts ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), "
        f"last_value({c} IGNORE NULLS) OVER (PARTITION BY site_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS {c}"
        for c in WCOLS) + " FROM w", w=W))
def back_forward_fill(spark, sf_dir):
    return tsx.back_forward_fill(roles.weather(spark, sf_dir), ["site_id"], "ts", WCOLS)


_GRID_SQL = ("SELECT s.site_id, CAST(g.ts AS TIMESTAMP) AS ts FROM (SELECT DISTINCT site_id FROM {rel}) s, "
             "(SELECT unnest(generate_series(min(ts), max(ts), INTERVAL 1 HOUR)) AS ts FROM {rel}) g")


@query("fill_time_grid", sql=with_roles(
    "SELECT g.site_id, g.ts, w.air_temperature, w.dew_temperature, w.wind_speed FROM g LEFT JOIN w USING (site_id, ts)",
    w=W, g=_GRID_SQL.format(rel="w")))
def fill_time_grid(spark, sf_dir):
    return tsx.fill_time_grid(roles.weather(spark, sf_dir), ["site_id"], "ts")


_T4_KEEP = ["air_temperature", "wind_speed"]


CLEAN_WEATHER_SQL = dict(
    w=W, o=roles.site_offsets_sql(),
    l="SELECT w.site_id, w.ts + to_hours(o.offset_h) AS ts, air_temperature, wind_speed FROM w JOIN o USING (site_id)",
    f=_interp_select("l", ["site_id", "ts"], _T4_KEEP, fill_edges=True, digits=None),
    g=_GRID_SQL.format(rel="f"),
    gj="SELECT g.site_id, g.ts, f.air_temperature, f.wind_speed FROM g LEFT JOIN f USING (site_id, ts)",
    wx=_interp_select("gj", ["site_id", "ts"], _T4_KEEP, fill_edges=True, digits=None))


@query("fill_time_interpolate", sql=with_roles(
    "SELECT site_id, ts, " + ", ".join(f"{rnd_sql(c, 6)} AS {c}" for c in _T4_KEEP) + " FROM wx", **CLEAN_WEATHER_SQL))
def fill_time_interpolate(spark, sf_dir):
    out = forecast.clean_weather(roles.weather(spark, sf_dir), roles.site_offsets(spark, sf_dir))
    return _rounded(out, _T4_KEEP)


_SITE_CODES = sorted(roles.EVENT_TYPE_TO_SITE.values())


@query("weather_without_offset", sql=with_roles(
    "SELECT w.site_id, count(*) AS n_rows FROM w ANTI JOIN ok USING (site_id) GROUP BY 1",
    w=W, ok="SELECT site_id FROM (" + roles.site_offsets_sql() + ") WHERE offset_h <> -8"))
def weather_without_offset(spark, sf_dir):
    """The rows T1 cannot shift: here the sites whose clock is eight hours behind are left out of the lookup."""
    known = roles.site_offsets(spark, sf_dir).where("offset_h <> -8")
    return forecast.weather_without_offset(roles.weather(spark, sf_dir), known)


@query("pivot_series", sql=with_roles(
    "SELECT ts, " + ", ".join(f"max(air_temperature) FILTER (WHERE site_id = {s}) AS site_{s}" for s in _SITE_CODES)
    + " FROM w GROUP BY ts", w=W))
def pivot_series(spark, sf_dir):
    return tsx.pivot_series(roles.weather(spark, sf_dir), "ts", "site_id", "air_temperature", _SITE_CODES, "site_")


@query("pivot_missing", sql=with_roles(
    "SELECT column_name, volume, percent, CASE WHEN sum(volume) OVER () = 0 THEN 0.0 "
    "ELSE volume / sum(volume) OVER () END AS perc_of_nulls FROM (" + " UNION ALL ".join(
        f"SELECT 'site_{s}' AS column_name, count(*) FILTER (WHERE site_{s} IS NULL) AS volume, "
        f"count(*) FILTER (WHERE site_{s} IS NULL) / count(*) AS percent FROM p" for s in _SITE_CODES) + ")",
    w=W, p="SELECT ts, " + ", ".join(f"max(air_temperature) FILTER (WHERE site_id = {s}) AS site_{s}" for s in _SITE_CODES)
    + " FROM w GROUP BY ts"))
def pivot_missing(spark, sf_dir):
    """T9: the time-spine pivot's NULL count, share of rows and share of all NULLs per column."""
    p = tsx.pivot_series(roles.weather(spark, sf_dir), "ts", "site_id", "air_temperature", _SITE_CODES, "site_")
    return pf.missing_table(p, [f"site_{s}" for s in _SITE_CODES], share_of_nulls=True)


@query("series_slice", sql=with_roles(
    "SELECT ts, air_temperature FROM w WHERE site_id = 2 AND air_temperature IS NOT NULL", w=W))
def series_slice(spark, sf_dir):
    w = roles.weather(spark, sf_dir)
    return w.where(F.col("site_id") == 2).dropna(subset=["air_temperature"]).select("ts", "air_temperature")


# --------------------------------------------------------------------------- zero-day runs
RKEYS = ["l_orderkey", "l_linenumber", "l_partkey", "building_id"]
_READ_Z = roles.readings_sql(zeros=True)
SEASON_SQL = ("CASE WHEN month(ts) IN (12, 1, 2) THEN 1 WHEN month(ts) IN (3, 4, 5) THEN 2 "
              "WHEN month(ts) IN (6, 7, 8) THEN 3 ELSE 4 END")


def _zero_sql(rules: list[tuple[int, int, int]]) -> str:
    rule_rows = " UNION ALL ".join(f"SELECT {m} AS meter, {s} AS season, {n} AS n_consec" for m, s, n in rules)
    return with_roles(f"""
SELECT {', '.join(RKEYS)}, meter, season, day, meter_reading FROM rs
WHERE NOT EXISTS (SELECT 1 FROM runs WHERE runs.remove AND runs.meter = rs.meter AND runs.season = rs.season
                  AND runs.building_id = rs.building_id AND runs.day = rs.day)""",
        r=_READ_Z, rules=rule_rows,
        rs=f"SELECT r.*, {SEASON_SQL} AS season, date_trunc('day', ts) AS day FROM r",
        daily="SELECT meter, season, building_id, day, coalesce(sum(meter_reading), 0.0) AS s, any_value(n_consec) AS n_consec "
              "FROM rs JOIN rules USING (meter, season) GROUP BY 1, 2, 3, 4",
        flagged="SELECT *, sum(chg) OVER (PARTITION BY meter, season, building_id ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run_id "
                "FROM (SELECT *, CASE WHEN lag(s = 0) OVER (PARTITION BY meter, season, building_id ORDER BY day) = (s = 0) THEN 0 ELSE 1 END AS chg FROM daily)",
        runs="SELECT *, s = 0 AND count(*) OVER (PARTITION BY meter, season, building_id, run_id) >= n_consec AS remove FROM flagged")


def _zero_spark(spark, sf_dir, rules):
    r = roles.readings(spark, sf_dir, zeros=True).withColumn("season", cal.season("ts")).withColumn("day", F.date_trunc("day", "ts").cast("timestamp_ntz"))
    rf = zd.rules_frame(spark, [{"meter": m, "season": s, "n_consec": n} for m, s, n in rules])
    rf = rf.select(F.col("meter").cast("int"), F.col("season").cast("int"), F.col("n_consec").cast("int"))
    out = zd.remove_consecutive_zero_days(r, "building_id", "day", "meter_reading", ["meter", "season"], rf)
    return out.select(*RKEYS, "meter", "season", "day", "meter_reading")


_WINTER_STEAM = [(2, 1, 3)]
# Winter steam and hot water, then summer chilled water, all with n = 3.
_SEASONAL = [(2, 1, 3), (3, 1, 3), (1, 3, 3)]


@query("remove_consecutive_zero_days", sql=_zero_sql(_WINTER_STEAM))
def remove_consecutive_zero_days(spark, sf_dir):
    return _zero_spark(spark, sf_dir, _WINTER_STEAM)


@query("seasonal_zero_cleanup", sql=_zero_sql(_SEASONAL))
def seasonal_zero_cleanup(spark, sf_dir):
    return _zero_spark(spark, sf_dir, _SEASONAL)
