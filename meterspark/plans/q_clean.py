"""Queries: outlier labelling, filters and row removal (D-*, F-*)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.numeric import rnd_sql
from ..operators import outliers as ol
from ..operators import profile as pf
from ..sources import roles
from .registry import query

EVENT_TYPES = sorted(roles.EVENT_TYPE_TO_SITE)
_EV_LIST = ", ".join(f"'{t}'" for t in EVENT_TYPES)


def _stats_by_value_sql(src: str, by: str, value: str) -> str:
    """SQL twin of profile.stats_by_value over relation ``src``."""
    def fin(e):
        return rnd_sql(f"coalesce({e}, 0.0::DOUBLE)", 2)
    return f"""
    SELECT s.{by}, CAST(count(*) AS BIGINT) AS count,
      {fin('min(s.' + value + ')')} AS min, {fin('avg(s.' + value + ')')} AS mean,
      {fin('stddev_samp(s.' + value + ')')} AS std, {fin('any_value(m.med)')} AS median,
      {fin('1.4826::DOUBLE * median(abs(s.' + value + ' - m.med))')} AS mad, {fin('max(s.' + value + ')')} AS max
    FROM {src} s LEFT JOIN (SELECT {by}, median({value}) AS med FROM {src} GROUP BY {by}) m USING ({by})
    GROUP BY s.{by}"""


def _mad_label_sql(src: str, by: str, value: str, vals: str, label: str) -> str:
    """Rows of ``src`` with a grouped MAD outlier label column ``label``."""
    return f"""
    SELECT r.*, CASE WHEN r.{by} IN ({vals}) THEN
        (CASE WHEN coalesce(abs(0.6745::DOUBLE * (r.{value} - st.med)) > 3.0::DOUBLE * dv.mad, false)
              THEN 'Outlier_' ELSE 'Normal_' END) || '{by}-' || CAST(r.{by} AS VARCHAR) END AS {label}
    FROM {src} r
    LEFT JOIN (SELECT {by}, median({value}) AS med FROM {src} WHERE {by} IN ({vals}) GROUP BY {by}) st USING ({by})
    LEFT JOIN (SELECT x.{by}, avg(abs(x.{value} - mu.mu)) AS mad FROM {src} x
               JOIN (SELECT {by}, avg({value}) AS mu FROM {src} GROUP BY {by}) mu USING ({by})
               WHERE x.{by} IN ({vals}) GROUP BY x.{by}) dv USING ({by})"""


# --------------------------------------------------------------------------- flagship
def outlier_clean_stats(spark, sf_dir):
    ev = roles.table(spark, sf_dir, "events")
    labelled = ol.detect_outliers(ev, "value", "outlier_label", "MAD", by="event_type", by_vals=EVENT_TYPES)
    return pf.stats_by_value(ol.keep_normal(labelled, "outlier_label"), "event_type", "value")


query("outlier_clean_stats", sql=roles.with_roles(
    _stats_by_value_sql("kept", "event_type", "value"),
    lab=_mad_label_sql("events", "event_type", "value", _EV_LIST, "outlier_label"),
    kept="SELECT * FROM lab WHERE outlier_label IS NULL OR contains(outlier_label, 'Normal')",
))(outlier_clean_stats)


@query("stats_by_value", sql=_stats_by_value_sql("events", "event_type", "value"))
def stats_by_value(spark, sf_dir):
    return pf.stats_by_value(roles.table(spark, sf_dir, "events"), "event_type", "value")


# --------------------------------------------------------------------------- outlier modes
@query("outlier_mad_global", sql="""
WITH st AS (SELECT median(value) AS med, avg(value) AS mu FROM events),
dv AS (SELECT avg(abs(value - st.mu)) AS mad FROM events, st)
SELECT event_id, value, CASE WHEN coalesce(abs(0.6745::DOUBLE * (value - st.med)) > 3.0::DOUBLE * dv.mad, false)
  THEN 'Outlier' ELSE 'Normal' END AS outlier_label
FROM events, st, dv""")
def outlier_mad_global(spark, sf_dir):
    ev = roles.table(spark, sf_dir, "events").select("event_id", "value")
    return ol.detect_outliers(ev, "value", "outlier_label", "MAD")


@query("outlier_mad_grouped", sql=roles.with_roles(
    "SELECT event_id, event_type, value, outlier_label FROM lab",
    lab=_mad_label_sql("events", "event_type", "value", "'click', 'error', 'purchase', 'view'", "outlier_label")))
def outlier_mad_grouped(spark, sf_dir):
    # 'signup' is deliberately not listed: its rows must get a NULL label.
    ev = roles.table(spark, sf_dir, "events").select("event_id", "event_type", "value")
    return ol.detect_outliers(ev, "value", "outlier_label", "MAD", by="event_type",
                              by_vals=["click", "error", "purchase", "view"])


@query("outlier_iqr_global", sql="""
WITH q AS (SELECT quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM events)
SELECT event_id, value, CASE WHEN coalesce(value > q1 - 3.0::DOUBLE * (q3 - q1) AND value < q3 + 3.0::DOUBLE * (q3 - q1), false)
  THEN 'Normal' ELSE 'Outlier' END AS outlier_label
FROM events, q""")
def outlier_iqr_global(spark, sf_dir):
    ev = roles.table(spark, sf_dir, "events").select("event_id", "value")
    return ol.detect_outliers(ev, "value", "outlier_label", "Quartile")


@query("outlier_iqr_grouped", sql=f"""
WITH q AS (SELECT event_type, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3
           FROM events WHERE event_type IN ({_EV_LIST}) GROUP BY 1)
SELECT e.event_id, e.event_type, e.value,
  CASE WHEN e.event_type IN ({_EV_LIST}) THEN
    (CASE WHEN coalesce(e.value > q1 - 3.0::DOUBLE * (q3 - q1) AND e.value < q3 + 3.0::DOUBLE * (q3 - q1), false)
      THEN 'Normal_' ELSE 'Outlier_' END) || 'event_type-' || e.event_type END AS outlier_label
FROM events e LEFT JOIN q USING (event_type)""")
def outlier_iqr_grouped(spark, sf_dir):
    ev = roles.table(spark, sf_dir, "events").select("event_id", "event_type", "value")
    return ol.detect_outliers(ev, "value", "outlier_label", "Quartile", by="event_type", by_vals=EVENT_TYPES)


# --------------------------------------------------------------------------- two-stage removal
def two_stage_sql(src: str, value: str, by: str, vals: str, entity: str, first: str, second: str) -> dict[str, str]:
    """SQL twin of outliers.two_stage over relation ``src``: its CTEs, the last one named ``s2``."""
    return {
        "lab": _mad_label_sql(src, by, value, vals, first),
        "s1": f"SELECT * FROM lab WHERE {first} IS NULL OR contains({first}, 'Normal')",
        "top": f"SELECT {entity} FROM s1 GROUP BY 1 ORDER BY stddev_samp({value}) DESC NULLS LAST, {entity} LIMIT 2",
        "s2": f"""
SELECT s1.*, CASE WHEN t.{entity} IS NOT NULL THEN (CASE WHEN coalesce(abs(0.6745::DOUBLE * (s1.{value} - st.med)) > 3.0::DOUBLE * dv.mad, false)
    THEN 'Outlier_' ELSE 'Normal_' END) || '{entity}-' || CAST(s1.{entity} AS VARCHAR) END AS {second}
FROM s1 LEFT JOIN top t USING ({entity})
LEFT JOIN (SELECT {entity}, median({value}) AS med FROM s1 WHERE {entity} IN (SELECT {entity} FROM top) GROUP BY 1) st USING ({entity})
LEFT JOIN (SELECT x.{entity}, avg(abs(x.{value} - mu.mu)) AS mad FROM s1 x JOIN (SELECT {entity}, avg({value}) AS mu FROM s1 GROUP BY 1) mu USING ({entity})
           WHERE x.{entity} IN (SELECT {entity} FROM top) GROUP BY 1) dv USING ({entity})
WHERE t.{entity} IS NULL OR NOT coalesce(abs(0.6745::DOUBLE * (s1.{value} - st.med)) > 3.0::DOUBLE * dv.mad, false)""",
    }


_TWO = ("outliers_target_type", "outliers_target_user")


@query("outlier_two_stage", sql=roles.with_roles(
    f"SELECT event_id, event_type, user_id, value, {', '.join(_TWO)} FROM s2",
    **two_stage_sql("events", "value", "event_type", _EV_LIST, "user_id", *_TWO)))
def outlier_two_stage(spark, sf_dir):
    """Stage 1: MAD by event type; stage 2: MAD within the two most variable users of what stage 1 kept."""
    out = ol.two_stage(roles.table(spark, sf_dir, "events"), "value", "event_type", EVENT_TYPES, "user_id", 2, *_TWO)
    return out.select("event_id", "event_type", "user_id", "value", *_TWO)
