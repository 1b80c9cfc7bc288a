"""End-to-end analysis (G7): every section as a lazy table over one shared input.

``analyze`` wires the operators the way the reference's orchestrator runs its
steps (intent -> profile -> cleaning plan -> statistics -> advice -> forecast
-> dashboard -> report). What several sections need is computed once
(``shared``). Every table is written once to the checkpoint folder,
so a table that fails, when built or when run, is reported in ``errors`` and
the others still run; the report and ``summary`` read the written tables.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import advice, clean, dashboard, forecast, intent, profile, report, stats
from ..session import stable
from .shared import Shared

CONCURRENT_TABLES = 4


def analyze(df: DataFrame, query: str = "", source: str | None = None, keys: list[str] | None = None,
            with_forecast: bool = True, forecast_models: list[str] | None = None) -> dict[str, DataFrame]:
    """Result tables by name (``section`` or ``section.table``) and ``errors`` (section, error) of those that failed."""
    spark = df.sparkSession
    shared = Shared(df)
    out: dict[str, DataFrame] = {}
    errors: list[tuple[str, str]] = []
    q = spark.createDataFrame([(query,)], "query string")

    def attempt(name, build):
        try:
            return build()
        except Exception as exc:  # noqa: BLE001 - one section must not stop the others
            errors.append((name, str(exc)))
            return None

    def run(sections: dict) -> None:
        lazy = {}
        for name, build in sections.items():
            res = attempt(name, build)
            lazy.update({f"{name}.{k}": v for k, v in res.items()} if isinstance(res, dict) else {name: res} if res is not None else {})
        with ThreadPoolExecutor(CONCURRENT_TABLES) as pool:
            done = pool.map(lambda kv: (kv[0], attempt(kv[0], lambda: stable(kv[1]))), lazy.items())
            out.update({name: table for name, table in done if table is not None})

    def under(section: str) -> dict[str, DataFrame]:
        return {k.split(".", 1)[1]: v for k, v in out.items() if k.startswith(section + ".")}

    run({
        "intent": lambda: intent.primary_intent(q, "query"),
        "tasks": lambda: intent.intent_tasks(q, "query"),
        "profile": lambda: profile.profile(df, shared),
        "cleaning_plan": lambda: clean.plan(df, shared.one, shared.duplicates),
        "statistics": lambda: stats.statistics(df, shared=shared),
        "model_advice": lambda: advice.model_advice(df),
        "data_signals": lambda: advice.data_signals(df),
        "chart_advice": lambda: advice.chart_advice(df),
        **({"forecast": lambda: forecast.forecast(df, keys=keys, models=forecast_models)} if with_forecast else {}),
        "kpis": lambda: dashboard.kpis(df, one=shared.one),
        "filters": lambda: dashboard.filter_options(df, freq=shared.frequencies),
        "date_bounds": lambda: dashboard.date_bounds(df, one=shared.one),
        "charts": lambda: dashboard.chart_specs(df),
    })
    if under("statistics"):
        run({"notes": lambda: stats.notes(under("statistics"))})
    run({"report": lambda: report.report_lines(df, query, source, out.get("forecast.choice"), out.get("forecast.series"),
                                               out.get("notes"), shared)})
    out["errors"] = spark.createDataFrame(sorted(errors), "section string, error string")
    return out


def summary(results: dict[str, DataFrame]) -> DataFrame:
    """Every result table as JSON lines (table, row) — written with any Spark writer."""
    parts = [frame.select(F.lit(name).alias("table"),
                          F.to_json(F.struct(*[F.col(f"`{c}`") for c in frame.columns])).alias("row"))
             for name, frame in results.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
