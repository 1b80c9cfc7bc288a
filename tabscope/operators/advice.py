"""Advice tables (A1-A4): chart recommendations, charts to avoid, modelling
recommendations and data signals, as rule rows over one small aggregate."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import NUMERIC_TYPES, as_text, col, datetime_typed_columns, numeric_columns
from .roles import target_rank_map

PIE_MAX = 8


def _kinds(df: DataFrame, datetime_cols: list[str] | None):
    numeric = numeric_columns(df)
    categorical = [f.name for f in df.schema.fields if not isinstance(f.dataType, NUMERIC_TYPES)]
    dates = datetime_cols if datetime_cols is not None else datetime_typed_columns(df)
    return numeric, categorical, dates


def _n_distinct(df: DataFrame, c: str):
    """Exact distinct count of one column as a one-row frame (partial aggregate, then count)."""
    return (df.select(as_text(df, c).alias("v")).where(F.col("v").isNotNull()).groupBy("v").agg(F.count(F.lit(1)).alias("_c"))
            .agg(F.count(F.lit(1)).alias("nd")))


class Rule(NamedTuple):
    """One row of a rule table: it holds when every slot is filled and, where ``few`` is set, when the distinct
    count of the counted column is (True) or is not (False) small."""

    name: str
    slots: tuple[str, ...] = ()
    few: bool | None = None
    avoid: bool = False
    score: float = 0.0
    fields: tuple[str, ...] = ()  # output field filled by each slot, in the order of ``slots``


# Chart types in order of preference with the columns they need and the field each column fills.
CHART_RULES = [
    Rule("line", ("date", "measure"), fields=("x", "y")),
    Rule("area", ("date", "measure"), fields=("x", "y")),
    Rule("bar", ("category", "measure"), fields=("x", "y")),
    Rule("pie", ("category", "measure"), few=True, fields=("names", "values")),
    Rule("pie", ("category", "measure"), few=False, avoid=True),
    Rule("scatter", ("measure", "measure2"), fields=("x", "y")),
    Rule("heatmap", ("measure", "measure2")),
    Rule("histogram", ("measure",), fields=("x",)),
    Rule("3d_pie", avoid=True),
]
CHART_FALLBACK = Rule("table")
CHART_FIELDS = ["x", "y", "names", "values"]

# Labels and scores of the modelling approaches.
MODEL_RULES = [
    Rule("Forecasting", ("date", "measure"), score=0.9),
    Rule("Regresyon", ("target",), few=False, score=0.88),
    Rule("Sınıflandırma", ("target",), few=True, score=0.85),
    Rule("Kümeleme", ("measure", "measure2"), score=0.7),
    Rule("Anomali Tespiti", ("measure", "measure2"), score=0.65),
    Rule("Recommendation System", ("category", "subject"), score=0.55),
]
MODEL_FALLBACK = Rule("Keşifsel Analiz", score=0.5)


def _slots(df: DataFrame, datetime_cols: list[str] | None, targets: list[str] | None) -> dict[str, str]:
    """Slot -> column, for the slots that the table's column roles can fill."""
    numeric, categorical, dates = _kinds(df, datetime_cols)
    ranks = target_rank_map(df)
    targets = targets if targets is not None else sorted(ranks, key=ranks.get)
    filled = {"date": dates[:1], "measure": numeric[:1], "measure2": numeric[1:2], "category": categorical[:1],
              "target": [t for t in targets[:1] if t in numeric], "subject": [*targets, *numeric][:1]}
    return {slot: found[0] for slot, found in filled.items() if found}


def _fired(base: DataFrame, rules: list[Rule], fallback: Rule, slots: dict[str, str], few: Column) -> DataFrame:
    """(ord, name, avoid, score, fields map, why) of the rules that hold on the one-row ``base`` (with ``nd``)."""
    ready = [r for r in rules if set(r.slots) <= slots.keys()]
    if all(r.avoid for r in ready):
        ready.insert(0, fallback)

    def row(r: Rule) -> Column:
        found = ", ".join(f"{s} {slots[s]}" for s in r.slots)
        why = F.lit(found or "any table")
        if r.few is not None:
            why = F.concat(why, F.lit("; distinct values: "), F.col("nd").cast("string"))
        pairs = [F.lit(x) for f, s in zip(r.fields, r.slots) for x in (f, slots[s])]
        fields = F.create_map(*pairs) if pairs else F.expr("cast(map() as map<string,string>)")
        return F.struct(F.lit(r.few is None) | F.coalesce(few == F.lit(bool(r.few)), F.lit(False)), F.lit(r.name).alias("name"),
                        F.lit(r.avoid).alias("avoid"), F.lit(r.score).alias("score"), fields.alias("fields"), why.alias("why"))

    kept = F.filter(F.array(*[row(r) for r in ready]), lambda r: r["col1"])
    return base.select(F.posexplode(kept).alias("pos", "r")).select((F.col("pos") + 1).alias("ord"), "r.*").drop("col1")


def chart_advice(df: DataFrame, datetime_cols: list[str] | None = None) -> DataFrame:
    """A1 + A2: (ord, advice, chart, title, x, y, names, values, why); advice is recommend / avoid.

    ``why`` names the columns (and the distinct count) by which the rule holds.
    """
    slots = _slots(df, datetime_cols, None)
    base = (_n_distinct(df, slots["category"]) if "category" in slots
            else df.sparkSession.range(1).select(F.lit(None).cast("long").alias("nd")))
    out = _fired(base, CHART_RULES, CHART_FALLBACK, slots, F.col("nd") <= PIE_MAX)
    fields = [F.col("fields")[f] for f in CHART_FIELDS]
    title = F.when(~F.col("avoid"), F.concat_ws(": ", "name", F.nullif(F.concat_ws(", ", *fields), F.lit(""))))
    return out.select("ord", F.when(F.col("avoid"), "avoid").otherwise("recommend").alias("advice"), F.col("name").alias("chart"),
                      title.alias("title"), *[c.alias(f) for c, f in zip(fields, CHART_FIELDS)], "why")


def model_advice(df: DataFrame, datetime_cols: list[str] | None = None, targets: list[str] | None = None) -> DataFrame:
    """A3: (rank, type, score, why), best first; a target is a class label when it has at most max(15, 5% of rows) values."""
    slots = _slots(df, datetime_cols, targets)
    base = df.agg(F.count(F.lit(1)).alias("n_rows"))
    if "target" in slots:
        base = base.crossJoin(F.broadcast(_n_distinct(df, slots["target"])))
    else:
        base = base.withColumn("nd", F.lit(None).cast("long"))
    few = F.col("nd") <= F.greatest(F.lit(15), F.floor(F.col("n_rows") * 0.05))
    return _fired(base, MODEL_RULES, MODEL_FALLBACK, slots, few).select(
        F.col("ord").alias("rank"), F.col("name").alias("type"), "score", "why")


def data_signals(df: DataFrame, datetime_cols: list[str] | None = None) -> DataFrame:
    """A4: one row (n_rows, numeric_columns, categorical_columns, datetime_columns, target_candidates)."""
    numeric, categorical, dates = _kinds(df, datetime_cols)
    ranks = target_rank_map(df)
    targets = ",".join(sorted(ranks, key=ranks.get)[:5])
    return df.agg(F.count(F.lit(1)).alias("n_rows")).select(
        "n_rows", F.lit(len(numeric)).alias("numeric_columns"), F.lit(len(categorical)).alias("categorical_columns"),
        F.lit(len(dates)).alias("datetime_columns"), F.lit(targets).alias("target_candidates"))
