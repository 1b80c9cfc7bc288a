"""Intent tagging of free-text requests (I1-I3), as a batch job over a column.

Every intent's hit count is a sum of ``contains`` / ``rlike`` tests with
literal patterns, so the whole tagger is one projection (whole-stage
codegen, no UDF); one query row becomes nine (intent) rows via ``inline``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Intents in priority order with their keywords, regular
# expressions and tasks (id, title, step). These must equal the reference's
# rules for the scores and tasks to match.
INTENTS = [
    ("sales_analysis",
     ["satış", "satis", "ciro", "revenue", "sales", "sipariş", "order"],
     [r"ayl[iı]k\s+ciro", r"sat[iı][sş]\s+analiz"],
     [("profile", "Veriyi profille", "data_profiler"), ("stats", "Satış istatistikleri", "statistics"),
      ("dashboard", "Satış dashboard", "dashboard_builder"), ("forecast", "Ciro tahmini", "forecast"),
      ("report", "Satış raporu", "reporting")]),
    ("dashboard",
     ["dashboard", "panel", "kpi", "gösterge", "gosterge", "ekran"],
     [r"dashboard\s+haz[iı]rla"],
     [("profile", "Veriyi profille", "data_profiler"), ("viz", "Grafik öner", "visualization_advisor"),
      ("dashboard", "Dashboard oluştur", "dashboard_builder")]),
    ("forecast",
     ["tahmin", "forecast", "projeksiyon", "gelecek", "öngörü", "ongoru"],
     [r"\d+\s*(hafta|ay|y[iı]l)"],
     [("profile", "Veriyi profille", "data_profiler"), ("forecast", "Tahmin üret", "forecast"),
      ("report", "Tahmin raporu", "reporting")]),
    ("profit_loss",
     ["kâr", "kar", "zarar", "profit", "loss", "gelir", "gider", "pnl"],
     [r"k[aâ]r[- ]?zarar"],
     [("profile", "Veriyi profille", "data_profiler"), ("stats", "Kâr-zarar istatistikleri", "statistics"),
      ("dashboard", "Kâr-zarar dashboard", "dashboard_builder"), ("report", "Finansal özet", "reporting")]),
    ("hr_dashboard",
     ["personel", "ik", "hr", "çalışan", "calisan", "maaş", "maas", "izin"],
     [r"personel\s+dashboard"],
     [("profile", "Personel verisini profille", "data_profiler"),
      ("dashboard", "Personel dashboard", "dashboard_builder"), ("report", "İK özeti", "reporting")]),
    ("document_tracking",
     ["belge", "doküman", "dokuman", "document", "takip", "tracking"],
     [r"belge\s+takip"],
     [("profile", "Belge verisini profille", "data_profiler"),
      ("dashboard", "Belge takip paneli", "dashboard_builder"), ("report", "Belge durum raporu", "reporting")]),
    ("cleaning",
     ["temizle", "eksik", "duplicate", "outlier", "cleaning", "doğrula"],
     [r"veri\s+temiz"],
     [("clean", "Temizleme planı çıkar", "data_cleaner"), ("profile", "Temizlik sonrası profil", "data_profiler")]),
    ("statistics",
     ["istatistik", "korelasyon", "regresyon", "anova", "hipotez", "normalite"],
     [r"istatistiksel\s+analiz"],
     [("stats", "İstatistiksel analiz", "statistics"), ("report", "İstatistik raporu", "reporting")]),
    ("general_analysis",
     ["analiz", "incele", "özet", "ozet", "keşfet", "kesfet"],
     [],
     [("profile", "Veri profili çıkar", "data_profiler"), ("stats", "İstatistiksel analiz yap", "statistics"),
      ("ml", "ML yaklaşımı öner", "ml_advisor"), ("dashboard", "Dashboard oluştur", "dashboard_builder"),
      ("report", "Rapor hazırla", "reporting")]),
]
# Tasks used when no intent yields any task.
FALLBACK_TASKS = [("profile", "Veri profili çıkar", "data_profiler"), ("stats", "İstatistiksel analiz yap", "statistics"),
                  ("dashboard", "Dashboard oluştur", "dashboard_builder"), ("report", "Rapor hazırla", "reporting")]
BASE_SCORE, HIT_SCORE = 0.35, 0.2
EMPTY_CONFIDENCE, NO_HIT_CONFIDENCE = 0.5, 0.4
DEFAULT_INTENT = "general_analysis"


def _hits(lq: Column, keywords: list[str], patterns: list[str]) -> Column:
    terms = [F.contains(lq, F.lit(k.lower())).cast("int") for k in keywords]
    terms += [lq.rlike("(?iu)" + p).cast("int") for p in patterns]
    return sum(terms[1:], terms[0]) if terms else F.lit(0)


def intent_scores(df: DataFrame, text_col: str, id_cols: list[str] | None = None) -> DataFrame:
    """(ids..., query, intent, intent_ord, hits, score) for every intent with at least one hit."""
    id_cols = id_cols or []
    lq = F.lower(F.trim(F.coalesce(F.col(text_col), F.lit(""))))
    rows = F.array(*[F.struct(F.lit(name).alias("intent"), F.lit(i).alias("intent_ord"),
                              _hits(lq, kws, pats).alias("hits")) for i, (name, kws, pats, _) in enumerate(INTENTS)])
    out = df.select(*id_cols, F.col(text_col).alias("query"), F.inline(rows)).where(F.col("hits") > 0)
    return out.withColumn("score", F.least(F.lit(1.0), BASE_SCORE + HIT_SCORE * F.col("hits")))


def primary_intent(df: DataFrame, text_col: str, id_cols: list[str] | None = None) -> DataFrame:
    """(ids..., query, primary_intent, confidence, matched) — best score, ties by intent order;
    empty text -> general analysis 0.5, no hit -> general analysis 0.4."""
    id_cols = id_cols or []
    lq = F.lower(F.trim(F.coalesce(F.col(text_col), F.lit(""))))
    rows = F.array(*[F.struct(F.lit(name).alias("intent"), F.lit(i).alias("intent_ord"),
                              _hits(lq, kws, pats).alias("hits")) for i, (name, kws, pats, _) in enumerate(INTENTS)])
    scored = F.transform(F.filter(rows, lambda r: r["hits"] > 0),
                         lambda r: F.struct(F.least(F.lit(1.0), BASE_SCORE + HIT_SCORE * r["hits"]).alias("score"),
                                            (-r["intent_ord"]).alias("neg_ord"), r["intent"].alias("intent")))
    ranked = F.reverse(F.array_sort(scored))  # score desc, then intent order asc
    empty = F.length(F.trim(F.coalesce(F.col(text_col), F.lit("")))) == 0
    top = F.element_at(ranked, 1)
    return df.select(
        *id_cols, F.col(text_col).alias("query"),
        F.when(empty | (F.size(ranked) == 0), F.lit(DEFAULT_INTENT)).otherwise(top["intent"]).alias("primary_intent"),
        F.when(empty, F.lit(EMPTY_CONFIDENCE)).when(F.size(ranked) == 0, F.lit(NO_HIT_CONFIDENCE))
        .otherwise(top["score"]).alias("confidence"),
        F.when(empty | (F.size(ranked) == 0), F.array(F.lit(DEFAULT_INTENT)))
        .otherwise(F.transform(ranked, lambda r: r["intent"])).alias("matched"))


def intent_tasks(df: DataFrame, text_col: str, id_cols: list[str] | None = None) -> DataFrame:
    """(ids..., query, task_rank, task_id, title, agent) — tasks of the matched intents in rank
    order, first occurrence of each id kept."""
    id_cols = id_cols or []
    tasks = F.create_map(*[x for name, _, _, ts in INTENTS for x in (
        F.lit(name), F.array(*[F.struct(F.lit(t[0]).alias("id"), F.lit(t[1]).alias("title"), F.lit(t[2]).alias("agent"))
                               for t in ts]))])
    p = primary_intent(df, text_col, id_cols)
    all_tasks = F.flatten(F.transform(F.col("matched"), lambda m: F.coalesce(tasks[m], F.array().cast(
        "array<struct<id:string,title:string,agent:string>>"))))
    fallback = F.array(*[F.struct(F.lit(t[0]).alias("id"), F.lit(t[1]).alias("title"), F.lit(t[2]).alias("agent"))
                         for t in FALLBACK_TASKS])
    chosen = F.when(F.size(all_tasks) == 0, fallback).otherwise(all_tasks)
    ids = F.transform(chosen, lambda t: t["id"])
    indexed = F.transform(chosen, lambda t, i: F.struct(t.alias("t"), i.alias("i")))
    # keep a task only if its id does not occur earlier in the list (one projection, no shuffle)
    dedup = F.filter(indexed, lambda x: ~F.array_contains(F.slice(ids, F.lit(1), x["i"]), x["t"]["id"]))
    return p.select(*id_cols, "query", F.posexplode(dedup).alias("pos", "x")).select(
        *id_cols, "query", (F.col("pos") + 1).alias("task_rank"), F.col("x.t.id").alias("task_id"),
        F.col("x.t.title").alias("title"), F.col("x.t.agent").alias("agent"))
