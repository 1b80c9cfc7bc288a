"""One-row aggregates of many expressions that stay in whole-stage codegen."""

from __future__ import annotations

from pyspark.sql import functions as F

# Buffer fields of one aggregate: whole-stage codegen is disabled above spark.sql.codegen.maxFields = 100 in one operator.
MAX_SLOTS = 90


def one_row_agg(df, specs, max_slots: int = MAX_SLOTS):
    """One-row aggregate of ``specs`` [(alias, expression, slots)], split into several
    aggregates of at most ``max_slots`` buffer fields so each stays in whole-stage codegen.

    On a columnar source every chunk reads only its own columns, so splitting
    does not re-read data; the one-row results are joined by broadcast.
    """
    chunks, cur, used = [], [], 0
    for alias, expr, slots in specs:
        if cur and used + slots > max_slots:
            chunks.append(cur)
            cur, used = [], 0
        cur.append(expr.alias(alias))
        used += slots
    if cur:
        chunks.append(cur)
    out = df.agg(*chunks[0])
    for c in chunks[1:]:
        out = out.crossJoin(F.broadcast(df.agg(*c)))
    return out
