"""What several sections of one analysis need of its table, from a fixed number of scans.

1. the quantile sketch of the numeric columns (row count, means);
2. one aggregate of all one-row values: missing values, volume, moments and shapes, KPI sums, date bounds and the exact
   counts of the quartiles' brackets (many columns in parts, as an aggregate has at most about 90 sums);
3. the values inside the brackets;
4. the value frequencies of the other columns;
5. the distinct rows (of wide rows: their digests, then the rows of repeated ones);
6. the Gram matrix of the numeric columns, for correlations and covariances.

Each is computed when first asked for and then kept: one-row values, pairs and quartiles as rows of the driver, value
frequencies as a saved table. The sections' own functions take them as arguments and scan for themselves without.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import categorical_columns, num, numeric_columns
from ..operators import brackets, dashboard, profile, stats
from ..session import saved


class Shared:
    def __init__(self, df: DataFrame):
        self.df, self.spark, self.numeric = df, df.sparkSession, numeric_columns(df)

    @cached_property
    def _summary(self) -> tuple:
        """(quartiles by column, sketch, one-row values) of scans 1 to 3."""
        df, numeric = self.df, self.numeric

        def specs(sketch):
            return (profile.missing_specs(df) + profile.volume_specs(df) + dashboard.kpi_specs(df) + dashboard.bound_specs(df)
                    + profile.summary_specs(df, numeric) + stats.shape_specs(df, numeric, sketch.mean))

        return brackets.column_quantiles(df, numeric, profile.SUMMARY_PROBS, more=specs)

    @property
    def quartiles(self) -> dict[str, list]:
        return self._summary[0]

    @property
    def means(self) -> dict[str, float]:
        return self._summary[1].mean

    @property
    def row(self) -> dict:
        return self._summary[2]

    @cached_property
    def one(self) -> DataFrame:
        """The one-row values of missing_specs, volume_specs, kpi_specs and bound_specs as a table."""
        specs = profile.missing_specs(self.df) + profile.volume_specs(self.df) + dashboard.kpi_specs(self.df) + dashboard.bound_specs(self.df)
        schema = self.df.agg(*[e.alias(a) for a, e, _ in specs]).schema
        return self.spark.createDataFrame([tuple(self.row[f.name] for f in schema.fields)], schema)

    @cached_property
    def duplicates(self) -> DataFrame:
        found = profile.duplicate_rows(self.df)
        return self.spark.createDataFrame([tuple(found.first())], found.schema)

    @cached_property
    def frequencies(self) -> DataFrame:
        """(column_name, value, count) of the non-numeric columns."""
        columns = categorical_columns(self.df)
        if not columns:
            return self.spark.createDataFrame([], "column_name string, value string, count long")
        return saved(profile.value_frequencies(self.df, columns))

    @cached_property
    def _gram(self):
        dev = self.df.select(*[(num(self.df, c) - F.lit(self.means[c])).alias(f"d{i}") for i, c in enumerate(self.numeric)])
        return profile.gram_sums(dev, len(self.numeric))

    def pairs(self, kind: str) -> DataFrame:
        """(a, b, i, j, r or cov, n): correlations ("corr") or covariances ("cov") of all numeric columns."""
        name = "r" if kind == "corr" else "cov"
        if len(self.numeric) < 2:
            return self.spark.createDataFrame([], f"a string, b string, i int, j int, {name} double, n long")
        return profile.pair_table(self.spark, self._gram, self.numeric, kind).withColumnRenamed("value", name)

    def numeric_summary(self) -> DataFrame:
        return self.spark.createDataFrame(profile.summary_rows(self.df, self.numeric, self.quartiles, self.row), profile.SUMMARY_SCHEMA)

    def descriptive_stats(self) -> DataFrame:
        return stats.descriptive_table(self.df, self.numeric, self.quartiles, self.row)
