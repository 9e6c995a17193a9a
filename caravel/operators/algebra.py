"""A small table algebra over results, and metric x dimension measurements with verdicts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caravel.functions import stats

AGGREGATES = {"sum": F.sum, "avg": F.avg, "min": F.min, "max": F.max, "count": F.count}
TESTS = {
    "=": lambda c, v: c == v, "!=": lambda c, v: ~c.eqNullSafe(F.lit(v)), ">": lambda c, v: c > v, ">=": lambda c, v: c >= v,
    "<": lambda c, v: c < v, "<=": lambda c, v: c <= v, "in": lambda c, v: c.isin(v), "contains": lambda c, v: F.lower(c).contains(v.lower()),
}


def summarise(df: DataFrame, group_by: str | None, measures: list[tuple[str, str]], where: list[tuple[str, str, object]] = [], sort: str | None = None, descending: bool = True, limit: int | None = None) -> DataFrame:  # noqa: B006
    """filter, group by one column, aggregate (name, column), sort, limit."""
    rows = reduce(lambda d, w: d.filter(TESTS[w[1]](F.col(w[0]), w[2])), where, df)
    aggs = [AGGREGATES[name](F.col(column) if column != "*" else F.lit(1)).alias(f"{name}_{column}" if column != "*" else "rows") for name, column in measures]
    found = rows.groupBy(*([group_by] if group_by else [])).agg(*aggs)
    if sort:
        key = F.col(sort)
        found = found.orderBy(key.desc_nulls_last() if descending else key.asc_nulls_last(), *([group_by] if group_by else []))
    return found.limit(limit) if limit else found


def combine(a: DataFrame, b: DataFrame, on: str) -> DataFrame:
    """a with b's columns on one key; columns that clash get `_2`, rows without a partner
    have matched = false.
    """
    right = b.withColumnsRenamed({c: f"{c}_2" for c in b.columns if c in a.columns and c != on}).withColumn("matched", F.lit(True))
    return a.join(right, on, "left").withColumn("matched", F.coalesce("matched", F.lit(False)))


def compare(a: DataFrame, b: DataFrame) -> DataFrame:
    """For each numeric column of both one-row results: figure, a, b, change, change_pct."""
    shared = [f.name for f in a.schema if f.name in b.columns and f.dataType.typeName() in ("long", "integer", "double", "float", "decimal")]
    long = lambda df, name: df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("figure"), F.col(c).cast("double").alias(name)) for c in shared])).alias("x")).select("x.*")
    both = long(a, "a").join(long(b, "b"), "figure")
    return both.withColumn("change", F.col("b") - F.col("a")).withColumn("change_pct", F.round(100 * (F.col("b") - F.col("a")) / F.nullif("a", F.lit(0.0)), 1))


#: metric: (kind, value column builder, unit floor). A rate's value is 0 or 1.
METRICS = {
    "completion": ("rate", lambda: F.when(F.col("outcome").isNotNull(), (F.col("outcome") == "completed").cast("double")), 0.03),
    "cancellation": ("rate", lambda: F.when(F.col("outcome").isNotNull(), (F.col("outcome") == "not_completed").cast("double")), 0.03),
    "fare": ("mean", lambda: F.when(F.col("has_fare"), F.col("price").cast("double")), 5.0),
    "distance": ("mean", lambda: F.when(F.col("has_distance"), F.col("distance_km")), 0.5),
}
DIMENSIONS = {
    "platform": lambda: F.col("platform"),
    "fleet": lambda: F.col("fleet_id"),
    "product": lambda: F.col("product"),
    "dow": lambda: F.col("local_dow").cast("string"),
    "hour": lambda: F.col("local_hour").cast("string"),
    "daypart": lambda: F.col("daypart"),
    "settlement": lambda: F.col("settlement_class"),
}
#: A metric says nothing about a dimension that it is made of.
TAUTOLOGIES = {("fare", "settlement")}


def measure(rows: DataFrame, metric: str, dimension: str, value: str) -> DataFrame:
    """One row: the segment `dimension = value` against the rest (null is rest)."""
    if (metric, dimension) in TAUTOLOGIES:
        raise ValueError(f"{metric} by {dimension} is true by definition")
    kind, build, _ = METRICS[metric]
    inside = DIMENSIONS[dimension]().eqNullSafe(F.lit(value))
    x = build().alias("x")
    both = rows.select(inside.alias("inside"), x).filter("x is not null")
    side = lambda p, name: [F.count(F.when(p, 1)).alias(f"n_{name}"), F.avg(F.when(p, F.col("x"))).alias(f"m_{name}"), F.stddev_samp(F.when(p, F.col("x"))).alias(f"s_{name}")]
    found = both.agg(*side(F.col("inside"), "in"), *side(~F.col("inside"), "out"))
    if kind == "rate":
        p = stats.two_proportion_p(F.col("m_in") * F.col("n_in"), F.nullif("n_in", F.lit(0)), F.col("m_out") * F.col("n_out"), F.nullif("n_out", F.lit(0)))
    else:
        p = stats.welch_p(F.col("m_in"), F.col("s_in"), F.nullif("n_in", F.lit(0)), F.col("m_out"), F.col("s_out"), F.nullif("n_out", F.lit(0)))
    return found.withColumn("effect", F.col("m_in") - F.col("m_out")).withColumn("p", p)


def adjudicated(measured: DataFrame, metric: str, higher: bool) -> DataFrame:
    """unsupported, immaterial, refuted or confirmed, by rows, sign, size and chance."""
    kind, _, floor = METRICS[metric]
    size = F.abs("effect")
    small = size < floor
    if kind == "mean":
        small = small | (size < 0.15 * F.abs("m_out"))
    wrong = F.col("effect") < 0 if higher else F.col("effect") > 0
    verdict = (
        F.when((F.col("n_in") == 0) | (F.col("n_out") == 0), "unsupported")
        .when((F.col("n_in") < 30) | (F.col("n_out") < 30), "immaterial")
        .when(wrong, "refuted")
        .when(small | (F.col("p") > 0.05), "immaterial")
        .otherwise("confirmed")
    )
    return measured.withColumn("verdict", verdict)


def scoped(df: DataFrame, fleets: list[str] | None, column: str = "fleet_id") -> DataFrame:
    """Row-level scope: only these fleets, before anything is aggregated; None is all."""
    return df if fleets is None else df.filter(F.col(column).isin(fleets))


def withheld(df: DataFrame, hidden: set[str]) -> DataFrame:
    """Field-level redaction: hidden columns are null, their types kept."""
    return df.select(*[F.lit(None).cast(f.dataType).alias(f.name) if f.name in hidden else F.col(f.name) for f in df.schema])
