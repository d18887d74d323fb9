"""Small result tables as JSON, Markdown or LaTeX text, and the data of figures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veclore.operators.ranks import quantiles


def cell(c: Column, kind: str, digits: int = 4) -> Column:
    """A value as report text: numbers with ``digits`` decimals, ``NA`` for NULL and non-finite ones."""
    if kind in ("double", "float"):
        return F.when(c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")), "NA").otherwise(F.format_string(f"%.{digits}f", c))
    return F.coalesce(c.cast("string"), F.lit("NA"))


def text_rows(rows: DataFrame, style: str = "markdown", digits: int = 4) -> DataFrame:
    """(line): one formatted line per row, made by Spark; see ``head_lines`` for what stands above them."""
    cells = [cell(F.col(c), k, digits) for c, k in rows.dtypes]
    if style == "latex":
        line = F.concat(F.concat_ws(" & ", *(F.regexp_replace(c, r"([%&_#])", r"\\$1") for c in cells)), F.lit(r" \\"))
    else:
        line = F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |"))
    return rows.select(line.alias("line"))


def head_lines(columns: list[str], style: str = "markdown") -> list[str]:
    if style == "latex":
        return [" & ".join(c.replace("_", r"\_") for c in columns) + r" \\", r"\hline"]
    return ["| " + " | ".join(columns) + " |", "|" + "---|" * len(columns)]


def json_rows(rows: DataFrame) -> DataFrame:
    """(line): one JSON object per row; NaN stays NaN, NULL fields are kept."""
    return rows.select(F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false"}).alias("line"))


def histogram(rows: DataFrame, group: str, value: str, low: float, high: float, bins: int) -> DataFrame:
    """(group, bin, n) of equal bins over [low, high]; values outside fall into bins 0 and bins + 1."""
    held = rows.where(F.col(value).isNotNull()).select(group, F.width_bucket(F.col(value).cast("double"), F.lit(float(low)), F.lit(float(high)), F.lit(bins)).cast("int").alias("bin"))
    return held.groupBy(group, "bin").agg(F.count("*").alias("n"))


def box(rows: DataFrame, group: str, value: str) -> DataFrame:
    """(group, n, q1, median, q3, low, high): quartiles, and the outermost values within 1.5 box lengths of the box."""
    held = rows.where(F.col(value).isNotNull()).select(group, F.col(value).cast("double").alias("v"))
    q = held.groupBy(group).agg(F.count("*").alias("n")).join(quantiles(held, [group], "v", {"q1": 0.25, "median": 0.5, "q3": 0.75}), group)
    reach = 1.5 * (F.col("q3") - F.col("q1"))
    inside = held.join(q, group).where((F.col("v") >= F.col("q1") - reach) & (F.col("v") <= F.col("q3") + reach))
    return inside.groupBy(group).agg(*(F.first(c).alias(c) for c in ("n", "q1", "median", "q3")), F.min("v").alias("low"), F.max("v").alias("high"))


def density(rows: DataFrame, group: str, x: str, y: str, step: float) -> DataFrame:
    """(group, x_bin, y_bin, n): the rows of each square of ``step``, for scatter and density figures. Rows without two finite values are left out."""
    good = [F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")) for c in (x, y)]
    bins = [F.floor(F.col(c) / step).alias(f"{n}_bin") for c, n in ((x, "x"), (y, "y"))]
    return rows.where(good[0] & good[1]).groupBy(group, *bins).agg(F.count("*").alias("n"))


def ellipses(rows: DataFrame, group: str, x: str, y: str, reach: float = 5.991465) -> DataFrame:
    """(group, n, x, y, long, short, angle): centre, half axes and angle in degrees of the ellipse that holds the share ``reach`` (a
    chi-squared quantile of two degrees, here 95 %) of a normal distribution. Groups of one row give NULL axes."""
    both = rows.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    m = both.groupBy(group).agg(F.count("*").alias("n"), F.avg(x).alias("x"), F.avg(y).alias("y"), F.var_samp(x).alias("a"), F.var_samp(y).alias("b"), F.covar_samp(x, y).alias("c"))
    spread = F.sqrt((F.col("a") - F.col("b")) ** 2 / 4 + F.col("c") ** 2)
    half = lambda s: F.sqrt(reach * F.greatest((F.col("a") + F.col("b")) / 2 + s, F.lit(0.0)))
    angle = F.degrees(F.atan2(2 * F.col("c"), F.col("a") - F.col("b")) / 2)
    several = lambda c: F.when(F.col("n") > 1, c)
    return m.select(group, "n", "x", "y", several(half(spread)).alias("long"), several(half(-spread)).alias("short"), several(angle).alias("angle"))
