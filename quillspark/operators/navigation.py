"""Units without content of their own: section dividers, tables of contents, closing slides."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MOST_DIVIDER_LINES, MOST_TOC_CHARS, MOST_CLOSING_CHARS = 4, 10, 60
TOC_WORD, CLOSING_WORD = "目次", "ご清聴"
#: Lines that count as digits only: decimal digits of any script and digit-like signs such as superscripts and circled ones.
DIGITS = r"^[\p{Nd}²³¹⁰⁴-⁹₀-₉①-⑨⑴-⑼⒈-⒐⓪⓵-⓽⓿❶-❾➀-➈➊-➒]+$"


def is_navigation(text: Column) -> Column:
    body = F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)\A\s+|\s+\z", "")
    raw = F.split(body, "\n")
    lines = F.filter(F.transform(raw, lambda x: F.regexp_replace(x, r"(?U)\A\s+|\s+\z", "")), lambda x: x != "")
    head, rest = F.get(lines, F.lit(0)), F.slice(lines, F.lit(2), F.greatest(F.size(lines) - 1, F.lit(0)))
    divider = (F.size(raw) <= MOST_DIVIDER_LINES) & (F.size(lines) >= 2) & head.rlike(DIGITS) & ~F.exists(rest, lambda x: x.rlike(DIGITS))
    contents = head.contains(TOC_WORD) & (F.length(head) <= MOST_TOC_CHARS)
    closing = body.startswith(CLOSING_WORD) & (F.length(body) <= MOST_CLOSING_CHARS)
    return F.coalesce(divider, F.lit(False)) | F.coalesce(contents, F.lit(False)) | closing


def marked(units: DataFrame, text: str = "text", source: str = "source") -> DataFrame:
    """units with is_nav and dropped; a source of nothing but navigation keeps all its units.

    Whether a source has any content is one flag per source, aggregated on the map side and joined back.
    """
    flagged = units.withColumn("is_nav", is_navigation(F.col(text)))
    whole = flagged.groupBy(F.col(source).alias("_source")).agg(F.bool_and("is_nav").alias("_all"))
    return flagged.join(whole, F.col(source).eqNullSafe(F.col("_source"))).withColumn("dropped", F.col("is_nav") & ~F.col("_all")).drop("_source", "_all")


def dropped_positions(flagged: DataFrame, source: str = "source", kind: str = "location_type", place: str = "location") -> DataFrame:
    """(source, location_type, positions): where units were dropped, in order."""
    return flagged.where("dropped").groupBy(source, kind).agg(F.array_join(F.transform(F.array_sort(F.collect_list(place)), lambda x: x.cast("string")), ", ").alias("positions"))


def numbered_locations(units: DataFrame, source: str, seq: str) -> DataFrame:
    """units with location, the running number of kept units within their source."""
    return units.withColumn("location", F.row_number().over(Window.partitionBy(source).orderBy(seq)))
