"""Score, grade and breakdown of a page from its recommendations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webgauge.functions.text import round_half_up
from webgauge.operators.rules import BUCKETS, PRIORITIES, recommendations

# Weights of the buckets and lower bounds of the grades.
WEIGHTS = {"basic": 0.4, "content": 0.3, "technical": 0.2, "performance": 0.1}
GRADES = (("A", 90), ("B", 75), ("C", 60), ("D", 40))


def bucket_points(recs: Column, bucket: str) -> Column:
    """What is left of 100 after the deductions of one bucket."""
    lost = F.filter(recs, lambda r: r["category"] == BUCKETS[bucket])["points"]
    return F.lit(100) - F.aggregate(lost, F.lit(0), lambda total, p: total + p)


def clamp(x: Column) -> Column:
    return F.greatest(F.lit(0), F.least(F.lit(100), x)).cast("int")


def weighted(buckets: dict[str, Column]) -> Column:
    """Rounded weighted mean of the buckets, summed in double arithmetic in a fixed order."""
    basic, content, technical, performance = (
        buckets[name].cast("double") * F.lit(weight).cast("double") for name, weight in WEIGHTS.items()
    )
    return round_half_up(basic + content + technical + performance).cast("int")


def grade_of(score: Column) -> Column:
    grade = F.when(score >= GRADES[0][1], GRADES[0][0])
    for name, bound in GRADES[1:]:
        grade = grade.when(score >= bound, name)
    return F.when(score.isNotNull(), grade.otherwise("F"))


def by_priority(recs: Column) -> Column:
    """Stable order: high, medium, low, then rule order."""

    def of(priority: str) -> Column:
        return F.filter(recs, lambda r: r["priority"] == priority)

    return F.concat(*[of(priority) for priority in PRIORITIES])


def seo_score(pages: DataFrame, broken: str | None = None) -> DataFrame:
    """Add ``recommendations, score, grade`` and the four buckets; null for pages not fetched.

    ``broken`` names a column with the number of broken links to deduct for. By default it is left
    out: pages are scored before their links are checked.
    """
    usable = F.col("usable")
    found = pages.withColumn("recs", F.when(usable, recommendations(broken)))
    left = found.withColumns({f"raw_{b}": bucket_points(F.col("recs"), b) for b in BUCKETS})
    final = left.withColumn("raw_score", weighted({b: F.col(f"raw_{b}") for b in BUCKETS}))
    kept = [c for c in pages.columns]
    return final.select(
        *kept,
        by_priority(F.col("recs")).alias("recommendations"),
        F.when(usable, clamp(F.col("raw_score"))).alias("score"),
        grade_of(F.col("raw_score")).alias("grade"),
        *[F.when(usable, clamp(F.col(f"raw_{b}"))).alias(f"score_{b}") for b in BUCKETS],
    )
