"""Tables of marks: totals, rankings, averages, comparisons. Columns are chosen from the schema only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

# Parts of column names, and patterns of questions in order.
NAME, NUMBER, TOTAL, RESULT = ["name", "student", "student_name"], ["usn", "roll", "roll_no", "enrollment"], ["total", "grand_total", "aggregate", "marks_total"], ["result", "status", "pass_fail"]
QUESTIONS = {
    "topper": r"(who is the topper|top student|highest total|first rank|topper name)",
    "top_n": r"(top \d+|best \d+|highest \d+ students)",
    "highest_subject": r"(who scored highest|highest marks|best score|maximum.*in)\s+\w+",
    "average": r"(average|mean)\s+(marks|score)",
    "compare": r"compare\s+.+\s+(and|vs|with)\s+",
    "pass_percentage": r"(pass percentage|pass rate|how many passed)",
    "lowest": r"(lowest|minimum|least)\s+(marks|score|total)",
    "subject_analysis": r"(subject analysis|subject wise|analyze.*subject)",
    "student_info": r"(marks of|scores? of|result of)\s+\w+",
    "rank": r"(rank|position|standing)\s+of",
}


def question_type(c: Column) -> Column:
    """The first kind of question whose pattern is found; null for none."""
    return F.coalesce(*[F.when(F.lower(c).rlike(f"(?U){p}"), F.lit(k)) for k, p in QUESTIONS.items()])


def find_column(df: DataFrame, parts: list[str]) -> str | None:
    return next((c for p in parts for c in df.columns if p in c.lower()), None)


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def subjects(df: DataFrame) -> list[str]:
    keys = {find_column(df, NAME), find_column(df, NUMBER)}
    return [c for c in numeric_columns(df) if c not in keys]


def with_total(df: DataFrame) -> DataFrame:
    """df with a column `total_marks`: its own total column, else the sum of the subjects, nulls as zero."""
    own = find_column(df, TOTAL)
    if own is None and not subjects(df):
        return df.withColumn("total_marks", F.lit(None).cast("double"))
    value = F.col(own) if own else sum((F.coalesce(F.col(c), F.lit(0)) for c in subjects(df)), F.lit(0))
    return df.withColumn("total_marks", value.cast("double"))


def extreme(df: DataFrame, column: str, order: str, highest: bool = True) -> DataFrame:
    """The row with the highest or lowest value, the first by the order on ties, as one row."""
    row = F.struct(*df.columns)
    rows = df.filter(F.col(column).isNotNull())
    best = F.max_by(row, F.struct(column, -F.col(order))) if highest else F.min_by(row, F.struct(column, order))
    return rows.agg(best.alias("r")).filter("r is not null").select("r.*")


def top_students(df: DataFrame, n: int, order: str) -> DataFrame:
    """The n best totals with their rank; a top-k of the whole table, then numbered among n rows."""
    best = with_total(df).orderBy(F.desc("total_marks"), order).limit(n)
    return best.withColumn("rank", F.row_number().over(W.orderBy(F.desc("total_marks"), order)))


def averages(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    return df.agg(*[F.round(F.avg(c), 2).alias(c) for c in columns or subjects(df)])


def subject_analysis(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(subject, average, highest, lowest, std_dev) from one aggregate over all columns, turned into rows afterwards."""
    columns = columns or subjects(df)
    named = lambda c: F.struct(F.lit(c).alias("subject"), F.round(F.avg(c), 2).alias("average"), F.max(F.col(c).cast("double")).alias("highest"), F.min(F.col(c).cast("double")).alias("lowest"), F.round(F.stddev_samp(c), 2).alias("std_dev"))
    return df.agg(F.array(*map(named, columns)).alias("x")).select(F.explode("x").alias("x")).select("x.*")


def pass_rate(df: DataFrame, result: str | None = None, word: str = "pass") -> DataFrame:
    result = result or find_column(df, RESULT)
    passed = F.count_if(F.coalesce(F.lower(F.col(result)).contains(word), F.lit(False)))
    n = F.count(F.lit(1))
    return df.agg(passed.alias("passed"), n.alias("total"), F.round(F.coalesce(F.try_divide(passed * 100, n), F.lit(0.0)), 1).alias("percentage"))


def compare(df: DataFrame, first: str, second: str, order: str, columns: list[str] | None = None, name: str | None = None) -> DataFrame:
    """(subject, first, second): subjects of the first students whose names contain each word, side by side."""
    columns, name = columns or subjects(df), name or find_column(df, NAME)
    holds = lambda word: F.lower(F.col(name)).contains(word.lower())
    pick = lambda word: F.min_by(F.struct(*[F.col(c).cast("double").alias(c) for c in columns]), F.when(holds(word), F.col(order)))
    both = df.filter(holds(first) | holds(second)).agg(pick(first).alias("a"), pick(second).alias("b")).filter("a is not null and b is not null")
    return both.select(F.explode(F.array(*[F.struct(F.lit(c).alias("subject"), F.col("a")[c].alias("first"), F.col("b")[c].alias("second")) for c in columns])).alias("x")).select("x.*")
