"""Weekday references and timetable questions. The day that counts as today is a parameter."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import strip

# Words and patterns that the service recognises.
WEEKDAYS = ["Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday"]
DAY_OFFSETS = {"today": 0, "tomorrow": 1, "yesterday": -1, "day after tomorrow": 2}
TIMETABLE_PATTERNS = [
    r"what class.*(today|tomorrow|monday|tuesday|wednesday|thursday|friday|saturday|sunday)",
    r"what.*schedule.*(today|tomorrow|monday|tuesday|wednesday|thursday|friday|saturday|sunday)",
    r"class.*(today|tomorrow|next)",
    r"lecture.*(today|tomorrow|next)",
    r"lab.*(today|tomorrow|next|monday|tuesday|wednesday|thursday|friday|saturday)",
    r"who teaches\s+(\w+)",
    r"which (room|lab|class).*(on|at|for)",
    r"what (is|are).*(at|on)\s+\d",
    r"timetable.*for\s+(monday|tuesday|wednesday|thursday|friday|saturday|sunday)",
    r"schedule.*for\s+(monday|tuesday|wednesday|thursday|friday|saturday|sunday)",
]
_ANY_DAY = "monday|tuesday|wednesday|thursday|friday|saturday|sunday"


def day_name(day: Column) -> Column:
    return F.date_format(day, "EEEE")


def day_reference(text: Column, today: Column) -> Column:
    """The weekday that a reference means: a word of DAY_OFFSETS, `next <day>` or a day's name; else null."""
    t = strip(F.lower(text))
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for word, n in DAY_OFFSETS.items():
        out = out.when(t == word, day_name(F.date_add(today, n)))
    named = F.regexp_extract(t, rf"^(?:next )?({_ANY_DAY})$", 1)  # the next such day has that name, whatever today is
    return out.when(named != "", F.initcap(named))


def is_timetable(text: Column) -> Column:
    t, found = F.lower(text), F.lit(False)
    for p in TIMETABLE_PATTERNS:
        found = found | t.rlike(f"(?U){p}")
    return found


def timetable_question(text: Column, today: Column) -> Column:
    """struct(day, time, subject, current_day), null where the text is no timetable question.

    `tomorrow` is looked for before `day after tomorrow`, so the latter means tomorrow here.
    """
    t = F.lower(text)
    day = F.when(F.lit(False), F.lit(None).cast("string"))
    for word in ("today", "tomorrow", "yesterday"):
        day = day.when(t.contains(word), day_name(F.date_add(today, DAY_OFFSETS[word])))
    day = day.otherwise(F.initcap(F.nullif(F.regexp_extract(t, _ANY_DAY, 0), F.lit(""))))
    time = F.nullif(F.regexp_extract(t, r"\d{1,2}[:.]\d{2}", 0), F.lit(""))
    subject = F.nullif(F.upper(strip(F.regexp_extract(t, r"who teaches\s+(.+?)(\?|$)", 1))), F.lit(""))
    return F.when(is_timetable(text), F.struct(day.alias("day"), time.alias("time"), subject.alias("subject"), day_name(today).alias("current_day")))


def timetable_context(text: Column, info: Column) -> Column:
    """The question with what is known about its day, time and subject, for retrieval."""
    day, time, subject = (info.getField(c) for c in ("day", "time", "subject"))
    return F.concat_ws(
        " ",
        text,
        F.when(day.isNotNull(), F.concat(F.lit("\n[System context: The user is asking about "), day, F.lit(". Today is "), info.getField("current_day"), F.lit(".]"))),
        F.when(time.isNotNull(), F.concat(F.lit("[Time reference: "), time, F.lit("]"))),
        F.when(subject.isNotNull(), F.concat(F.lit("[Subject: "), subject, F.lit("]"))),
    )
