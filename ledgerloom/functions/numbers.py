"""Number, date and class-vector expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# A return of this percentage or less is a negative signal; days to the later price, days it may come late.
THRESHOLD, HORIZON, TOLERANCE = -5.0, 30, 20
# Texts of the classes, in predictions and in the prototype's table.
CLASS_TEXTS = {0: "🟢 유지/매수 (Positive/Neutral)", 1: "🔴 숨은 매도 (Negative Signal)"}
PROTOTYPE_TEXTS = {0: "유지/매수 (Positive)", 1: "숨은 매도 (Negative)"}
HOLD_MARK = "유지/매수"


def to_report_date(c: Column) -> Column:
    """yyyy.MM.dd as a date; null where there is no such day."""
    return F.try_to_date(c, "yyyy.MM.dd")


def return_pct(base: Column, future: Column) -> Column:
    """Percent from base to future; null at a base of 0."""
    return F.try_divide(future - base, base) * 100


def label_id(pct: Column) -> Column:
    return F.when(pct <= THRESHOLD, 1).otherwise(0)


def shown(pct: Column) -> Column:
    """Rounded to cents, half to even."""
    return F.bround(pct, 2)


def class_text(label: Column, texts: dict[int, str] | None = None) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in (texts or CLASS_TEXTS).items() for x in kv]), label.cast("int"))


def softmax(logits: Column) -> Column:
    """Probabilities of a vector of logits."""
    powers = F.transform(logits, lambda x: F.exp(x - F.array_max(logits)))
    total = F.aggregate(powers, F.lit(0.0), lambda a, x: a + x)
    return F.transform(powers, lambda x: x / total)


def arg_max(values: Column) -> Column:
    """The first place, from 0, of the greatest value."""
    return F.array_position(values, F.array_max(values)).cast("int") - 1


def progress(confidence: Column) -> Column:
    return confidence.cast("int") / 100
