"""Column expressions over score vectors. ``scores`` is an ARRAY<DOUBLE> in class order."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from kinfold.fixed import SCORE_PREFIX


def score_columns(classes: Sequence[str]) -> list[str]:
    return [f"{SCORE_PREFIX}{c}" for c in classes]


def quoted(name: str) -> Column:
    """A column by its exact name, also when the name holds dots or spaces."""
    return F.col("`" + name.replace("`", "``") + "`")


def scores_from_columns(classes: Sequence[str]) -> Column:
    """Wide ``prob_<class>`` columns as one array; a missing score counts as NaN."""
    return F.array(*[F.coalesce(quoted(c).cast("double"), F.lit(float("nan"))) for c in score_columns(classes)])


def columns_from_scores(scores: Column, classes: Sequence[str]) -> list[Column]:
    return [F.element_at(scores, i + 1).alias(name) for i, name in enumerate(score_columns(classes))]


def class_array(classes: Sequence[str]) -> Column:
    return F.array(*[F.lit(c) for c in classes])


def argmax_index(scores: Column) -> Column:
    """Position of the largest score. The first maximum wins and NaN counts as the maximum."""
    return (F.array_position(scores, F.array_max(scores)) - 1).cast("int")


def class_at(index: Column, classes: Sequence[str]) -> Column:
    return F.element_at(class_array(classes), (index + 1).cast("int"))


def label_index(label: Column, classes: Sequence[str]) -> Column:
    """Index of a label in the class list. A label outside the list fails the query."""
    position = F.array_position(class_array(classes), label)
    unknown = F.concat(F.lit("label not in the class list: "), F.coalesce(label.cast("string"), F.lit("NULL")))
    return F.when(position > 0, (position - 1).cast("int")).otherwise(F.raise_error(unknown).cast("int"))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` over a value that is computed once per row. Inside an array lambda a plain column
    expression would be evaluated again for every element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def softmax(logits: Column) -> Column:
    """Softmax of an array, shifted by its maximum so that exp cannot overflow."""
    exps = let(F.array_max(logits).cast("double"), lambda top: F.transform(logits, lambda v: F.exp(v.cast("double") - top)))

    def normalised(e: Column) -> Column:
        total = F.aggregate(e, F.lit(0.0).cast("double"), lambda acc, v: acc + v)
        return let(total, lambda t: F.transform(e, lambda v: v / t))

    return let(exps, normalised)


def ranked_scores(scores: Column, classes: Sequence[str]) -> Column:
    """ARRAY<STRUCT<label, score>>, highest score first, equal scores in class order."""
    paired = F.transform(
        scores, lambda v, i: F.struct((-v).alias("down"), i.alias("k"), F.element_at(class_array(classes), i + 1).alias("label"))
    )
    return F.transform(F.array_sort(paired), lambda e: F.struct(e["label"].alias("label"), (-e["down"]).alias("score")))


def ratio(numerator: Column, denominator: Column) -> Column:
    """numerator / denominator as DOUBLE, NULL (undefined) for a zero denominator."""
    return F.try_divide(numerator.cast("double"), denominator.cast("double"))
