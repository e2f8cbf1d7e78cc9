"""Score maps and dense vectors as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..conf import EMOTIONS
from .scoring import rounded


def _sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda x, y: x + y)


def _let(value: Column, then) -> Column:
    """then(value), with value worked out once however often `then` names it."""
    return F.transform(F.array(value), then)[0]


def normalized(scores: Column, labels: tuple[str, ...] = EMOTIONS) -> Column:
    """Scores by label, negatives as 0, summing to 1; {neutral: 1} if nothing is left."""
    return F.map_from_arrays(F.array(*(F.lit(x) for x in labels)), _shares(scores, labels))


def _shares(scores: Column, labels: tuple[str, ...]) -> Column:
    """normalized() as an array in the order of labels."""
    kept = F.array(*(F.greatest(F.lit(0.0), F.coalesce(F.try_element_at(scores, F.lit(x)), F.lit(0.0))) for x in labels))
    nothing = F.array(*(F.lit(1.0 if x == "neutral" else 0.0) for x in labels))
    return _let(kept, lambda k: _let(_sum(k), lambda total: F.when(total > 0, F.transform(k, lambda x: x / total)).otherwise(nothing)))


def argmax_label(scores: Column, labels: tuple[str, ...] = EMOTIONS) -> Column:
    """The label of the highest score; the first in the order of labels on ties."""
    return _best(F.array(*(F.coalesce(F.try_element_at(scores, F.lit(x)), F.lit(0.0)) for x in labels)), labels)


def _best(values: Column, labels: tuple[str, ...]) -> Column:
    """The first label whose value is the largest."""
    names = F.array(*(F.lit(x) for x in labels))
    return _let(values, lambda v: F.element_at(names, F.array_position(v, F.array_max(v)).cast("int")))


def ensemble(df: DataFrame, models: dict[str, tuple[Column, float]], labels: tuple[str, ...] = EMOTIONS) -> DataFrame:
    """df with label, confidence, agreement "k/n" and has_incongruity of the models (name -> (score map or null, weight)) that are there.

    The vote is one column of which the four are fields, so that it is worked out once a row. (As plain arithmetic on a
    column for each label and model it compiles to a method beyond what the JVM optimizes, and is slower.) df's own columns
    of these names are replaced.
    """
    each = F.array_compact(F.array(*(F.when(s.isNotNull(), F.struct(_shares(s, labels).alias("s"), F.lit(w).alias("w"))) for s, w in models.values())))

    def vote(present: Column) -> Column:
        weight = F.aggregate(present, F.lit(0.0), lambda a, m: a + m["w"])
        total = F.aggregate(present, F.array_repeat(F.lit(0.0), len(labels)), lambda a, m: F.zip_with(a, m["s"], lambda x, y: x + y * m["w"]))
        mean = _let(weight, lambda w: F.transform(total, lambda x: x / F.when(w > 0, w).otherwise(1.0)))
        winners = F.transform(present, lambda m: _best(m["s"], labels))
        return _let(F.struct(mean.alias("mean"), winners.alias("winners")), result)

    def result(v: Column) -> Column:
        n, winner = F.size(v["winners"]), _best(v["mean"], labels)
        return _let(
            winner,
            lambda w: F.struct(
                F.when(n > 0, w).otherwise("unknown").alias("label"),
                F.when(n > 0, F.array_max(v["mean"])).otherwise(0.0).alias("confidence"),
                F.concat(F.when(n > 0, n - F.size(F.array_remove(v["winners"], w))).otherwise(0).cast("string"), F.lit("/"), n.cast("string")).alias("agreement"),
                (F.size(F.array_distinct(v["winners"])) > 1).alias("has_incongruity"),
            ),
        )

    made = ("label", "confidence", "agreement", "has_incongruity")
    return df.withColumn("__vote", _let(each, vote)).select(*(c for c in df.columns if c not in made), *(F.col(f"__vote.{c}") for c in made))


def mean_scores(df: DataFrame, key: str, scores: Column, labels: tuple[str, ...] = EMOTIONS) -> DataFrame:
    """key and scores: the mean of a key's score maps, each made to sum to 1 before, and the mean after (label -> share)."""
    each = df.select(key, normalized(scores, labels).alias("__m"))
    means = each.groupBy(key).agg(*(F.avg(F.col("__m")[x]).alias(x) for x in labels))
    return means.select(key, normalized(F.create_map(*(y for x in labels for y in (F.lit(x), F.col(x)))), labels).alias("scores"))


def multilabel(scores: Column, predicted: Column, labels: tuple[str, ...], per_model: Column | None = None) -> Column:
    """Per label min(3, 3 * score); where there is no score, 1 if the prediction begins with the label, else 0.

    A score is that of `scores`, else what the last model in per_model says of the label: an array of structs
    (emotion, confidence, scores), of which the emotion's confidence (0 if null) goes before the score.
    """

    def one(x: str) -> Column:
        score = F.try_element_at(scores, F.lit(x))
        if per_model is not None:
            said = F.transform(per_model, lambda m: F.when(m["emotion"] == x, F.coalesce(m["confidence"], F.lit(0.0))).otherwise(F.try_element_at(m["scores"], F.lit(x))))
            score = F.coalesce(score, F.try_element_at(F.array_compact(said), F.lit(-1)))
        begins = F.lower(F.coalesce(predicted, F.lit(""))).startswith(x)
        return F.when(score.isNotNull(), F.least(F.lit(3.0), score * 3)).otherwise(F.when(begins, 1.0).otherwise(0.0))

    return F.array(*(one(x) for x in labels))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of the common length, 0 at least; 0 if either has no length."""
    n = F.least(F.size(a), F.size(b))
    x, y = (F.transform(F.slice(v, 1, n), lambda e: e.cast("double")) for v in (a, b))
    dot = _sum(F.zip_with(x, y, lambda p, q: p * q))
    size = F.sqrt(_sum(F.transform(x, lambda p: p * p))) * F.sqrt(_sum(F.transform(y, lambda p: p * p)))
    return F.coalesce(F.greatest(F.lit(0.0), F.try_divide(dot, F.nullif(size, F.lit(0.0)))), F.lit(0.0))


def iou(a: Column, b: Column) -> Column:
    """Intersection over union of boxes [x1, y1, x2, y2]; 0 unless both have four numbers."""
    at = lambda v, i: F.try_element_at(v, F.lit(i)).cast("double")
    span = lambda low, high: F.greatest(F.lit(0.0), high - low)
    inter = span(F.greatest(at(a, 1), at(b, 1)), F.least(at(a, 3), at(b, 3))) * span(F.greatest(at(a, 2), at(b, 2)), F.least(at(a, 4), at(b, 4)))
    area = lambda v: span(at(v, 1), at(v, 3)) * span(at(v, 2), at(v, 4))
    union = area(a) + area(b) - inter
    return F.when((F.size(a) == 4) & (F.size(b) == 4) & (union > 0), inter / union).otherwise(0.0)


def padded(v: Column, n: int) -> Column:
    return F.slice(F.concat(v, F.array_repeat(F.lit(0.0), n)), 1, n)


def finite(v: Column) -> Column:
    """NaN and infinities, and nulls, as 0."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return F.transform(v, lambda x: F.when(bad(x), 0.0).otherwise(x))


def resampled(v: Column, n: int) -> Column:
    """v at n equally spaced places from its first to its last element, in between by line."""
    last = F.size(v) - 1

    def at(i: Column) -> Column:
        x = i.cast("double") * last / max(1, n - 1)
        lo = F.floor(x).cast("int")
        hi = F.least(last, lo + 1)
        a, b = F.try_element_at(v, lo + 1).cast("double"), F.try_element_at(v, hi + 1).cast("double")
        return a + (b - a) * (x - lo)

    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), at)


def ranked(scores: dict[str, Column], digits: int = 4) -> Column:
    """array of (label, score), highest first, equal ones in the order given; scores are rounded after they are ranked."""
    each = F.array(*(F.struct((-F.coalesce(s, F.lit(0.0))).alias("less"), F.lit(i).alias("place"), F.lit(x).alias("label")) for i, (x, s) in enumerate(scores.items())))
    return F.transform(F.array_sort(each), lambda e: F.struct(e["label"].alias("label"), rounded(-e["less"], digits).alias("score")))


def blended(first: Column, second: Column, share: float, labels: tuple[str, ...]) -> dict[str, Column]:
    """Of two score maps, label -> share of the first and the rest of the second, made to sum to 1; what a map lacks is 0, and all are 0 if nothing is left."""
    of = lambda scores, x: F.coalesce(F.try_element_at(scores, F.lit(x)), F.lit(0.0))
    parts = {x: of(first, x) * share + of(second, x) * (1 - share) for x in labels}
    total = sum(list(parts.values())[1:], next(iter(parts.values())))
    return {x: F.when(total > 0, p / total).otherwise(p) for x, p in parts.items()}


def merged_maps(*maps: Column) -> Column:
    """One map of all keys; of a key in several the last value."""
    last = lambda a, b: F.map_concat(F.map_filter(a, lambda k, _: ~F.map_contains_key(b, k)), b)
    empty = [F.coalesce(m, F.expr("map()").cast("map<string,string>")) for m in maps]
    out = empty[0]
    for more in empty[1:]:
        out = last(out, more)
    return out
