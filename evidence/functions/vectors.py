"""Column builders over ``array<double>`` vectors and class-score arrays."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def as_double(vec: Column) -> Column:
    return vec.cast("array<double>")


def let(value: Column, body) -> Column:
    """body(value) with the value computed once, also when body uses it per array element."""
    return F.transform(F.array(value), body).getItem(0)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def cosine(a: Column, b: Column) -> Column:
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def l2_normalize(v: Column) -> Column:
    """v / |v|; the zero vector stays zero."""
    return let(F.greatest(norm(v), F.lit(1e-12)), lambda length: F.transform(v, lambda x: x / length))


def top2(scores: str) -> Column:
    """struct(predicted, runner_up, best, second, margin) with class indexes from 0.

    ``scores`` is the name of (or an SQL expression for) an ``array<double>`` column. One pass
    over the array; equal scores go to the lowest class index.
    """
    return F.expr(f"""
        aggregate({scores},
          named_struct('i', 0, 'b', -double('Infinity'), 'bi', -1, 's', -double('Infinity'), 'si', -1),
          (a, x) -> CASE
            WHEN x > a.b THEN named_struct('i', a.i + 1, 'b', x, 'bi', a.i, 's', a.b, 'si', a.bi)
            WHEN x > a.s THEN named_struct('i', a.i + 1, 'b', a.b, 'bi', a.bi, 's', x, 'si', a.i)
            ELSE named_struct('i', a.i + 1, 'b', a.b, 'bi', a.bi, 's', a.s, 'si', a.si) END,
          a -> named_struct('predicted', a.bi, 'runner_up', a.si, 'best', a.b, 'second', a.s, 'margin', a.b - a.s))
    """)


def scaled_logits(cosines: Column, scale: Column | float, bias: Column | float = 0.0) -> Column:
    scale = scale if isinstance(scale, Column) else F.lit(float(scale))
    bias = bias if isinstance(bias, Column) else F.lit(float(bias))
    return F.transform(cosines, lambda x: x * scale + bias)


def rank_changed(before: str, after: str) -> Column:
    """True where scaling altered the winner or the runner-up."""
    a, b = top2(before), top2(after)
    return (a["predicted"] != b["predicted"]) | (a["runner_up"] != b["runner_up"])


def target_margin(scores: Column, target: Column) -> Column:
    """Score of a fixed class minus the best score of all others."""
    others = F.filter(scores, lambda _, i: i != target)
    return F.get(scores, target) - F.array_max(others)


def cross_entropy(scores: Column, target: Column) -> Column:
    """-log softmax(scores)[target], shifted by the maximum for stability."""

    def loss(top: Column) -> Column:
        total = F.aggregate(scores, F.lit(0.0), lambda s, x: s + F.exp(x - top))
        return F.log(total) + top - F.get(scores, target)

    return let(F.array_max(scores), loss)
