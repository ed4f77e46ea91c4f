"""Scalar column expressions shared by the operators.

Fixed values that must equal the reference for identical results:
  like threshold: rating >= 4; dislike threshold: rating <= 3;
  branch order of the children of node p: like -> 3p, dislike -> 3p+1,
  unknown -> 3p+2; attitude letters 'L', 'D', 'U';
  item code padding: codes that start with a digit and are shorter than 10
  characters get one leading '0'.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values (see module docstring)
LIKE, DISLIKE, UNKNOWN = 0, 1, 2
LIKE_MIN = 4.0
DISLIKE_MAX = 3.0
ATTITUDE_CODES = {LIKE: "L", DISLIKE: "D", UNKNOWN: "U"}
CODE_LENGTH = 10


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def attitude_branch(rating) -> Column:
    """0 = like (>=4), 1 = dislike (<=3), 2 = unknown (absent or strictly 3..4)."""
    r = _c(rating)
    return (
        F.when(r >= F.lit(LIKE_MIN), F.lit(LIKE))
        .when(r <= F.lit(DISLIKE_MAX), F.lit(DISLIKE))
        .otherwise(F.lit(UNKNOWN))
    )


def attitude_letter(branch) -> Column:
    b = _c(branch)
    return (
        F.when(b == LIKE, F.lit("L"))
        .when(b == DISLIKE, F.lit("D"))
        .otherwise(F.lit("U"))
    )


def child_node(node, branch) -> Column:
    return _c(node) * F.lit(3) + _c(branch)


def residual(rating, bias) -> Column:
    return _c(rating) - _c(bias)


def dot_product(u, v) -> Column:
    """Dot product of two numeric arrays, evaluated in double precision."""
    return F.aggregate(
        F.zip_with(_c(u), _c(v), lambda a, b: a.cast("double") * b.cast("double")),
        F.lit(0.0).cast("double"),
        lambda acc, x: acc + x,
    )


def pad_item_code(code) -> Column:
    c = _c(code)
    return F.when(
        c.rlike("^[0-9]") & (F.length(c) < F.lit(CODE_LENGTH)), F.concat(F.lit("0"), c)
    ).otherwise(c)


def histogram_bin(x, lo, hi, bins: int) -> Column:
    """Equal-width bin over [lo, hi]; the last bin is closed on the right."""
    width = (_c(hi) - _c(lo)).cast("double")
    raw = F.floor((_c(x) - _c(lo)).cast("double") / width * F.lit(bins))
    return F.when(width == 0, F.lit(0)).otherwise(
        F.least(raw, F.lit(bins - 1))
    ).cast("int")


def star_from_quantity(q) -> Column:
    """Stand-in star rating 1..5 from a quantity 1..50."""
    return F.floor((_c(q) - F.lit(1)) / F.lit(10)) + F.lit(1)
