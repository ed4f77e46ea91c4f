"""Column expressions (all JVM-side, codegen friendly)."""

from coldsplit.functions.columns import (
    ATTITUDE_CODES,
    DISLIKE,
    LIKE,
    UNKNOWN,
    attitude_branch,
    attitude_letter,
    child_node,
    dot_product,
    histogram_bin,
    pad_item_code,
    residual,
    star_from_quantity,
)

__all__ = [
    "ATTITUDE_CODES",
    "DISLIKE",
    "LIKE",
    "UNKNOWN",
    "attitude_branch",
    "attitude_letter",
    "child_node",
    "dot_product",
    "histogram_bin",
    "pad_item_code",
    "residual",
    "star_from_quantity",
]
