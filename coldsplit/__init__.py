"""coldsplit: cold-start recommendation on Spark DataFrames.

Ratings live as a COO DataFrame ``(user_id int, item_id int, rating double)``.
A ternary interview tree (like / dislike / unknown) is grown breadth-first with
joins and aggregations, every node becomes a pseudo-user whose ratings are
factorised per level with Spark ML ALS, and unseen users (or items) are routed
down the tree and scored.
"""

from coldsplit.session import drop_scratch_tables, ensure_checkpoint_dir, scratch_path

__all__ = ["drop_scratch_tables", "ensure_checkpoint_dir", "scratch_path"]
