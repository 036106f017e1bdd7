"""Who may read what, as filters and semi-joins that come before any other work on the rows.

A profile is read by its owner and by an admin; everything else of a user by its owner alone.
A node of a tree is read if it and every node above it is shared (no owner) or the reader's
own, and fits the exam that is looked at.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import tree


class Policy(NamedTuple):
    uid: str | None
    admin: bool = False
    exam: str = "all"


def owns(policy: Policy, owner: Column) -> Column:
    """A reader who isn't signed in owns nothing."""
    return F.coalesce(owner.cast("string") == F.lit(policy.uid), F.lit(False)) if policy.uid is not None else F.lit(False)


def profiles(rows: DataFrame, policy: Policy, owner: str = "uid") -> DataFrame:
    return rows.where(F.lit(policy.admin) | owns(policy, F.col(owner)))


def private(rows: DataFrame, policy: Policy, owner: str = "uid") -> DataFrame:
    """Documents, study material, chats and whatever else lies below a user: an admin sees none of it."""
    return rows.where(owns(policy, F.col(owner)))


def readable(nodes: DataFrame, policy: Policy) -> DataFrame:
    """The ids of ``nodes(id, parent_id, exam, owner)`` that the reader may see."""
    own = F.col("owner").isNull() | owns(policy, F.col("owner"))
    fits = nodes.select(F.col("id").alias("ancestor"), (tree.exam_fits(F.col("exam"), policy.exam) & own).alias("fits"))
    hidden = fits.where("NOT fits").select("ancestor")
    below = tree.closure(nodes).join(hidden, "ancestor", "left_semi").select("id").distinct()  # what is hidden, or lies below it
    return nodes.select("id").distinct().join(below, "id", "left_anti")
