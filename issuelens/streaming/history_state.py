"""Prior-issue counts per user, advanced by each append (see ``keyed_state``).

Appending one percent of the issues touches the users of that percent only; an issue that arrives out of order has its
user's counts computed anew, and no one else's.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from issuelens.operators.skew import running_count
from issuelens.streaming.keyed_state import KeyedState

PLACE = "struct<created_at: timestamp, repo: string, number: bigint>"


class HistoryState(KeyedState):
    """``user_issue_count`` and ``is_new_user`` of every issue, as ``features.user_history`` gives them over the whole table."""

    key = ["author"]
    place = ["created_at", "repo", "number"]
    mark_names = ["n"]
    schemas = {
        "events": "author string, created_at timestamp, repo string, number bigint",
        "states": "author string, repo string, number bigint, user_issue_count bigint, is_new_user int, version bigint",
        "carry": f"author string, last {PLACE}, n bigint, since bigint, version bigint",
    }

    def marks(self, rows: DataFrame) -> DataFrame:
        at = F.struct(*self.place)
        return rows.groupBy("author").agg(F.max(at).alias("last"), F.min(at).alias("first"), F.count(F.lit(1)).alias("n"))

    def merged(self, name: str, new: Column, old: Column) -> Column:
        return new + F.coalesce(old, F.lit(0))

    def states(self, rows: DataFrame, carry: DataFrame) -> DataFrame:
        counted = running_count(rows, ["author"], [F.col(c) for c in self.place], "_k")
        held = counted.alias("r").join(carry.select("author", "n").alias("c"), F.col("r.author").eqNullSafe(F.col("c.author")), "left")
        before = (F.col("r._k") + F.coalesce("c.n", F.lit(0))).cast("bigint")
        return held.select("r.author", "r.repo", "r.number", before.alias("user_issue_count"), (before == 0).cast("int").alias("is_new_user"))
