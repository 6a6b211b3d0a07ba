"""Label state of issues, advanced batch by batch (see ``keyed_state``)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from issuelens.operators.events import MARKS, label_marks, label_states
from issuelens.streaming.keyed_state import KeyedState

PLACE = "struct<ts: timestamp, delivery_id: bigint>"


class LabelState(KeyedState):
    """The ``complexity:*`` labels of each issue after each processed event (``events.label_events`` rows)."""

    key = ["repo", "number"]
    place = ["ts", "delivery_id"]
    mark_names = [f"last_{m}" for m in MARKS]
    schemas = {
        "events": "delivery_id bigint, repo string, number bigint, ts timestamp, complexity string, is_comment boolean",
        "states": "delivery_id bigint, repo string, number bigint, complexity string, is_comment boolean, complexity_labels string, version bigint",
        "carry": f"repo string, number bigint, last {PLACE}, {', '.join(f'last_{m} {PLACE}' for m in MARKS)}, since bigint, version bigint",
    }

    def marks(self, rows: DataFrame) -> DataFrame:
        return label_marks(rows)

    def merged(self, name: str, new: Column, old: Column) -> Column:
        return F.greatest(new, old)

    def states(self, rows: DataFrame, carry: DataFrame) -> DataFrame:
        return label_states(rows, carry)

    def labels(self) -> DataFrame:
        """The classes among every issue's labels now, from the carry rows alone."""
        there = [F.when(F.col(f"last_{m}").isNotNull() & (F.col("last_comment").isNull() | (F.col(f"last_{m}") >= F.col("last_comment"))), F.lit(m))
                 for m in sorted(MARKS[1:])]
        return self.now().select(*self.key, F.concat_ws(",", *there).alias("classes"))
