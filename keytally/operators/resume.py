"""Go on counting from a snapshot, edited or not (batch form)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame

from keytally.operators.counting import STRETCH_ROWS, final_count, merge_state, running_count
from keytally.operators.snapshots import snapshot_at


def resume(
    snapshot: DataFrame,
    rows: DataFrame,
    key: str = "key",
    seq: str = "seq",
    stretch_rows: int = STRETCH_ROWS,
) -> DataFrame:
    """Running counts of new rows, each key starting from its value in the snapshot."""
    return running_count(rows, key, seq, initial=snapshot, stretch_rows=stretch_rows)


def state_after(snapshot: DataFrame, rows: DataFrame, key: str = "key") -> DataFrame:
    """The state once the new rows are counted; keys without new rows keep theirs."""
    return merge_state(snapshot, final_count(rows, key), key=key)


def snapshot_edit_resume(
    rows: DataFrame,
    cut: Column | int,
    new_rows: DataFrame,
    edit: Callable[[DataFrame], DataFrame],
    key: str = "key",
    seq: str = "seq",
) -> DataFrame:
    """Snapshot a run at ``cut``, edit the snapshot, count new rows from it."""
    return resume(edit(snapshot_at(rows, cut, key, seq)), new_rows, key, seq)
