"""Which rows belong to a set of ids, told exactly inside of tasks by a few bitmaps of fixed size, so that wide rows are not shuffled.

The first bitmap holds all ids of the set and may hold others. Those others are looked up once, by ids alone, and a second
bitmap holds them; members that it holds wrongly are in a third, and so on until none is wrong.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut
from .marks import marked, test
from .textbytes import lean

#: Bitmaps at most; a set too large for them is joined.
LEVELS = 5
#: Each bitmap has places of its own, so that ids that share one in the first don't in the next.
SALT = 0x1D8AF066F1B3A5C7


def _marks(ids: DataFrame, level: int) -> Broadcast:
    return marked(ids.select(F.col(ids.columns[0]).bitwiseXOR(F.lit(SALT * level & (1 << 62) - 1)).alias("id")))


def _test(marks: Broadcast, column: pa.Array, level: int) -> np.ndarray:
    ids = pa.array(column.fill_null(0).to_numpy(zero_copy_only=False) ^ np.int64(SALT * level & (1 << 62) - 1))
    return test(marks, ids) & column.is_valid().to_numpy(zero_copy_only=False)


def bitmaps(ids: DataFrame, members: DataFrame, levels: int = LEVELS) -> list[Broadcast] | None:
    """Bitmaps that tell, for all of `ids`, whether they are in `members` (one long column each); None if `levels` are not enough."""
    name = ids.columns[0]
    members = cut(members.select(members[members.columns[0]].alias(name)).where(f"{name} IS NOT NULL").distinct())
    ids = ids.where(f"{name} IS NOT NULL").distinct()
    inside, outside = cut(ids.join(members, name, "left_semi")), cut(ids.join(members, name, "left_anti"))
    found = [_marks(inside, 0)]
    while True:
        marks, level = found[-1], len(found) - 1

        def held(batches: Iterator[pa.RecordBatch], marks: Broadcast = marks, level: int = level) -> Iterator[pa.RecordBatch]:
            for b in batches:
                yield b.filter(pa.array(_test(marks, b.column(name), level)))

        wrong = cut(outside.mapInArrow(lean(held), outside.schema))
        if wrong.isEmpty():
            return found
        if len(found) == levels:
            return None
        found.append(_marks(wrong, len(found)))
        inside, outside = wrong, inside


def is_member(found: list[Broadcast], column: pa.Array) -> np.ndarray:
    """Whether each id is a member: an odd number of bitmaps in a row hold it. Nulls are not."""
    depth, open_ = np.zeros(len(column), np.int64), np.ones(len(column), bool)
    for level, marks in enumerate(found):
        open_ &= _test(marks, column, level)
        depth += open_
    return depth % 2 == 1


def only(found: list[Broadcast], name: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For mapInArrow: the rows of members."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(is_member(found, b.column(name))))

    return run


def rows_of(rows: DataFrame, name: str, members: DataFrame) -> DataFrame:
    """The rows whose id (a long column) is in the one column of `members`, without a shuffle of rows where the bitmaps suffice."""
    found = bitmaps(rows.select(name), members)
    if found is None:
        return rows.join(members.select(members[members.columns[0]].alias(name)).distinct(), name, "left_semi").select(*rows.columns)
    return rows.mapInArrow(lean(only(found, name)), rows.schema)
