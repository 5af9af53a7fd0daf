"""Files of any length as byte ranges, so that no file has to fit into one value or one task."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keytally.sources.listing import list_files, store_of

RANGE_BYTES = 1 << 20


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the bytes from ``start`` to ``stop`` of ``path``, one row at a time: a task holds one range."""
    for batch in batches:
        places = zip(*(batch[name].to_pylist() for name in ("path", "start", "stop")))
        for path, rows in groupby(enumerate(places), lambda row: row[1][0]):
            store, inside, _ = store_of(path)
            with store.open_input_file(inside) as file:
                for at, (_, start, stop) in rows:
                    file.seek(start)
                    content = pa.array([file.read(max(stop - start, 0))], pa.binary())
                    yield batch.slice(at, 1).append_column("content", content)


def read_windows(requests: DataFrame, partitions: int | None = None) -> DataFrame:
    """``requests`` and ``content``, the bytes of ``path`` from ``start`` to before ``stop``.

    The requests are dealt out over ``partitions`` tasks (the session's number of
    shuffle partitions if not given), which open the files themselves.
    """
    number = partitions or int(requests.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = requests.repartition(number, "path", "start").sortWithinPartitions("path", "start")
    kept = ", ".join(f"`{name}` {kind}" for name, kind in requests.dtypes)
    return dealt.mapInArrow(_read, f"{kept}, content binary")


def file_ranges(
    spark: SparkSession, root: str, glob: str = "*", size: int = RANGE_BYTES, overlap: int = 0, partitions: int | None = None
) -> DataFrame:
    """``(path, length, start, content)``: the bytes of each file from every multiple of ``size`` on.

    ``content`` has ``size`` bytes and ``overlap`` more, as far as the file goes,
    so that what crosses a border is whole in the range it starts in. An empty
    file has one empty range. See ``read_windows`` for ``partitions``.
    """
    names = list_files(spark, root, glob).select("path", "length")
    last = F.greatest(F.col("length") - 1, F.lit(0).cast("bigint"))
    starts = F.explode(F.sequence(F.lit(0).cast("bigint"), last, F.lit(size).cast("bigint")))
    stop = F.least(F.col("start") + size + overlap, F.col("length")).alias("stop")
    return read_windows(names.select("path", "length", starts.alias("start")).select("*", stop), partitions).drop("stop")
