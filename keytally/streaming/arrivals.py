"""Act on files as they arrive or change, and keep one status row per file."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from itertools import islice

import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from keytally.functions.binary import STORE_SIGNATURE, signature_status
from keytally.operators.snapshots import LAST_N
from keytally.sources.files import BINARY_FILE, binary_files
from keytally.sources.listing import LISTED, listing_stream, store_of
from keytally.streaming.counts import AVAILABLE_NOW, state_settings

STATUS = "path string, modificationTime timestamp, status string, message string"
#: Files acted on together unless the caller says otherwise; the driver holds their names.
FILES_PER_TRIGGER = 1000
#: The default: no file is read as one value, so none is too long.
ANY_LENGTH = (1 << 63) - 1
#: How often an action may be called in a batch.
MOST_PARTS = 1_000_000
#: Parts that a file's ranking is begun in, so that no task ranks a whole file.
RANKED_PARTS = 64

# Called with the names ``(path, modificationTime, length)`` of the files that
# arrived, a bounded number, and the number of their batch.
Action = Callable[[DataFrame, int], DataFrame]


def _literal(path: str) -> str:
    """A path that a reader takes by its letters, not as a pattern."""
    return re.sub(r"([*?\[\]{}\\])", r"\\\1", path)


def _tails(names: DataFrame, size: int) -> DataFrame:
    """``names`` and ``tail``, each file's last ``size`` bytes; NULL for a file that is gone."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tails = []
            for path in batch["path"].to_pylist():
                store, inside, _ = store_of(path)
                try:
                    with store.open_input_file(inside) as file:
                        file.seek(max(file.size() - size, 0))
                        tails.append(file.read(size))
                except FileNotFoundError:
                    tails.append(None)
            yield batch.append_column("tail", pa.array(tails, pa.binary()))

    number = int(names.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return names.select("path", "modificationTime", "length").repartition(number, "path").mapInArrow(each, f"{LISTED}, tail binary")


def signature_action(signature: bytes = STORE_SIGNATURE, max_length: int = ANY_LENGTH) -> Action:
    """Report ``ok`` or ``error`` by the closing signature; only the last bytes of a file are read.

    A file longer than ``max_length``, or one gone meanwhile, is an error.
    """

    def act(names: DataFrame, batch_id: int) -> DataFrame:
        found = signature_status(F.col("tail"), signature)
        found = F.when(F.col("tail").isNull(), "not_found").otherwise(found)
        verdict = F.when(F.col("length") > max_length, "too_long").otherwise(found)
        return _tails(names, len(signature)).select(
            "path",
            "modificationTime",
            F.when(verdict == "ok", F.lit("ok")).otherwise(F.lit("error")).alias("status"),
            verdict.alias("message"),
        )

    return act


def python_action(handle: Callable[[str], str]) -> Action:
    """Call ``handle(path)`` for each file, on the executors; an exception makes
    that file's status ``error`` and leaves the others alone."""

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            results = []
            for path in batch["path"]:
                try:
                    results.append(("ok", handle(path)))
                except Exception as problem:
                    results.append(("error", f"{type(problem).__name__}: {problem}"))
            done = pd.DataFrame(results, columns=["status", "message"], index=batch.index)
            yield pd.concat([batch, done], axis=1)

    return lambda files, batch_id: files.select("path", "modificationTime").mapInPandas(each, STATUS)


def _readable(files: DataFrame, max_length: int) -> DataFrame:
    """``(path, schema, problem)``: each file is opened on the executors and decoded in pieces.

    A task reads the footer and then one row group after the other, so a file
    of any length takes the memory of one.
    """

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, length in zip(*[column.to_pylist() for column in batch.columns]):
                schema, problem = None, None
                try:
                    if length > max_length:
                        problem = f"{length} bytes are too many"
                    else:
                        store, inside, _ = store_of(path)
                        with store.open_input_file(inside) as opened:
                            file = pq.ParquetFile(opened)
                            schema = from_arrow_schema(file.schema_arrow).json()
                            for rows in file.iter_batches():
                                del rows
                except FileNotFoundError:
                    problem = "not found"
                except Exception as error:
                    schema, problem = None, f"not a readable parquet file: {type(error).__name__}"
                yield pa.record_batch([pa.array([v], pa.string()) for v in (path, schema, problem)], ["path", "schema", "problem"])

    # One file is one row: without a number Spark would put all names in one task.
    number = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = files.select("path", "length").repartition(number, "path")
    return dealt.mapInArrow(each, "path string, schema string, problem string")


def _edited(entries: DataFrame, n: int, value: float, key: str, column: str) -> DataFrame:
    """``entries`` with the values of each file's last ``n`` keys set.

    Ranks are taken in parts of a file first, so no task sorts a whole file; a
    key that a file repeats counts once, and all its rows are set.
    """
    keys = entries.select("file", key).distinct().withColumn("_part", F.pmod(F.hash(key), F.lit(RANKED_PARTS)))
    last = keys
    for by in (["file", "_part"], ["file"]):
        rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.col(key).desc()))
        last = last.withColumn("_rank", rank).filter(F.col("_rank") <= n)
    last = last.select(F.col("file").alias("_file"), F.col(key).alias("_hit"), F.lit(True).alias("_set"))
    same = (F.col("file") == F.col("_file")) & F.col(key).eqNullSafe(F.col("_hit"))
    new = F.when(F.col("_set"), F.lit(value)).otherwise(F.col(column))
    joined = entries.join(last, same, "left")
    return joined.withColumn(column, new.cast(entries.schema[column].dataType)).select(*entries.columns)


def edit_action(
    out_dir: str,
    n: int = LAST_N,
    value: float = 0,
    key: str = "key",
    column: str = "n",
    schema: str = "key string, n bigint",
    max_length: int = ANY_LENGTH,
) -> Action:
    """Set the values of the last ``n`` keys of each snapshot file that arrives.

    The edited entries of a batch go to ``<out_dir>/batch=<id>`` with their
    ``file``; the files stay as they are. Every file is decoded on its own
    first: one that is no readable parquet, is longer than ``max_length``, lacks
    a column of ``schema`` or has it in another type, or has a further column in
    another type than a file before it, is an ``error`` with the reason, and the
    others are edited. Further columns are kept; read the output with
    ``mergeSchema``.
    """

    def act(names: DataFrame, batch_id: int) -> DataFrame:
        spark = names.sparkSession
        # At most as many rows as a batch has files.
        checked = _readable(names, max_length).collect()
        required = spark.createDataFrame([], schema).schema
        types = {field.name: field.dataType.simpleString() for field in required}
        groups: dict[str, list[str]] = {}
        problems: dict[str, str] = {}
        for row in sorted(checked, key=lambda row: row["path"]):
            problem = row["problem"]
            if problem is None:
                own = {f.name: f.dataType.simpleString() for f in StructType.fromJson(json.loads(row["schema"])).fields}
                wrong = [c for c in types if c in own and own[c] != types[c]] + [c for c in required.names if c not in own]
                problem = f"column {wrong[0]} is {own.get(wrong[0], 'missing')}" if wrong else None
            if problem is None:
                types |= own
                groups.setdefault(row["schema"], []).append(row["path"])
            else:
                problems[row["path"]] = problem
        target = f"{out_dir}/batch={batch_id}"
        entries = spark.createDataFrame([], schema).withColumn("file", F.lit(None).cast("string"))
        for paths in groups.values():
            # Names in the metadata are encoded as in an address.
            file = F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))
            read = spark.read.parquet(*map(_literal, paths)).withColumn("file", _plain(file))
            entries = entries.unionByName(read, allowMissingColumns=True)
        edited = _edited(entries, n, value, key, column)
        edited.write.mode("overwrite").parquet(target)

        written = spark.read.schema(edited.schema).parquet(target).groupBy("file")
        totals = written.agg(F.count(F.lit(1)).alias("total"), F.count_distinct(F.struct(key)).alias("keys"))
        rows = [(row["path"], problems.get(row["path"])) for row in checked]
        judged = spark.createDataFrame(rows, "_path string, problem string")
        total, keys = F.coalesce("total", F.lit(0)), F.coalesce("keys", F.lit(0))
        done = F.format_string("%d entries, the last %d set", total, F.least(keys, F.lit(n)))
        known = names.join(judged, F.col("path") == F.col("_path")).join(totals, _plain(F.col("path")) == F.col("file"), "left")
        return known.select(
            "path",
            "modificationTime",
            F.when(F.col("problem").isNull(), F.lit("ok")).otherwise(F.lit("error")).alias("status"),
            F.coalesce("problem", done).alias("message"),
        )

    return act


def _plain(path: Column) -> Column:
    """Local paths are written with one or three slashes, by source."""
    return F.regexp_replace(path, "^file:/+", "file:/")


def _write_status(result: DataFrame, status_dir: str, batch_id: int) -> None:
    # A batch that is run again after a failure replaces its own rows.
    result.write.mode("overwrite").parquet(f"{status_dir}/batch={batch_id}")


def watch(
    spark: SparkSession,
    root: str,
    action: Action,
    status_dir: str,
    checkpoint: str,
    glob: str = "*.sst",
    trigger: dict | None = None,
    files_per_trigger: int = FILES_PER_TRIGGER,
) -> StreamingQuery:
    """Act on every new file under ``root``. A file seen once is not seen again;
    ``follow`` also notices changed and empty files. The stream carries names
    only."""
    files = (
        spark.readStream.format("binaryFile")
        .schema(BINARY_FILE)
        .option("pathGlobFilter", glob)
        .option("recursiveFileLookup", "true")
        .option("maxFilesPerTrigger", files_per_trigger)
        .load(root)
        .select("path", "modificationTime", "length")
    )

    def arrive(batch: DataFrame, number: int) -> None:
        # The names of a batch are held, so that no step lists the folder again.
        names = batch.sparkSession.createDataFrame(batch.collect(), batch.schema)
        _write_status(action(names, number), status_dir, number)

    return (
        files.writeStream.foreachBatch(arrive)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or AVAILABLE_NOW))
        .start()
    )


def follow(
    spark: SparkSession,
    root: str,
    action: Action,
    status_dir: str,
    checkpoint: str,
    glob: str = "*.sst",
    trigger: dict | None = None,
    files_per_action: int = FILES_PER_TRIGGER,
    partitions: int | None = None,
) -> StreamingQuery:
    """Act on every file under ``root`` that is new or has changed, empty ones among them.

    Each micro-batch lists what is there; the state knows the path, time and
    length of what was seen, so no history is read again. A file counts as
    changed if its time or length has; one written twice between two listings is
    seen as the later. The action is called with at most ``files_per_action``
    files and a number that no other call has; what a micro-batch that failed has
    done is done again. By default one listing is made; give ``trigger`` an
    interval to go on.
    """
    files = listing_stream(spark, root, glob).dropDuplicates(["path", "modificationTime", "length"])

    def arrive(batch: DataFrame, number: int) -> None:
        rows = batch.select("path", "modificationTime", "length").toLocalIterator()
        results, parts = f"{status_dir}/batch={number}", 0
        while (some := list(islice(rows, files_per_action))) or not parts:
            done = action(spark.createDataFrame(some, LISTED), number * MOST_PARTS + parts) if some else spark.createDataFrame([], STATUS)
            done.write.mode("append" if parts else "overwrite").parquet(results)
            parts += 1

    with state_settings(spark, partitions):
        return (
            files.writeStream.foreachBatch(arrive)
            .option("checkpointLocation", checkpoint)
            .trigger(**(trigger or AVAILABLE_NOW))
            .start()
        )


def read_status(spark: SparkSession, status_dir: str) -> DataFrame:
    return spark.read.schema(f"{STATUS}, batch int").parquet(status_dir)


def poll(
    spark: SparkSession,
    root: str,
    action: Action,
    status_dir: str,
    batch_id: int,
    glob: str = "*.sst",
    files_per_action: int = FILES_PER_TRIGGER,
) -> DataFrame:
    """Act on the files that are new or changed since batch ``batch_id - 1``.

    Only names and times are compared; contents are read for the changed files,
    ``files_per_action`` at a time. An action that is called more than once in
    a batch is given numbers of its own, below zero.
    """
    names = binary_files(spark, root, glob).select("path", "modificationTime", "length")
    if batch_id > 0:
        done = read_status(spark, status_dir).filter(F.col("batch") < batch_id)
        names = names.join(done.select("path", "modificationTime"), ["path", "modificationTime"], "left_anti")
    kind = "path string, modificationTime timestamp, length bigint"
    result = spark.createDataFrame([], STATUS)
    parts = 0
    rows = names.select("path", "modificationTime", "length").toLocalIterator()
    while some := list(islice(rows, files_per_action)):
        result = action(spark.createDataFrame(some, kind), batch_id if parts == 0 else -(batch_id * MOST_PARTS + parts))
        result.write.mode("append" if parts else "overwrite").parquet(f"{status_dir}/batch={batch_id}")
        parts += 1
    if not parts:
        _write_status(result, status_dir, batch_id)
    return read_status(spark, status_dir).filter(F.col("batch") == batch_id)
