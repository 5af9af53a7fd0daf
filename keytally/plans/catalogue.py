"""Every query by name: ``(spark, sf_dir) -> DataFrame`` over the given tables."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keytally.functions import binary as b
from keytally.functions import text as t
from keytally.functions.checksum import crc32c_udf
from keytally.functions.doubles import bytes_double, double_bytes
from keytally.operators import binary as bo
from keytally.operators import counting, inspection, ranges, ranking, resume, snapshots
from keytally.operators.versions import SnapshotVersions
from keytally.session import work_dir
from keytally.sources import words
from keytally.sources.files import binary_files, dump_lines
from keytally.sources.tables import (
    document_words,
    keyed_events,
    page_bytes,
    table,
    table_stream,
    widen,
)
from keytally.streaming import arrivals, counts, state, totals

Query = Callable[[SparkSession, str], DataFrame]

SEED = 42
TAG = b"<p"
PATCH_HEX = "05 00:00 00"
# Pages hold ".</p><p>", which is this value with the bytes of each half reversed.
SWAPPED_TARGET = b"p/<.>p<>"
# No page holds this value; its first byte starts a letter such as "é".
ABSENT_TARGET = b"\xc3\x00\x01\x02"
PAGE_END = b"></html>"
RAW_DOUBLE = -0.1
#: Short ranges, so that small tables have borders too.
RANGE_BYTES = 4096
RANGE_PATTERNS = {"border": b"</html>\n<", "tag": b"</p>", "absent": ABSENT_TARGET}


def _events(spark: SparkSession, sf: str) -> DataFrame:
    return keyed_events(table(spark, sf, "events"))


def _cut(events: DataFrame) -> int:
    """Four fifths of the way through the arrival order.

    Looked up first, so that the comparison reaches the parquet scan as a literal.
    """
    return events.agg(F.expr("max(seq) * 8 div 10").alias("cut")).first()["cut"]


def _split(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The events up to the cut, and those after it."""
    cut = _cut(events)
    return events.filter(F.col("seq") <= cut), events.filter(F.col("seq") > cut)


def _snapshot(spark: SparkSession, sf: str) -> DataFrame:
    events = _events(spark, sf)
    return snapshots.snapshot_at(events, _cut(events))


def _pages(spark: SparkSession, sf: str) -> DataFrame:
    return page_bytes(table(spark, sf, "pages"))


# Counting


def running_count(spark, sf):
    return counting.running_count(_events(spark, sf))


def running_count_split(spark, sf):
    """The same with every key of more than some hundred rows cut into stretches."""
    return counting.running_count(_events(spark, sf), stretch_rows=64)


def word_running_count(spark, sf):
    rows = document_words(table(spark, sf, "documents"))
    return counting.running_count(rows, seq=["doc_id", "pos"])


def emitted_counts(spark, sf):
    return counting.emitted_counts(_events(spark, sf))


def final_count(spark, sf):
    return counting.final_count(_events(spark, sf))


def render_tuple(spark, sf):
    pairs = counting.typed_pairs(counting.running_count(_events(spark, sf)))
    line = t.render_tuple(F.col("key"), F.col("n"))
    word, n = t.parse_tuple(F.col("line"))
    return pairs.select(line.alias("line")).select("line", word.alias("key"), n.alias("n"))


# Vocabularies and draws: one draw per event


def _draws(spark, sf):
    return words.draw_words(table(spark, sf, "events"), "event_id", SEED)


def draw_words(spark, sf):
    return _draws(spark, sf)


def draw_from_vocab(spark, sf):
    path = work_dir(spark, "vocabulary")
    spoken = document_words(table(spark, sf, "documents")).select(F.col("key").alias("word"))
    words.bucketed_words(spoken).write.parquet(path)
    return words.draw_from(table(spark, sf, "events"), "event_id", spark.read.parquet(path), SEED)


def vocab(spark, sf):
    index = words.draw_index(F.col("event_id"), SEED, words.LETTERS**3)
    drawn = counting.final_count(table(spark, sf, "events").select(index.alias("id")), "id")
    return words.vocabulary(spark, 3).join(drawn, "id", "left").select(
        "id", "word", F.coalesce("n", F.lit(0)).cast("bigint").alias("n")
    )


def vocab_stats(spark, sf):
    return words.vocabulary_stats(_draws(spark, sf))


def vocab_head_tail(spark, sf):
    drawn = _draws(spark, sf).select("word").distinct()
    first = drawn.orderBy("word").limit(10).withColumn("part", F.lit("first"))
    last = drawn.orderBy(F.col("word").desc()).limit(10).withColumn("part", F.lit("last"))
    return first.unionByName(last)


# Snapshots and edits


def snapshot_at(spark, sf):
    return _snapshot(spark, sf)


def edit_last_n(spark, sf):
    return snapshots.edit_last_n(_snapshot(spark, sf))


def edit_last_n_double(spark, sf):
    """The same on counts stored as doubles, the last set to a negative fraction."""
    raw = _snapshot(spark, sf).select("key", double_bytes(F.col("n")).alias("value"))
    edited = snapshots.edit_last_n(raw, value=RAW_DOUBLE, column="value")
    return edited.select("key", F.hex("value").alias("value"), bytes_double(F.col("value")).alias("n"))


def double_roundtrip(spark, sf):
    """Prices, their negatives and their inverses as bytes and back."""
    price = F.col("l_extendedprice").cast("double")
    x = F.when(F.col("l_linenumber") % 3 == 0, -price).when(F.col("l_linenumber") % 3 == 1, 1 / price).otherwise(price)
    made = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", x.alias("x"))
    stored = double_bytes(F.col("x"))
    return made.select("l_orderkey", "l_linenumber", F.hex(stored).alias("bytes"), (bytes_double(stored) == F.col("x")).alias("same"))


def edit_last_n_raw(spark, sf):
    """The same on raw values: a length and a count, four bytes each."""
    raw = F.concat(b.write_u32(F.lit(4), little=False), b.write_u32(F.col("n"), little=False))
    snapshot = _snapshot(spark, sf).select("key", raw.alias("value"))
    edited = snapshots.edit_last_n(snapshot, value=snapshots.ZERO_DOUBLE, column="value")
    return edited.withColumn("value", F.hex("value"))


def suffix_last(spark, sf):
    return snapshots.suffix_last(_snapshot(spark, sf).select("key", F.col("n").cast("string").alias("value")))


def snapshot_versions(spark, sf):
    versions = SnapshotVersions(spark, work_dir(spark, "versions"))
    before = versions.write(_snapshot(spark, sf), "events", 0)
    versions.write(snapshots.edit_last_n(before), "events", 1)
    return versions.read_all("events")


def tail_n(spark, sf):
    before = _snapshot(spark, sf)
    listed = snapshots.tail(before).withColumn("version", F.lit(0))
    return listed.unionByName(snapshots.tail(snapshots.edit_last_n(before)).withColumn("version", F.lit(1)))


def last_record(spark, sf):
    return snapshots.last_record(_snapshot(spark, sf))


def snapshot_diff(spark, sf):
    before = _snapshot(spark, sf)
    return snapshots.snapshot_diff(before, snapshots.edit_last_n(before))


def edit_report(spark, sf):
    return snapshots.edit_report(_snapshot(spark, sf))


# Resuming


def resume_counts(spark, sf):
    early, late = _split(_events(spark, sf))
    return resume.resume(counting.final_count(early), late)


def resume_edited(spark, sf):
    events = _events(spark, sf)
    cut = _cut(events)
    late = events.filter(F.col("seq") > cut)
    return resume.snapshot_edit_resume(events, cut, late, snapshots.edit_last_n)


def state_after_resume(spark, sf):
    early, late = _split(_events(spark, sf))
    return resume.state_after(snapshots.edit_last_n(counting.final_count(early)), late)


# Streams: as many partitions of the state as the cluster has cores


def _cores(spark):
    return spark.sparkContext.defaultParallelism


def _counted(spark, stream, out, checkpoint):
    number = _cores(spark)
    return counts.run(counts.stream_counts(stream, partitions=number), out, checkpoint, number)


def collection_source(spark, sf):
    root = work_dir(spark, "collection")
    draws = _draws(spark, sf)
    draws.write.parquet(f"{root}/in")
    stream = spark.readStream.schema(draws.schema).parquet(f"{root}/in")
    return counts.run(stream, f"{root}/out", f"{root}/checkpoint", _cores(spark))


def _stream_run(spark, sf, root):
    stream = keyed_events(table_stream(spark, sf, "events"))
    return _counted(spark, stream, f"{root}/out", f"{root}/checkpoint")


def stream_running_count(spark, sf):
    return _stream_run(spark, sf, work_dir(spark, "stream"))


def stream_word_running_count(spark, sf):
    """Every word of every document through the stream: many keys, few records of each."""
    root = work_dir(spark, "stream-words")
    words_in = document_words(table_stream(spark, sf, "documents"))
    return totals.run_totals(words_in, f"{root}/out", f"{root}/checkpoint", partitions=_cores(spark))


def _split_documents(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    cut = docs.agg(F.expr("max(doc_id) * 8 div 10").alias("cut")).first()["cut"]
    return docs.filter(F.col("doc_id") <= cut), docs.filter(F.col("doc_id") > cut)


def _two_word_drops(spark, sf, root):
    """The words of the first documents, then those of the others on the same checkpoint."""
    for docs in _split_documents(spark, sf):
        docs.write.mode("append").parquet(f"{root}/in")
        stream = document_words(spark.readStream.schema(docs.schema).parquet(f"{root}/in"))
        counted = totals.run_totals(stream, f"{root}/out", f"{root}/checkpoint", partitions=_cores(spark))
    return counted


def stream_word_snapshot_at(spark, sf):
    root = work_dir(spark, "word-snapshot")
    _two_word_drops(spark, sf, root)
    return totals.read_totals(spark, f"{root}/checkpoint", batch_id=0)


def stream_word_changes(spark, sf):
    """What the second drop changed, read from the state's changes alone."""
    root = work_dir(spark, "word-changes")
    _two_word_drops(spark, sf, root)
    return totals.changed_totals(spark, f"{root}/checkpoint", 0, 1)


def stream_word_resume_edited(spark, sf):
    """Count the first documents' words, snapshot, edit, count the other documents' from there."""
    root = work_dir(spark, "word-resume")
    for name, docs in zip(("1", "2"), _split_documents(spark, sf)):
        docs.write.parquet(f"{root}/in{name}")
        stream = document_words(spark.readStream.schema(docs.schema).parquet(f"{root}/in{name}"))
        edited = snapshots.edit_last_n(totals.read_totals(spark, f"{root}/checkpoint1")) if name == "2" else None
        counted = totals.run_totals(stream, f"{root}/out{name}", f"{root}/checkpoint{name}", edited, partitions=_cores(spark))
    return counted


def snapshot_scan(spark, sf):
    root = work_dir(spark, "scan")
    _stream_run(spark, sf, root)
    return snapshots.in_key_order(state.read_snapshot(spark, f"{root}/checkpoint"))


def snapshot_metadata(spark, sf):
    """Of a run with one micro-batch for each event type, with the entries of its last one."""
    root = work_dir(spark, "metadata")
    events = keyed_events(table(spark, sf, "events"))
    kinds = events.select(F.substring_index("key", ":", 1).alias("kind")).distinct().orderBy("kind").collect()
    for row in kinds:
        events.filter(F.startswith("key", F.lit(f"{row['kind']}:"))).write.mode("append").parquet(f"{root}/in")
        stream = spark.readStream.schema(events.schema).parquet(f"{root}/in")
        _counted(spark, stream, f"{root}/out", f"{root}/checkpoint")
    found = state.snapshot_metadata(spark, f"{root}/checkpoint").drop("operator")
    entries = state.read_snapshot(spark, f"{root}/checkpoint").count()
    return found.withColumn("entries", F.lit(entries).cast("bigint"))


def _two_drops(spark, sf, root):
    """Count the early events, drop the late ones into the same folder, restart."""
    events = _events(spark, sf)
    early, late = _split(events)
    early.write.mode("append").parquet(f"{root}/in")
    stream = spark.readStream.schema(events.schema).parquet(f"{root}/in")
    _counted(spark, stream, f"{root}/out", f"{root}/checkpoint")
    late.write.mode("append").parquet(f"{root}/in")
    return _counted(spark, stream, f"{root}/out", f"{root}/checkpoint")


def stream_restart(spark, sf):
    return _two_drops(spark, sf, work_dir(spark, "restart"))


def stream_snapshot_at(spark, sf):
    root = work_dir(spark, "snapshot")
    _two_drops(spark, sf, root)
    return state.read_snapshot(spark, f"{root}/checkpoint", batch_id=0)


def _stream_resume(spark, sf, root, edit):
    """Count the early events, snapshot, edit, count the late ones from there."""
    events = _events(spark, sf)
    for part, path in zip(_split(events), (f"{root}/in1", f"{root}/in2")):
        part.write.parquet(path)
    first = spark.readStream.schema(events.schema).parquet(f"{root}/in1")
    second = spark.readStream.schema(events.schema).parquet(f"{root}/in2")
    _counted(spark, first, f"{root}/out1", f"{root}/checkpoint1")
    versions = SnapshotVersions(spark, f"{root}/versions")
    taken = versions.write(edit(state.read_snapshot(spark, f"{root}/checkpoint1")), "events", 0)
    return counts.resume_from_snapshot(second, taken, f"{root}/out2", f"{root}/checkpoint2", _cores(spark))


def stream_resume(spark, sf):
    return _stream_resume(spark, sf, work_dir(spark, "resume"), lambda snapshot: snapshot)


def stream_resume_edited(spark, sf):
    return _stream_resume(spark, sf, work_dir(spark, "edited"), snapshots.edit_last_n)


def stream_state_after_resume(spark, sf):
    root = work_dir(spark, "after")
    _stream_resume(spark, sf, root, snapshots.edit_last_n)
    return state.read_snapshot(spark, f"{root}/checkpoint2")


def _by_kind(spark, sf):
    """The snapshot with one file for each event type."""
    kind = F.substring_index("key", ":", 1)
    return _snapshot(spark, sf).withColumn("kind", kind).repartition("kind")


def file_arrivals(spark, sf):
    """A snapshot is written as files, beside a broken one; each that arrives is checked."""
    root = work_dir(spark, "arrivals")
    _by_kind(spark, sf).write.partitionBy("kind").parquet(f"{root}/in/snapshot")
    broken = _snapshot(spark, sf).limit(1).select(F.lit("broken").alias("kind"), "key")
    broken.coalesce(1).write.partitionBy("kind").text(f"{root}/in/text")
    action = arrivals.signature_action(b"PAR1")
    watching = arrivals.watch(spark, f"{root}/in", action, f"{root}/status", f"{root}/checkpoint", "part-*")
    watching.awaitTermination()
    kind = F.regexp_extract("path", "/kind=([^/]*)/", 1).alias("kind")
    return arrivals.read_status(spark, f"{root}/status").select(kind, "status", "message")


def file_changes(spark, sf):
    """Two snapshots arrive one after the other, and an empty file; each file is reported once, by the listing that saw it."""
    root = work_dir(spark, "changes")
    before = _by_kind(spark, sf)
    empty = spark.createDataFrame([], "value string").coalesce(1)
    for number, drop in enumerate(("early", "late")):
        rows = before if number == 0 else snapshots.edit_last_n(before).repartition("kind")
        rows.write.partitionBy("kind").parquet(f"{root}/in/{drop}")
        empty.write.mode("overwrite").text(f"{root}/in/{drop}/kind=empty")
        action = arrivals.signature_action(b"PAR1")
        arrivals.follow(spark, f"{root}/in", action, f"{root}/status", f"{root}/checkpoint", "part-*", partitions=_cores(spark)).awaitTermination()
    place = [F.regexp_extract("path", f"/in/([a-z]*)/kind=([^/]*)/", i) for i in (1, 2)]
    return arrivals.read_status(spark, f"{root}/status").select(place[0].alias("drop"), place[1].alias("kind"), "batch", "status", "message")


def file_arrivals_edit(spark, sf):
    """A snapshot is written as one file per event type; each arriving file is edited."""
    root = work_dir(spark, "arrivals-edit")
    _by_kind(spark, sf).write.partitionBy("kind").parquet(f"{root}/in")
    action = arrivals.edit_action(f"{root}/edited")
    arrivals.watch(
        spark, f"{root}/in", action, f"{root}/status", f"{root}/checkpoint", "*.parquet"
    ).awaitTermination()
    return spark.read.parquet(f"{root}/edited").select("key", "n")


# Files and binary contents


def largest_file(spark, sf):
    return ranking.largest(table(spark, sf, "documents"), "source", "doc_id", "n_chars")


def largest_page(spark, sf):
    files = table(spark, sf, "pages").select(
        F.col("url").alias("path"), F.octet_length("html").cast("bigint").alias("length")
    )
    return ranking.largest_state_file(files, excluded="")


def largest_version_file(spark, sf):
    """Two versions are written, each as a large and a small file; how many entries has the largest?"""
    root = work_dir(spark, "version-files")
    before = _snapshot(spark, sf)
    written = []
    for version, entries in enumerate((before, snapshots.edit_last_n(before))):
        for part, rows in (("all", entries), ("tail", snapshots.tail(entries))):
            written.append(rows.withColumns({"version": F.lit(version), "part": F.lit(part)}))
    both = reduce(DataFrame.unionByName, written)
    both.repartition("version", "part").write.partitionBy("version", "part").parquet(root)
    files = ranking.largest_state_file(
        binary_files(spark, root, "*.parquet")
        .select(F.regexp_replace("path", "/part=([a-z]+)/", "/$1-").alias("path"), "length")
    )
    largest = F.broadcast(files.select(F.regexp_extract("path", "[^/]*-part", 0).alias("_part"), F.regexp_extract("path", "/version=([0-9]+)/", 1).cast("int").alias("_version")))
    entries = spark.read.parquet(root)
    inside = (F.col("version") == F.col("_version")) & F.startswith(F.col("_part"), F.col("part"))
    return entries.join(largest, inside).groupBy("version").agg(F.count(F.lit(1)).alias("entries"))


def file_filter(spark, sf):
    url = F.col("url")
    wanted = t.has_suffix(url, ".html", is_directory=F.endswith(url, F.lit("/")))
    return table(spark, sf, "pages").filter(wanted).select("page_id", "url", t.base_name(url).alias("name"))


def binary_scan(spark, sf):
    content = F.col("content")
    return _pages(spark, sf).select(
        "page_id",
        F.length(content).cast("bigint").alias("length"),
        F.hex(F.substring(content, 1, 16)).alias("head"),
        F.md5(content).alias("md5"),
    )


# Files by byte ranges: pages one after another in text files of a hundred each


def _page_files(spark, sf):
    """A folder with a file for each hundred pages, in order of their number."""
    root = work_dir(spark, "page-files")
    pages = table(spark, sf, "pages").select(F.expr("page_id div 100").alias("part"), "page_id", "html")
    ordered = pages.repartition("part").sortWithinPartitions("part", "page_id")
    ordered.select("part", "html").write.partitionBy("part").text(root)
    return root


def _part():
    return F.regexp_extract("path", "/part=([0-9]+)/", 1).cast("bigint").alias("part")


def file_range_search(spark, sf):
    """What ends a page and begins the next, the last byte of a tag, and a value that no page holds, across range borders."""
    root = _page_files(spark, sf)
    found = []
    for label, pattern in RANGE_PATTERNS.items():
        offsets = ranges.search_files(spark, root, pattern, "part-*", RANGE_BYTES)
        found.append(offsets.select(_part(), F.lit(label).alias("label"), "offset"))
    return reduce(DataFrame.unionByName, found)


def file_range_search_encodings(spark, sf):
    found = ranges.search_files_encodings(spark, _page_files(spark, sf), SWAPPED_TARGET, "part-*", RANGE_BYTES)
    return found.select(_part(), "label", "offset")


def file_range_context(spark, sf):
    around = ranges.context_files(spark, _page_files(spark, sf), RANGE_PATTERNS["tag"], "part-*", RANGE_BYTES)
    return around.select(_part(), "row_offset", "hex", "is_target", "line")


def file_range_prefix(spark, sf):
    found = ranges.search_prefix_files(spark, _page_files(spark, sf), ABSENT_TARGET, "part-*", RANGE_BYTES)
    return found.select(_part(), "prefix_len", "offset")


def file_range_dump(spark, sf):
    dumped = ranges.dump_files(spark, _page_files(spark, sf), "part-*", RANGE_BYTES)
    return dumped.select(_part(), "offset", "hex", "ascii", "line")


def file_range_checksum(spark, sf):
    """Checksums by ranges beside those of whole values."""
    root = _page_files(spark, sf)
    by_ranges = ranges.checksum_files(spark, root, "part-*", RANGE_BYTES).select(_part(), "length", "computed")
    whole = binary_files(spark, root, "part-*").select(_part().alias("_part"), crc32c_udf("content").alias("whole"))
    both = by_ranges.join(whole, F.col("part") == F.col("_part"))
    return both.select("part", "length", (F.col("computed") == F.col("whole")).alias("same"))


def signature_check(spark, sf):
    """Pages as they are, signed, and cut short, by the page number."""
    page, content = F.col("page_id"), F.col("content")
    signed = F.concat(content, b.literal_bytes(b.STORE_SIGNATURE))
    stored = F.when(page % 3 == 0, signed).when(page % 3 == 1, F.substring(content, 1, 6)).otherwise(content)
    return _pages(spark, sf).select(
        "page_id",
        b.signature_status(stored).alias("store_status"),
        b.signature_status(content, PAGE_END).alias("page_status"),
    )


def byte_search(spark, sf):
    return bo.byte_search(_pages(spark, sf), TAG)


def byte_search_encodings(spark, sf):
    found = bo.search_encodings(_pages(spark, sf), SWAPPED_TARGET, id="page_id")
    return found.withColumn("pattern", F.hex("pattern"))


def prefix_search(spark, sf):
    return bo.search_prefix(_pages(spark, sf), ABSENT_TARGET, id="page_id")


def _requests(spark, sf):
    """A patch of every kind, asked for in text: inside, up to the end, over it, past it,
    before the start, with bad bytes, by a hexadecimal place, and with no place at all."""
    page = F.col("page_id")
    size = F.length("content")
    at = [F.lit("100"), size - 4, size - 3, size, F.lit("-1"), F.lit("100"), F.concat(F.lit("0x"), F.hex(page % 64)), F.lit("zz")]
    offset = F.element_at(F.array(*[a.cast("string") for a in at]), (page % 8 + 1).cast("int"))
    return _pages(spark, sf).withColumns({"at": offset, "new": F.when(page % 8 == 5, "05 0G").otherwise(PATCH_HEX)})


def byte_patch(spark, sf):
    patched = bo.patch(_requests(spark, sf), t.parse_offset(F.col("at")), F.col("new"))
    return patched.select("page_id", "status", F.hex("original").alias("original"), F.md5("content").alias("md5"))


def patch_requests(spark, sf):
    return bo.patch_requests(_requests(spark, sf), F.col("at"), F.col("new"), id="page_id")


def hex_dump(spark, sf):
    return bo.hex_dump(_pages(spark, sf), id="page_id")


def hex_context(spark, sf):
    return bo.patch_context(_with_tag_offset(spark, sf), id="page_id")


def hex_match_context(spark, sf):
    return bo.match_context(_with_tag_offset(spark, sf), len(TAG), id="page_id")


def encoding_contexts(spark, sf):
    return bo.encoding_contexts(_pages(spark, sf), SWAPPED_TARGET, id="page_id")


def last_record_offset(spark, sf):
    """Four records are dumped from each page, some with a value that it does not hold."""
    pages = _pages(spark, sf)
    content = F.col("content")
    lines = []
    for seq in range(4):
        value = F.hex(F.substring(content, 65 + 32 * seq, 8))
        value = F.when(F.col("page_id") % 5 == 0, F.reverse(value)).otherwise(value)
        lines.append(t.render_dump_line(F.hex(F.substring(content, 1 + 16 * seq, 4)), F.lit(seq), value))
    dumped = pages.select("page_id", F.explode(F.array(*lines, F.lit("no record"))).alias("value"))
    return inspection.last_record_offset(dumped, pages, id="page_id")


def patched_context(spark, sf):
    """Find a tag, overwrite it, and show the bytes around it afterwards."""
    patched = bo.patch(_with_tag_offset(spark, sf), F.col("offset"), F.lit(PATCH_HEX))
    return bo.patch_context(patched, id="page_id")


def _with_tag_offset(spark, sf):
    return _pages(spark, sf).withColumn("offset", b.find_bytes(F.col("content"), TAG))


def checksum_verify(spark, sf):
    """Pages as they are, with a right footer, and cut short, by the page number."""
    page, content = F.col("page_id"), F.col("content")
    footer = F.concat(b.literal_bytes(bytes(4)), b.write_u32(crc32c_udf(content), little=True))
    stored = F.when(page % 3 == 0, F.concat(content, footer)).when(page % 3 == 1, F.substring(content, 1, 5)).otherwise(content)
    return bo.verify_checksum(_pages(spark, sf).withColumn("content", stored))


# Text


def extract_id(spark, sf):
    said = table(spark, sf, "conversations")
    log = F.concat(F.col("text"), F.lit("\nJob has been submitted with JobID "), F.md5("text"))
    line = F.when(F.col("role") == "assistant", log).otherwise(F.col("text"))
    return said.select("conv_id", "turn", t.extract_job_id(line).alias("job_id"))


def extract_path(spark, sf):
    pages = table(spark, sf, "pages")
    log = F.concat(F.col("html"), F.lit("\nSavepoint completed. Path: file:"), F.col("url"), F.lit(" done\n"))
    line = F.when(F.length("url") % 2 == 0, log).otherwise(F.col("html"))
    return pages.select("page_id", t.extract_path(line).alias("path"))


def sanitize_hex(spark, sf):
    digits = t.sanitize_hex(F.col("text"))
    return widen(table(spark, sf, "documents").select("doc_id", "text")).select(
        "doc_id", F.length(digits).cast("bigint").alias("digits"), F.md5(digits).alias("md5")
    )


def hex_roundtrip(spark, sf):
    digits = F.hex("content")
    return _pages(spark, sf).select(
        "page_id", F.md5(digits).alias("hex_md5"), (t.hex_bytes(digits) == F.col("content")).alias("same")
    )


def decode_u32_pair(spark, sf):
    content = F.col("content")
    pair = {
        "be1": b.read_u32(content, 0, little=False),
        "be2": b.read_u32(content, 4, little=False),
        "le1": b.read_u32(content, 0, little=True),
        "le2": b.read_u32(content, 4, little=True),
    }
    swapped = F.concat(b.write_u32(F.col("be1"), little=True), b.write_u32(F.col("be2"), little=True))
    return _pages(spark, sf).withColumns(pair).select("page_id", *pair, F.hex(swapped).alias("swapped"))


def parse_offset(spark, sf):
    distinct = document_words(table(spark, sf, "documents")).select(F.col("key").alias("word")).distinct()
    word = F.col("word")
    return distinct.select("word", t.parse_offset(word).alias("offset"), t.offset_status(word).alias("status"))


def _dump(spark, sf):
    """The final state as dump lines, good and bad ones by the count's remainder."""
    key, n = F.hex("key"), F.col("n")
    value = F.concat(F.lit("00000004"), F.lpad(F.hex(n), 8, "0"))
    seq = F.concat(F.lit(" seq:"), n.cast("string"))
    line = (
        F.when(n % 4 == 0, F.concat(key, seq, F.lit(" => "), value))
        .when(n % 4 == 1, F.concat(F.lit("'"), key, F.lit("'"), seq, F.lit(" = "), value))
        .when(n % 4 == 2, F.concat(F.lit("'x"), key, F.lit("'"), seq, F.lit(" => "), value, F.lit(" => z")))
        .otherwise(t.render_dump_line(key, n, value))
    )
    return counting.final_count(_events(spark, sf)).select(line.alias("value"))


def dump_lines_query(spark, sf):
    path = work_dir(spark, "dump")
    with_blanks = _dump(spark, sf).select(F.explode(F.array("value", F.lit(" \t"), F.lit(""))).alias("value"))
    with_blanks.write.text(path)
    return dump_lines(spark, path)


def dump_parse(spark, sf):
    return t.parse_dump_lines(_dump(spark, sf))


def dump_parse_quoted(spark, sf):
    return t.parse_dump_lines(_dump(spark, sf), quoted_only=True)


def all_queries() -> dict[str, Query]:
    return {
        "running_count": running_count,
        "running_count_split": running_count_split,
        "word_running_count": word_running_count,
        "emitted_counts": emitted_counts,
        "final_count": final_count,
        "render_tuple": render_tuple,
        "draw_words": draw_words,
        "draw_from_vocab": draw_from_vocab,
        "vocab": vocab,
        "vocab_stats": vocab_stats,
        "vocab_head_tail": vocab_head_tail,
        "collection_source": collection_source,
        "snapshot_at": snapshot_at,
        "snapshot_scan": snapshot_scan,
        "snapshot_metadata": snapshot_metadata,
        "snapshot_versions": snapshot_versions,
        "edit_last_n": edit_last_n,
        "edit_last_n_raw": edit_last_n_raw,
        "edit_last_n_double": edit_last_n_double,
        "double_roundtrip": double_roundtrip,
        "suffix_last": suffix_last,
        "tail_n": tail_n,
        "last_record": last_record,
        "snapshot_diff": snapshot_diff,
        "edit_report": edit_report,
        "resume": resume_counts,
        "resume_edited": resume_edited,
        "state_after_resume": state_after_resume,
        "stream_running_count": stream_running_count,
        "stream_word_running_count": stream_word_running_count,
        "stream_word_snapshot_at": stream_word_snapshot_at,
        "stream_word_changes": stream_word_changes,
        "stream_word_resume_edited": stream_word_resume_edited,
        "stream_restart": stream_restart,
        "stream_snapshot_at": stream_snapshot_at,
        "stream_resume": stream_resume,
        "stream_resume_edited": stream_resume_edited,
        "stream_state_after_resume": stream_state_after_resume,
        "file_arrivals": file_arrivals,
        "file_arrivals_edit": file_arrivals_edit,
        "file_changes": file_changes,
        "largest_file": largest_file,
        "largest_page": largest_page,
        "largest_version_file": largest_version_file,
        "file_filter": file_filter,
        "binary_scan": binary_scan,
        "signature_check": signature_check,
        "byte_search": byte_search,
        "byte_search_encodings": byte_search_encodings,
        "prefix_search": prefix_search,
        "file_range_search": file_range_search,
        "file_range_search_encodings": file_range_search_encodings,
        "file_range_context": file_range_context,
        "file_range_prefix": file_range_prefix,
        "file_range_dump": file_range_dump,
        "file_range_checksum": file_range_checksum,
        "byte_patch": byte_patch,
        "patch_requests": patch_requests,
        "hex_dump": hex_dump,
        "hex_context": hex_context,
        "hex_match_context": hex_match_context,
        "encoding_contexts": encoding_contexts,
        "last_record_offset": last_record_offset,
        "patched_context": patched_context,
        "checksum_verify": checksum_verify,
        "extract_id": extract_id,
        "extract_path": extract_path,
        "sanitize_hex": sanitize_hex,
        "hex_roundtrip": hex_roundtrip,
        "decode_u32_pair": decode_u32_pair,
        "parse_offset": parse_offset,
        "dump_lines": dump_lines_query,
        "dump_parse": dump_parse,
        "dump_parse_quoted": dump_parse_quoted,
    }
