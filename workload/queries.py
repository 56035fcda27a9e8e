"""The registered queries: ``name -> f(spark, sf_dir) -> DataFrame``."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

import logframe as lf
from logframe.functions import extract, paths
from logframe.functions.text import clean_utf8, clean_words, needs_token
from logframe.schema import RECORD_SCHEMA
from logframe.session import scratch_path

from .files import append_files, cut_in_half, rename, write_files, write_logs, write_parts
from .lines import LINES, concat, file_path, lines_of, mixed_lines, table

Query = Callable[[SparkSession, str], DataFrame]
PARSERS = {
    "auth": lf.parse_auth,
    "syslog": lf.parse_syslog,
    "kern": lf.parse_kern,
    "dpkg": lf.parse_dpkg,
    "dmesg": lf.parse_dmesg,
}


def parsed(log_type: str, *columns: str) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        records = PARSERS[log_type](lines_of(spark, sf_dir, log_type)).drop("part")
        return records.select(*columns) if columns else records

    return query


auth_records = parsed("auth")


def all_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lf.parse_all(mixed_lines(spark, sf_dir)).drop("part", "file_path", "filename")


def on_records(operator: Callable[[DataFrame], DataFrame], source: Query = auth_records) -> Query:
    return lambda spark, sf_dir: operator(source(spark, sf_dir))


# Sources


def read_plain(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = lines_of(spark, sf_dir, "auth")
    keyed = lines.select(concat(F.col("event_id"), "\t", F.col("line")).alias("line"))
    folder = scratch_path(spark, "plain")
    write_parts(keyed, folder)
    key, line = F.substring_index("line", "\t", 1), F.substring_index("line", "\t", -1)
    return lf.read_lines(spark, folder).select(key.cast("bigint").alias("event_id"), line.alias("line"))


def read_gzip(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch_path(spark, "gzip")
    write_parts(lines_of(spark, sf_dir, "auth"), folder, "gzip")
    return lf.read_lines(spark, folder).select("line", paths.reader(F.col("filename")).alias("reader"))


def clean_utf8_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in Latin-1 bytes, read as UTF-8."""
    single_byte = F.regexp_replace("text", r"[^\x00-\xff]", "?")
    mislabelled = F.encode(single_byte, "ISO-8859-1").cast("string")
    return documents(spark, sf_dir).select("doc_id", clean_utf8(mislabelled).alias("text"))


def frame_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    framed = lf.frame_lines(documents(spark, sf_dir), "text")
    return framed.select("doc_id", F.col("part").cast("bigint").alias("part"), F.col("text").alias("line"))


def process_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events as lines of each format, in plain and gzip files, read back by file type."""
    folder = scratch_path(spark, "logs")
    names = {"auth": "auth.log", "syslog": "syslog", "kern": "kern.log", "dpkg": "dpkg.log"}
    for log_type, name in names.items():
        write_logs(lines_of(spark, sf_dir, log_type), scratch_path(spark, log_type), folder, name + ".{}")
    write_logs(lines_of(spark, sf_dir, "dmesg"), scratch_path(spark, "dmesg"), folder, "dmesg.{}.gz", "gzip")
    return lf.process_logs(spark, folder)[1].select(*RECORD_SCHEMA.names)


# Following files


def follow(spark: SparkSession, pattern: str, checkpoint: str) -> DataFrame:
    """Run the stream up to what the files hold now; gives what this run brought."""
    output = scratch_path(spark, "tail-out")
    stream = lf.tail_logs(spark, pattern).writeStream.format("parquet").option("checkpointLocation", checkpoint)
    query = stream.trigger(availableNow=True).start(output)
    query.awaitTermination()
    # The sink's log of this folder starts with this run's batch, so the folder is read by its files.
    return spark.read.schema(lf.TAIL_SCHEMA).parquet(f"{output}/*.parquet")


def write_shards(spark: SparkSession, sf_dir: str, folder: str, which, shards: int | None = None) -> list[str]:
    """Lines of the chosen events, dealt out evenly to log files ``<number>.log``."""
    lines = lines_of(spark, sf_dir, "auth").filter(which)
    lines = lines.repartition(shards or spark.sparkContext.defaultParallelism, "event_id")
    return write_logs(lines, scratch_path(spark, "shards"), folder, "{}.log")


def tail_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch_path(spark, "tail")
    write_shards(spark, sf_dir, folder, F.lit(True))
    return follow(spark, f"{folder}/*.log", scratch_path(spark, "tail-state")).select("line")


def tail_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Even events first; then the odd ones are appended to the same files."""
    folder, state = scratch_path(spark, "tail"), scratch_path(spark, "tail-state")
    logs = write_shards(spark, sf_dir, folder, F.col("event_id") % 2 == 0)
    first = follow(spark, f"{folder}/*.log", state)
    more = write_shards(spark, sf_dir, scratch_path(spark, "more"), F.col("event_id") % 2 == 1, len(logs))
    append_files(spark, list(zip(more, logs)))
    second = follow(spark, f"{folder}/*.log", state)
    return rounds(first, second).select("round", "line")


def tail_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five parts of the events. The first is read; the second is appended and the files renamed, with no new ones yet;
    the third comes in new files; the fourth is appended, the files renamed, and new ones take the last."""
    folder, state = scratch_path(spark, "tail"), scratch_path(spark, "tail-state")
    part = F.col("event_id") % 5

    def append(number: int, logs: list[str]) -> None:
        more = write_shards(spark, sf_dir, scratch_path(spark, "more"), part == number, len(logs))
        append_files(spark, list(zip(more, logs)))

    def read() -> DataFrame:
        return follow(spark, f"{folder}/*.log", state)

    logs = write_shards(spark, sf_dir, folder, part == 0)
    brought = [read()]
    append(1, logs)
    for log in logs:
        rename(spark, log, f"{log}.1")
    brought.append(read())
    write_shards(spark, sf_dir, folder, part == 2, len(logs))
    brought.append(read())
    append(3, logs)
    for log in logs:
        rename(spark, log, f"{log}.0")
    write_shards(spark, sf_dir, folder, part == 4, len(logs))
    brought.append(read())
    return rounds(*brought).select("round", "segment", "line")


def tail_bounded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A backlog of files in batches of at most about an eighth of it, by a stream that is started twice. ``fits`` says
    whether a line's batch is within the limit."""
    folder, state, output = (scratch_path(spark, name) for name in ("tail", "tail-state", "tail-out"))
    write_shards(spark, sf_dir, folder, F.lit(True), 16)
    total = lines_of(spark, sf_dir, "auth").agg(F.sum(F.octet_length("line") + 1)).first()[0]
    limit = total // 8

    def write(frame: DataFrame, batch: int) -> None:
        frame.write.mode("overwrite").parquet(f"{output}/batch={batch}")

    for which in ("the first batch", "the rest"):
        lines = lf.tail_logs(spark, f"{folder}/*.log", max_bytes=limit, progress=f"{state}/progress")
        writer = lines.writeStream.foreachBatch(write).option("checkpointLocation", f"{state}/checkpoint")
        # A run of this trigger is one batch.
        query = (writer.trigger(availableNow=True) if which == "the first batch" else writer).start()
        if which == "the first batch":
            query.awaitTermination()
        else:
            query.processAllAvailable()
            query.stop()
    rows = spark.read.schema(lf.TAIL_SCHEMA + ", batch bigint").parquet(output)
    sizes = rows.groupBy("batch").agg((F.sum(F.octet_length("line") + 1) <= limit).alias("fits"))
    return rows.join(sizes, "batch").select("line", "fits")


def stream_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of three batches of logs that grow and are renamed; the stream starts anew for each."""
    folder, state, counts = (scratch_path(spark, name) for name in ("tail", "tail-state", "counts"))
    part = F.col("event_id") % 3

    def run() -> None:
        records = lf.parse_auth(lf.tail_logs(spark, f"{folder}/*.log"))
        lf.write_counts(lf.summary_counts(records), counts, state, compact_every=2).trigger(availableNow=True).start().awaitTermination()

    logs = write_shards(spark, sf_dir, folder, part == 0)
    run()
    more = write_shards(spark, sf_dir, scratch_path(spark, "more"), part == 1, len(logs))
    append_files(spark, list(zip(more, logs)))
    run()
    for log in logs:
        rename(spark, log, f"{log}.1")
    write_shards(spark, sf_dir, folder, part == 2, len(logs))
    run()
    return lf.read_counts(spark, counts, "dimension string, value string, n bigint")


def stream_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that come in three batches, in the order of their ids, by a stream that starts anew for each."""
    folder, state, output = (scratch_path(spark, name) for name in ("texts", "texts-state", "tokens"))
    texts = documents(spark, sf_dir).select("doc_id", "text")
    last = texts.agg(F.max("doc_id")).first()[0] or 0
    for number in range(3):
        third = F.floor(F.col("doc_id") * 3 / (last + 1)) == number
        texts.filter(third).write.mode("append").parquet(folder)
        stream = spark.readStream.schema(texts.schema).parquet(folder)
        writer = lf.normalize_stream(stream, output, state, "text", ["doc_id"], compact_every=2)
        writer.trigger(availableNow=True).start().awaitTermination()
    return lf.stream_messages(spark, output, texts.schema).select("doc_id", "text")


def rounds(*frames: DataFrame) -> DataFrame:
    numbered = [frame.withColumn("round", F.lit(n).cast("bigint")) for n, frame in enumerate(frames)]
    return reduce(DataFrame.unionByName, numbered)


# Catalogue and reports


def detect_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "events").select("event_id", "user_id")
    return lf.catalog_paths(lines.groupBy(file_path().alias("path")).agg(F.count("*").alias("n_lines")))


def file_exists(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = detect_files(spark, sf_dir).select("path")
    listed = detect_files(spark, sf_dir).filter(F.col("log_type") != "unknown")
    return lf.mark_existing(asked, listed)


def report(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = detect_files(spark, sf_dir)
    asked = files.select("path").unionByName(files.select(concat(F.col("path"), ".missing").alias("path")))
    return lf.run_report(files, mixed_lines(spark, sf_dir), expected=asked)


def run_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(spark, sf_dir).select("path", "log_type", "reader", "rotation", "n_lines", "n_records", "status")


FILE_SHARDS = 4


def write_catalogue(spark: SparkSession, sf_dir: str) -> str:
    """Files of four kinds, each a fourth of the events' lines: plain, gzip, without a format, and gzip cut in half."""
    folder = scratch_path(spark, "catalogue")
    kinds = {"none": {"auth": "auth.log.{}", "kern": "nginx.log.{}"}, "gzip": {"dmesg": "dmesg.{}.gz", "syslog": "syslog.{}.gz"}}
    for compression, names in kinds.items():
        shards = [
            lines_of(spark, sf_dir, log_type).select("line", (F.col("event_id") % FILE_SHARDS + place * FILE_SHARDS).alias("file"))
            for place, log_type in enumerate(names)
        ]
        files = [f"{folder}/{name.format(shard)}" for name in names.values() for shard in range(FILE_SHARDS)]
        write_files(reduce(DataFrame.unionByName, shards), "file", scratch_path(spark, "shards"), files, compression)
    for shard in range(FILE_SHARDS):
        cut_in_half(spark, f"{folder}/{kinds['gzip']['syslog'].format(shard)}")
    return folder


def catalog_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = lf.catalog_files(spark, write_catalogue(spark, sf_dir))
    return files.select("filename", "log_type", "compressed", "rotation", "extension", "reader", "stem", "suffix")


def run_report_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of real files; what can be read of a torn one is left open."""
    folder = write_catalogue(spark, sf_dir)
    paths = [folder, f"{folder}/absent.log"]
    files, _ = lf.process_logs(spark, paths, strict=False, tolerant=True)
    asked = files.select("path").unionByName(spark.createDataFrame([(paths[1],)], "path string"))
    lines = lf.read_lines(spark, folder, tolerant=True)
    report = lf.run_report(files, lines, expected=asked, broken=lf.broken_files(files))
    whole = lambda name: F.when(F.col("status") != "failed", F.col(name)).alias(name)
    name = F.substring_index("path", "/", -1).alias("filename")
    return report.select(name, "log_type", "reader", "rotation", whole("n_lines"), whole("n_records"), "status")


def parse_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lf.parse_rejects(mixed_lines(spark, sf_dir)).select("event_id", "log_type", "line", "reason")


# Extractors


def parse_header(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lf.parse_header(lines_of(spark, sf_dir, "auth")).drop("part")


def extracted(field: str) -> Query:
    function = getattr(extract, f"extract_{field}")
    return lambda spark, sf_dir: parse_header(spark, sf_dir).select("event_id", function(F.col("message")).alias(field))


# Words and tokens


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lf.spread(table(spark, sf_dir, "documents").select("doc_id", "text"))


def document_dictionary(spark: SparkSession, sf_dir: str) -> lf.Dictionary:
    return lf.build_dictionary(documents(spark, sf_dir), "text", ["doc_id"])


def clean_words_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = documents(spark, sf_dir).select("doc_id", F.posexplode(clean_words(F.col("text"))).alias("place", "word"))
    place = (F.col("place") + 1).cast("bigint").alias("pos")
    return words.select("doc_id", place, "word", needs_token(F.col("word")).alias("needs_token"))


def normalize_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    dictionary = document_dictionary(spark, sf_dir)
    return lf.normalize_messages(documents(spark, sf_dir), dictionary, "text", ["doc_id"])


def expand_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens, dictionary = lf.normalize(documents(spark, sf_dir), None, "text", ["doc_id"])
    return lf.expand_messages(tokens, dictionary, "text", ["doc_id"])


def normalize_messages_large(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With most of the dictionary beyond the part that is broadcast, as in a large corpus."""
    dictionary = document_dictionary(spark, sf_dir)
    return lf.normalize_messages(documents(spark, sf_dir), dictionary, "text", ["doc_id"], head_entries=200)


def expand_messages_large(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens, dictionary = lf.normalize(documents(spark, sf_dir), None, "text", ["doc_id"], head_entries=200)
    return lf.expand_messages(tokens, dictionary, "text", ["doc_id"], head_entries=200)


def build_dictionary_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From scanned lines, in the order of files, blocks, lines and pieces. Files are named by the lines' first event."""
    lines = lines_of(spark, sf_dir, "auth")
    folder = scratch_path(spark, "ordered")
    numbered = lines.repartitionByRange(4, "event_id").sortWithinPartitions("event_id")
    write_parts(numbered, folder)
    records = lf.parse_auth(lf.read_lines(spark, folder))
    return lf.build_dictionary(records).entries


def normalize_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lf.normalize(auth_records(spark, sf_dir), order_by=["event_id"])[0]


def dictionary_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = lf.save_dictionary(document_dictionary(spark, sf_dir), scratch_path(spark, "dictionary"))
    loaded = lf.load_dictionary(spark, path)
    return loaded.entries.withColumn("counter", F.lit(loaded.counter).cast("bigint"))


def dictionary_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One dictionary text per event; some are empty, malformed or without a counter."""
    kind, event_id = F.col("event_id") % 10, F.col("event_id")
    no_counter = concat('{"word_to_token": {"', F.col("event_type"), '": "TK0001"}}')
    whole = concat(
        '{"counter": ', event_id % 5000, ', "word_to_token": {"', F.col("event_type"), '": "TK0001", "u',
        F.col("user_id"), '": "TK0002"}}',
    )
    twice = concat('{"word_to_token": {"w": "TK0001", "', F.col("event_type"), '": "TK0002", "w": "TK0003"}}')
    text = F.when(kind == 0, "").when(kind == 1, "{bad").when(kind == 2, no_counter).when(kind == 3, twice).otherwise(whole)
    texts = table(spark, sf_dir, "events").select("event_id", text.alias("value"))
    return lf.parse_dictionary_json(texts).select("event_id", "counter", "word", "token")


def dictionary_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    dictionary = document_dictionary(spark, sf_dir)
    raw = documents(spark, sf_dir).select(F.explode(F.split("text", " ")).alias("word")).distinct()
    empty = lf.clear_dictionary(spark)

    def stat(name: str, counted: DataFrame) -> DataFrame:
        return counted.agg(F.count("*").alias("n")).select(F.lit(name).alias("stat"), "n")

    def value(name: str, number: int) -> DataFrame:
        return spark.range(1).select(F.lit(name).alias("stat"), F.lit(number).cast("bigint").alias("n"))

    return (
        stat("size", dictionary.entries)
        .unionByName(value("counter", dictionary.counter))
        .unionByName(stat("contained", lf.contains_words(raw, dictionary)))
        .unionByName(stat("cleared_size", empty.entries))
        .unionByName(value("cleared_counter", empty.counter))
    )


# Sinks


def json_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = auth_records(spark, sf_dir)
    return lf.read_json(spark, lf.write_json(records, scratch_path(spark, "json")), records.schema)


def csv_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = auth_records(spark, sf_dir)
    return lf.read_csv(spark, lf.write_csv(records, scratch_path(spark, "csv")), records.columns)


def sink_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = auth_records(spark, sf_dir)
    schema, columns = records.schema, records.columns
    json_path, csv_path = scratch_path(spark, "json"), scratch_path(spark, "csv")
    cleared_json, cleared_csv = scratch_path(spark, "json"), scratch_path(spark, "csv")
    for path in (json_path, cleared_json):
        lf.write_json(records, path)
    for path in (csv_path, cleared_csv):
        lf.write_csv(records, path)
    lf.clear_json(spark, cleared_json, schema)
    lf.clear_csv(spark, cleared_csv, schema)
    counts = [
        ("json", "written", lf.read_json(spark, json_path, schema)),
        ("csv", "written", lf.read_csv(spark, csv_path, columns)),
        ("json", "cleared", lf.read_json(spark, cleared_json, schema)),
        ("csv", "cleared", lf.read_csv(spark, cleared_csv, columns)),
    ]
    rows = [
        frame.agg(F.count("*").alias("n")).select(F.lit(sink).alias("sink"), F.lit(stage).alias("stage"), "n")
        for sink, stage, frame in counts
    ]
    return rows[0].unionByName(rows[1]).unionByName(rows[2]).unionByName(rows[3])


def table_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = lf.KeyedTable(spark, scratch_path(spark, "keyed"))
    for log_type in ("auth", "kern"):
        stored.append(parsed(log_type)(spark, sf_dir), order_by=["event_id"])
    fields = "log_type string, event_id bigint, event_type string, user string, port bigint, message string"
    return stored.read().select("id", F.from_json("data", fields).alias("record")).select("id", "record.*")


def table_clear(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Append, clear, append: ids go on. Also the number of rows and the last id after each step."""
    stored = lf.KeyedTable(spark, scratch_path(spark, "keyed"))
    steps = []
    for step in ("append", "clear", "append again"):
        if step == "clear":
            stored.clear()
        else:
            stored.append(parsed("auth" if step == "append" else "kern")(spark, sf_dir), order_by=["event_id"])
        steps.append((step, stored.count(), stored.last_id()))
    rows = stored.read().select("id", F.from_json("data", "event_id bigint").alias("record"))
    rows = rows.select(F.lit("row").alias("step"), F.col("record.event_id").alias("n"), F.col("id"))
    return rows.unionByName(spark.createDataFrame(steps, "step string, n bigint, id bigint"))


def queries() -> dict[str, Query]:
    registered: dict[str, Query] = {
        "read_plain": read_plain,
        "read_gzip": read_gzip,
        "clean_utf8": clean_utf8_query,
        "frame_lines": frame_lines,
        "process_files": process_files,
        "tail_first": tail_first,
        "tail_append": tail_append,
        "tail_rotation": tail_rotation,
        "tail_bounded": tail_bounded,
        "stream_counts": stream_counts,
        "stream_normalize": stream_normalize,
        "detect_files": detect_files,
        "file_exists": file_exists,
        "parse_header": parse_header,
        "parse_all": all_records,
        "parse_rejects": parse_rejects,
        "security_events": on_records(lf.security_events),
        "network_events": on_records(lf.network_events),
        "user_events": on_records(lf.user_events),
        "summary_counts": on_records(lambda records: lf.summary_counts(records, by=["log_type"]), all_records),
        "record_counts": on_records(lf.record_counts, all_records),
        "preview": on_records(lambda records: lf.preview(records, 5, ["event_id"])),
        "chars_read": on_records(lf.chars_read, mixed_lines),
        "clean_words": clean_words_query,
        "build_dictionary": lambda spark, sf_dir: document_dictionary(spark, sf_dir).entries,
        "normalize_messages": normalize_messages,
        "expand_messages": expand_messages,
        "build_dictionary_lines": build_dictionary_lines,
        "normalize_messages_large": normalize_messages_large,
        "expand_messages_large": expand_messages_large,
        "normalize_records": normalize_records,
        "dictionary_roundtrip": dictionary_roundtrip,
        "dictionary_load": dictionary_load,
        "dictionary_stats": dictionary_stats,
        "json_roundtrip": json_roundtrip,
        "csv_roundtrip": csv_roundtrip,
        "sink_counts": sink_counts,
        "table_append": table_append,
        "table_clear": table_clear,
        "catalog_files": catalog_files,
        "run_report": run_report,
        "run_report_files": run_report_files,
        "report_totals": on_records(lf.report_totals, report),
    }
    for log_type in LINES:
        registered[f"parse_{log_type}"] = parsed(log_type)
        registered[f"classify_{log_type}"] = parsed(log_type, "event_id", "event", "event_type", "severity")
    for field in ("user", "ip", "port", "protocol"):
        registered[f"extract_{field}"] = extracted(field)
    return registered
