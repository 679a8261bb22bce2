"""Readers for staged items, recordings, sidecars, reports, logs and gradient tables."""

from __future__ import annotations

import hashlib
import io
import tarfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Name parts that tell a recording's kind, and fields every sidecar must have.
SIGNAL_KINDS = {"RESPData": "resp_wave", "RESPTrig": "resp_trig", "PPGData": "card_wave", "PPGTrig": "card_trig"}
SIDECAR_FIELDS = ("group", "experiment", "session", "epoch", "timestamp")
RAW_GLOB = "P?????.7"
BINARY_SCHEMA = "path string, modificationTime timestamp, length long, content binary"
LOG_TIME = "MM-dd-yyyy HH:mm:ss.SSS"


def _file_name(column: str = "path") -> Column:
    return F.substring_index(F.col(column), "/", -1)


def read_staged(spark: SparkSession, path: str, files_per_trigger: int = 1000) -> DataFrame:
    """Stream of staged files, oldest first; hidden files never show up. The content is only read if used."""
    rows = spark.readStream.schema(BINARY_SCHEMA).format("binaryFile").option("maxFilesPerTrigger", files_per_trigger).option(
        "recursiveFileLookup", "true").load(path)
    return rows.where(~_file_name().startswith("."))


def list_staged(spark: SparkSession, path: str) -> DataFrame:
    """The same listing as a batch: path, modificationTime, length."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return rows.where(~_file_name().startswith(".")).select("path", "modificationTime", "length").orderBy("modificationTime", "path")


def read_raw_listing(spark: SparkSession, path: str, since=None, glob: str = RAW_GLOB) -> DataFrame:
    """Raw scanner files not older than the high-water mark: path, size, mod_time. File contents are not read."""
    rows = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
    rows = rows.select("path", F.col("length").alias("size"), F.col("modificationTime").alias("mod_time"))
    if since is not None:
        rows = rows.where(F.col("mod_time") >= F.lit(since).cast("timestamp"))
    return rows.orderBy("mod_time", "path")


def whole_text(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """One row per file: name, folder, value."""
    reader = spark.read.option("recursiveFileLookup", "true")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    rows = reader.text(path, wholetext=True).select("value", F.col("_metadata.file_path").alias("path"))
    return rows.select(_file_name().alias("name"), F.element_at(F.split("path", "/"), -2).alias("folder"), "path", "value")


def read_signals(spark: SparkSession, path: str, recording: str = r"([^/]+)/[^/]+$") -> DataFrame:
    """Recordings: (recording, kind, idx, value). The path tells the kind, and ``recording`` extracts the name."""
    files = whole_text(spark, path)
    kind = F.lit(None).cast("string")
    for part, name in reversed(SIGNAL_KINDS.items()):
        kind = F.when(F.contains("path", F.lit(part)), name).otherwise(kind)
    numbers = F.filter(F.split(F.trim("value"), r"\s+"), lambda v: v != "")
    return files.withColumn("kind", kind).where("kind is not null").select(
        F.regexp_extract("path", recording, 1).alias("recording"), "kind", F.posexplode(numbers).alias("idx", "text")).select(
        "recording", "kind", "idx", F.col("text").cast("double").alias("value"))


def read_sidecar(spark: SparkSession, path: str, glob: str = "*_physio.json") -> tuple[DataFrame, DataFrame]:
    return parse_sidecars(whole_text(spark, path, glob))


def parse_sidecars(texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """JSON sidecars (name, value), split into complete ones and those lacking a required field (with their text)."""
    schema = ", ".join(f"`{f}` string" for f in SIDECAR_FIELDS)
    files = texts.withColumn("j", F.from_json("value", schema))
    complete = F.lit(True)
    for name in SIDECAR_FIELDS:
        complete = complete & F.col(f"j.{name}").isNotNull()
    good = files.where(complete).select("name", *[F.col(f"j.{f}").alias(f) for f in SIDECAR_FIELDS])
    return good, files.where(~complete).select("name", "value")


# fixed values: the field names of a report
QA_SCHEMA = ("version double, tr double, `frame #` array<int>, transrot array<array<double>>, `mean displacement` array<double>, "
             "`relative displacement` array<double>, `max md` double, `median md` double, `temporal SNR (median)` double, "
             "`global mean signal` array<double>, `timeseries zscore` array<array<double>>, spikes array<array<int>>, "
             "`spike thresh` double")


def read_qa_reports(spark: SparkSession, path: str, named_by: str = "name") -> DataFrame:
    """Reports of a folder; a report is named by its file (``name``) or by the ``folder`` it lies in."""
    return parse_qa_reports(whole_text(spark, path).select(F.col(named_by).alias("name"), "value"))


def parse_qa_reports(texts: DataFrame) -> DataFrame:
    """QA reports (name, value): current documents, and the older form (a list; its first element, version 0.1)."""
    files = texts.withColumn("text", F.trim("value"))
    old = F.col("text").startswith("[")
    report = F.when(old, F.try_element_at(F.from_json("text", f"array<struct<{_struct(QA_SCHEMA)}>>"), F.lit(1))).otherwise(
        F.from_json("text", QA_SCHEMA))
    rows = files.select(F.col("name").alias("report_id"), old.alias("old"), report.alias("r")).select("report_id", "old", "r.*")
    return rows.withColumn("version", F.when(F.col("old"), 0.1).otherwise(F.col("version"))).drop("old")


def _struct(ddl: str) -> str:
    """Column list of a table schema in the form nested types use (``name: type``)."""
    import re

    return re.sub(r"(`[^`]+`|\b\w+) (array|double|int)", r"\1: \2", ddl)


def read_notch_log(spark: SparkSession, path: str, min_duration: float = 10.0, row_tag: str = "value") -> DataFrame:
    """Service log entries longer than ``min_duration`` seconds: (start, duration, notches). No stop means 0 s."""
    rows = spark.read.format("xml").option("rowTag", row_tag).schema(
        "_starttime string, _stoptime string, _VALUE string").load(path)
    stamp = lambda c: F.to_timestamp(F.col(c), LOG_TIME)
    seconds = (F.unix_micros(stamp("_stoptime")) - F.unix_micros(stamp("_starttime"))) / F.lit(1e6)
    duration = F.when(F.coalesce("_stoptime", F.lit("")) == "", 0.0).otherwise(seconds)
    return rows.select(stamp("_starttime").cast("timestamp_ntz").alias("start"), duration.alias("duration"),
                       F.trim("_VALUE").cast("int").alias("notches")).where(F.col("duration") > min_duration)


def read_gradients(spark: SparkSession, path: str, vectors: str | None = None) -> DataFrame:
    """Tables of ``*.bval`` and ``*.bvec`` files; with ``vectors`` all files of ``path`` are b-values, all of ``vectors`` b-vectors."""
    if vectors is not None:
        return parse_gradients(whole_text(spark, path), whole_text(spark, vectors))
    return parse_gradients(whole_text(spark, path, "*.bval"), whole_text(spark, path, "*.bvec"))


def parse_gradients(bvals: DataFrame, bvecs: DataFrame) -> DataFrame:
    """Gradient tables: (folder, i, bval, bx, by, bz) from a b-value vector and a 3-line vector table per folder."""
    numbers = lambda text: F.filter(F.split(F.trim(text), r"\s+"), lambda v: v != "")
    bval = bvals.select("folder", F.posexplode(numbers(F.col("value"))).alias("i", "v"))
    lines = bvecs.select("folder", F.posexplode(F.split(F.trim("value"), r"\n")).alias("dim", "line"))
    bvec = lines.select("folder", "dim", F.posexplode(numbers(F.col("line"))).alias("i", "v"))
    axes = bvec.groupBy("folder", "i").agg(*[F.max(F.when(F.col("dim") == d, F.col("v").cast("double"))).alias(n) for d, n in enumerate(("bx", "by", "bz"))])
    return bval.select("folder", "i", F.col("v").cast("double").alias("bval")).join(axes, ["folder", "i"])


def parse_scan_responses(captures: DataFrame, text: str = "value") -> DataFrame:
    """Query responses in captured scanner output: adds ``position``, ``transfer_syntax`` and ``tags`` (label -> value).

    Captures without a success status have no responses. A repeated label keeps its last value.
    """
    # fixed values of the format: the header of a data set, the line that names its syntax, the mark of an element
    header, syntax, element, comment = "# Dicom-Data-Set", "# Used TransferSyntax: ", "W: (", "#"
    lines = F.split(F.col(text), "\n")
    done = captures.where(F.exists(lines, lambda l: l.contains("DIMSE Status ") & l.endswith("Success")))
    sets = F.filter(F.transform(F.slice(F.split(F.col(text), header), 2, 1 << 30), lambda part: F.split(part, "\n")),
                    lambda own: own[1].contains(syntax) & (F.size(F.filter(own, lambda l: l.startswith(element))) > 1))
    found = done.select("*", F.posexplode(sets).alias("position", "_lines"))

    def described(line: Column) -> Column:
        """An element is tag, type and value, then the comment mark, lengths and the label."""
        note = F.substring_index(line, comment, -1)
        value = F.substr(line, F.lit(len("W: (0000,0000) XX ") + 1), F.length(line) - F.length(note) - len("W: (0000,0000) XX ") - 1)
        return F.struct(F.substring_index(note, " ", -1).alias("label"), value.alias("raw"))
    elements = F.filter("_lines", lambda l: l.startswith(element) & l.contains(comment))
    latest = F.reverse(F.transform(elements, described))
    labels = F.transform(latest, lambda p: p["label"])
    once = F.filter(latest, lambda p, i: F.array_position(labels, p["label"]) == i + 1)
    tags = F.map_from_entries(F.transform(once, lambda p: F.struct(p["label"], F.btrim(p["raw"], F.lit("[]= ")))))
    return found.select(*captures.columns, "position", F.substring_index(F.col("_lines")[1], syntax, -1).alias("transfer_syntax"), tags.alias("tags"))


def read_scan_responses(spark: SparkSession, path: str) -> DataFrame:
    return parse_scan_responses(whole_text(spark, path))


def verify_uploads(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """Uploads whose SHA-1 equals the announced digest: adds ``valid``.

    ``files``: path, content; ``manifest``: name, digest (hex). A file without an announcement is not valid.
    """
    hashed = files.select("path", _file_name().alias("name"), F.sha1("content").alias("actual"))
    return hashed.join(manifest, "name", "left").withColumn("valid", F.coalesce(F.col("actual") == F.lower("digest"), F.lit(False)))


def content_digests(files: DataFrame) -> DataFrame:
    """SHA-1 of a folder's contents: (folder, digest).

    ``files``: folder, path, content. Files enter in path order; archives enter as their regular members. Folders
    are spread over tasks, and each task reads its sorted rows as a stream, holding one file at a time.
    """
    def members(content: bytes) -> Iterator[bytes]:
        try:
            with tarfile.open(fileobj=io.BytesIO(content), mode="r:*") as archive:
                for member in archive:
                    if member.isfile():
                        yield archive.extractfile(member).read()
        except tarfile.TarError:
            yield content

    def digest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        folder, state = None, None
        for pdf in batches:
            done = []
            for here, content in zip(pdf["folder"], pdf["content"]):
                if here != folder:
                    if state is not None:
                        done.append((folder, state.hexdigest()))
                    folder, state = here, hashlib.sha1()
                for part in members(bytes(content)):
                    state.update(part)
            if done:
                yield pd.DataFrame(done, columns=["folder", "digest"])
        if state is not None:
            yield pd.DataFrame([(folder, state.hexdigest())], columns=["folder", "digest"])

    placed = files.select("folder", "path", "content").repartition("folder").sortWithinPartitions("folder", "path")
    return placed.select("folder", "content").mapInPandas(digest, "folder string, digest string")


def split_dead_letters(items: DataFrame, parsed: Column, path: str = "path", root: str = "") -> tuple[DataFrame, DataFrame]:
    """Items that parse, and the rest with the flat name they are preserved under."""
    ok = F.coalesce(parsed, F.lit(False))
    relative = F.regexp_replace(F.regexp_replace(F.col(path), "^" + root, ""), "^/", "")
    return items.where(ok), items.where(~ok).withColumn("preserved_as", F.translate(relative, "/", "_"))
