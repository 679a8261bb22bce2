"""Queries that write tables derived from the driver's data, read them back, or run them as streams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scanloom import catalog
from scanloom.operators import physio, quality, repair
from scanloom.plans.registry import query
from scanloom.plans.signal_queries import _BRAIN, _DRIFT, _MOVED, _REGRESSORS, _THRESHOLD, _gradients, _reports, _runs, series
from scanloom.plans.state_queries import _NOW, _READY, _empty_archive
from scanloom.session import cut_lineage, scratch_folder
from scanloom.sources import readers, writers
from scanloom.streaming import monitor, stability
from scanloom.streaming.ingest_sink import IngestSink

_OBSERVED = "observation"


def _stream(tb, table: str) -> DataFrame:
    """The driver's table as a file stream."""
    schema = tb.base(table).schema
    return tb.spark.readStream.schema(schema).option("pathGlobFilter", f"{table}.parquet").parquet(tb.sf_dir)


def _drain(stream: DataFrame, label: str) -> DataFrame:
    """Run a stream over everything available into a table, and read the table."""
    folder = scratch_folder(stream.sparkSession, label)
    running = (stream.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/log")
               .trigger(availableNow=True).start())
    running.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}/out")


def _observe(events: DataFrame) -> DataFrame:
    return events.selectExpr("user_id as item", "ts as poll_ts", "event_id as seq", "cast(floor(value / 40) as bigint) as size")


# sources -----------------------------------------------------------------------------------------

def _written(rows: DataFrame, folder: str, *places: str) -> str:
    """Text files (column value), one folder for each value of ``places``; a group's rows are one bounded file."""
    writers.write_texts(rows, folder, *places)
    return folder


def _place(name: str, column: str = "path") -> Column:
    return F.regexp_extract(column, f"{name}=([^/]*)", 1)


@query("S1_load_catalog", """select d.id as dataset_id, case when d.filenames = '' then 0 else len(string_split(d.filenames, ', ')) end as n_files, d.kind as kind, e.series as series,
    e.trashtime is not null as epoch_trashed, s.uid as uid, s.timestamp as taken, u.code as code, u.trashtime is not null as subject_trashed, x.name as experiment, g.gid as lab
    from dataset d join epoch e on d.container_id = e.id join session s on e.session_id = s.id join subject u on s.subject_id = u.id
    join experiment x on u.experiment_id = x.id join research_group g on x.owner_id = g.id""")
def _(tb):
    """Entity tables in their stored form, written, loaded by their declared schemas and chained."""
    folder, levels = scratch_folder(tb.spark, "catalog"), catalog.CONTAINERS
    shared = lambda column, level: F.col(column) * len(levels) + levels.index(level)  # containers share one range of ids

    def stored(rows: DataFrame, entity: str) -> DataFrame:
        return rows.select(*[F.col(f.name).cast(f.dataType) for f in catalog.schema_of(entity) if f.name in rows.columns])

    containers = None
    for level in levels:
        key, above = catalog.PARENT[level]
        rows = tb.catalog.frames[level].withColumn("id", shared("id", level))
        if above in levels:
            rows = rows.withColumn(key, shared(key, above))
        stored(rows.drop("timestamp", "trashtime", "dirty", "scheduling"), level).write.parquet(f"{folder}/{level}")
        own = stored(rows, "data_container")
        containers = own if containers is None else containers.unionByName(own, allowMissingColumns=True)
    containers.write.parquet(f"{folder}/data_container")
    datasets = tb.catalog.dataset.withColumn("container_id", shared("container_id", "epoch")).withColumn("filenames", catalog.join_filenames("filenames"))
    stored(datasets, "dataset").write.parquet(f"{folder}/dataset")
    stored(tb.catalog.research_group, "research_group").write.parquet(f"{folder}/research_group")
    rows = catalog.load_catalog(tb.spark, folder).chain("dataset", "research_group")
    return rows.select(
        "dataset_id", F.size("dataset_filenames").alias("n_files"), F.col("dataset_kind").alias("kind"), F.col("epoch_series").alias("series"),
        F.col("epoch_trashtime").isNotNull().alias("epoch_trashed"), F.col("session_uid").cast("string").alias("uid"), F.col("session_timestamp").alias("taken"),
        F.col("subject_code").alias("code"), F.col("subject_trashtime").isNotNull().alias("subject_trashed"),
        F.col("experiment_name").alias("experiment"), F.col("research_group_gid").alias("lab"))


_BYTES = "cast(sum(coalesce(strlen(text), 0) + 1) as bigint) as size"


@query("S2_list_staged", f"select cast(floor(doc_id / 25) as bigint) as item, {_BYTES} from documents group by 1")
def _(tb):
    """Staged items are folders of 25 documents, so their number grows with the table and none of them does."""
    rows = tb.base("documents").select(F.floor(F.col("doc_id") / 25).alias("item"), F.col("text").alias("value"))
    listed = readers.list_staged(tb.spark, _written(rows, scratch_folder(tb.spark, "staged"), "item"))
    return listed.groupBy(_place("item").cast("long").alias("item")).agg(F.sum("length").alias("size"))


@query("S2_staged_stream", f"select cast(floor(doc_id / 100) as bigint) as item, {_BYTES} from documents group by 1")
def _(tb):
    """The stream of staged items, 20 files in a micro-batch; every file arrives once."""
    rows = tb.base("documents").select(F.floor(F.col("doc_id") / 100).alias("item"), F.col("text").alias("value"))
    folder = _written(rows, scratch_folder(tb.spark, "staged"), "item")
    seen = _drain(readers.read_staged(tb.spark, folder, 20).select("path", "length"), "staged-seen")
    return seen.groupBy(_place("item").cast("long").alias("item")).agg(F.sum("length").alias("size"))


@query("S3_raw_listing", f"select source, cast(floor(doc_id / 500) as bigint) as item, {_BYTES} from documents group by 1, 2")
def _(tb):
    rows = tb.base("documents").select("source", F.floor(F.col("doc_id") / 500).alias("item"), F.col("text").alias("value"))
    folder = _written(rows, scratch_folder(tb.spark, "raw"), "source", "item")
    listed = readers.read_raw_listing(tb.spark, folder, "2020-01-01", "part-*")
    return listed.groupBy(_place("source").alias("source"), _place("item").cast("long").alias("item")).agg(F.sum("size").alias("size"))


@series("S4_read_signals", "select cast(acq_id as varchar) as recording, kind, idx, round(value, 2) as value from signal")
def _(tb):
    folder = scratch_folder(tb.spark, "signals")
    part = F.element_at(F.create_map(*[F.lit(v) for k in readers.SIGNAL_KINDS for v in (readers.SIGNAL_KINDS[k], k)]), F.col("kind"))
    rows = tb.signal.select("acq_id", part.alias("part"), F.col("idx").alias("position"), F.col("value").cast("string").alias("line"))
    # trigger files list sample numbers; their value becomes the index again below
    writers.write_texts(writers.documents(rows, ["acq_id", "part"], ["position"]), folder, "acq_id", "part")
    read = readers.read_signals(tb.spark, folder, r"acq_id=(\d+)")
    place = F.when(F.col("kind").endswith("_trig"), F.col("value").cast("int")).otherwise(F.col("idx"))
    return read.select("recording", "kind", place.alias("idx"), F.round("value", 2).alias("value"))


@query("S5_sidecars", "select cast(event_id as varchar) || '_physio.json' as name, case when event_id % 4 = 0 then null else event_type end as experiment, event_id % 4 <> 0 as complete from events")
def _(tb):
    texts = tb.base("events").selectExpr(
        "concat(event_id, '_physio.json') as name",
        """concat('{"group": "g", ', case when event_id % 4 = 0 then '' else concat('"experiment": "', event_type, '", ') end, '"session": "s", "epoch": "', event_id, '", "timestamp": "', ts, '"}') as value""")
    good, bad = readers.parse_sidecars(texts)
    return good.select("name", "experiment", F.lit(True).alias("complete")).unionAll(
        bad.select("name", F.lit(None).cast("string").alias("experiment"), F.lit(False).alias("complete")))


@query("S6_qa_report_forms", "select event_id as report_id, case when event_id % 2 = 0 then 0.1::double else 1.0::double end as version, round(value, 2) as tsnr, cast(event_id % 3 as int) as num_spikes from events")
def _(tb):
    body = """concat('{', case when event_id % 2 = 0 then '' else '"version": 1.0, ' end, '"temporal SNR (median)": ', cast(value as string), ', "frame #": [0, 1], "spikes": [',
        array_join(transform(slice(array('[1, 2]', '[3, 4]'), 1, cast(event_id % 3 as int)), x -> x), ', '), ']}')"""
    texts = tb.base("events").selectExpr("event_id as name", f"case when event_id % 2 = 0 then concat('[', {body}, ']') else {body} end as value")
    return quality.qa_summary(readers.parse_qa_reports(texts))


@query("S5_read_sidecars", "select s_suppkey as epoch, case when s_suppkey % 4 = 0 then null else s_name end as experiment, s_suppkey % 4 <> 0 as complete from supplier")
def _(tb):
    """One sidecar file for each supplier; those without an experiment keep their text."""
    texts = tb.base("supplier").selectExpr("s_suppkey as recording", """concat('{"group": "g", ',
        case when s_suppkey % 4 = 0 then '' else concat('"experiment": "', s_name, '", ') end, '"session": "s", "epoch": "', s_suppkey, '", "timestamp": "t"}') as value""")
    good, bad = readers.read_sidecar(tb.spark, _written(texts, scratch_folder(tb.spark, "sidecars"), "recording"), "part-*")
    return good.select(F.col("epoch").cast("long").alias("epoch"), "experiment", F.lit(True).alias("complete")).unionAll(
        bad.select(F.get_json_object("value", "$.epoch").cast("long"), F.lit(None).cast("string"), F.lit(False)))


@query("S6_read_reports", "select s_suppkey as report, case when s_suppkey % 2 = 0 then 0.1::double else 1.0::double end as version, round(s_acctbal, 2) as tsnr, cast(s_suppkey % 3 as int) as num_spikes from supplier")
def _(tb):
    """One report file for each supplier, every other one in the older form."""
    body = """concat('{', case when s_suppkey % 2 = 0 then '' else '"version": 1.0, ' end, '"temporal SNR (median)": ', cast(s_acctbal as string), ', "frame #": [0, 1], "spikes": [',
        array_join(slice(array('[1, 2]', '[3, 4]'), 1, cast(s_suppkey % 3 as int)), ', '), ']}')"""
    texts = tb.base("supplier").selectExpr("s_suppkey as report", f"case when s_suppkey % 2 = 0 then concat('[', {body}, ']') else {body} end as value")
    read = readers.read_qa_reports(tb.spark, _written(texts, scratch_folder(tb.spark, "report-files"), "report"), "folder")
    return quality.qa_summary(read).select(_place("report", "report_id").cast("long").alias("report"), "version", "tsnr", "num_spikes")


@query("S7_notch_log", "select o_orderdate + interval '1' second * (o_orderkey % 60) as start, case when o_custkey % 3 = 0 then 0 else (o_custkey % 50) + 0.25::double end as duration, cast(o_custkey as int) as notches from orders where case when o_custkey % 3 = 0 then 0 else (o_custkey % 50) + 0.25 end > 10")
def _(tb):
    folder = scratch_folder(tb.spark, "log")
    lines = tb.sql("""select o_orderkey as position, floor(o_orderkey / 5000) as part, concat('<value starttime="', date_format(o_orderdate + interval '1' second * (o_orderkey % 60), 'MM-dd-yyyy HH:mm:ss.SSS'), '"',
        case when o_custkey % 3 = 0 then '' else concat(' stoptime="', date_format(o_orderdate + interval '1' second * (o_orderkey % 60 + o_custkey % 50) + interval '250' millisecond, 'MM-dd-yyyy HH:mm:ss.SSS'), '"') end,
        '>', o_custkey, '</value>') as line from {orders}""")
    texts = writers.documents(lines, ["part"], ["position"])
    writers.write_texts(texts.select("part", F.concat(F.lit("<log>"), "value", F.lit("</log>")).alias("value")), folder, "part")
    return readers.read_notch_log(tb.spark, folder)


@query("S8_gradients", """select cast(floor(vec_id / 50) as bigint) as folder, cast(vec_id % 50 as int) as i, (vec_id % 7)::double as bval,
    round(embedding[21], 4) as bx, round(embedding[22], 4) as "by", round(embedding[23], 4) as bz from embeddings""")
def _(tb):
    rows = tb.base("embeddings").selectExpr("floor(vec_id / 50) as folder", "vec_id % 50 as i", "vec_id % 7 as b",
                                            *[f"cast(embedding[{20 + k}] as string) as g{k}" for k in range(3)])
    line = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", F.col(c).cast("string").alias("s")))), lambda e: e["s"]), " ")
    packed = rows.groupBy("folder").agg(line("b").alias("bval"), F.concat_ws("\n", line("g0"), line("g1"), line("g2")).alias("bvec"))
    out = readers.parse_gradients(packed.select("folder", F.col("bval").alias("value")), packed.select("folder", F.col("bvec").alias("value")))
    return out.select("folder", "i", "bval", *[F.round(F.col(c), 4).cast("float").alias(c) for c in ("bx", "by", "bz")])


@query("S8_read_gradients", """select cast(floor(vec_id / 50) as bigint) as acq_id, cast(vec_id % 50 as int) as i, (vec_id % 7)::double as bval,
    embedding[21]::float as bx, embedding[22]::float as "by", embedding[23]::float as bz from embeddings""")
def _(tb):
    """A b-value file and a b-vector file for each 50 vectors, written and read back."""
    rows = tb.base("embeddings").selectExpr("floor(vec_id / 50) as acq", "vec_id % 50 as i", "vec_id % 7 as b", *[f"embedding[{20 + k}] as g{k}" for k in range(3)])
    line = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", F.col(c).cast("string").alias("s")))), lambda e: e["s"]), " ")
    packed = rows.groupBy("acq").agg(line("b").alias("bval"), F.concat_ws("\n", line("g0"), line("g1"), line("g2")).alias("bvec"))
    folder = scratch_folder(tb.spark, "gradients")
    parts = [_written(packed.select("acq", F.col(c).alias("value")), f"{folder}/{c}", "acq") for c in ("bval", "bvec")]
    out = readers.read_gradients(tb.spark, *parts)
    return out.select(_place("acq", "folder").cast("long").alias("acq_id"), "i", "bval", *[F.col(c).cast("float").alias(c) for c in ("bx", "by", "bz")])


@query("S9_scan_responses", """select event_id, k as position, event_type || k as patient, cast(event_id % 90 + k as varchar) as images from events, range(0, 2) q(k) where event_id % 5 <> 0""")
def _(tb):
    one = """concat('\\nW: # Dicom-Data-Set\\nW: # Used TransferSyntax: Little Endian Explicit\\n', 'W: (0010,0020) LO [', event_type, {k}, ' ]  #  14, 1 PatientID\\n',
        'W: (0020,1002) IS [', event_id % 90 + {k}, ']  #   2, 1 ImagesInAcquisition\\n')"""
    text = f"""concat('I: start\\nW: ----', {one.format(k=0)}, 'W: ----', {one.format(k=1)}, 'I: DIMSE Status : ', case when event_id % 5 = 0 then 'Failed' else '0x0000: Success' end, '\\n') as value"""
    rows = readers.parse_scan_responses(tb.base("events").selectExpr("event_id", text))
    return rows.select("event_id", F.col("position").cast("long").alias("position"), F.col("tags")["PatientID"].alias("patient"),
                       F.col("tags")["ImagesInAcquisition"].alias("images"))


@query("S9_read_responses", """select s_suppkey as capture, cast(k as bigint) as position, s_name || '.' || k as patient, cast(s_nationkey + k as varchar) as images from supplier, range(0, 2) q(k) where s_suppkey % 5 <> 0""")
def _(tb):
    """One captured answer for each supplier, with two responses; every fifth capture failed."""
    one = """concat('\\nW: # Dicom-Data-Set\\nW: # Used TransferSyntax: Little Endian Explicit\\n', 'W: (0010,0020) LO [', s_name, '.{k}', ' ]  #  14, 1 PatientID\\n',
        'W: (0020,1002) IS [', s_nationkey + {k}, ']  #   2, 1 ImagesInAcquisition\\n')"""
    text = f"""concat('I: start\\nW: ----', {one.format(k=0)}, 'W: ----', {one.format(k=1)}, 'I: DIMSE Status : ', case when s_suppkey % 5 = 0 then 'Failed' else '0x0000: Success' end, '\\n') as value"""
    folder = _written(tb.base("supplier").selectExpr("s_suppkey as capture", text), scratch_folder(tb.spark, "captures"), "capture")
    rows = readers.read_scan_responses(tb.spark, folder)
    return rows.select(_place("capture", "folder").cast("long").alias("capture"), F.col("position").cast("long").alias("position"),
                       F.col("tags")["PatientID"].alias("patient"), F.col("tags")["ImagesInAcquisition"].alias("images"))


@query("S17_verify_uploads", "select doc_id, sha1(text) as actual, doc_id % 2 = 0 as valid from documents")
def _(tb):
    files = tb.base("documents").select(F.concat(F.lit("up/"), F.col("doc_id").cast("string")).alias("path"), F.col("text").cast("binary").alias("content"))
    manifest = tb.base("documents").select(F.col("doc_id").cast("string").alias("name"),
                                           F.when(F.col("doc_id") % 2 == 0, F.upper(F.sha1(F.col("text").cast("binary")))).otherwise("0").alias("digest"))
    return readers.verify_uploads(files, manifest).select(F.col("name").cast("long").alias("doc_id"), "actual", "valid")


@query("S18_content_digest", "select cast(cast(floor(doc_id / 20) as bigint) as varchar) as folder, sha1(string_agg(text, '' order by doc_id)) as digest from documents group by 1")
def _(tb):
    files = tb.base("documents").select(F.floor(F.col("doc_id") / 20).cast("string").alias("folder"), F.lpad(F.col("doc_id").cast("string"), 12, "0").alias("path"),
                                        F.col("text").cast("binary").alias("content"))
    return readers.content_digests(files)


@query("S15_dead_letters", "select page_id, case when url like 'https%' then '' else replace(regexp_replace(url, '^http:/', ''), '/', '_') end as preserved_as from pages")
def _(tb):
    pages = tb.base("pages").select("page_id", "url")
    good, bad = readers.split_dead_letters(pages, F.col("url").startswith("https"), "url", "http:/")
    flat = F.translate(F.regexp_replace("url", "^http:/", ""), "/", "_")
    return good.select("page_id", F.lit("").alias("preserved_as")).unionAll(bad.select("page_id", flat.alias("preserved_as")))


# sinks -------------------------------------------------------------------------------------------

@series("S10_qa_report_sink", f"""with {_BRAIN}, {_DRIFT}, ts as (select acq_id, median(s) as tsnr from (select acq_id, x, y, z, avg(v) / stddev_pop(v - trend) as s from brain join trend using (acq_id, t) group by 1, 2, 3, 4) q group by 1)
    select round_even(tsnr, 3) as tsnr, (select count(*) from p2 where p2.acq_id = ts.acq_id and spike) as n_spikes from ts""")
def _(tb):
    folder = scratch_folder(tb.spark, "reports")
    writers.write_qa_reports(_reports(tb), folder)
    read = tb.spark.read.schema(readers.QA_SCHEMA).json(folder)
    return read.select(F.col("`temporal SNR (median)`").alias("tsnr"), F.size("spikes").cast("long").alias("n_spikes"))


def _read_reports(tb, label: str) -> DataFrame:
    """Reports of every acquisition, written by the sink and read back."""
    folder = scratch_folder(tb.spark, label)
    writers.write_qa_reports(_reports(tb), folder)
    return tb.spark.read.schema(f"acq_id long, {readers.QA_SCHEMA}").json(folder)


_POSE = ("t0", "t1", "t2", "rx", "ry", "rz")


@series("S10_qa_report_frames", f"""with {_BRAIN}, {_MOVED}, level as (select acq_id, avg(g) as fill from g group by 1)
    select acq_id, t as frame, round_even(absolute, 2) as mean_displacement, round_even(relative, 2) as relative_displacement, round_even(coalesce(g, fill), 3) as global_signal,
      {', '.join(f'round_even({c}, 4) as {c}' for c in _POSE)} from moved join level using (acq_id) left join g using (acq_id, t)""")
def _(tb):
    """The four arrays of the report sink that hold one entry per frame."""
    read = _read_reports(tb, "report-frames")
    zipped = F.arrays_zip("frame #", "transrot", "mean displacement", "relative displacement", "global mean signal")
    rows = read.select("acq_id", F.explode(zipped).alias("f"))
    return rows.select("acq_id", F.col("f.`frame #`").alias("frame"), F.col("f.`mean displacement`").alias("mean_displacement"),
                       F.col("f.`relative displacement`").alias("relative_displacement"), F.col("f.`global mean signal`").alias("global_signal"),
                       *[F.col("f.transrot")[k].alias(c) for k, c in enumerate(_POSE)])


@series("S10_qa_report_scores", f"""with {_BRAIN}, {_MOVED}, every as (select acq_id, t, z from (select distinct acq_id, t from motion) a join (select distinct acq_id, z from means) b using (acq_id)),
      top as (select acq_id, round_even(max(relative), 3) as max_md, round_even(median(relative), 3) as median_md from moved group by 1)
    select acq_id, z, t, round_even(coalesce(zs, 0), 1) as zscore, max_md, median_md, 1.0::double as version, 2.0::double as tr, {_THRESHOLD}::double as threshold
    from every left join p2 using (acq_id, z, t) join top using (acq_id)""")
def _(tb):
    """Scores of all slices and frames and the single numbers of the report sink."""
    read = _read_reports(tb, "report-scores")
    one = [F.col("`max md`").alias("max_md"), F.col("`median md`").alias("median_md"), "version", "tr", F.col("`spike thresh`").alias("threshold")]
    slices = read.select("acq_id", *one, F.posexplode("timeseries zscore").alias("z", "row"))
    return slices.select("acq_id", "z", F.posexplode("row").alias("t", "zscore"), "max_md", "median_md", "version", "tr", "threshold")


def _onsets(tb):
    return tb.timing.select("acq_id", "slice", "onset")


@series("S11_regressor_table", """select acq_id, position, case when position = -3 then 4 else 52 end as cells from (select distinct acq_id from timing) a, (select unnest([-3, -1] || range(0, 18)) as position) p""")
def _(tb):
    folder = scratch_folder(tb.spark, "regressors")
    regressors = cut_lineage(physio.regressors(tb.signal, tb.timing))
    writers.write_regressors(regressors, _onsets(tb), folder)
    lines = tb.spark.read.text(folder)
    body = writers.regressor_lines(regressors, _onsets(tb))
    return body.join(lines.select(F.col("value").alias("line"), "acq_id"), ["acq_id", "line"], "left_semi").select(
        "acq_id", "position", F.size(F.split("line", ",")).cast("long").alias("cells"))


def _frame_cells(lines, separator: str):
    """Every cell of the body lines of one table: (frame, k, value), counted from 0."""
    body = F.filter(lines, lambda line: (line != "") & ~line.startswith("#"))
    return F.posexplode(F.transform(body, lambda line: F.split(F.trim(line), separator))).alias("frame", "cells")


@series("S11_S13_regressor_cells", f"""{_REGRESSORS} select 'table' as form, acq_id, slice, frame, name, round(value, 5) + 0 as value from done
    union all select 'slices', acq_id, slice, frame, name, round(value, 6) + 0 from done""")
def _(tb):
    """The cells of both regressor files, read back; the regressors are computed once."""
    folder = scratch_folder(tb.spark, "regressor-cells")
    regressors = cut_lineage(physio.regressors(tb.signal, tb.timing))
    writers.write_regressors(regressors, _onsets(tb), f"{folder}/table")
    writers.write_regressors_legacy(regressors, _onsets(tb), f"{folder}/slices")
    text = lambda form: tb.spark.read.text(f"{folder}/{form}", wholetext=True).withColumn("acq_id", F.col("acq_id").cast("long"))
    names, n = F.array(*[F.lit(r) for r in physio.REGRESSORS]), len(physio.REGRESSORS)
    table = text("table").select("acq_id", _frame_cells(F.split("value", "\n"), ",")).select(
        "acq_id", "frame", F.posexplode("cells").alias("k", "cell")).withColumn("slice", F.floor(F.col("k") / n))
    parts = text("slices").select("acq_id", F.explode(F.split("value", "# slice ")).alias("part")).where(~F.col("part").startswith("#"))
    slices = parts.select("acq_id", F.split("part", "\n").alias("_l")).select(
        "acq_id", F.get("_l", F.lit(0)).cast("long").alias("slice"), _frame_cells(F.slice("_l", 2, F.size("_l")), " +")).select(
        "acq_id", "slice", "frame", F.posexplode("cells").alias("k", "cell"))
    rows = table.select(F.lit("table").alias("form"), "acq_id", "slice", "frame", "k", "cell").unionAll(
        slices.select(F.lit("slices").alias("form"), "acq_id", "slice", "frame", "k", "cell"))
    return rows.select("form", "acq_id", F.col("slice").cast("int").alias("slice"), "frame", F.get(names, F.col("k") % n).alias("name"),
                       (F.col("cell").cast("double") + 0).alias("value"))


_STAMPS = {k: f"string_agg(cast(round(({v}) * 1000) as bigint)::varchar, ',' order by idx) filter (kind = '{w}')" for k, v, w in (
    ("resp_time", "0.04::double * idx - ro", "resp_wave"), ("card_time", "0.04::double * idx - co", "card_wave"),
    ("resp_trig", "value", "resp_trig"), ("card_trig", "value * 0.04::double - co", "card_trig"))}
_WAVES = {k: f"string_agg(cast(trunc(value) as bigint)::varchar, ',' order by idx) filter (kind = '{k}')" for k in ("resp_wave", "card_wave")}


@series("S12_signals_json", f"""with n as (select acq_id, 0.04::double * (max(idx) filter (kind = 'resp_wave') + 1) - 18.0::double as ro,
      0.04::double * (max(idx) filter (kind = 'card_wave') + 1) - 18.0::double as co from signal group by 1)
    select acq_id, {', '.join(f"coalesce({v}, '') as {k}" for k, v in (_STAMPS | _WAVES).items())} from signal join n using (acq_id) group by 1""")
def _(tb):
    """All six arrays as read back; times and triggers in thousandths."""
    folder = scratch_folder(tb.spark, "signals-json")
    writers.write_signals_json(tb.signal, tb.timing, folder)
    arrays = ", ".join([f"{k} array<double>" for k in _STAMPS] + [f"{k} array<long>" for k in _WAVES])
    read = tb.spark.read.schema(f"acq_id long, {arrays}").json(folder)
    whole = lambda c: F.array_join(F.transform(c, lambda v: F.round(v * 1000).cast("long").cast("string")), ",").alias(c)
    return read.select("acq_id", *[whole(c) for c in _STAMPS], *[F.array_join(F.col(c).cast("array<string>"), ",").alias(c) for c in _WAVES])


@series("S13_regressor_legacy", "select acq_id, slice, 19::bigint as n from timing union all select distinct acq_id, -1, 4::bigint from timing")
def _(tb):
    folder = scratch_folder(tb.spark, "regressors-legacy")
    writers.write_regressors_legacy(physio.regressors(tb.signal, tb.timing), _onsets(tb), folder)
    read = tb.spark.read.text(folder, wholetext=True).select("acq_id", F.explode(F.split("value", "# slice ")).alias("part"))
    size = F.size(F.filter(F.split("part", "\n"), lambda line: line != ""))
    head = F.col("part").startswith("#")
    return read.select(F.col("acq_id").cast("long").alias("acq_id"), F.when(head, -1).otherwise(F.substring_index("part", "\n", 1).try_cast("int")).alias("slice"),
                       size.cast("long").alias("n"))


@series("S14_distortion_lines", """with gr as (select cast(floor(vec_id / 100) as bigint) as acq_id, floor(vec_id / 50)::int % 2 + 1 as run, vec_id % 50 as i, (case when vec_id % 10 < 3 then 0 else 1000 end + vec_id % 7)::double as b, embedding[21:23] as v from embeddings),
    n as (select acq_id, count(*) as n from gr where run = 1 and b < 10 and i < 5 group by 1)
    select acq_id, 'bvec' as file, a as position, string_agg(printf('%.4f', v[a + 1]::double), ' ' order by run, i) as line from gr, range(0, 3) q(a) where i >= 5 group by 1, 3
    union all select acq_id, 'bval' as file, 0 as position, string_agg(printf('%.1f', b), ' ' order by run, i) as line from gr where i >= 5 group by 1
    union all select acq_id, 'index', 0, string_agg(case when run = 1 then '1' else cast(n + 1 as varchar) end, ' ' order by run, i) from gr join n using (acq_id) where i >= 5 group by 1
    union all select acq_id, 'acqparams', run * 100000 + k, case when run = 1 then '0 1 0 0.0384' else '0 -1 0 0.0384' end from (select acq_id, run, row_number() over (partition by acq_id, run order by i) - 1 as k from gr where b < 10 and i < 5)""")
def _(tb):
    gradients = _gradients(tb)
    out = repair.polarity_pair(_runs(tb), gradients, 5)
    runs = repair.reference_frames(gradients, 5).groupBy("acq_id", "run").agg(F.count(F.lit(1)).alias("n")).select(
        "acq_id", "run", "n", F.when(F.col("run") == 1, 1).otherwise(-1).alias("direction"), F.lit("0.0384").alias("readout"), F.lit(1).alias("dim"))
    folder = scratch_folder(tb.spark, "distortion")
    writers.write_distortion_inputs(out["gradients"], out["index"], runs, folder)
    read = tb.spark.read.text(folder)
    lines = writers.distortion_lines(out["gradients"], out["index"], runs)
    return lines.join(read.select("acq_id", "file", F.col("value").alias("line")), ["acq_id", "file", "line"], "left_semi").select(
        "acq_id", "file", "position", "line")


# streams -----------------------------------------------------------------------------------------

_GROWN = f"""with p as (select *, max(size) over (partition by item order by poll_ts, seq rows between unbounded preceding and 1 preceding) as before from {_OBSERVED}),
    u as (select *, before is null or size > before as up from p), l as (select *, lag(up) over (partition by item order by poll_ts, seq) as was from u)
    select item, poll_ts, before as size from l where not up and was"""
_EQUAL = f"""with l as (select *, lag(size) over w as p1, lag(size, 2) over w as p2 from {_OBSERVED} window w as (partition by item order by poll_ts, seq))
    select item, poll_ts, size from l where size = p1 and (p2 is null or p1 <> p2)"""


@query("R1_stable_series_stream", _GROWN)
def _(tb):
    return _drain(stability.stable_series(_observe(_stream(tb, "events")).select("item", "poll_ts", "size")), "series")


@query("R1_stable_series_batch", _GROWN)
def _(tb):
    return stability.stable_series_batch(_observe(tb.base("events")), order=("poll_ts", "seq"))


@query("R2_stable_files_stream", _EQUAL)
def _(tb):
    seen = _observe(_stream(tb, "events")).select("item", "poll_ts", "size", F.col("poll_ts").cast("timestamp").alias("mod_time"))
    return _drain(stability.stable_files(seen), "files").select("item", "poll_ts", "size")


@query("R2_unchanged_files_stream", _EQUAL)
def _(tb):
    """The looks arrive in several micro-batches, with a restart between; a file's mod_time never changes."""
    looks = _observe(tb.base("events")).withColumn("mod_time", F.expr("timestamp'2020-01-01' + make_dt_interval(item)"))
    cuts = looks.selectExpr("percentile_approx(unix_micros(cast(poll_ts as timestamp)), array(0.3, 0.5, 0.8)) as c").first()[0]
    folder, at = scratch_folder(tb.spark, "looks"), F.unix_micros(F.col("poll_ts").cast("timestamp"))
    for low, high in zip([None, *cuts], [*cuts, None]):
        part = looks.where((F.lit(True) if low is None else at > low) & (F.lit(True) if high is None else at <= high))
        part.write.mode("append").parquet(f"{folder}/in")
        stream = tb.spark.readStream.schema(looks.schema).parquet(f"{folder}/in").select("item", "poll_ts", "size", "mod_time")
        running = (stability.stable_files(stream, forget_after="60 days").writeStream.format("parquet").option("path", f"{folder}/out")
                   .option("checkpointLocation", f"{folder}/log").trigger(availableNow=True).start())
        running.awaitTermination()
    return tb.spark.read.schema(stability.FILES_OUTPUT).parquet(f"{folder}/out").select("item", "poll_ts", "size")


@query("R2_stable_files_batch", _EQUAL)
def _(tb):
    return stability.stable_files_batch(_observe(tb.base("events")), order=("poll_ts", "seq"))


@query("R3_high_water_mark", """with e as (select event_id, ts - interval '1' hour * (event_id % 7) as seen, event_type = 'purchase' as emitted from events),
    m as (select *, max(case when emitted then seen end) over (order by event_id rows unbounded preceding) as mark from e) select event_id, seen from m where mark is null or seen >= mark""")
def _(tb):
    rows = tb.sql("select event_id, ts - interval '1' hour * (event_id % 7) as seen, event_type = 'purchase' as emitted from {events}")
    return stability.accept_above_mark(rows, "seen", "emitted", ("event_id",)).select("event_id", "seen")


def _in_batches(tb, rows: DataFrame, time: str, label: str, start) -> str:
    """Feed a table as a stream in several micro-batches with a restart between; ``start(stream, folder)`` writes to folder."""
    cuts = rows.selectExpr(f"percentile_approx(unix_micros(cast({time} as timestamp)), array(0.3, 0.5, 0.8)) as c").first()[0]
    folder, at = scratch_folder(tb.spark, label), F.unix_micros(F.col(time).cast("timestamp"))
    for low, high in zip([None, *cuts], [*cuts, None]):
        part = rows.where((F.lit(True) if low is None else at > low) & (F.lit(True) if high is None else at <= high))
        part.write.mode("append").parquet(f"{folder}/in")
        stream = tb.spark.readStream.schema(rows.schema).parquet(f"{folder}/in")
        start(stream, folder).option("checkpointLocation", f"{folder}/log").trigger(availableNow=True).start().awaitTermination()
    return folder


@query("R3_mark_in_stream", f"""with f as (select q.*, poll_ts - to_hours(cast(item % 5 as integer)) as mod_time from ({_EQUAL}) q), p as (select poll_ts, max(mod_time) as latest from f group by 1),
    m as (select poll_ts, max(latest) over (order by poll_ts rows between unbounded preceding and 1 preceding) as mark from p)
    select item, poll_ts, size from f join m using (poll_ts) where mark is null or mod_time >= mark""")
def _(tb):
    """Each micro-batch starts from the mark the one before it committed; files change up to four hours before a look."""
    looks = _observe(tb.base("events")).withColumn("mod_time", (F.col("poll_ts") - F.make_dt_interval(hours=F.col("item") % 5)).cast("timestamp"))
    start = lambda stream, folder: (stability.stable_files(stream.select("item", "poll_ts", "size", "mod_time"), forget_after="60 days")
                                    .writeStream.foreachBatch(monitor.MarkedSink(f"{folder}/out")))
    folder = _in_batches(tb, looks, "poll_ts", "marked", start)
    return monitor.MarkedSink(f"{folder}/out").rows(tb.spark).select("item", "poll_ts", "size")


@query("R4_monitored_series")
def _(tb):
    """Four scanners list the users seen in an hour as exams, their event types as series."""
    looks = tb.base("events").selectExpr(
        "user_id % 4 as scanner", "date_trunc('hour', ts)::timestamp_ntz as poll_ts", "user_id as exam_id", "timestamp_ntz'2020-01-01' + make_dt_interval(int(user_id % 97)) as exam_ts",
        "length(event_type)::bigint as series_id", "cast(floor(value / 40) as bigint) as size", "cast(null as bigint) as received")
    start = lambda stream, folder: (monitor.monitored_series(stream, forget_after="60 days").writeStream.format("parquet").option("path", f"{folder}/out"))
    folder = _in_batches(tb, looks, "poll_ts", "monitored", start)
    return tb.spark.read.schema(monitor.MONITORED).parquet(f"{folder}/out")


@query("R4_monitored_exams", """with m as (select o_orderkey as exam_id, o_orderdate as t from orders where o_orderkey % 3 <> 0 order by 2, 1 limit 2), o as (select o_orderkey as exam_id, o_orderdate as t from orders where o_orderkey % 5 <> 0),
    k as (select * from m where exam_id in (select exam_id from o)), f as (select exam_id from (select * from k order by t, exam_id limit 1) where exam_id not in (select o_orderkey from orders where o_orderstatus = 'O') and (select count(*) from k) >= 2),
    s as (select 0 as p, exam_id, t from k where exam_id not in (select exam_id from f) union all select 1, exam_id, t from o where exam_id not in (select exam_id from k) and ((select max(t) from k) is null or t >= (select max(t) from k)))
    select exam_id, t as exam_ts from s order by p, t, exam_id limit 2""")
def _(tb):
    orders = tb.base("orders").selectExpr("o_orderkey as exam_id", "o_orderdate as exam_ts", "o_orderstatus as status")
    monitored = orders.where("exam_id % 3 <> 0").orderBy("exam_ts", "exam_id").limit(2).select("exam_id", "exam_ts")
    outstanding = orders.where("exam_id % 5 <> 0").select("exam_id", "exam_ts")
    return stability.advance_monitor(monitored, outstanding, orders.where("status = 'O'"))


@query("R4_vanished_exams", "select o_orderkey as exam_id from orders where o_orderstatus = 'F' and o_orderkey % 5 = 0")
def _(tb):
    orders = tb.base("orders").selectExpr("o_orderkey as exam_id", "o_orderstatus as status")
    return stability.vanished(orders.where("status = 'F'"), orders.where("exam_id % 5 <> 0")).select("exam_id")


@query("R5_first_look_is_silent", f"select item from {_OBSERVED} group by 1 having count(*) > 1 and min(seq) is not null and item in (select item from ({_GROWN}) q)")
def _(tb):
    return stability.stable_series_batch(_observe(tb.base("events")), order=("poll_ts", "seq")).select("item").distinct()


@query("R6_incomplete_transfers", f"""with p as (select *, seq % 3 <> 0 as complete, max(size) over (partition by item order by poll_ts, seq rows between unbounded preceding and 1 preceding) as before from {_OBSERVED}),
    u as (select *, before is null or size > before as up from p), g as (select *, sum(up::int) over (partition by item order by poll_ts, seq) as run, greatest(size, coalesce(before, size)) as peak from u)
    select item, min(poll_ts) as poll_ts, any_value(peak) as size from g where not up and complete group by item, run""")
def _(tb):
    # a transfer is complete unless the look's number divides by three
    events = _observe(_stream(tb, "events"))
    peak = F.when(F.col("seq") % 3 != 0, F.lit(None).cast("long")).otherwise(F.lit(-1).cast("long"))
    looks = events.select("item", "poll_ts", "size", peak.alias("received"))
    return _drain(stability.stable_series(looks), "incomplete")


@query("R7_ingest_sink", f"with {_READY} select se.exam_uid as uid, r.exam_no as exam, r.exp as experiment, se.start as timestamp from se")
def _(tb):
    folder = scratch_folder(tb.spark, "ingest")
    empty = _empty_archive(tb)
    records = tb.view("scan_record").withColumn("source", F.concat(F.lit("stage/"), F.col("arrival_seq").cast("string")))
    records.write.parquet(f"{folder}/records")
    sink = IngestSink(f"{folder}/catalog", empty, empty, _NOW)
    running = (tb.spark.readStream.schema(records.schema).parquet(f"{folder}/records").writeStream.foreachBatch(sink)
               .option("checkpointLocation", f"{folder}/log").trigger(availableNow=True).start())
    running.awaitTermination()
    return sink.snapshot(tb.spark, 0).chain("session", "experiment").select(
        F.col("session_uid").alias("uid"), F.col("session_exam").alias("exam"), F.col("experiment_name").alias("experiment"),
        F.col("session_timestamp").alias("timestamp"))


@query("R8_quiet_containers", """with s as (select user_id, ts, sum(case when ts - l < interval 2 hour then 0 else 1 end) over (partition by user_id order by ts) as g from (select user_id, ts, lag(ts) over (partition by user_id order by ts) as l from events) q)
    select user_id as container_id, min(ts) as first_update, max(ts) as last_update, count(*) as n from s group by user_id, g""")
def _(tb):
    updates = tb.base("events").selectExpr("user_id as container_id", "cast(ts as timestamp) as updatetime")
    rows = stability.quiet_containers(updates, "2 hours")
    return rows.select("container_id", *[F.col(c).cast("timestamp_ntz").alias(c) for c in ("first_update", "last_update")], "n")


@query("R9_attach_recordings", """select a.event_id as epoch_id, cast(b.event_id as varchar) as name, b.ts as rec_ts from events a join events b on a.user_id % 10 = b.user_id % 10
    and a.event_type = 'view' and b.event_type = 'click' and b.ts >= a.ts + interval 30 second and b.ts <= a.ts + interval 630 second""")
def _(tb):
    e = tb.base("events").selectExpr("event_id", "event_type", "cast(user_id % 10 as string) as psd", "ts")
    scans = e.where("event_type = 'view'").selectExpr("event_id as epoch_id", "psd", "ts as scan_ts")
    recordings = e.where("event_type = 'click'").selectExpr("psd", "cast(event_id as string) as name", "ts as rec_ts")
    return stability.attach_recordings(scans, recordings, 30, 600)


@query("R9_earliest_recordings", """with m as (select a.event_id as epoch_id, cast(b.event_id as varchar) as name, b.ts as rec_ts from events a join events b on a.user_id % 10 = b.user_id % 10
    and a.event_type = 'view' and b.event_type = 'click' and b.ts >= a.ts + interval 30 second and b.ts <= a.ts + interval 630 second)
    select * from m where rec_ts = (select min(rec_ts) from m k where k.epoch_id = m.epoch_id)""")
def _(tb):
    e = tb.base("events").selectExpr("event_id", "event_type", "cast(user_id % 10 as string) as psd", "ts")
    scans = e.where("event_type = 'view'").selectExpr("event_id as epoch_id", "psd", "ts as scan_ts")
    recordings = e.where("event_type = 'click'").selectExpr("psd", "cast(event_id as string) as name", "ts as rec_ts")
    return stability.earliest_recordings(stability.attach_recordings(scans, recordings, 30, 600)).select("epoch_id", "name", "rec_ts")


@query("R9_recording_outcomes", """with m as (select a.event_id as epoch_id, cast(b.event_id as varchar) as name, b.ts as rec_ts from events a join events b on a.user_id % 10 = b.user_id % 10
    and a.event_type = 'view' and b.event_type = 'click' and b.ts >= a.ts + interval 30 second and b.ts <= a.ts + interval 630 second),
    f as (select epoch_id, min(rec_ts) as rec_ts from m group by 1)
    select e.event_id as epoch_id, case when f.rec_ts is null then 'no physio files found' else 'physio files found' end as outcome, f.rec_ts,
      coalesce((select string_agg(name, ',' order by name) from m where m.epoch_id = e.event_id and m.rec_ts = f.rec_ts), '') as names
    from events e left join f on f.epoch_id = e.event_id where e.event_type = 'view'""")
def _(tb):
    """A row a month after the last one moves the clock past every scan's time."""
    e = tb.base("events").selectExpr("event_type", "event_id", "cast(user_id % 10 as string) as psd", "ts")
    clock = e.agg(F.max("ts").alias("ts")).selectExpr("'click' as event_type", "-1L as event_id", "'clock' as psd", "ts + interval 30 days as ts")
    rows = e.unionByName(clock.unionByName(clock.selectExpr("'view' as event_type", "event_id", "psd", "ts")))

    def start(stream, folder):
        scans = stream.where("event_type = 'view'").selectExpr("event_id as epoch_id", "psd", "ts as scan_ts")
        recordings = stream.where("event_type = 'click'").selectExpr("psd", "cast(event_id as string) as name", "ts as rec_ts")
        return monitor.recording_outcomes(scans, recordings, 30, 600, "1 hour").writeStream.format("parquet").option("path", f"{folder}/out")
    folder = _in_batches(tb, rows, "ts", "outcomes", start)
    return tb.spark.read.schema(monitor.OUTCOMES).parquet(f"{folder}/out").withColumn("names", F.array_join("names", ","))
