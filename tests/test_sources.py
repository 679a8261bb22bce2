"""Catalog tables and files written and read back."""

import hashlib
import io
import tarfile

from pyspark.sql import functions as F

from scanloom.catalog import load_catalog, out_of_vocabulary, schema_of
from scanloom.operators.matching import ancestors
from scanloom.sources import readers, writers


def test_load_catalog(spark, tmp_path):
    spark.sql("select 1L as id, timestamp_ntz '2020-01-01 00:00:00' as timestamp, interval '90' second as duration, "
              "cast(null as timestamp_ntz) as trashtime, false as dirty, false as scheduling").select(
        *[F.col(f.name).cast(f.dataType) for f in schema_of("data_container")]).write.parquet(f"{tmp_path}/data_container")
    spark.createDataFrame([(1, "exp", "irb", 7)], schema_of("experiment")).write.parquet(f"{tmp_path}/experiment")
    rows = [(1, "NIfTI", "a.nii.gz, b.nii.gz"), (2, "QA", "")]
    spark.createDataFrame(rows, "id long, label string, filenames string").select(
        *[(F.col(f.name) if f.name in ("id", "label", "filenames") else F.lit(None)).cast(f.dataType).alias(f.name)
          for f in schema_of("dataset")]).write.parquet(f"{tmp_path}/dataset")
    catalog = load_catalog(spark, str(tmp_path))  # tables that are not asked for need not exist
    experiment = catalog.experiment.first()
    assert (experiment.name, experiment.owner_id, experiment.trashtime) == ("exp", 7, None)
    assert {r.id: r.filenames for r in catalog.dataset.collect()} == {1: ["a.nii.gz", "b.nii.gz"], 2: []}


def test_vocabulary(spark):
    df = spark.createDataFrame([(1, "primary"), (2, "raw"), (3, None)], "id long, kind string")
    assert [r.id for r in out_of_vocabulary(df, "dataset").collect()] == [2]


def test_regressor_file(spark, tmp_path):
    reg = spark.createDataFrame([(1, s, f, n, s + f / 3) for s in (0, 1) for f in (2, 0, 1) for n in writers.REGRESSORS],
                                "acq_id long, slice int, frame int, name string, value double")
    onsets = spark.createDataFrame([(1, 0, 0.0), (1, 1, 0.5)], "acq_id long, slice int, onset double")
    writers.write_regressors(reg, onsets, f"{tmp_path}/r", gzip=False, notes="made for a test")
    (file,) = (tmp_path / "r" / "acq_id=1").glob("*.txt")
    lines = file.read_text().rstrip("\n").split("\n")
    assert lines[0] == "#slice_onsets = [ 0.0,0.5 ]" and lines[1] == "#made for a test"
    assert lines[2].startswith("#slice0c1_c,slice0s1_c") and lines[2].endswith("slice1hr")
    assert [line.split(",")[0] for line in lines[3:]] == ["0.00000", "0.33333", "0.66667"]
    assert [line.split(",")[13] for line in lines[3:]] == ["1.00000", "1.33333", "1.66667"]


def test_content_digest_reads_archives(spark):
    buffer = io.BytesIO()
    with tarfile.open(fileobj=buffer, mode="w:gz") as archive:
        for name in ("b", "a"):
            info = tarfile.TarInfo(name)
            info.size = 3
            archive.addfile(info, io.BytesIO(name.encode() * 3))
    files = [("f", "f/2.tgz", buffer.getvalue()), ("f", "f/1.txt", b"plain"), ("g", "g/1", b"x")]
    got = {r.folder: r.digest for r in readers.content_digests(spark.createDataFrame(files, "folder string, path string, content binary")).collect()}
    assert got == {"f": hashlib.sha1(b"plain" + b"bbb" + b"aaa").hexdigest(), "g": hashlib.sha1(b"x").hexdigest()}


def test_staged_stream_skips_hidden_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for name in ("a.dcm", ".tmp", "b.dcm"):
        (tmp_path / "in" / name).write_text(name)
    query = (readers.read_staged(spark, f"{tmp_path}/in").select("path").writeStream.format("parquet").option("path", f"{tmp_path}/out")
             .option("checkpointLocation", f"{tmp_path}/log").trigger(availableNow=True).start())
    query.awaitTermination()
    assert sorted(r.path.rsplit("/", 1)[1] for r in spark.read.parquet(f"{tmp_path}/out").collect()) == ["a.dcm", "b.dcm"]


def test_raw_listing_by_glob(spark, tmp_path):
    for name in ("P12345.7", "P1.7", "notes.txt"):
        (tmp_path / name).write_text(name)
    assert [r.path.rsplit("/", 1)[1] for r in readers.read_raw_listing(spark, str(tmp_path)).collect()] == ["P12345.7"]


def test_lineage_of_a_long_line_and_a_diamond(spark):
    edges = [(i + 1, i) for i in range(1, 40)] + [(100, 41), (100, 42), (41, 43), (42, 43), (43, 44), (100, 43)]
    got = {(r.child_id, r.ancestor_id): r.depth for r in ancestors(spark.createDataFrame(edges, "child_id long, parent_id long")).collect()}
    assert got[40, 1] == 39 and got[100, 44] == 2 and got[100, 43] == 1
    assert sum(1 for c, _ in got if c <= 40) == 39 * 40 // 2


def test_many_small_files_are_written_by_several_tasks(spark, tmp_path):
    from scanloom.plans.io_queries import _written

    rows = spark.range(200).selectExpr("id as item", "concat('text ', id) as value")
    _written(rows, f"{tmp_path}/files", "item")
    files = list((tmp_path / "files").glob("item=*/part-*.txt"))
    assert len(files) == 200
    assert len({f.name.split("-")[1] for f in files}) > 4
    read = readers.whole_text(spark, f"{tmp_path}/files")
    assert {(r.folder, r.value.strip()) for r in read.collect()} == {(f"item={n}", f"text {n}") for n in range(200)}


def test_grouped_documents_are_written_by_several_tasks(spark, tmp_path):
    lines = spark.range(600).selectExpr("id % 200 as acq_id", "id as position", "concat('line ', id) as line")
    writers.write_texts(writers.documents(lines, ["acq_id"], ["position"]), f"{tmp_path}/files", "acq_id")
    files = list((tmp_path / "files").glob("acq_id=*/part-*.txt"))
    assert len(files) == 200
    assert len({f.name.split("-")[1] for f in files}) > 4
    assert next((tmp_path / "files" / "acq_id=7").glob("part-*.txt")).read_text() == "line 7\nline 207\nline 407\n"
