"""Writers for reports, regressors, recordings and distortion inputs. Formatting stays in the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scanloom.operators.physio import REGRESSORS, align
from scanloom.operators.repair import acquisition_parameter_row


def write_qa_reports(reports: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """JSON documents, one per acquisition; numbers were rounded when the report was assembled."""
    reports.write.mode(mode).json(path)


def _cells(regressors: DataFrame, pattern: str) -> DataFrame:
    place = F.element_at(F.create_map(*[F.lit(v) for p in ((n, i) for i, n in enumerate(REGRESSORS)) for v in p]), F.col("name"))
    regressors = regressors.where(F.col("frame").isNotNull())  # rejected recordings have no table
    return regressors.select("acq_id", "slice", "frame", place.alias("k"), F.format_string(pattern, "value").alias("text"))


def _joined(items: str, separator: str) -> Column:
    return F.array_join(F.transform(F.array_sort(items), lambda s: s["text"]), separator)


def documents(lines: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One text per file, its lines in order (a sort before a partitioned write may be dropped by the planner)."""
    packed = lines.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(*order, "line"))).alias("_l"))
    return packed.select(*keys, F.array_join(F.transform("_l", lambda s: s["line"]), "\n").alias("value"))


def write_texts(texts: DataFrame, path: str, *places: str, compression: str = "none") -> None:
    """Text files (column value), one folder for each value of ``places``; a folder's rows are one file.

    A file costs far more than its bytes, so the files are dealt to a given number of tasks: a shuffle without one is
    merged by size, and one task then writes them all. Each task moves its own files into place (committer version 2),
    not the driver all of them after the last; nobody reads the folder before the write has ended.
    """
    spark = texts.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    place = F.xxhash64(*places)  # by the places alone the planner drops this shuffle after a grouping by them
    (texts.repartition(n, place).write.partitionBy(*places).option("compression", compression)
     .option("mapreduce.fileoutputcommitter.algorithm.version", "2").text(path))


def regressor_lines(regressors: DataFrame, onsets: DataFrame, notes: str = "") -> DataFrame:
    """Lines of the regressor table: (acq_id, position, line). A row holds slices x 13 values of one frame.

    ``onsets``: acq_id, slice, onset.
    """
    rows = _cells(regressors, "%.5f").groupBy("acq_id", "frame").agg(F.collect_list(F.struct("slice", "k", "text")).alias("_c"))
    body = rows.select("acq_id", F.col("frame").cast("long").alias("position"), _joined("_c", ",").alias("line"))
    per = onsets.groupBy("acq_id").agg(F.array_sort(F.collect_list(F.struct("slice", "onset"))).alias("_o"))
    # fixed values: the comment lines of the table
    head = F.concat(F.lit("#slice_onsets = [ "), F.array_join(F.transform("_o", lambda s: s["onset"].cast("string")), ","), F.lit(" ]"))
    names = F.array(*[F.lit(n) for n in REGRESSORS])
    titles = F.flatten(F.transform("_o", lambda s: F.transform(names, lambda n: F.concat(F.lit("slice"), s["slice"].cast("string"), n))))
    line = lambda position, text: per.select("acq_id", F.lit(position).cast("long").alias("position"), text.alias("line"))
    out = line(-3, head).unionAll(line(-1, F.concat(F.lit("#"), F.array_join(titles, ","))))
    if notes:
        out = out.unionAll(line(-2, F.lit("#" + notes)))
    return out.unionAll(body)


def write_regressors(regressors: DataFrame, onsets: DataFrame, path: str, gzip: bool = True, notes: str = "") -> None:
    """One CSV text per acquisition, in frame order."""
    texts = documents(regressor_lines(regressors, onsets, notes), ["acq_id"], ["position"])
    write_texts(texts, path, "acq_id", compression="gzip" if gzip else "none")


def legacy_lines(regressors: DataFrame, onsets: DataFrame) -> DataFrame:
    """Lines of the per-slice text table: (acq_id, slice, position, line)."""
    rows = _cells(regressors, "%-7.6f").groupBy("acq_id", "slice", "frame").agg(F.collect_list(F.struct("k", "text")).alias("_c"))
    body = rows.select("acq_id", F.col("slice").cast("int").alias("slice"), F.col("frame").cast("long").alias("position"), _joined("_c", " ").alias("line"))
    per = onsets.groupBy("acq_id").agg(F.array_sort(F.collect_list(F.struct("slice", "onset"))).alias("_o"))
    shape = regressors.where(F.col("frame").isNotNull()).groupBy("acq_id").agg((F.max("frame") + 1).alias("_n"))
    head = per.join(shape, "acq_id")
    comment = lambda position, text: head.select("acq_id", F.lit(-1).alias("slice"), F.lit(position).cast("long").alias("position"), text.alias("line"))
    onset = F.array_join(F.transform("_o", lambda s: s["onset"].cast("string")), ",")
    # fixed values: the comment lines of the text table
    size = F.format_string("# Full array shape: (%d, %d, %d)", "_n", F.lit(len(REGRESSORS)), F.size("_o"))
    slices = onsets.select("acq_id", F.col("slice").cast("int").alias("slice"), F.lit(-1).cast("long").alias("position"), F.format_string("# slice %d", "slice").alias("line"))
    return (comment(0, F.concat(F.lit("# slice_onsets = [ "), onset, F.lit(" ]"))).unionAll(comment(1, size))
            .unionAll(comment(2, F.lit("# time x regressor for each slice in the acquired volume")))
            .unionAll(comment(3, F.lit("# regressors: [ " + ",".join(REGRESSORS) + " ]"))).unionAll(slices).unionAll(body))


def write_regressors_legacy(regressors: DataFrame, onsets: DataFrame, path: str) -> None:
    write_texts(documents(legacy_lines(regressors, onsets), ["acq_id"], ["slice", "position"]), path, "acq_id")


def signals_json(signal: DataFrame, timing: DataFrame) -> DataFrame:
    """Recordings as documents: times at 3 digits, waves as whole numbers; one array per series of a recording."""
    rows = align(signal, timing)
    stamp = F.round("time", 3)
    value = (F.when(F.col("kind").isin("resp_wave", "card_wave"), F.col("value").cast("long").cast("double"))
             .when(F.col("kind") == "card_trig", stamp).otherwise(F.round("value", 3)))
    part = lambda kind, field: F.transform(
        F.array_sort(F.collect_list(F.when(F.col("kind") == kind, F.struct("idx", "t", "v")))), lambda s: s[field])
    packed = rows.select("acq_id", "kind", "idx", stamp.alias("t"), value.alias("v")).groupBy("acq_id").agg(
        part("resp_wave", "t").alias("resp_time"), part("resp_wave", "v").alias("resp_wave"), part("resp_trig", "v").alias("resp_trig"),
        part("card_wave", "t").alias("card_time"), part("card_wave", "v").alias("card_wave"), part("card_trig", "v").alias("card_trig"))
    whole = lambda c: F.transform(c, lambda v: v.cast("long")).alias(c)
    return packed.select("acq_id", "resp_time", whole("resp_wave"), "resp_trig", "card_time", whole("card_wave"), "card_trig")


def write_signals_json(signal: DataFrame, timing: DataFrame, path: str, gzip: bool = True) -> None:
    signals_json(signal, timing).write.option("compression", "gzip" if gzip else "none").json(path)


def distortion_lines(gradients: DataFrame, index: DataFrame, runs: DataFrame) -> DataFrame:
    """Text lines of the distortion inputs: (acq_id, file, position, line).

    ``gradients``: acq_id, t, bval, bx, by, bz; ``index``: acq_id, t, index; ``runs``: acq_id, run, n (reference
    frames), direction, readout, dim. Vectors are one line per axis; reference frames one line each.
    """
    def vector(df: DataFrame, file: str, position: int, text: Column) -> DataFrame:
        packed = df.select("acq_id", "t", text.alias("text")).groupBy("acq_id").agg(F.collect_list(F.struct("t", "text")).alias("_c"))
        return packed.select("acq_id", F.lit(file).alias("file"), F.lit(position).cast("long").alias("position"), _joined("_c", " ").alias("line"))

    out = vector(gradients, "bval", 0, F.format_string("%.1f", "bval"))
    for position, axis in enumerate(("bx", "by", "bz")):
        out = out.unionAll(vector(gradients, "bvec", position, F.format_string("%.4f", axis)))
    out = out.unionAll(vector(index, "index", 0, F.col("index").cast("string")))
    rows = [F.when(F.col("dim") == d, acquisition_parameter_row(F.col("direction"), F.col("readout"), d)) for d in range(3)]
    frames = runs.select("acq_id", "run", F.explode(F.sequence(F.lit(0), F.col("n").cast("int") - 1)).alias("k"), F.coalesce(*rows).alias("line"))
    return out.unionAll(frames.select("acq_id", F.lit("acqparams").alias("file"), (F.col("run") * 100_000 + F.col("k")).cast("long").alias("position"), "line"))


def write_distortion_inputs(gradients: DataFrame, index: DataFrame, runs: DataFrame, path: str) -> None:
    write_texts(documents(distortion_lines(gradients, index, runs), ["acq_id", "file"], ["position"]), path, "acq_id", "file")
