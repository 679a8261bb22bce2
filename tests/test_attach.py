"""The search for an epoch's recording: outcomes, missing verdicts, excluded scanners, epochs that do not search."""

from datetime import datetime

from scanloom.operators import physio

AT = datetime(2020, 1, 1, 12)


def epochs(spark, rows):
    return spark.createDataFrame(rows, "id long, psd string, timestamp timestamp_ntz, num_slices int, scanner_name string, physio_recorded boolean")


def test_outcomes(spark):
    asked = epochs(spark, [
        (1, "epi", AT, 3, "A", True), (2, "bad", AT, 3, "A", True), (3, "unknown", AT, 3, "A", True), (4, "none", AT, 3, "A", True),
        (5, "epi", AT, 3, "A", False), (6, "epi", AT, 1, "A", True), (7, "epi", AT, None, "A", True), (8, "epi", AT, 3, "X", True),
        (9, "epi", AT, 3, None, True), (10, "epi", None, 3, "A", True), (11, "epi", AT, 3, "A", None)])
    late = AT.replace(minute=5)
    files = spark.createDataFrame(
        [("b", "epi", late, 0), ("a", "epi", late, 0), ("a", "epi", late, 0), ("c", "epi", late.replace(minute=9), 1), ("d", "bad", late, 1), ("e", "unknown", late, 2)],
        "name string, psd string, ts timestamp_ntz, acq_id long")
    verdicts = spark.createDataFrame([(0, True), (1, False)], "acq_id long, valid boolean")
    out = {r["id"]: (r["outcome"], r["file"]) for r in physio.attach(asked, files, verdicts, ("X",)).collect()}
    valid, invalid, none, off = "valid physio found", "invalid physio found and discarded", "no physio files found", "physio not recorded"
    assert out == {1: (valid, "a"), 2: (invalid, None), 3: (invalid, None), 4: (none, None), 5: (off, None), 6: (None, None), 7: (None, None),
                   8: (None, None), 9: (valid, "a"), 10: (none, None), 11: (off, None)}


def test_empty_tables(spark):
    no_files = spark.createDataFrame([], "name string, psd string, ts timestamp_ntz, acq_id long")
    no_verdicts = spark.createDataFrame([], "acq_id long, valid boolean")
    assert physio.attach(epochs(spark, []), no_files, no_verdicts).collect() == []
    one = physio.attach(epochs(spark, [(1, "epi", AT, 3, "A", True)]), no_files, no_verdicts).first()
    assert (one["outcome"], one["file"]) == ("no physio files found", None)
