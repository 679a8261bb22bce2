"""Column functions: documented examples and properties."""

import functools
import random

from pyspark.sql import functions as F

from scanloom.functions import names, sortkey, text
from scanloom.operators import manifest


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], list(values))
    return df.select(column.alias("v")).first().v


def test_clean_string_example(spark):
    assert one(spark, text.clean_string("s"), s="-__-&&&HELLO GOOD ((    SIR  )))___----   ") == "HELLO_GOOD_SIR"
    assert one(spark, text.clean_string(F.lit(None).cast("string")), s="x") == ""


def test_patient_id(spark):
    df = spark.createDataFrame([("S12@Lab X/Exp-1",), ("lab",), ("a@b@lab/",), (" #@lab/exp/2! ",)], "p string")
    got = [tuple(r.v) for r in df.select(text.patient_id_parts("p").alias("v")).collect()]
    assert got == [("s12", "lab_x", "exp_1"), ("", "lab", "untitled"), ("a@b", "lab", "untitled"), ("", "lab", "exp2")]


def test_uid_round_trip(spark):
    rng = random.Random(1)
    uids = ["1." + ".".join(str(rng.randrange(0, 10 ** rng.randrange(1, 8))) for _ in range(rng.randrange(1, 6))) for _ in range(200)]
    df = spark.createDataFrame([(u,) for u in uids], "u string")
    assert all(r.u == r.v for r in df.select("u", text.unpack_uid(text.pack_uid("u")).alias("v")).collect())


def test_human_size(spark):
    sizes = {999: "999B", 5: "  5B", 1000: "1.0K", 10240: " 10K", 1310720: "1.2M", 5 * 1024 ** 3: "5.0G"}
    df = spark.createDataFrame([(k,) for k in sizes], "s long")
    assert {r.s: r.v for r in df.select("s", text.human_size("s").alias("v")).collect()} == sizes


def test_legacy_and_flat_names(spark):
    assert one(spark, names.legacy_filename("f", "s", "a", F.lit("bold")), f="1_2_3_physio.tgz", s=3, a=1) == "0003_01_bold_physio.tgz"
    df = spark.createDataFrame([(["x_1.nii.gz", "x_2.nii.gz"],), (["x_1.nii.gz"],)], "fs array<string>")
    assert [r.v for r in df.select(names.extension_start("fs").alias("v")).collect()] == [1, 3]


def test_natural_order(spark):
    cells = ["img12", "img2", "10", "9.5", "0x1F", "2", "Img3", "", "2014-01-16"]
    df = spark.createDataFrame([(c,) for c in cells], "c string")
    got = [r.c for r in df.orderBy(*sortkey.natural_order("c"), "c").collect()]
    assert [c for c in got if c.startswith("img")] == ["img2", "img12"]
    assert [c for c in got if c in ("2", "9.5", "10")] == ["2", "9.5", "10"]
    assert got.index("10") < got.index("img2")


def test_unique_targets_equal_the_sequential_rule(spark):
    rng = random.Random(3)
    files = [(i, rng.choice("pq"), rng.choice(["a.x", "a+.x", "a++.x", "b.x.y", "b", "a+++.x"])) for i in range(250)]
    taken, want = set(), {}
    for i, folder, name in files:
        while (folder, name) in taken:
            stem, dot, ext = name.partition(".")
            name = stem + "+" + dot + ext
        taken.add((folder, name))
        want[i] = f"{folder}/{name}"
    rows = manifest.unique_targets(spark.createDataFrame(files, "id int, folder string, name string"), "folder", "name", ["id"])
    assert {r.id: r.target for r in rows.collect()} == want


def test_partial(spark):
    assert functools.reduce(lambda a, b: a and b, [one(spark, names.slice_color(F.lit(0), F.lit(1)), x=1) == "#1010ff"])


def test_cells_that_read_as_numbers(spark):
    """What casts to double and ends in a digit or a point; everything else is split in runs."""
    yes = ["7", "-7", "+7", "7.", ".5", "-2.50", "7.5e2", "1e5", "7e22", "007"]
    no = ["7.5.1", "f7", "7 1", "-", "7d", "7F", "12px", "1f12", "NaN", "Infinity", "7e", "1,000"]
    rows = spark.createDataFrame([(c,) for c in yes + no], "c string")
    one = {r.c for r in rows.select("c", sortkey.natural_key("c")["tokens"].alias("t")).collect() if len(r.t) == 1 and r.t[0].string == r.c and not r.t[0].text}
    assert one == set(yes)
