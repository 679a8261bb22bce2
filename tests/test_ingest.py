"""Set-based ingest against a record-at-a-time simulation, in one batch and over several."""

import datetime as dt
import random
import re

import pytest

from scanloom.catalog import Catalog
from scanloom.operators import ingest

T0 = dt.datetime(2020, 1, 1)
NOW = dt.datetime(2024, 1, 1)
GROUPS = {1: "alpha", 2: "beta", 9: "unknown"}
ROLES = [(1, 10, "pi"), (1, 11, "manager"), (1, 12, "member"), (1, 11, "member"), (2, 12, "pi")]


def records(seed, n):
    rng = random.Random(seed)
    out = []
    for seq in range(n):
        exam = rng.randrange(0, 14)
        series = rng.randrange(0, 4)
        fixed = random.Random(exam)  # header fields that belong to an exam
        code = fixed.choice(["", "", "s007", "x12", "s003"])
        first, last = fixed.choice([("ann", "lee"), ("bob", "ray"), ("", "")])
        dob = fixed.choice([None, dt.date(1980, 1, 1)])
        lab = fixed.choice(["alpha/pilot", "beta", "alpha/pilot", "nobody/x"])
        kind = rng.choice(["dicom", "pfile", "nifti"])
        out.append(dict(
            arrival_seq=seq, patient_id=f"{code}@{lab}" if code else lab, subj_firstname=first, subj_lastname=last, subj_dob=dob,
            exam_uid=f"1.{exam}", series_uid=f"1.{exam}.{series}", exam_no=exam, series_no=series,
            acq_no=rng.choice([None, 0, 1]), timestamp=T0 + dt.timedelta(minutes=rng.randrange(0, 5000)),
            operator=rng.choice(["u10", "zz"]), series_desc="T1 w-9mm", psd_name="epi", filetype=kind,
            priority=rng.randrange(0, 5), is_screenshot=rng.random() < 0.1, filename=f"f{seq}.{kind}"))
    return out


def simulate(rows, state=None):
    """The rules applied one record at a time."""
    s = state or dict(exp={}, subj=[], sess={}, epoch={}, data={}, access=set())
    for r in rows:
        acq, ts = (0, r["timestamp"].replace(hour=23, minute=59, second=59, microsecond=0)) if r["is_screenshot"] else (r["acq_no"], r["timestamp"])
        ekey, dkey = (r["series_uid"], acq), (r["series_uid"], acq, r["filetype"])
        if dkey not in s["data"]:
            alt = next((d for k, d in s["data"].items() if k[:2] == ekey and d["kind"] == "primary"), None)
            rerun = False
            if alt is None:
                kind = "primary"
            elif alt["priority"] < r["priority"]:
                kind, alt["kind"], rerun = "primary", "secondary", True
            else:
                kind = "secondary"
            if ekey not in s["epoch"]:
                if r["exam_uid"] not in s["sess"]:
                    code, _, info = r["patient_id"].rpartition("@")
                    lab, _, exp = info.partition("/")
                    exp = exp or "untitled"
                    gid = lab if lab in ("alpha", "beta") else "unknown"
                    if gid == "unknown":
                        exp = r["patient_id"]
                    here = [x for x in s["subj"] if x["exp"] == (gid, exp)]
                    if code:
                        found = next((x for x in here if x["code"] == code), None)
                    elif r["subj_firstname"] and r["subj_lastname"]:
                        found = next((x for x in here if (x["first"], x["last"], x["dob"]) == (r["subj_firstname"], r["subj_lastname"], r["subj_dob"])), None)
                    else:
                        found = None
                    if found is None:
                        if (gid, exp) not in s["exp"]:
                            s["exp"][(gid, exp)] = True
                            number = {v: k for k, v in GROUPS.items()}[gid]
                            heads = {u for g, u, role in ROLES if g == number and role != "member"}
                            for g, u, role in ROLES:
                                if g == number:
                                    s["access"].add((gid, exp, u, 4 if u in heads else 2))
                        top = max([int("0" + re.sub(r"[^0-9]+", "", x["code"])) for x in here], default=0)
                        found = dict(exp=(gid, exp), code=code or f"s{top + 1:03d}", first=r["subj_firstname"], last=r["subj_lastname"], dob=r["subj_dob"])
                        s["subj"].append(found)
                    s["sess"][r["exam_uid"]] = dict(subj=found, ts=ts, operator=10 if r["operator"] == "u10" else None)
                sess = s["sess"][r["exam_uid"]]
                sess["ts"] = min(sess["ts"], ts)
                s["epoch"][ekey] = dict(exam=r["exam_uid"], ts=ts, qa="pending")
            if rerun:
                s["epoch"][ekey]["qa"] = "rerun"
            s["data"][dkey] = dict(kind=kind, priority=r["priority"])
        s["data"][dkey]["file"] = r["filename"]
    return s


SCHEMA = ("arrival_seq long, patient_id string, subj_firstname string, subj_lastname string, subj_dob date, exam_uid string, series_uid string, "
          "exam_no int, series_no int, acq_no int, timestamp timestamp_ntz, operator string, series_desc string, psd_name string, "
          "filetype string, priority int, is_screenshot boolean, filename string")


def empty(spark):
    frame = lambda ddl, rows=(): spark.createDataFrame(list(rows), ddl)
    return Catalog(dict(
        research_group=frame("id long, gid string", GROUPS.items()), user=frame("id long, uid string", [(10, "u10"), (11, "u11"), (12, "u12")]),
        group_role=frame("research_group_id long, user_id long, role string", ROLES),
        experiment=frame("id long, name string, owner_id long, trashtime timestamp_ntz"), access=frame("user_id long, experiment_id long, privilege int"),
        subject=frame("id long, code string, firstname string, lastname string, dob date, experiment_id long, person_id long, trashtime timestamp_ntz"),
        session=frame("id long, uid string, exam int, subject_id long, operator_id long, timestamp timestamp_ntz, trashtime timestamp_ntz"),
        epoch=frame("id long, uid string, session_id long, series int, acq int, description string, psd string, timestamp timestamp_ntz, "
                    "trashtime timestamp_ntz, physio_recorded boolean, qa_status string, num_timepoints int, dirty boolean"),
        dataset=frame("id long, container_id long, label string, kind string, filetype string, priority int, filenames array<string>, "
                      "trashtime timestamp_ntz, updatetime timestamp_ntz")))


def check(catalog, want):
    sessions = catalog.chain("session", "research_group").collect()
    got = {r.session_uid: (r.subject_code, r.research_group_gid, r.experiment_name, r.session_operator_id, r.session_timestamp, r.subject_dob) for r in sessions}
    assert got == {k: (v["subj"]["code"], *v["subj"]["exp"], v["operator"], v["ts"], v["subj"]["dob"]) for k, v in want["sess"].items()}
    assert catalog.subject.count() == len(want["subj"])
    data = catalog.chain("dataset", "session").collect()
    got = {(r.epoch_uid, r.epoch_acq, r.dataset_filetype): (r.dataset_kind, r.dataset_priority, r.dataset_filenames, r.epoch_qa_status, r.session_uid, r.epoch_timestamp) for r in data}
    assert got == {k: (v["kind"], v["priority"], [v["file"]], want["epoch"][k[:2]]["qa"], want["epoch"][k[:2]]["exam"], want["epoch"][k[:2]]["ts"])
                   for k, v in want["data"].items()}
    grants = catalog.access.join(catalog.chain("experiment", "research_group"), "experiment_id").collect()
    assert {(r.research_group_gid, r.experiment_name, r.user_id, r.privilege) for r in grants} == want["access"]
    for name in ("subject", "session", "epoch", "dataset"):
        ids = [r.id for r in catalog.frames[name].select("id").collect()]
        assert sorted(ids) == list(range(1, len(ids) + 1))


@pytest.fixture(autouse=True)
def few_partitions(spark):
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", "8")


def test_one_batch(spark):
    rows = records(1, 120)
    done = ingest.ingest(empty(spark), spark.createDataFrame([tuple(r.values()) for r in rows], SCHEMA), NOW)
    check(done, simulate(rows))


def test_two_batches(spark):
    rows = records(5, 140)
    state, catalog = None, empty(spark)
    for part in (rows[:70], rows[70:]):
        state = simulate(part, state)
        after = ingest.ingest(catalog, spark.createDataFrame([tuple(r.values()) for r in part], SCHEMA), NOW)
        catalog = catalog.replace(**{n: after.frames[n].checkpoint() for n in ("experiment", "access", "subject", "session", "epoch", "dataset")})
    check(catalog, state)


def test_records_of_few_labs_are_spread(spark):
    """Records meet their patient id, not their lab, so two labs do not leave two tasks with all rows."""
    ids = [None, "", "s1@nobody/x"] + [f"s{i}@{'alpha' if i % 2 else 'Beta.'}/p{i % 5}" for i in range(200)]
    rows = [(i, ids[i % len(ids)], i % 3, T0, i % 7 == 0) for i in range(1000)]
    settings = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.shuffle.partitions": "12"}
    kept = {k: spark.conf.get(k) for k in settings}
    try:
        for key, value in settings.items():
            spark.conf.set(key, value)
        records = spark.createDataFrame(rows, "arrival_seq int, patient_id string, acq_no int, timestamp timestamp_ntz, is_screenshot boolean")
        groups = spark.createDataFrame([("alpha",), ("beta",), ("unknown",)], "gid string")
        done = ingest.normalize(records, groups)
        assert done.columns == [*records.columns, "subj_code", "group_gid", "exp_name"]
        assert len({p for p, in done.rdd.mapPartitionsWithIndex(lambda i, part: [(i,) for _ in part]).collect()}) > 6
        got = {r.arrival_seq: (r.subj_code, r.group_gid, r.exp_name) for r in done.collect()}
    finally:
        for key, value in kept.items():
            spark.conf.set(key, value)

    def want(i):
        name = ids[i % len(ids)]
        if not name:
            return ("", "unknown", "untitled")
        if "nobody" in name:
            return ("s1", "unknown", name)
        n = int(name[1:name.index("@")])
        return (f"s{n}", "alpha" if n % 2 else "beta", f"p{n % 5}")
    assert got == {i: want(i) for i in range(1000)}
