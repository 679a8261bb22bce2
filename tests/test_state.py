"""State transforms on small catalogs with the awkward cases."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from scanloom.catalog import Catalog
from scanloom.operators import access, filters, search, state

NOW = dt.datetime(2024, 5, 5)
OLD = dt.datetime(2020, 1, 1)


@pytest.fixture(scope="module")
def catalog(spark):
    f = lambda ddl, rows: spark.createDataFrame(rows, ddl)
    return Catalog(dict(
        research_group=f("id long, gid string", [(1, "lab"), (2, "other")]),
        user=f("id long, uid string, firstname string, lastname string, admin_mode boolean", [
            (1, "root", "R", "Oot", True), (2, "pi", "P", "I", False), (3, "man", None, "An", False), (4, "mem", "M", None, False), (5, "out", "O", "Ut", True)]),
        user_group=f("user_id long, group_id long", [(1, 1), (2, 2)]),
        group_role=f("research_group_id long, user_id long, role string", [(1, 2, "pi"), (1, 3, "manager"), (1, 4, "member")]),
        access=f("user_id long, experiment_id long, privilege int", [(2, 1, 4), (3, 1, 4), (4, 1, 2), (4, 1, 2), (4, 3, 3), (2, 2, 4), (3, 2, 4)]),
        experiment=f("id long, name string, owner_id long, trashtime timestamp_ntz", [(1, "a", 1, None), (2, "b", 1, OLD), (3, "c", 2, None)]),
        subject=f("id long, code string, firstname string, lastname string, dob date, experiment_id long, person_id long, trashtime timestamp_ntz", [
            (1, "s001", "Ada", "Byron", dt.date(1990, 1, 1), 1, 1, None), (2, "s009", None, "Hop", None, 1, 2, None), (3, "x", "K", "G", None, 2, 3, OLD)]),
        session=f("id long, exam int, notes string, subject_id long, operator_id long, timestamp timestamp_ntz, trashtime timestamp_ntz", [
            (1, 10, "", 1, 3, dt.datetime(2020, 3, 1, 23, 59, 59), None), (2, 11, "", 2, None, dt.datetime(2020, 3, 2), OLD), (3, 12, "", 3, 3, OLD, OLD)]),
        epoch=f("id long, session_id long, description string, psd string, scan_type string, timestamp timestamp_ntz, trashtime timestamp_ntz", [
            (1, 1, "d", "muxepi", "functional", OLD, None), (2, 2, "e", "epi", "anatomy", OLD, OLD), (3, 3, "f", "epi", "anatomy", OLD, OLD)]),
        dataset=f("id long, container_id long, kind string, trashtime timestamp_ntz", [(1, 1, "primary", None), (2, 1, "web", OLD), (3, 3, "qa", OLD)])))


def trashed(c):
    return {level: {r.id: r.trashtime for r in c.frames[level].collect()} for level in ("experiment", "subject", "session", "epoch", "dataset")}


def test_trash_then_untrash(spark, catalog):
    pick = spark.createDataFrame([(1, NOW)], "id long, now timestamp_ntz")
    gone = trashed(state.trash(catalog, "experiment", pick))
    assert gone["session"] == {1: NOW, 2: NOW, 3: OLD} and gone["dataset"] == {1: NOW, 2: NOW, 3: OLD}
    back = trashed(state.untrash(state.trash(catalog, "experiment", pick), "experiment", pick))
    assert back["session"] == {1: None, 2: None, 3: OLD} and back["experiment"] == {1: None, 2: OLD, 3: None}


def test_untrash_a_leaf_restores_its_line_only(spark, catalog):
    got = trashed(state.untrash(catalog, "dataset", spark.createDataFrame([(3,)], "id long")))
    assert got["dataset"] == {1: None, 2: OLD, 3: None} and got["experiment"][2] is None and got["session"] == {1: None, 2: OLD, 3: None}


def test_mixed_selection_is_trashed(spark, catalog):
    ask = spark.createDataFrame([(1, 3, 1, NOW), (1, 3, 2, NOW), (2, 4, 1, NOW), (3, 1, 3, NOW)], "request_id long, user_id long, id long, now timestamp_ntz")
    got = {(r.request_id, r.id): r.action for r in state.trash_decisions(catalog, ask, "session").collect()}
    assert got == {(1, 1): "trash", (1, 2): "trash", (2, 1): "refused", (3, 3): "untrash"}


def test_access_changes_are_all_or_nothing(spark, catalog):
    ask = spark.createDataFrame([(1, 3, 4, 1, 3), (1, 3, 5, 1, 1), (2, 3, 2, 1, 1), (2, 3, 5, 2, 4), (3, 3, 4, 2, None), (4, 4, 5, 1, 4)],
                                "request_id long, requester_id long, user_id long, experiment_id long, privilege int")
    got = {(r.user_id, r.experiment_id): r.privilege for r in state.change_access(catalog, ask).access.collect()}
    assert got[4, 1] == 3 and got[5, 1] == 1 and got[2, 1] == 4 and (5, 2) not in got


def test_membership(spark, catalog):
    ask = spark.createDataFrame([
        (1, 3, 1, 4, "members", "admins", True),   # manager promotes a member, access follows
        (2, 3, 1, 5, "others", "pis", False),      # only a head may name heads
        (3, 2, 1, 5, "others", "pis", True),       # access of a head cannot be rewritten
        (4, 4, 1, 5, "others", "members", False),  # a member manages nothing
        (5, 1, 1, 3, "admins", "others", True),    # a superuser removes a manager and the grants
    ], "request_id long, requester_id long, research_group_id long, user_id long, src string, dst string, retroactive boolean")
    after, verdict = state.change_membership(catalog, ask)
    assert {r.request_id: r.success for r in verdict.collect()} == {1: True, 2: False, 3: False, 4: False, 5: True}
    assert {(r.user_id, r.role) for r in after.group_role.collect()} == {(2, "pi"), (4, "manager")}
    grants = {(r.user_id, r.experiment_id): r.privilege for r in after.access.collect()}
    assert grants[4, 1] == 4 and grants[4, 2] == 4 and (3, 1) not in grants and (3, 2) not in grants


def test_duplicate_grants_do_not_duplicate_hits(catalog):
    request = {k: "" for k in filters.REQUIRED} | {"subject_firstname": "", "subject_lastname": "", "search_psdname": "MUX%", "date_to": "2020-03-01"}
    assert search.search_epochs(catalog, 4, request).count() == 1
    assert search.search_epochs(catalog, 5, request).count() == 0


def test_search_refuses(catalog):
    base = {k: "" for k in filters.REQUIRED}
    for request, reason in ((base, "contract"), (base | {"search_all": "1"}, "empty_fields"),
                            (base | {"search_all": "1", "search_psdname": "a*"}, "could not be processed"),
                            (base | {"search_all": "1", "subject_firstname": "x"}, "contract")):
        with pytest.raises(search.SearchError, match=reason):
            search.search_epochs(catalog, 1, request)
    assert search.search_epochs(catalog, 1, base | {"search_all": "1", "search_psdname": "mux*"}, star_wildcard=True).count() == 1


def test_move_to_a_trashed_experiment(spark, catalog):
    moved = state.move_sessions(catalog, spark.createDataFrame([(1, 2)], "session_id long, experiment_id long"))
    assert {r.id: r.trashtime for r in moved.experiment.collect()}[2] is None
    subjects = {r.id: (r.code, r.experiment_id) for r in moved.subject.collect()}
    assert subjects == {2: ("s009", 1), 3: ("x", 2), 4: ("s001", 2)}


def test_privilege_levels(catalog):
    got = {r.experiment_id for r in access.granted(catalog, 4, access.WRITE).collect()}
    assert got == {3}
    ask = catalog.session.select(F.lit(5).cast("long").alias("user_id"), F.col("id").alias("session_id"))
    assert not any(r.allowed for r in access.has_access(catalog, ask, "session", F.lit(1)).collect())  # admin mode alone is not enough
