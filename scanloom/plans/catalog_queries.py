"""Queries over the catalog: filters, joins, listings, security, search, names."""

from __future__ import annotations

from pyspark.sql import functions as F

from scanloom.functions import names, text
from scanloom.operators import access, filters, listing, manifest, matching, search
from scanloom.operators.ordering import row_numbers
from scanloom.plans.registry import query

_SESSION = "join session s on e.session_id = s.id join subject u on s.subject_id = u.id"
_CHAIN = f"epoch e {_SESSION} join experiment x on u.experiment_id = x.id join research_group g on x.owner_id = g.id"
_DATA = "dataset d join epoch e on d.container_id = e.id " + _SESSION + " join experiment x on u.experiment_id = x.id join research_group g on x.owner_id = g.id"


def _grant(user: int, level: int) -> str:
    return f"x.id in (select experiment_id from access where user_id = {user} and privilege >= {level})"


REQUEST = {k: "" for k in ("search_age_min", "search_age_max", "search_exam", "search_scantype", "search_operator",
                           "search_psdname", "date_from", "date_to")}
NAMED = {**REQUEST, "subject_firstname": "", "subject_lastname": ""}
_FOUND = ("g.gid as group_gid, x.name as experiment, strftime(e.timestamp, '%Y-%m-%d %H:%M') as time, s.exam as exam, "
          "e.scan_type as scan_type, e.description as description, 'epoch=' || e.id as row_id")


# sources and projections -------------------------------------------------------------------------

@query("S1_catalog_counts", """
    select 'research_group' as entity, count(*) as n from research_group union all select 'experiment', count(*) from experiment
    union all select 'subject', count(*) from subject union all select 'session', count(*) from session
    union all select 'epoch', count(*) from epoch union all select 'dataset', count(*) from dataset
    union all select 'access', count(*) from access union all select 'job', count(*) from job""")
def _(tb):
    out = None
    for name in "research_group experiment subject session epoch dataset access job".split():
        row = tb.catalog.frames[name].agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("entity"), "n")
        out = row if out is None else out.unionAll(row)
    return out


@query("S16_listing_contract", f"""
    select g.gid || '|' || x.name as cells, 'exp=' || x.id as row_id,
           'access_' || lower(case a.p when 1 then 'Anon-Read' when 2 then 'Read-Only' when 3 then 'Read-Write' else 'Manage' end)
             || ' ' || case when x.trashtime is not null then 'trash' else '' end as row_class
    from experiment x join research_group g on x.owner_id = g.id
    join (select experiment_id, max(privilege) as p from access where user_id = 7 group by 1) a on a.experiment_id = x.id""")
def _(tb):
    rows = listing.listing_contract(listing.list_experiments(tb.catalog, 7, mode=1), ["owner", "name"])
    return rows.select(F.array_join("data", "|").alias("cells"), F.col("attrs.row_id").alias("row_id"),
                       F.col("attrs.row_class").alias("row_class"))


# filters -----------------------------------------------------------------------------------------

@query("F1_by_psd", "select id, psd from epoch where lower(psd) like 'mux%'")
def _(tb):
    return tb.catalog.epoch.where(filters.by_psd("MUX%", "psd")).select("id", "psd")


@query("F2_by_scan_type", "select id, scan_type from epoch where lower(scan_type) like '%field%'")
def _(tb):
    return tb.catalog.epoch.where(filters.by_scan_type("%Field%", "scan_type")).select("id", "scan_type")


@query("F3_by_subject_name", """select id, firstname, lastname from subject
    where (firstname ilike 'a%' or lastname ilike 'a%') and (firstname ilike '%n%' or lastname ilike '%n%')""")
def _(tb):
    both = filters.by_subject_name("A%", "firstname", "lastname") & filters.by_subject_name("%N%", "firstname", "lastname")
    return tb.catalog.subject.where(both).select("id", "firstname", "lastname")


@query("F4_by_exam", "select e.id, s.exam from epoch e join session s on e.session_id = s.id where s.exam = 42")
def _(tb):
    c = tb.catalog
    rows = c.chain("epoch", "session", {"session": filters.by_exam("42")})
    return rows.select(F.col("epoch_id").alias("id"), F.col("session_exam").alias("exam"))


@query("F5_by_operator", "select id, operator_id from session where operator_id is not distinct from (select max(id) from archive_user where uid = 'user0033')")
def _(tb):
    return filters.by_operator(tb.catalog.user, "user0033", tb.catalog.session, "operator_id").select("id", "operator_id")


@query("F5_by_operator_unknown", "select id from session where operator_id is null")
def _(tb):
    return filters.by_operator(tb.catalog.user, "nobody", tb.catalog.session, "operator_id").select("id")


@query("F6_date_from", "select id, timestamp from session where timestamp >= timestamp '1998-03-01'")
def _(tb):
    return tb.catalog.session.where(filters.date_from("1998-03-01", "timestamp")).select("id", "timestamp")


@query("F7_date_to", "select id, timestamp from session where timestamp <= timestamp '1998-03-01 23:59:59'")
def _(tb):
    return tb.catalog.session.where(filters.date_to("1998-03-01", "timestamp")).select("id", "timestamp")


@query("F8_age_min", "select s.id from session s join subject u on s.subject_id = u.id where epoch_us(s.timestamp) - epoch_us(u.dob::timestamp) >= 40 * 365.25 * 86400000000")
def _(tb):
    return tb.catalog.chain("session", "subject").where(filters.age_min("40")).select(F.col("session_id").alias("id"))


@query("F9_age_max", "select s.id, epoch_us(s.timestamp) - epoch_us(u.dob::timestamp) <= 20.5 * 365.25 * 86400000000 as young from session s join subject u on s.subject_id = u.id where epoch_us(s.timestamp) - epoch_us(u.dob::timestamp) <= 31 * 365.25 * 86400000000")
def _(tb):
    rows = tb.catalog.chain("session", "subject").where(filters.age_max("30"))
    return rows.select(F.col("session_id").alias("id"), filters.age_max("20.5").alias("young"))


@query("F10_validate_requests", """
    with r as (select event_id as request_id,
          case when event_id % 9 <> 0 then '' end as age_min, case event_id % 4 when 0 then '30' when 1 then 'x3' else '' end as age_max,
          case event_id % 5 when 0 then '12' when 1 then '1a' else '' end as exam,
          case event_id % 3 when 0 then 'mux%' when 1 then 'b*d' else '' end as psd,
          case event_id % 7 when 0 then '1999-12-31' when 1 then '1899-01-01' else '' end as dfrom,
          case event_id % 2 when 0 then 'ann' end as fname, case event_id % 2 when 0 then '' end as lname,
          event_id % 2 = 1 or event_id % 11 = 0 as everywhere, event_id % 22 = 0 as super from events)
    select request_id, case
      when age_min is null or not ((fname is not null and lname is not null) or everywhere)
           or ((fname is not null or lname is not null) and everywhere and not super) then 'contract'
      when coalesce(age_min,'') = '' and age_max = '' and exam = '' and psd = '' and dfrom = '' and coalesce(fname,'') = '' and coalesce(lname,'') = '' then 'empty_fields'
      else concat_ws(',', case when dfrom = '1899-01-01' then 'date_from' end, case when age_max = 'x3' then 'search_age_max' end,
                     case when exam = '1a' then 'search_exam' end, case when psd = 'b*d' then 'search_psdname' end) end as errors
    from r""")
def _(tb):
    pick = lambda n, **values: "case event_id % {} {} else '' end".format(
        n, " ".join(f"when {k[1:]} then '{v}'" for k, v in values.items()))
    requests = tb.base("events").selectExpr(
        "event_id as request_id", "case when event_id % 9 <> 0 then '' end as search_age_min",
        pick(4, _0="30", _1="x3") + " as search_age_max", pick(5, _0="12", _1="1a") + " as search_exam",
        "'' as search_scantype", "'' as search_operator", pick(3, _0="mux%", _1="b*d") + " as search_psdname",
        pick(7, _0="1999-12-31", _1="1899-01-01") + " as date_from", "'' as date_to",
        "case when event_id % 2 = 0 then 'ann' end as subject_firstname",
        "case when event_id % 2 = 0 then '' end as subject_lastname",
        "event_id % 2 = 1 or event_id % 11 = 0 as search_all", "event_id % 22 = 0 as is_superuser")
    return filters.validate_requests(requests).select("request_id", "errors")


@query("F12_visible", """select 'live' as mode, count(*) as n from epoch where trashtime is null union all
    select 'all', count(*) from epoch union all select 'trash', count(*) from epoch where trashtime is not null""")
def _(tb):
    count = lambda mode, name: filters.visible(tb.catalog.epoch, mode).agg(F.count(F.lit(1)).alias("n")).select(
        F.lit(name).alias("mode"), "n")
    return count(0, "live").unionAll(count(1, "all")).unionAll(count(2, "trash"))


@query("F13_min_access", "select user_id, experiment_id, privilege from access where privilege >= 3")
def _(tb):
    return filters.min_access(tb.catalog.access, names.level("Read-Write"))


@query("F14_by_kind", """select id, true as raw from dataset where kind <> 'web' union all
    select id, false from dataset where kind in ('peripheral', 'derived')""")
def _(tb):
    d = tb.catalog.dataset
    pick = lambda raw: filters.by_kind(d, raw).select("id", F.lit(raw).alias("raw"))
    return pick(True).unionAll(pick(False))


@query("F15_hide_raw", "select id, kind from dataset where kind in ('peripheral', 'derived', 'qa')")
def _(tb):
    return filters.hide_raw(tb.catalog.dataset).select("id", "kind")


@query("F16_by_ids", """select id, 'literal' as how from session where id in (3, 14, 159) union all
    select id, 'table' from session where id in (select data_container_id from job where status = 'failed')""")
def _(tb):
    c = tb.catalog
    wanted = c.job.where("status = 'failed'").select("data_container_id")
    return filters.by_ids(c.session, [3, 14, 159]).select("id", F.lit("literal").alias("how")).unionAll(
        filters.by_ids(c.session, wanted).select("id", F.lit("table").alias("how")))


_NOW = "1999-06-01 12:00:00"


@query("F17_cooled", f"""select e.id from epoch e where e.dirty and not exists (select 1 from dataset d
    where d.container_id = e.id and d.updatetime > timestamp '{_NOW}' - interval 30 second)""")
def _(tb):
    return filters.cooled(tb.catalog.epoch, tb.catalog.dataset, _NOW, 30).select("id")


@query("F18_jobs_where", "select id, status, task from job where status in ('pending', 'failed') and task = 'proc' and needs_rerun = true")
def _(tb):
    return filters.jobs_where(tb.catalog.job, ["pending", "failed"], "proc", True).select("id", "status", "task")


@query("F19_where_expr", "select id, psd, num_bands from epoch where not contains(psd, 'mux') and num_bands > 1 and size_x = 96")
def _(tb):
    return filters.where_expr(tb.catalog.epoch, "not contains(psd, 'mux')", "num_bands > 1", "size_x = 96").select(
        "id", "psd", "num_bands")


@query("F20_not_discarded", "select arrival_seq, patient_id from scan_record where lower(trim(patient_id, '/')) not in ('zz', 's101@zz/pilot')")
def _(tb):
    return filters.not_discarded(tb.view("scan_record"), ["zz", "s101@zz/pilot"]).select("arrival_seq", "patient_id")


@query("F21_by_patient_glob", "select arrival_seq, patient_id from scan_record where regexp_matches(patient_id, '^(s1.*@a)')")
def _(tb):
    return filters.by_patient_glob(tb.view("scan_record"), "s1*@a").select("arrival_seq", "patient_id")


@query("F22_purge_after", """
    with ns as (select id, subject_id from session where timestamp > timestamp '2000-01-01'),
    gs as (select id from session where id in (select id from ns) or subject_id in (select subject_id from ns)),
    ge as (select id from epoch where timestamp > timestamp '2000-01-01' or session_id in (select id from gs))
    select 'subject' as level, id from subject where id not in (select subject_id from ns)
    union all select 'session', id from session where id not in (select id from gs)
    union all select 'epoch', id from epoch where id not in (select id from ge)
    union all select 'dataset', id from dataset where container_id not in (select id from ge)""")
def _(tb):
    kept = filters.purge_after(tb.catalog, "2000-01-01 00:00:00")
    parts = [kept.frames[n].select(F.lit(n).alias("level"), "id") for n in ("subject", "session", "epoch", "dataset")]
    return parts[0].unionAll(parts[1]).unionAll(parts[2]).unionAll(parts[3])


@query("F23_scope_epochs", f"""select e.id as epoch_id, 'exp' as scope from epoch e {_SESSION} where contains(e.description, 'pe0') and u.experiment_id = 3
    union all select e.id, 'exam' from epoch e {_SESSION} where contains(e.description, 'BOLD') and s.exam = 77
    union all select e.id, 'type' from epoch e where e.scan_type = 'functional'""")
def _(tb):
    c = tb.catalog
    tag = lambda df, s: df.select("epoch_id", F.lit(s).alias("scope"))
    return tag(filters.scope_epochs(c, "pe0", experiment_id=3), "exp").unionAll(
        tag(filters.scope_epochs(c, "BOLD", exam=77), "exam")).unionAll(
        tag(filters.scope_epochs(c, scan_type="functional"), "type"))


@query("F24_path_filters", f"""select d.id from {_DATA} where g.gid ilike 'a%' and x.name ilike 'nation_%' and e.series = 3 and e.acq = 1 and d.trashtime is null""")
def _(tb):
    rows = manifest._tree(tb.catalog, "dataset", None, "A%", "nation_%", False, manifest.path_filters("a_b_%", "%_3_1"))
    return rows.select(F.col("dataset_id").alias("id"))


@query("F25_qa_candidates", """select id from epoch e where qa_status in ('pending', 'rerun') and scan_type = 'functional' and trashtime is null
    and exists (select 1 from dataset d where d.container_id = e.id and d.filetype = 'nifti')""")
def _(tb):
    return filters.qa_candidates(tb.catalog.epoch, tb.catalog.dataset).select("id")


@query("F26_nondiffusion", "select event_id, i, bval from (select event_id, event_id % 50 as i, value as bval from events) where bval < 10 and i < 20")
def _(tb):
    rows = tb.base("events").selectExpr("event_id", "event_id % 50 as i", "value as bval")
    return filters.nondiffusion(rows, 20)


@query("F27_listings", f"""
    select strftime(s.timestamp, '%Y-%m-%d %H:%M') as time, cast(s.exam as varchar) as cell, u.code as code, 'sess=' || s.id as row_id, case when s.trashtime is not null then 'trash' else '' end as row_class
    from session s join subject u on s.subject_id = u.id join experiment x on u.experiment_id = x.id where x.id = 4 and s.trashtime is null and {_grant(11, 1)}
    union all
    select strftime(e.timestamp, '%H:%M:%S'), e.description, '', 'epoch=' || e.id, case when e.trashtime is not null then 'trash' else '' end
    from {_CHAIN} where s.id = 40 and {_grant(11, 1)}""")
def _(tb):
    a = listing.list_sessions(tb.catalog, 4, 11).select("time", F.col("exam").cast("string").alias("cell"), "code", "row_id", "row_class")
    b = listing.list_epochs(tb.catalog, 40, 11, mode=1).select("time", F.col("description").alias("cell"), F.lit("").alias("code"), "row_id", "row_class")
    return a.unionAll(b)


@query("F28_dataset_rows", """
    select label || case when kind = 'primary' then '*' else '' end as label, 'dataset=' || id as row_id, case when trashtime is not null then 'trash' else '' end as row_class from dataset
    union all select 'Volume viewer', 'dataset=v' || d.id, case when d.trashtime is not null then 'trash' else '' end
    from dataset d join epoch e on d.container_id = e.id where filetype = 'nifti' and num_slices > 1 and num_timepoints = 1""")
def _(tb):
    return listing.dataset_rows(tb.catalog.chain("dataset", "epoch"))


@query("F29_validate_edits", """
    with edits as (select o_orderkey as edit_id, case when o_orderkey % 10 = 9 then -1 else o_orderkey end as session_id, o_custkey as subject_id,
         case when o_orderkey % 2 = 0 then 's' || lpad(cast(o_custkey % 90 as varchar), 3, '0') end as subject_code,
         case when o_orderkey % 5 = 0 then 'user' || lpad(cast(o_custkey as varchar), 4, '0') end as uid,
         case when o_orderkey % 3 = 0 then 'nation_' || (o_orderkey % 30) end as experiment_name, 'asia' as owner_gid from orders)
    select edit_id, case when e.session_id is not null and s.id is null then 'parseerr'
       when h.holder <> e.subject_id then 'exists' when e.uid is not null and a.uid is null then 'doesntexist'
       when x.name is not null then 'experiment_exists' end as error
    from edits e left join session s on s.id = e.session_id left join subject u on u.id = s.subject_id
    left join (select experiment_id, code, min(id) as holder from subject group by 1, 2) h on h.experiment_id = u.experiment_id and h.code = e.subject_code
    left join archive_user a on a.uid = e.uid
    left join (select x.name, g.gid from experiment x join research_group g on x.owner_id = g.id) x on x.name = e.experiment_name and x.gid = e.owner_gid""")
def _(tb):
    edits = tb.base("orders").selectExpr(
        "o_orderkey as edit_id", "case when o_orderkey % 10 = 9 then -1 else o_orderkey end as session_id", "o_custkey as subject_id",
        "case when o_orderkey % 2 = 0 then concat('s', lpad(cast(o_custkey % 90 as string), 3, '0')) end as subject_code",
        "case when o_orderkey % 5 = 0 then concat('user', lpad(cast(o_custkey as string), 4, '0')) end as uid",
        "case when o_orderkey % 3 = 0 then concat('nation_', o_orderkey % 30) end as experiment_name", "'asia' as owner_gid")
    return filters.validate_edits(tb.catalog, edits).select("edit_id", "error")


# joins -------------------------------------------------------------------------------------------

@query("J1_hierarchy_chain", f"select e.id as epoch_id, s.exam as exam, u.code as code, x.name as experiment from {_CHAIN}")
def _(tb):
    return tb.catalog.chain("epoch", "experiment").select(
        "epoch_id", F.col("session_exam").alias("exam"), F.col("subject_code").alias("code"), F.col("experiment_name").alias("experiment"))


@query("J2_chain_with_owner_and_data", f"select d.id as dataset_id, g.gid as gid, e.series as series from {_DATA}")
def _(tb):
    return tb.catalog.chain("dataset", "research_group").select(
        "dataset_id", F.col("research_group_gid").alias("gid"), F.col("epoch_series").alias("series"))


@query("J3_row_level_security", "select u.id from subject u where u.experiment_id in (select experiment_id from access where user_id = 21 and privilege >= 2)")
def _(tb):
    return access.secure(tb.catalog.subject, tb.catalog, 21, access.READ).select("id")


@query("J4_container_inheritance", "select id, o_orderpriority as notes, ts, trash from (select id, timestamp as ts, trashtime as trash from session) join (select o_orderkey as id, o_orderpriority from orders) using (id)")
def _(tb):
    from scanloom.catalog import flatten_container
    container = tb.catalog.session.select("id", F.col("timestamp").alias("ts"), F.col("trashtime").alias("trash"))
    child = tb.base("orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("notes"))
    return flatten_container(container, child).select("id", "notes", "ts", "trash")


@query("J5_association_joins", """select g.gid as gid, r.role as role, u.uid as uid from group_role r
    join research_group g on r.research_group_id = g.id join archive_user u on r.user_id = u.id""")
def _(tb):
    c = tb.catalog
    return (c.group_role.join(c.research_group.select(F.col("id").alias("research_group_id"), "gid"), "research_group_id")
            .join(c.user.select(F.col("id").alias("user_id"), "uid"), "user_id").select("gid", "role", "uid"))


@query("J6_outsiders", "select uid from archive_user where id not in (select user_id from group_role where research_group_id = 2)")
def _(tb):
    return access.outsiders(tb.catalog, 2).select("uid")


@query("J7_without_recent_data", """select id from epoch e where not exists (select 1 from dataset d where d.container_id = e.id
    and d.updatetime > timestamp '1998-01-01' - interval 3600 second) and dirty""")
def _(tb):
    return filters.cooled(tb.catalog.epoch, tb.catalog.dataset, "1998-01-01 00:00:00", 3600).select("id")


@query("J8_with_image_data", "select id from epoch e where exists (select 1 from dataset d where d.container_id = e.id and filetype = 'nifti')")
def _(tb):
    images = tb.catalog.dataset.where("filetype = 'nifti'").select("container_id")
    return filters.by_ids(tb.catalog.epoch, images).select("id")


@query("J10_nearest_sibling", """
    with bad as (select id from epoch where id % 5 = 2)
    select b.id as bad_id, arg_min(g.id, (abs(epoch_us(b.timestamp) - epoch_us(g.timestamp)), g.id)) as good_id
    from epoch b join epoch g on b.session_id = g.session_id and b.num_bands = g.num_bands and b.num_slices = g.num_slices
      and b.phase_encode_undersample = g.phase_encode_undersample and b.size_x = g.size_x and b.size_y = g.size_y
    where b.id in (select id from bad) and g.id not in (select id from bad) group by b.id""")
def _(tb):
    epochs = tb.catalog.epoch
    return matching.nearest_sibling(epochs, epochs.where("id % 5 = 2")).select("bad_id", "good_id")


@query("J11_calibration_scan", """
    with t as (select *, contains(description, 'pe1') as pe1 from epoch),
    live as (select * from t where trashtime is null and psd like 'mux%'),
    target as (select * from t where psd = 'muxepi' and num_bands > 1),
    single as (select distinct session_id, size_x, size_y from live where num_bands = 1),
    c as (select g.id as epoch_id, l.id as calibration_id, l.series - g.series as gap from target g left join single s using (session_id, size_x, size_y)
        join live l on l.session_id = g.session_id and l.size_x = g.size_x and l.size_y = g.size_y and l.pe1 = g.pe1 and l.id <> g.id
         and case when s.session_id is not null then l.num_bands = 1 else g.num_mux_cal_cycle < 2 and l.num_mux_cal_cycle >= 2 end)
    select epoch_id, arg_min(calibration_id, (abs(gap), gap, calibration_id)) as calibration_id from c group by epoch_id""")
def _(tb):
    return matching.calibration_scan(tb.catalog.epoch).select("epoch_id", "calibration_id")


_PHYSIO = """scans as (select id as epoch_id, psd, timestamp + interval 30 second as t from epoch where physio_recorded),
    files as (select 'RESPData_' || psd || '_' || strftime(ts, '%m%d%Y%H_%M_%S') || '_0' as name, psd, ts from (
        select case o_custkey % 5 when 0 then 'muxepi' when 1 then 'mux2_dwi' when 2 then 'efgre3d' when 3 then 'spiral' else 'EPI' end as psd,
               o_orderdate + interval '1' second * (o_orderkey * 104729 % 86400) as ts from orders) q)"""


def recording_files(tb):
    """Names of recordings, one for each order, with the sequence and time they hold."""
    files = tb.sql("""select concat('RESPData_', psd, '_', date_format(ts, 'MMddyyyyHH_mm_ss'), '_0') as name from (
        select case o_custkey % 5 when 0 then 'muxepi' when 1 then 'mux2_dwi' when 2 then 'efgre3d' when 3 then 'spiral' else 'EPI' end as psd,
               o_orderdate + interval '1' second * (o_orderkey * 104729 % 86400) as ts from {orders})""")
    return files.select("name", text.physio_file_psd("name").alias("psd"), text.physio_file_time("name").alias("ts"))


@query("J12_physio_files", f"""with {_PHYSIO}
    , first as (select epoch_id, any_value(s.psd) as psd, min(f.ts) as ts from scans s join files f on s.psd = f.psd and f.ts >= s.t
        and cast(f.ts as date) between cast(s.t as date) and cast(s.t as date) + 1 group by epoch_id)
    select epoch_id, f.ts as ts, f.name as name from first join files f using (psd, ts)""")
def _(tb):
    files = recording_files(tb)
    scans = tb.catalog.epoch.where("physio_recorded").select(F.col("id").alias("epoch_id"), "psd", "timestamp")
    return matching.physio_files(scans, files)


@query("J15_fuzzy_lab_match")
def _(tb):
    asks = tb.base("documents").select(F.explode(F.split(F.lower("text"), r"[\x20\x09-\x0D]+")).alias("lab_id")).distinct()
    groups = tb.base("benchmark").select(F.explode(F.split(F.lower("text"), r"\W+")).alias("gid")).distinct()
    return matching.match_labs(asks, groups)


@query("J16_users_with_access", """select u.uid as uid, case a.privilege when 1 then 'Anon-Read' when 2 then 'Read-Only' when 3 then 'Read-Write' else 'Manage' end as privilege
    from access a join archive_user u on a.user_id = u.id where a.experiment_id = 9
    and (a.user_id = 6 or exists (select 1 from access m where m.experiment_id = 9 and m.user_id = 6 and m.privilege = 4))""")
def _(tb):
    return access.users_with_access(tb.catalog, 9, 6)


@query("J17_latest_session", f"""select s.id as session_id, x.id as experiment_id from session s join subject u on s.subject_id = u.id
    join experiment x on u.experiment_id = x.id where s.trashtime is null and {_grant(13, 1)} order by s.timestamp desc, s.id limit 1""")
def _(tb):
    return access.latest_session(tb.catalog, 13).select("session_id", "experiment_id")


@query("J18_lineage", """with recursive up(child_id, ancestor_id, depth) as (select child_id, parent_id, 1 from dataset_parent
    union all select u.child_id, e.parent_id, u.depth + 1 from up u join dataset_parent e on e.child_id = u.ancestor_id)
    select child_id, ancestor_id, min(depth) as depth from up group by 1, 2""")
def _(tb):
    return matching.ancestors(tb.catalog.dataset_parent)


@query("J19_data_product", f"select e.id as epoch_id, s.exam as exam, e.series as series, e.acq as acq from epoch e {_SESSION} join part p on p.p_partkey = s.exam and p.p_size % 7 + 1 = e.series and p.p_size % 3 = e.acq")
def _(tb):
    wanted = tb.base("part").selectExpr("cast(p_partkey as int) as exam", "p_size % 7 + 1 as series", "p_size % 3 as acq")
    rows = tb.catalog.chain("epoch", "subject").select(
        "epoch_id", F.col("session_exam").alias("exam"), F.col("epoch_series").alias("series"), F.col("epoch_acq").alias("acq"))
    return rows.join(wanted, ["exam", "series", "acq"]).select("epoch_id", "exam", "series", "acq")


@query("J20_person_experiments", "select distinct person_id, x.name as experiment from subject u join experiment x on u.experiment_id = x.id")
def _(tb):
    return tb.catalog.chain("subject", "experiment").select(
        F.col("subject_person_id").alias("person_id"), F.col("experiment_name").alias("experiment")).distinct()


# sorts, sets, products ---------------------------------------------------------------------------

@query("O1_natural_sort", """with k as (select p_partkey, p_brand || ' ' || p_type || p_size as cell from part),
    t as (select p_partkey, cell, list_transform(regexp_extract_all(cell, '([0-9]+|[^0-9]+)'),
        lambda t: {'a': case when regexp_matches(t, '^[0-9]') then 0 else 1 end, 'b': case when regexp_matches(t, '^[0-9]') then t::double else 0 end, 'c': t}) as k from k)
    select p_partkey, cell, row_number() over (order by k, p_partkey) as place from t""")
def _(tb):
    from scanloom.functions.sortkey import natural_key
    rows = tb.base("part").select("p_partkey", F.concat("p_brand", F.lit(" "), "p_type", F.col("p_size").cast("string")).alias("cell"))
    keyed = rows.withColumn("tokens", natural_key("cell")["tokens"])
    return row_numbers(keyed, [], ["tokens", "p_partkey"], "place").select("p_partkey", "cell", "place")


@query("O1_sort_lanes", """with c as (select o_orderkey, case o_orderkey % 4 when 0 then '0x' || printf('%x', o_orderkey) when 1 then strftime(o_orderdate, '%Y-%m-%d')
        when 2 then o_custkey || '.' || o_orderkey % 100 else o_orderpriority || o_custkey end as cell,
      case o_orderkey % 4 when 0 then o_orderkey::double when 1 then epoch(o_orderdate::timestamp) end as lane from orders),
    t as (select *, case when o_orderkey % 4 = 2 then [{'a': 0, 'b': cell::double, 'c': cell}] else list_transform(regexp_extract_all(cell, '([0-9]+|[^0-9]+)'),
      lambda t: {'a': case when regexp_matches(t, '^[0-9]') then 0 else 1 end, 'b': case when regexp_matches(t, '^[0-9]') then t::double else 0 end, 'c': t}) end as k from c)
    select o_orderkey, cell, row_number() over (order by lane nulls first, k, o_orderkey) as place from t""")
def _(tb):
    """Cells of all lanes: hex numbers and dates by their value, after numbers and text."""
    from scanloom.functions.sortkey import natural_key
    rows = tb.base("orders").selectExpr("o_orderkey", """case o_orderkey % 4 when 0 then concat('0x', lower(hex(o_orderkey))) when 1 then date_format(o_orderdate, 'yyyy-MM-dd')
        when 2 then concat(o_custkey, '.', o_orderkey % 100) else concat(o_orderpriority, o_custkey) end as cell""")
    keyed = rows.withColumn("key", natural_key("cell")).select("o_orderkey", "cell", "key.*")
    return row_numbers(keyed, [], ["lane", "tokens", "o_orderkey"], "place").select("o_orderkey", "cell", "place")


@query("O2_default_order", f"select strftime(s.timestamp, '%Y-%m-%d %H:%M') as time, s.exam as exam, 'sess=' || s.id as row_id from session s join subject u on s.subject_id = u.id join experiment x on u.experiment_id = x.id where x.id = 5 and s.trashtime is null and {_grant(5, 1)} order by 1 desc, 3")
def _(tb):
    return listing.default_order(listing.list_sessions(tb.catalog, 5, 5), "sessions").select("time", "exam", "row_id")


@query("O3_status_lists", """select id, status, task, activity from job where status in ('failed', 'running')
    union all select * from (select id, status, task, activity from job where status = 'pending' order by id limit 200)""")
def _(tb):
    return listing.status_lists(tb.catalog.job)


@query("O4_next_jobs", "select id, task from job where status = 'pending' and task = 'proc' and not needs_rerun order by id desc limit 25")
def _(tb):
    return listing.next_jobs(tb.catalog.job, 25, "proc", True, "not needs_rerun").select("id", "task")


@query("O5_next_dirty", "select id, timestamp from epoch where dirty order by timestamp, id limit 40")
def _(tb):
    return listing.next_dirty(tb.catalog.epoch, 40).select("id", "timestamp")


@query("O6_tree_names", """select distinct g.gid as name, 0 as place from experiment x join research_group g on x.owner_id = g.id
    where x.id in (select experiment_id from access where user_id = 3) union all select 'README.txt', 1 union all select 'raw', 2""")
def _(tb):
    return manifest.tree_groups(tb.catalog, 3, raw_dir=True)


@query("O7_keyset_page", "select id, kind from dataset where id > 5000 and kind = 'qa' order by id limit 30")
def _(tb):
    return listing.page_after(tb.catalog.dataset.where("kind = 'qa'"), 5000, 30).select("id", "kind")


@query("U1_shared_experiments", """select b.experiment_id as experiment_id, case b.privilege when 1 then 'Anon-Read' when 2 then 'Read-Only' when 3 then 'Read-Write' else 'Manage' end as privilege
    from access b join experiment x on x.id = b.experiment_id where b.user_id = 17 and x.trashtime is null
    and b.experiment_id in (select experiment_id from access where user_id = 18 and privilege = 4)""")
def _(tb):
    return access.shared_experiments(tb.catalog, 18, 17)


@query("U2_default_grants", """with h as (select distinct research_group_id, user_id from group_role where role in ('pi', 'manager')),
    m as (select distinct research_group_id, user_id from group_role where role = 'member' except select * from h)
    select user_id, x.id as experiment_id, 4 as privilege from h join experiment x on x.owner_id = h.research_group_id
    union all select user_id, x.id, 2 from m join experiment x on x.owner_id = m.research_group_id""")
def _(tb):
    return access.default_grants(tb.catalog.group_role, tb.catalog.experiment)


@query("U3_permissions", "select distinct user_id, permission_id from user_group join group_permission using (group_id)")
def _(tb):
    return access.permissions(tb.catalog)


@query("U4_role_groups", "select user_id, gid from group_role r join research_group g on r.research_group_id = g.id where role in ('pi', 'manager')")
def _(tb):
    return access.role_groups(tb.catalog)


@query("U6_scope_by_exams", f"""select d.id from dataset d join epoch e on d.container_id = e.id join session s on e.session_id = s.id
    where d.kind = 'peripheral' and d.filetype = 'physio' and s.exam in (select s.exam from session s join subject u on s.subject_id = u.id where u.experiment_id = 6)""")
def _(tb):
    c = tb.catalog
    exams = c.chain("session", "subject", {"subject": F.col("experiment_id") == 6}).select("session_exam").distinct()
    rows = c.chain("dataset", "session", {"dataset": F.expr("dataset_kind = 'peripheral' and dataset_filetype = 'physio'")})
    return rows.join(exams, "session_exam", "left_semi").select(F.col("dataset_id").alias("id"))


@query("Q1_search_epochs", f"""select {_FOUND} from {_CHAIN} where {_grant(8, 2)} and e.psd ilike '%mux%' and e.scan_type ilike 'func%'
    and s.timestamp >= timestamp '1996-01-01' and s.timestamp <= timestamp '2000-12-31 23:59:59'
    and (u.firstname ilike 'a%' or u.lastname ilike 'a%')
    and epoch_us(s.timestamp) - epoch_us(u.dob::timestamp) >= 20 * 365.25 * 86400000000 and epoch_us(s.timestamp) - epoch_us(u.dob::timestamp) <= 61 * 365.25 * 86400000000""")
def search_epochs(tb):
    request = {**NAMED, "search_psdname": "%mux%", "search_scantype": "func%", "date_from": "1996-01-01",
               "date_to": "2000-12-31", "subject_firstname": "a%", "search_age_min": "20", "search_age_max": "60"}
    return search.search_epochs(tb.catalog, 8, request)


@query("Q1_search_everything", f"select {_FOUND} from {_CHAIN} where e.psd ilike 'EPI' and s.operator_id is not distinct from (select max(id) from archive_user where uid = 'user0033')")
def _(tb):
    return search.search_epochs(tb.catalog, 8, {**REQUEST, "search_all": "1", "search_psdname": "epi", "search_operator": "user0033"})


@query("Q2_experiments", """select x.name as name, case a.p when 1 then 'Anon-Read' when 2 then 'Read-Only' when 3 then 'Read-Write' else 'Manage' end as privilege
    from experiment x join (select experiment_id, max(privilege) as p from access where user_id = 30 and privilege >= 2 group by 1) a on a.experiment_id = x.id where x.trashtime is null""")
def _(tb):
    return access.experiments_with_privilege(tb.catalog, 30, access.READ).select(F.col("experiment_name").alias("name"), "privilege")


@query("Q3_children", f"""select e.id as id, 'epoch' as level from {_CHAIN} where s.id = 120 and e.trashtime is null and {_grant(31, 1)}
    union all select d.id, 'dataset' from {_DATA} where s.id = 120 and d.trashtime is null and {_grant(31, 1)}
    union all select s.id, 'session' from session s join subject u on s.subject_id = u.id join experiment x on u.experiment_id = x.id where x.id = 8 and s.trashtime is not null and {_grant(31, 1)}""")
def _(tb):
    c = tb.catalog
    pick = lambda level, df: df.select(F.col(f"{level}_id").alias("id"), F.lit(level).alias("level"))
    return pick("epoch", access.children(c, "epoch", "session", 120, 31)).unionAll(
        pick("dataset", access.children(c, "dataset", "session", 120, 31))).unionAll(
        pick("session", access.children(c, "session", "experiment", 8, 31, mode=2)))


@query("Q4_has_access", """select j.id as id, j.user_id as user_id, coalesce(a.p >= 3, false) or su.id is not null as allowed
    from (select o_orderkey as id, o_custkey % 160 as user_id from orders) j join session s on s.id = j.id join subject u on s.subject_id = u.id
    left join (select user_id, experiment_id, max(privilege) as p from access group by 1, 2) a on a.user_id = j.user_id and a.experiment_id = u.experiment_id
    left join (select id from archive_user where admin_mode and id in (select user_id from user_group where group_id = 1)) su on su.id = j.user_id""")
def _(tb):
    asks = tb.base("orders").selectExpr("o_orderkey as session_id", "o_custkey % 160 as user_id")
    return access.has_access(tb.catalog, asks, "session", F.lit(access.WRITE)).select(
        F.col("session_id").alias("id"), "user_id", "allowed")


def _manifest_sql(user: int, where: str, folder: str, name: str) -> str:
    return f"""with f as (select d.id as did, s.p as position, {folder} as folder,
        (case when d.archived then 'archive' else 'current' end) || printf('/%03d/%08d', d.id % 1000, d.id) || '/' || s.f as source, {name} as name
        from {_DATA} join (select experiment_id, max(privilege) as has from access where user_id = {user} group by 1) a on a.experiment_id = x.id,
          lateral (select unnest(string_split(d.filenames, ', ')) as f, generate_subscripts(string_split(d.filenames, ', '), 1) as p) s
        where d.filenames <> '' and a.has >= case when d.kind in ('primary', 'secondary') then 2 else 1 end and {where}),
    b as (select *, string_split(name, '.')[1] as stem, substr(name, length(string_split(name, '.')[1]) + 1) as tail from f),
    c as (select *, regexp_replace(stem, '\\++$', '') as bare from b),
    fam as (select *, length(stem) - length(bare) as plus, bare || tail as base from c),
    one as (select *, row_number() over (partition by folder, base order by did, position) - 1 as slot from fam where plus = 0),
    two as (select * exclude (slot), row_number() over (partition by folder, base order by did, position) as slot from (
        select * from one where slot >= 1 union all select *, 0 as slot from fam where plus = 1))
    select source, folder || '/' || bare || repeat('+', slot::int) || tail as target from (select * from one where slot = 0 union all by name select * from two)"""


_FOLDER = "'archive/' || g.gid || '/' || x.name || '/' || strftime(s.timestamp, '%Y%m%d_%H%M') || '/' || e.series || case when e.acq is null then '' else '_' || e.acq end || '_' || e.description"


@query("Q5_download_manifest", _manifest_sql(12, "d.kind <> 'web'", _FOLDER, "s.f"))
def _(tb):
    return manifest.download_manifest(tb.catalog, 12, raw=True)


@query("Q5_download_manifest_legacy", _manifest_sql(
    12, "d.kind in ('peripheral', 'derived')",
    "'archive/' || g.gid || '/' || x.name || '/' || strftime(s.timestamp, '%Y%m%d') || '_' || s.exam",
    """printf('%04d_%02d_', e.series, coalesce(e.acq, 0)) || e.description
       || case when string_split(s.f, '.')[1] like '%\\_B0' escape '\\' then '_B0' when string_split(s.f, '.')[1] like '%\\_physio' escape '\\' then '_physio'
               when string_split(s.f, '.')[1] like '%\\_dicoms' escape '\\' then '_dicoms' else '' end
       || '.' || substr(s.f, length(string_split(s.f, '.')[1]) + 2)"""))
def _(tb):
    return manifest.download_manifest(tb.catalog, 12, raw=False, legacy=True)


_URGENT = "select o_orderkey as id from {orders} where o_orderpriority = '1-URGENT'"
_FAILED = "select o_orderkey * 8 + 1 + o_custkey % 7 as id from {orders} where o_orderkey % 7 = 3"
_LOST = "select (l_orderkey * 8 + l_linenumber) * 8 + case when l_linestatus = 'O' then 5 else 4 end as id from {lineitem} where l_returnflag = 'R'"


@query("Q5_download_sessions", _manifest_sql(12, f"d.kind <> 'web' and e.session_id in ({_URGENT.format(orders='orders')})", _FOLDER, "s.f"))
def _(tb):
    """All data but viewer files of the sessions marked urgent."""
    return manifest.download_selected(tb.catalog, 12, "session", tb.sql(_URGENT), raw=True)


@query("Q5_download_epochs", _manifest_sql(12, f"d.kind in ('peripheral', 'derived') and e.id in ({_FAILED.format(orders='orders')})", _FOLDER, "s.f"))
def _(tb):
    """Peripheral and derived data of the epochs with a failed job."""
    failed = tb.catalog.job.where("status = 'failed'").select(F.col("data_container_id").alias("id"))
    return manifest.download_selected(tb.catalog, 12, "epoch", failed)


@query("Q5_download_datasets", _manifest_sql(12, f"d.id in ({_LOST.format(lineitem='lineitem')})", _FOLDER, "s.f"))
def _(tb):
    """Datasets picked one by one, whatever their kind, each id asked for as often as it has lines."""
    return manifest.download_selected(tb.catalog, 12, "dataset", tb.sql(_LOST))


@query("Q6_list_datasets", f"""with v as (select d.*, e.num_slices, e.num_timepoints from {_DATA}
      join (select experiment_id, max(privilege) as has from access where user_id = 14 group by 1) a on a.experiment_id = x.id
      where d.trashtime is null and a.has >= case when d.kind in ('primary', 'secondary') then 2 else 1 end)
    select label || case when kind = 'primary' then '*' else '' end as label, 'dataset=' || id as row_id, '' as row_class from v
    union all select 'Volume viewer', 'dataset=v' || id, '' from v where filetype = 'nifti' and num_slices > 1 and num_timepoints = 1""")
def _(tb):
    return listing.list_datasets(tb.catalog, 14)


@query("Q7_tree_sessions", f"""select strftime(s.timestamp, '%Y%m%d_%H%M') || '_' || s.exam as name from session s join subject u on s.subject_id = u.id
    join experiment x on u.experiment_id = x.id join research_group g on x.owner_id = g.id where g.gid ilike 'asia' and x.name ilike 'nation%' and s.trashtime is null and {_grant(2, 1)}""")
def _(tb):
    return manifest.tree_sessions(tb.catalog, 2, "ASIA", "nation%")


@query("Q7_tree_epochs", f"""select s.exam || '_' || e.series || case when e.acq is null then '' else '_' || e.acq end || '_' || e.description as name
    from {_CHAIN} where g.gid ilike 'eu%' and x.name ilike '%' and e.trashtime is null and {_grant(2, 1)}""")
def _(tb):
    return manifest.tree_epochs(tb.catalog, 2, "eu%", "%", "%")


@query("Q7_tree_files", f"""select printf('%04d_%02d_', e.series, coalesce(e.acq, 0)) || e.scan_type || substr(f, 1 + case when n > 1 then greatest(0, p - 1) else length(string_split(fs[1], '.')[1]) end) as name,
      (case when archived then 'archive' else 'current' end) || printf('/%03d/%08d', did % 1000, did) || '/' || f as path
    from (select d.id as did, d.archived, e.series, e.acq, e.scan_type, string_split(d.filenames, ', ') as fs, unnest(string_split(d.filenames, ', ')) as f,
        len(string_split(d.filenames, ', ')) as n,
        list_max(list_filter(range(0, 60), lambda k: len(list_distinct(list_transform(string_split(d.filenames, ', '), lambda q: q[1:k]))) = 1 and k <= list_min(list_transform(string_split(d.filenames, ', '), lambda q: length(q))))) as p
      from {_DATA} where g.gid ilike 'africa' and x.name ilike '%' and d.trashtime is null and d.filetype = 'nifti' and d.filenames <> '') e""")
def _(tb):
    return manifest.tree_files(tb.catalog, None, "africa", "%", "%", "%t")


@query("Q8_member_lists", """select case role when 'pi' then 'pis' when 'manager' then 'admins' else 'members' end as list, u.uid as uid,
      case when firstname is not null and lastname is not null then lastname || ', ' || firstname else lastname end as name
    from group_role r join archive_user u on u.id = r.user_id where research_group_id = 1
    union all select 'others', uid, case when firstname is not null and lastname is not null then lastname || ', ' || firstname else lastname end
    from archive_user where id not in (select user_id from group_role where research_group_id = 1)""")
def _(tb):
    return access.member_lists(tb.catalog, 1)


@query("Q9_access_overlay", """select u.uid as uid, 'access_' || lower(coalesce(case a.privilege when 1 then 'Anon-Read' when 2 then 'Read-Only' when 3 then 'Read-Write' when 4 then 'Manage' end, 'none')) as row_class
    from archive_user u left join access a on a.user_id = u.id and a.experiment_id = 9
    and (a.user_id = 10 or exists (select 1 from access m where m.experiment_id = 9 and m.user_id = 10 and m.privilege = 4))""")
def _(tb):
    levels = access.users_with_access(tb.catalog, 9, 10)
    return access.access_overlay(access.user_listing(tb.catalog.user), levels, "uid").select("uid", "row_class")


@query("Q10_status_board", """select status, count(*) as n, min(id) as first_id, max(id) as last_id from (select id, status from job where status in ('failed', 'running')
    union all select * from (select id, status from job where status = 'pending' order by id limit 200)) group by 1""")
def _(tb):
    return listing.status_lists(tb.catalog.job).groupBy("status").agg(
        F.count(F.lit(1)).alias("n"), F.min("id").alias("first_id"), F.max("id").alias("last_id"))


@query("W8_unique_targets", """
    with f as (select page_id as id, regexp_replace(url, '^https?://([^/]*)/.*$', '\\1') as folder, case page_id % 6 when 0 then 'scan+.nii' when 1 then 'scan++.nii' else 'scan.nii' end as name from pages)
    select f.id as id, folder || '/scan' || repeat('+', slot::int) || '.nii' as target from f join (
      with recursive a as (select id, folder, length(name) - 8 as plus, row_number() over (partition by folder order by id) as n from f),
      zero as (select *, row_number() over (partition by folder order by id) - 1 as slot from a where plus = 0),
      pool1 as (select id, folder from zero where slot >= 1 union all select id, folder from a where plus = 1),
      one as (select *, row_number() over (partition by folder order by id) as slot from pool1),
      pool2 as (select id, folder from one where slot >= 2 union all select id, folder from a where plus = 2),
      two as (select *, row_number() over (partition by folder order by id) + 1 as slot from pool2)
      select id, slot from zero where slot = 0 union all select id, slot from one where slot = 1 union all select id, slot from two) s on s.id = f.id""")
def _(tb):
    files = tb.base("pages").selectExpr(
        "page_id as id", r"regexp_replace(url, '^https?://([^/]*)/.*$', '$1') as folder",
        "case page_id % 6 when 0 then 'scan+.nii' when 1 then 'scan++.nii' else 'scan.nii' end as name")
    return manifest.unique_targets(files, "folder", "name", ["id"]).select("id", "target")
