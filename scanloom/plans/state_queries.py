"""Queries over catalog maintenance, roll-ups, window numbering and name functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from scanloom.catalog import Catalog
from scanloom.functions import names, text
from scanloom.operators import ingest, rollup, search, state
from scanloom.operators.listing import id_lists
from scanloom.operators.ordering import row_numbers
from scanloom.plans.registry import query

_NOW = "2002-02-02 02:02:02"
_PLACE = "(select s.id as sid, u.experiment_id from session s join subject u on s.subject_id = u.id)"


# roll-ups and numbering --------------------------------------------------------------------------

@query("A1_counts", """select 'accessible_sessions' as what, count(*) as n from session s join subject u on s.subject_id = u.id where u.experiment_id in (select experiment_id from access where user_id = 44)
    union all select 'all_sessions', count(*) from session union all select 'unfinished_jobs', count(*) from job where status in ('pending', 'running')""")
def _(tb):
    return search.session_counts(tb.catalog, 44)


@query("A2_psd_choices", "select 0 as place, '' as psd union all select distinct 1, psd from epoch")
def _(tb):
    return search.psd_choices(tb.catalog.epoch)


@query("A3_next_subject_code", """select x.id as experiment_id, printf('s%03d', coalesce(max(cast('0' || regexp_replace(code, '[^0-9]+', '', 'g') as bigint)), 0) + 1) as code
    from experiment x left join subject u on u.experiment_id = x.id group by x.id""")
def _(tb):
    return rollup.next_subject_codes(tb.catalog.subject, tb.catalog.experiment).select("experiment_id", "code")


@query("A4_session_start", "select s.id, least(s.timestamp, (select min(timestamp) from epoch e where e.session_id = s.id)) as timestamp from session s")
def _(tb):
    return rollup.session_start(tb.catalog.session, tb.catalog.epoch).select("id", "timestamp")


@query("A5_contains_trash", """with e as (select id, session_id, trashtime is not null or coalesce((select bool_or(d.trashtime is not null) from dataset d where d.container_id = e0.id), false) as t from epoch e0),
    s as (select id, subject_id, trashtime is not null or coalesce((select bool_or(t) from e where session_id = s0.id), false) as t from session s0),
    u as (select id, experiment_id, trashtime is not null or coalesce((select bool_or(t) from s where subject_id = u0.id), false) as t from subject u0)
    select 'epoch' as level, id, t as contains_trash from e union all select 'session', id, t from s union all select 'subject', id, t from u
    union all select 'experiment', id, trashtime is not null or coalesce((select bool_or(t) from u where experiment_id = x.id), false) from experiment x""")
def _(tb):
    flags = rollup.contains_trash(tb.catalog)
    out = None
    for level in ("epoch", "session", "subject", "experiment"):
        part = flags[level].select(F.lit(level).alias("level"), "id", "contains_trash")
        out = part if out is None else out.unionAll(part)
    return out


@query("A19_acquisition_files", """with f as (select l_orderkey as exam, l_linenumber as series, cast(l_suppkey % 2 as int) as acq,
      'img' || lpad(cast(l_partkey as varchar), 7, '0') || lpad(cast(l_suppkey as varchar), 6, '0') as path from lineitem),
    n as (select *, cast(floor((row_number() over (partition by exam, series, acq order by path) - 1) / 10000) as bigint) as part from f)
    select exam, series, acq, part, count(*) as n, string_agg(path, ',' order by path) as paths from n group by 1, 2, 3, 4""")
def _(tb):
    files = tb.base("lineitem").selectExpr(
        "l_orderkey as exam", "l_linenumber as series", "cast(l_suppkey % 2 as int) as acq",
        "concat('img', lpad(cast(l_partkey as string), 7, '0'), lpad(cast(l_suppkey as string), 6, '0')) as path")
    return rollup.acquisition_files(files).select("exam", "series", "acq", "part", F.size("paths").cast("long").alias("n"),
                                                  F.array_join("paths", ",").alias("paths"))


@query("A20_recording_files", """with n as (select o_orderdate as ts, o_orderkey as k, cast(floor((row_number() over (partition by o_orderdate order by o_orderkey) - 1) / 10000) as bigint) as part from orders)
    select ts, part, string_agg('f' || lpad(cast(k as varchar), 8, '0'), ',' order by k) as names from n group by 1, 2""")
def _(tb):
    files = tb.base("orders").selectExpr("o_orderdate as ts", "concat('f', lpad(cast(o_orderkey as string), 8, '0')) as name")
    return rollup.recording_files(files).select("ts", "part", F.array_join("names", ",").alias("names"))


@query("A23_id_lists", """select 'sess' as type, cast(floor(id / 10000) as bigint) as part, count(*) as n, string_agg(cast(id as varchar), ',' order by cast(id as varchar)) as ids from session group by 1, 2
    union all select 'subj', cast(floor(id / 10000) as bigint), count(*), string_agg(cast(id as varchar), ',' order by cast(id as varchar)) from subject group by 1, 2""")
def _(tb):
    rows = tb.catalog.session.select(F.concat(F.lit("sess="), F.col("id").cast("string")).alias("row_id")).unionAll(
        tb.catalog.subject.select(F.concat(F.lit("subj="), F.col("id").cast("string")).alias("row_id")))
    return id_lists(rows).select("type", "part", F.size("ids").cast("long").alias("n"), F.array_join("ids", ",").alias("ids"))


@query("W1_renumber_subjects", """select u.id, printf('s%03d', row_number() over (partition by experiment_id order by f is null, f, u.id)) as code
    from subject u left join (select subject_id, min(timestamp) as f from session group by 1) s on s.subject_id = u.id""")
def _(tb):
    return rollup.renumber_subjects(tb.catalog.subject, tb.catalog.session).select("id", "code")


@query("W12_primary_dataset", """select container_id, min(case when kind = 'primary' then id end) as dataset_id, count(*) as originals
    from dataset where kind in ('primary', 'secondary') group by 1""")
def _(tb):
    d = tb.catalog.dataset
    originals = rollup.original_datasets(d).groupBy("container_id").agg(F.count(F.lit(1)).alias("originals"))
    return originals.join(rollup.primary_datasets(d), "container_id", "left").select("container_id", "dataset_id", "originals")


# ingest ------------------------------------------------------------------------------------------

def _empty_archive(tb) -> Catalog:
    """Groups, people and roles of the test catalog; no data yet."""
    spark, c = tb.spark, tb.catalog
    empty = lambda ddl: spark.createDataFrame([], ddl)
    unknown = spark.createDataFrame([(99, "unknown", "unknown")], "id long, gid string, name string")
    return c.replace(
        research_group=c.research_group.unionByName(unknown),
        experiment=empty("id long, name string, irb string, owner_id long, timestamp timestamp_ntz, trashtime timestamp_ntz"),
        access=empty("user_id long, experiment_id long, privilege int"),
        subject=empty("id long, code string, firstname string, lastname string, dob date, experiment_id long, person_id long, trashtime timestamp_ntz"),
        session=empty("id long, uid string, exam int, notes string, subject_id long, operator_id long, timestamp timestamp_ntz, trashtime timestamp_ntz"),
        epoch=empty("id long, uid string, session_id long, series int, acq int, description string, psd string, timestamp timestamp_ntz, "
                    "trashtime timestamp_ntz, physio_recorded boolean, qa_status string, num_timepoints int, dirty boolean, scheduling boolean"),
        dataset=empty("id long, container_id long, label string, kind string, filetype string, priority int, filenames array<string>, "
                      "trashtime timestamp_ntz, updatetime timestamp_ntz, archived boolean, compressed boolean, qa_status string, datatype string"))


_READY = """ready as (select *, case when split_part(ltrim(patient_id, '@'), '/', 1) like '%zz' then 'unknown'
        else replace(regexp_replace(split_part(ltrim(patient_id, '@'), '/', 1), '^.*@', ''), 'asiia', 'asia') end as gid,
      case when split_part(patient_id, '/', 1) like '%zz' then patient_id when contains(patient_id, '/') then split_part(patient_id, '/', 2) else 'untitled' end as exp,
      case when is_screenshot then 0 else acq_no end as acq,
      case when is_screenshot then date_trunc('day', timestamp) + interval '86399' second else timestamp end as ts from scan_record),
    ep as (select series_uid, acq, arg_min(r, arrival_seq) as r from (select series_uid, acq, arrival_seq, {'arrival_seq': arrival_seq, 'exam_uid': exam_uid, 'exam_no': exam_no, 'gid': gid, 'exp': exp, 'operator': operator, 'ts': ts, 'series_no': series_no, 'series_desc': series_desc, 'psd_name': psd_name,
      'code': case when contains(patient_id, '@') then split_part(patient_id, '@', 1) else '' end, 'first': subj_firstname, 'last': subj_lastname, 'dob': subj_dob} as r from ready) q group by 1, 2),
    se as (select r.exam_uid as exam_uid, arg_min(r, r.arrival_seq) as r, min(r.ts) as start from ep group by 1)"""


@query("M1_ingest_sessions", f"""with {_READY} select se.exam_uid as uid, r.exam_no as exam, r.gid as gid, r.exp as experiment, a.id as operator_id, se.start as timestamp,
      row_number() over (order by r.arrival_seq) as id from se left join archive_user a on a.uid = r.operator""")
def _(tb):
    done = ingest.ingest(_empty_archive(tb), tb.view("scan_record"), _NOW)
    return done.chain("session", "research_group").select(
        F.col("session_uid").alias("uid"), F.col("session_exam").alias("exam"), F.col("research_group_gid").alias("gid"),
        F.col("experiment_name").alias("experiment"), F.col("session_operator_id").alias("operator_id"),
        F.col("session_timestamp").alias("timestamp"), F.col("session_id").alias("id"))


@query("M1_ingest_epochs", f"""with {_READY} select series_uid as uid, acq, r.exam_uid as exam_uid, r.series_no as series, replace(r.series_desc, ' ', '_') as description, r.ts as timestamp,
      row_number() over (order by r.arrival_seq) as id from ep""")
def _(tb):
    done = ingest.ingest(_empty_archive(tb), tb.view("scan_record"), _NOW)
    return done.chain("epoch", "session").select(
        F.col("epoch_uid").alias("uid"), F.col("epoch_acq").alias("acq"), F.col("session_uid").alias("exam_uid"),
        F.col("epoch_series").alias("series"), F.col("epoch_description").alias("description"),
        F.col("epoch_timestamp").alias("timestamp"), F.col("epoch_id").alias("id"))


# a creator is the first session of a code, of a person (also when met as the first of a code before), or an unnamed one;
# codes made here follow the highest number seen so far in the experiment
_SUBJECTS = f"""with {_READY}, a as (select exam_uid, r.arrival_seq as seq, r.gid as gid, r.exp as exp, r.code as code, r.first as first, r.last as last, r.dob as dob,
      case when r.code <> '' then 'code' when r.first <> '' and r.last <> '' then 'name' else 'none' end as how from se),
    cc as (select gid, exp, code, min(seq) as creator from a where how = 'code' group by 1, 2, 3),
    pool as (select gid, exp, first, last, coalesce(cast(dob as varchar), '') as dob, seq from a where how = 'name' or seq in (select creator from cc)),
    nc as (select gid, exp, first, last, dob, min(seq) as creator from pool group by 1, 2, 3, 4, 5),
    l as (select a.*, case how when 'code' then cc.creator when 'name' then nc.creator else a.seq end as creator from a
      left join cc on a.how = 'code' and cc.gid = a.gid and cc.exp = a.exp and cc.code = a.code
      left join nc on a.how = 'name' and nc.gid = a.gid and nc.exp = a.exp and nc.first = a.first and nc.last = a.last and nc.dob = coalesce(cast(a.dob as varchar), '')),
    made as (select *, case when how = 'code' then cast('0' || regexp_replace(code, '[^0-9]+', '', 'g') as bigint) end as number,
      count(*) filter (how <> 'code') over (partition by gid, exp order by seq) as u from a where seq in (select creator from l)),
    coded as (select *, u + greatest(0, coalesce(max(number - u) over (partition by gid, exp order by seq), 0)) as next from made)
    select row_number() over (order by seq) as id, case when how = 'code' then code else printf('s%03d', next) end as code, first as firstname, last as lastname, dob,
      gid, exp as experiment, (select count(*) from l where l.creator = coded.seq) as sessions from coded"""


@query("M1_ingest_subjects", _SUBJECTS)
def _(tb):
    done = ingest.ingest(_empty_archive(tb), tb.view("scan_record"), _NOW)
    sessions = done.session.groupBy(F.col("subject_id").alias("id")).agg(F.count(F.lit(1)).alias("sessions"))
    place = done.chain("experiment", "research_group").select("experiment_id", F.col("experiment_name").alias("experiment"),
                                                              F.col("research_group_gid").alias("gid"))
    return done.subject.join(place, "experiment_id").join(sessions, "id", "left").select(
        "id", "code", "firstname", "lastname", "dob", "gid", "experiment", F.coalesce("sessions", F.lit(0)).alias("sessions"))


@query("M2_arbitration", f"""with {_READY}, d as (select series_uid, acq, filetype, min(arrival_seq) as seq, arg_min(priority, arrival_seq) as priority from ready group by 1, 2, 3),
    w as (select *, max(priority) over (partition by series_uid, acq order by seq rows between unbounded preceding and 1 preceding) as before from d),
    v as (select *, before is null or before < priority as wins from w),
    k as (select *, max(case when wins then seq end) over (partition by series_uid, acq) as top, count(*) filter (wins) over (partition by series_uid, acq) as n from v)
    select series_uid, acq, filetype, priority, case when seq = top then 'primary' else 'secondary' end as kind, case when n > 1 then 'rerun' else 'pending' end as qa_status from k""")
def _(tb):
    done = ingest.ingest(_empty_archive(tb), tb.view("scan_record"), _NOW)
    return done.chain("dataset", "epoch").select(
        F.col("epoch_uid").alias("series_uid"), F.col("epoch_acq").alias("acq"), F.col("dataset_filetype").alias("filetype"),
        F.col("dataset_priority").alias("priority"), F.col("dataset_kind").alias("kind"), F.col("epoch_qa_status").alias("qa_status"))


@query("M3_grants_of_new_experiments", f"""with {_READY}, x as (select distinct r.gid as gid, r.exp as exp from se), g as (select id, gid from research_group),
    h as (select distinct research_group_id, user_id from group_role where role in ('pi', 'manager')),
    m as (select distinct research_group_id, user_id from group_role where role = 'member' except select * from h)
    select x.gid as gid, x.exp as experiment, user_id, 4 as privilege from x join g using (gid) join h on h.research_group_id = g.id
    union all select x.gid, x.exp, user_id, 2 from x join g using (gid) join m on m.research_group_id = g.id""")
def _(tb):
    done = ingest.ingest(_empty_archive(tb), tb.view("scan_record"), _NOW)
    return done.access.join(done.chain("experiment", "research_group"), "experiment_id").select(
        F.col("research_group_gid").alias("gid"), F.col("experiment_name").alias("experiment"), "user_id", "privilege")


@query("J9_get_or_create", """select c_name as name, n, case when n is null then 25 + row_number() over (partition by n is null order by c_name) else n end as id
    from (select distinct lower(c_mktsegment) || '_' || c_nationkey as c_name, case when c_nationkey % 2 = 0 then c_nationkey end as n from customer)""")
def _(tb):
    asks = tb.base("customer").selectExpr("concat(lower(c_mktsegment), '_', c_nationkey) as name", "c_nationkey").distinct()
    stored = tb.base("customer").where("c_nationkey % 2 = 0").selectExpr(
        "concat(lower(c_mktsegment), '_', c_nationkey) as name", "cast(c_nationkey as int) as n").distinct()
    seen = asks.join(stored, "name", "left")
    top = tb.catalog.experiment.agg(F.max("id")).scalar()
    made = row_numbers(seen.where("n is null"), [], ["name"], "_k").select("name", "n", (F.col("_k") + top + 1).alias("id"))
    return seen.where("n is not null").select("name", "n", F.col("n").cast("long").alias("id")).unionAll(made)


# access and trash commands -----------------------------------------------------------------------

_COMMANDS = """select event_id % 200 as request_id, user_id as requester_id, (user_id * 7 + event_id) % 150 as user_id,
    (user_id + event_id % 5) % 25 as experiment_id, cast(case when event_id % 5 < 4 then event_id % 5 + 1 end as int) as privilege
    from {events} where event_id % 200 = user_id"""


@query("M4_change_access", f"""with cmd as ({_COMMANDS.format(events='events')}),
    su as (select id from archive_user where admin_mode and id in (select user_id from user_group where group_id = 1)),
    ok as (select request_id from cmd c join experiment x on x.id = c.experiment_id
       left join (select user_id, experiment_id, max(privilege) as p from access group by 1, 2) a on a.user_id = c.requester_id and a.experiment_id = c.experiment_id
       left join (select distinct research_group_id, user_id from group_role where role = 'pi') h on h.research_group_id = x.owner_id and h.user_id = c.user_id
       group by request_id having bool_and((coalesce(a.p >= 4, false) or c.requester_id in (select id from su)) and h.user_id is null)),
    last as (select user_id, experiment_id, arg_max(coalesce(privilege, -1), (request_id, coalesce(privilege, -1))) as p from cmd where request_id in (select request_id from ok) group by 1, 2)
    select user_id, experiment_id, privilege from access a where not exists (select 1 from last l where l.user_id = a.user_id and l.experiment_id = a.experiment_id)
    union all select user_id, experiment_id, p from last where p > 0""")
def _(tb):
    return state.change_access(tb.catalog, tb.sql(_COMMANDS)).access


_MOVES = """select user_id as request_id, (user_id * 3) % 150 as requester_id, user_id % 5 as research_group_id, user_id,
      case when floor(user_id / 5) % 4 = 0 then 'pis' when floor(user_id / 5) % 4 = 1 then 'admins' else 'members' end as src,
      case user_id % 4 when 0 then 'members' when 1 then 'admins' when 2 then 'others' else 'pis' end as dst, user_id % 3 = 0 as retroactive
    from (select distinct user_id from {events}) u"""


_MOVED_ROLES = f"""cmd as ({_MOVES.format(events='events')}),
    su as (select id from archive_user where admin_mode and id in (select user_id from user_group where group_id = 1)),
    rank as (select research_group_id, user_id, bool_or(role = 'pi') as pi from group_role where role in ('pi', 'manager') group by 1, 2),
    may as (select request_id, bool_and(c.requester_id in (select id from su) or (r.user_id is not null and (r.pi or (c.src <> 'pis' and c.dst <> 'pis')))) as may
        from cmd c left join rank r on r.research_group_id = c.research_group_id and r.user_id = c.requester_id group by 1),
    retro as (select c.*, x.id as experiment_id, case dst when 'pis' then 4 when 'admins' then 4 when 'members' then 2 end as privilege from cmd c join experiment x on x.owner_id = c.research_group_id where retroactive),
    heads as (select distinct research_group_id, user_id from group_role h where role = 'pi' and not exists (select 1 from retro r where r.src = 'pis' and r.user_id = h.user_id and r.research_group_id = h.research_group_id)
        union select research_group_id, user_id from retro where dst = 'pis'),
    managed as (select user_id, experiment_id, max(privilege) as p from access group by 1, 2),
    refused as (select distinct request_id from retro r left join managed a on a.user_id = r.requester_id and a.experiment_id = r.experiment_id
        where not (coalesce(a.p >= 4, false) or r.requester_id in (select id from su)) or exists (select 1 from heads h where h.user_id = r.user_id and h.research_group_id = r.research_group_id)),
    done as (select *, case src when 'pis' then 'pi' when 'admins' then 'manager' when 'members' then 'member' end as old, case dst when 'pis' then 'pi' when 'admins' then 'manager' when 'members' then 'member' end as new
        from cmd where request_id in (select request_id from may where may) and request_id not in (select request_id from refused)),
    roles as (select g.research_group_id, g.user_id, g.role from group_role g where not exists (select 1 from done d where d.research_group_id = g.research_group_id and d.user_id = g.user_id and g.role in (d.old, d.new))
        union all select distinct research_group_id, user_id, new from done where new is not null),
    last as (select user_id, experiment_id, arg_max(coalesce(privilege, 0), request_id) as p from retro where request_id in (select request_id from done) group by 1, 2),
    grants as (select user_id, experiment_id, privilege from access a where not exists (select 1 from last l where l.user_id = a.user_id and l.experiment_id = a.experiment_id)
        union all select user_id, experiment_id, p from last where p > 0)"""


@query("M5_roles_after", f"with {_MOVED_ROLES} select research_group_id, user_id, role from roles")
def _(tb):
    return state.change_membership(tb.catalog, tb.sql(_MOVES))[0].group_role.select("research_group_id", "user_id", "role")


@query("M5_access_after", f"with {_MOVED_ROLES} select user_id, experiment_id, privilege from grants")
def _(tb):
    return state.change_membership(tb.catalog, tb.sql(_MOVES))[0].access.select("user_id", "experiment_id", "privilege")


@query("M5_change_membership", f"""with {_MOVED_ROLES} select research_group_id || ' ' || role as what, count(*) as n from roles group by 1
    union all select case when request_id in (select request_id from done) then 'success true' else 'success false' end, count(*) from cmd group by 1
    union all select 'privilege ' || privilege, count(*) from grants group by 1""")
def _(tb):
    after, verdict = state.change_membership(tb.catalog, tb.sql(_MOVES))
    roles = after.group_role.groupBy("research_group_id", "role").agg(F.count(F.lit(1)).alias("n")).select(
        F.concat_ws(" ", "research_group_id", "role").alias("what"), "n")
    return roles.unionAll(verdict.groupBy("success").agg(F.count(F.lit(1)).alias("n")).select(
        F.concat(F.lit("success "), F.col("success").cast("string")).alias("what"), "n")).unionAll(
        after.access.groupBy("privilege").agg(F.count(F.lit(1)).alias("n")).select(
            F.concat(F.lit("privilege "), F.col("privilege").cast("string")).alias("what"), "n"))


_TRASH_ASKS = "select o_orderkey % 500 as request_id, o_orderkey % 500 % 150 as user_id, o_orderkey as id from {orders} where o_orderkey % 500 <= o_custkey % 40"


@query("M6_trash_decisions", f"""with cmd as ({_TRASH_ASKS.format(orders='orders')}),
    su as (select id from archive_user where admin_mode and id in (select user_id from user_group where group_id = 1)),
    j as (select c.*, s.trashtime, coalesce(a.p >= 3, false) or c.user_id in (select id from su) as ok from cmd c join session s on s.id = c.id join subject u on u.id = s.subject_id
      left join (select user_id, experiment_id, max(privilege) as p from access group by 1, 2) a on a.user_id = c.user_id and a.experiment_id = u.experiment_id)
    select request_id, id, case when not bool_and(ok) over (partition by request_id) then 'refused' when bool_or(trashtime is null) over (partition by request_id) then 'trash' else 'untrash' end as action from j""")
def _(tb):
    cmd = tb.sql(_TRASH_ASKS).withColumn("now", F.lit(_NOW).cast("timestamp_ntz"))
    return state.trash_decisions(tb.catalog, cmd, "session").select("request_id", "id", "action")


@query("M7_trash_cascade", f"""with hit as (select id from subject where id % 7 = 1), s as (select *, subject_id in (select id from hit) as h from session),
    e as (select e.id, e.trashtime, s.h from epoch e join s on e.session_id = s.id), d as (select d.id, d.trashtime, e.h from dataset d join e on d.container_id = e.id)
    select 'subject' as level, id, case when id in (select id from hit) then timestamp '{_NOW}' else trashtime end as trashtime from subject
    union all select 'session', id, case when h then timestamp '{_NOW}' else trashtime end from s union all select 'epoch', id, case when h then timestamp '{_NOW}' else trashtime end from e
    union all select 'dataset', id, case when h then timestamp '{_NOW}' else trashtime end from d""")
def _(tb):
    picked = tb.catalog.subject.where("id % 7 = 1").select("id", F.lit(_NOW).cast("timestamp_ntz").alias("now"))
    after = state.trash(tb.catalog, "subject", picked)
    parts = [after.frames[n].select(F.lit(n).alias("level"), "id", "trashtime") for n in ("subject", "session", "epoch", "dataset")]
    return parts[0].unionAll(parts[1]).unionAll(parts[2]).unionAll(parts[3])


@query("M8_untrash", """with hit as (select id from session where id % 9 = 4), up as (select distinct subject_id as id from session where id % 9 = 4),
    top as (select distinct experiment_id as id from subject where id in (select id from up)), e as (select id, case when session_id % 9 <> 4 then trashtime end as trashtime, session_id from epoch)
    select 'experiment' as level, id, case when id not in (select id from top) then trashtime end as trashtime from experiment
    union all select 'subject', id, case when id not in (select id from up) then trashtime end from subject
    union all select 'session', id, case when id % 9 <> 4 then trashtime end from session union all select 'epoch', id, trashtime from e
    union all select 'dataset', d.id, case when e.session_id % 9 <> 4 then d.trashtime end from dataset d join e on d.container_id = e.id""")
def _(tb):
    after = state.untrash(tb.catalog, "session", tb.catalog.session.where("id % 9 = 4").select("id"))
    out = None
    for n in ("experiment", "subject", "session", "epoch", "dataset"):
        part = after.frames[n].select(F.lit(n).alias("level"), "id", "trashtime")
        out = part if out is None else out.unionAll(part)
    return out


@query("M9_move_sessions", f"""with mv as (select s.id as session_id, cast((u.experiment_id + 1 + s.id % 2) % 25 as bigint) as t, u.id as sid, u.person_id, s.trashtime from session s join subject u on s.subject_id = u.id where s.id % 10 < 4),
    there as (select experiment_id as t, person_id, min(id) as found from subject group by 1, 2),
    l as (select mv.*, found from mv left join there using (t, person_id)),
    f as (select t, person_id, min(session_id) as s from l where found is null group by 1, 2),
    n as (select *, row_number() over (partition by t order by s) as n, row_number() over (order by t, s) as k from f),
    used as (select experiment_id as t, max(cast('0' || regexp_replace(code, '[^0-9]+', '', 'g') as bigint)) as u from subject group by 1)
    select s.id, coalesce(l.found, n.k + (select max(id) from subject), s.subject_id) as subject_id,
      case when n.k is not null then printf('s%03d', coalesce(used.u, 0) + n.n) else u.code end as code
    from session s left join l on l.session_id = s.id left join n on n.t = l.t and n.person_id = l.person_id and l.found is null
    left join used on used.t = n.t left join subject u on u.id = coalesce(l.found, s.subject_id)""")
def _(tb):
    c = tb.catalog
    moves = c.chain("session", "subject").where("session_id % 10 < 4").select(
        "session_id", F.expr("(experiment_id + 1 + session_id % 2) % 25").alias("experiment_id"))
    after = state.move_sessions(c, moves)
    return after.chain("session", "subject").select(F.col("session_id").alias("id"), "subject_id", F.col("subject_code").alias("code"))


@query("M10_mark_dirty", "select id, dirty or id in (select container_id from dataset where updatetime > timestamp '2001-01-01') as dirty from epoch")
def _(tb):
    return state.mark_dirty(tb.catalog.epoch, tb.catalog.dataset.where("updatetime > '2001-01-01'")).select("id", "dirty")


@query("M11_schedule_jobs", f"""with ch as (select id as cid from epoch where id % 3 <> 0), held as (select data_container_id as cid, min(id) as id from job where task = 'find&proc' group by 1)
    select id, status, needs_rerun or (id in (select id from held where cid in (select cid from ch)) and status <> 'pending') as needs_rerun, data_container_id from job
    union all select row_number() over (order by cid) + (select max(id) from job), 'pending', false, cid from ch where cid not in (select cid from held)""")
def _(tb):
    digests = tb.catalog.epoch.selectExpr("id as container_id", "cast(id % 3 as string) as old_digest", "'0' as new_digest",
                                          f"cast('{_NOW}' as timestamp_ntz) as now")
    return state.schedule_jobs(tb.catalog.job, digests).select("id", "status", "needs_rerun", "data_container_id")


@query("M12_relaunch_jobs", """select id, case when h then 'pending' else status end as status, case when h then 'reset to pending' else activity end as activity, needs_rerun and not h as needs_rerun
    from (select *, status not in ('running', 'abandoned') and needs_rerun as h from job)""")
def _(tb):
    return state.relaunch_jobs(tb.catalog.job).select("id", "status", "activity", "needs_rerun")


@query("M13_crash_reset", """select 'job' as what, id, case when status in ('running', 'failed') and task = 'find' then 'pending' else status end as state from job
    union all select 'epoch', id, case when dirty or scheduling then 'dirty' else 'clean' end from epoch""")
def _(tb):
    jobs = state.reset_jobs(tb.catalog.job, "find").select(F.lit("job").alias("what"), "id", F.col("status").alias("state"))
    epochs = state.reset_containers(tb.catalog.epoch)
    return jobs.unionAll(epochs.where("not scheduling").select(
        F.lit("epoch").alias("what"), "id", F.when(F.col("dirty"), "dirty").otherwise("clean").alias("state")))


@query("M14_qa_status", """select id, case when not (qa_status in ('pending', 'rerun') or num_bands = 1) then qa_status
      when not exists (select 1 from dataset d where d.container_id = e.id and d.filetype = 'nifti') then 'pending'
      when size_x = 96 and series = 3 then 'failed' when num_timepoints < 9 then 'abandoned' when series = 5 then 'rerun' else 'done' end as qa_status from epoch e""")
def _(tb):
    images = tb.catalog.dataset.where("filetype = 'nifti'").select(F.col("container_id").alias("id")).distinct().withColumn("img", F.lit(True))
    rows = tb.catalog.epoch.join(images, "id", "left")
    after = state.qa_status_after(F.col("qa_status"), F.col("num_bands") == 1, F.col("img").isNotNull(), F.col("num_timepoints"), 6,
                                  F.expr("size_x = 96 and series = 3"), F.when(F.col("series") == 5, "rerun").otherwise("running"))
    return rows.select("id", after.alias("qa_status"))


@query("M15_qa_sweep", """with r as (select id, container_id, id % 2 = 0 as there from dataset where filetype = 'json' and label = 'QA' and filenames <> ''),
      done as (select id from epoch where qa_status = 'done' and scan_type = 'functional')
    select 'epoch' as what, id, case when id in (select id from done) and id not in (select container_id from r where there) then 'rerun' else qa_status end as state from epoch
    union all select 'dataset', id, '' from dataset d where not (filetype = 'json' and label = 'QA' and container_id in (select id from done) and (filenames = '' or id % 2 = 1))""")
def _(tb):
    listing = tb.catalog.dataset.where("id % 2 = 0").select(F.col("id").alias("dataset_id"), F.explode("filenames").alias("filename"))
    epochs, datasets = state.qa_sweep(tb.catalog.epoch, tb.catalog.dataset, listing, "functional")
    return epochs.select(F.lit("epoch").alias("what"), "id", F.col("qa_status").alias("state")).unionAll(
        datasets.select(F.lit("dataset").alias("what"), "id", F.lit("").alias("state")))


@query("M16_clear_outputs", "select id, kind from dataset where not (kind in ('derived', 'web', 'qa') and container_id in (select id from epoch where dirty))")
def _(tb):
    return state.clear_outputs(tb.catalog.dataset, tb.catalog.epoch.where("dirty")).select("id", "kind")


@query("M17_edits", """select id, case when id % 3 = 0 then 'note ' || id else notes end as notes, case when id % 6 = 0 then id % 11 else operator_id end as operator_id from session""")
def _(tb):
    edits = tb.catalog.session.where("id % 3 = 0").selectExpr(
        "id", "concat('note ', id) as notes", "case when id % 6 = 0 then id % 11 end as operator_id")
    return state.apply_edits(tb.catalog.session, edits).select("id", "notes", "operator_id")


@query("M17_experiment_edits", "select x.id as id, case when x.id % 2 = 0 then 'renamed_' || x.id else x.name end as name, case when x.id % 2 = 0 then 2 else x.owner_id end as owner_id from experiment x")
def _(tb):
    edits = tb.catalog.experiment.where("id % 2 = 0").selectExpr("id", "concat('Renamed_', id) as name", "'asia' as owner_gid")
    return state.edit_experiments(tb.catalog.experiment, edits, tb.catalog.research_group).select("id", "name", "owner_id")


@query("M18_merge_archives", """select id as key, case when id % 3 = 0 then filenames when id % 3 = 1 then 'new.tgz' else case when filenames = '' then 'new.tgz' else filenames || ', new.tgz' end end as files,
    case when id % 3 = 0 then 'keep' when id % 3 = 1 then 'replace' else 'merge' end as action from dataset""")
def _(tb):
    stored = tb.catalog.dataset.select(F.col("id").alias("key"), (F.col("id") % 3).cast("string").alias("digest"), F.col("filenames").alias("files"))
    incoming = tb.catalog.dataset.where("id % 3 <> 0").select(
        F.col("id").alias("key"), F.when(F.col("id") % 3 == 1, "1").when(F.col("id") % 6 == 2, "9").alias("digest"),
        F.array(F.lit("new.tgz")).alias("files"))
    return state.merge_archives(stored, incoming).select("key", F.array_join("files", ", ").alias("files"), "action")


def _registrations(tb):
    cmd = tb.base("part").selectExpr(
        "p_partkey as request_id", "case when p_partkey % 2 = 0 then p_partkey * 64 + 8 end as dataset_id", "cast(p_partkey as int) as exam",
        "1 as series", "1 as acq", "'nifti' as filetype", "cast(null as string) as label", "p_partkey % 7 = 0 as force",
        "array(case when p_partkey % 5 = 0 then 'absent.nii' when p_partkey % 3 = 0 then 'scan.nii.gz' else concat('f', p_partkey) end) as names")
    listing = tb.base("part").selectExpr("concat('f', p_partkey) as name").unionAll(
        tb.base("part").selectExpr("'scan.nii.gz' as name").distinct())
    return cmd, listing


@query("S19_register_files", f"""with cmd as (select p_partkey as request_id, case when p_partkey % 2 = 0 then p_partkey * 64 + 8 end as dataset_id, cast(p_partkey as int) as exam, 1 as series, 1 as acq from part),
     pl as (select s.exam, e.series, e.acq, min(e.id) as id from epoch e join session s on e.session_id = s.id group by 1, 2, 3)
    select request_id, case when dataset_id is null then case when pl.id is null then 'no epoch' else 'created' end
       when d.id is null then 'no dataset' when request_id % 5 = 0 then 'missing file' when request_id % 3 = 0 and contains(d.filenames, 'scan.nii.gz') and request_id % 7 <> 0 then 'name conflict' else 'added' end as outcome
    from cmd left join dataset d on d.id = cmd.dataset_id left join pl on pl.exam = cmd.exam and pl.series = cmd.series and pl.acq = cmd.acq""")
def _(tb):
    return state.register_files(tb.catalog, *_registrations(tb))[1]


@query("S19_registered_datasets", """with cmd as (select p_partkey as request_id, case when p_partkey % 2 = 0 then p_partkey * 64 + 8 end as dataset_id, cast(p_partkey as int) as exam,
        case when p_partkey % 5 = 0 then null when p_partkey % 3 = 0 then 'scan.nii.gz' else 'f' || p_partkey end as name from part),
    pl as (select s.exam, min(e.id) as id from epoch e join session s on e.session_id = s.id where e.series = 1 and e.acq = 1 group by 1)
    select d.id as id, d.container_id as container_id, d.kind as kind, d.filetype as filetype, d.label as label,
      case when c.name is null or list_contains(string_split(d.filenames, ', '), c.name) then d.filenames when d.filenames = '' then c.name else d.filenames || ', ' || c.name end as files
    from dataset d left join cmd c on c.dataset_id = d.id
    union all select (select max(id) from dataset) + row_number() over (order by request_id), pl.id, 'derived', 'nifti', 'NIfTI', coalesce(name, '') from cmd join pl using (exam) where dataset_id is null""")
def _(tb):
    """The whole dataset table after the registrations: grown, created and untouched rows."""
    return state.register_files(tb.catalog, *_registrations(tb))[0].select(
        "id", "container_id", "kind", "filetype", "label", F.array_join("filenames", ", ").alias("files"))


# names -------------------------------------------------------------------------------------------

@query("X1_clean_string", r"select doc_id, trim(regexp_replace(regexp_replace(text, '[^A-Za-z0-9 _-]', '', 'g'), '[ _-]+', '_', 'g'), '_') as cleaned from documents")
def _(tb):
    return tb.base("documents").select("doc_id", text.clean_string("text").alias("cleaned"))


@query("X2_patient_id", """select arrival_seq, case when contains(ltrim(patient_id, '@'), '@') then split_part(ltrim(patient_id, '@'), '@', 1) else '' end as code,
    split_part(regexp_replace(ltrim(patient_id, '@'), '^.*@', ''), '/', 1) as lab, case when contains(patient_id, '/') then split_part(patient_id, '/', 2) else 'untitled' end as exp from scan_record""")
def _(tb):
    return tb.view("scan_record").select("arrival_seq", text.patient_id_parts("patient_id").alias("p")).select(
        "arrival_seq", F.col("p.subj_code").alias("code"), F.col("p.lab_id").alias("lab"), F.col("p.exp_id").alias("exp"))


@query("X3_parse_subject", """select c_custkey, 'Building' as f, case when c_custkey % 5 = 0 then null when c_custkey % 7 = 0 then null else date '1900-01-01' + cast(c_custkey % 28 as int) end as dob,
    upper(substr(c_mktsegment, 1, 1)) || lower(substr(c_mktsegment, 2)) as l from customer""")
def _(tb):
    rows = tb.base("customer").selectExpr(
        "c_custkey", "concat(c_mktsegment, '^', 'bUILDING') as name",
        "case when c_custkey % 5 = 0 then '1899' || '1231' when c_custkey % 7 = 0 then '19001399' else date_format(date_add(date '1900-01-01', cast(c_custkey % 28 as int)), 'yyyyMMdd') end as dob")
    return rows.select("c_custkey", text.parse_subject("name", "dob").alias("p")).select(
        "c_custkey", F.col("p.firstname").alias("f"), F.col("p.lastname").alias("l"), F.col("p.dob").alias("dob"))


@query("X4_pack_uid", "select id, uid, lower(translate(uid, '0123456789.', '123456789ab')) || case when length(uid) % 2 = 1 then '0' else '' end as packed from session")
def _(tb):
    packed = text.pack_uid("uid")
    return tb.catalog.session.select("id", text.unpack_uid(packed).alias("uid"), F.lower(F.hex(packed)).alias("packed"))


@query("X5_human_size", """select o_orderkey, case when b < 1000 then printf('%3dB', b) when b / 1024.0 < 10 then printf('%3.1fK', b / 1024.0) when b / 1024.0 < 1000 then printf('%3.0fK', b / 1024.0)
    when b / 1048576.0 < 10 then printf('%3.1fM', b / 1048576.0) else printf('%3.0fM', b / 1048576.0) end as size from (select o_orderkey, cast(floor(o_totalprice * (o_orderkey % 1000)) as bigint) as b from orders)""")
def _(tb):
    rows = tb.base("orders").selectExpr("o_orderkey", "cast(floor(o_totalprice * (o_orderkey % 1000)) as bigint) as b")
    return rows.select("o_orderkey", text.human_size("b").alias("size"))


@query("X6_session_names", "select id, strftime(timestamp, '%Y%m%d_%H%M') || '_' || exam as name, strftime(timestamp, '%Y%m%d_%H%M') as dir, strftime(timestamp, '%Y%m%d') || '_' || exam as legacy from session")
def _(tb):
    return tb.catalog.session.select("id", names.session_name("timestamp", "exam").alias("name"), names.session_dirname("timestamp").alias("dir"),
                                     names.session_legacy_dirname("timestamp", "exam").alias("legacy"))


@query("X7_epoch_names", """select e.id as id, exam || '_' || series || case when acq is null then '' else '_' || acq end as name, series || case when acq is null then '' else '_' || acq end || '_' || description as dir
    from epoch e join session s on e.session_id = s.id""")
def _(tb):
    return tb.catalog.chain("epoch", "session").select(
        F.col("epoch_id").alias("id"), names.epoch_name("session_exam", "epoch_series", "epoch_acq").alias("name"),
        names.epoch_dirname("epoch_series", "epoch_acq", "epoch_description").alias("dir"))


@query("X8_dataset_relpath", "select id, case when archived then 'archive' else 'current' end || printf('/%03d/%08d', id % 1000, id) as relpath from dataset")
def _(tb):
    return tb.catalog.dataset.select("id", names.dataset_relpath("id", "archived").alias("relpath"))


@query("X9_primary_file", r"""select id, case when len(fs) <= 1 then fs[1] when filetype = 'json' then fs[1] else list_filter(fs, lambda f: case filetype
      when 'pfile' then regexp_matches(f, '^P.....\.7\.gz$') when 'dicom' then f like '%\_dicoms.tgz' escape '\' when 'nifti' then f like '%.nii.gz' when 'bitmap' then f like '%.png'
      when 'img_pyr' then f like '%.pyrdb' else f like '%.physio.tgz' end)[1] end as file
    from (select id, filetype, case when filenames = '' then [] else string_split(filenames, ', ') end as fs from dataset)""")
def _(tb):
    return tb.catalog.dataset.select("id", names.primary_file("filenames", "filetype").alias("file"))


@query("X10_legacy_filename", r"""select e.id as id, printf('%04d_%02d_', series, coalesce(acq, 0)) || description || '_physio.tgz' as a, printf('%04d_%02d_', series, coalesce(acq, 0)) || description || '.nii.gz' as b from epoch e""")
def _(tb):
    rows = tb.catalog.epoch.select("id", "series", "acq", "description", F.lit("12_3_physio.tgz").alias("f"), F.lit("12_3.nii.gz").alias("g"))
    return rows.select("id", names.legacy_filename("f", "series", "acq", "description").alias("a"),
                       names.legacy_filename("g", "series", "acq", "description").alias("b"))


@query("X11_flat_display_name", r"""select id, f as file, printf('%04d_%02d_', s, 0) || 'x' || substr(f, 1 + greatest(0, p - 1)) as name from (
      select p_partkey as id, p_size as s, p_name || '.a' as a, p_name || '_' || p_brand || '.b' as b, length(p_name) as p from part) q, lateral (select unnest([a, b]) as f) z""")
def _(tb):
    rows = tb.base("part").selectExpr("p_partkey as id", "p_size as s", "array(p_name || '.a', p_name || '_' || p_brand || '.b') as fs")
    return rows.withColumn("file", F.explode("fs")).select(
        "id", "file", names.flat_display_name("file", "fs", "s", F.lit(None).cast("int"), F.lit("x")).alias("name"))


@query("X12_download_dir", "select x.id as id, 'archive/' || g.gid || '/' || x.name || '/s' as path from experiment x join research_group g on x.owner_id = g.id")
def _(tb):
    return tb.catalog.chain("experiment", "research_group").select(
        F.col("experiment_id").alias("id"), names.download_dir("archive", "research_group_gid", "experiment_name", F.lit("s")).alias("path"))


@query("X13_staged_name", "select page_id, array_to_string(list_reverse(list_reverse(string_split(n, '_'))[1:4]), '_') as name from (select page_id, replace(replace(url, '/', '_'), '.', '_') as n from pages)")
def _(tb):
    rows = tb.base("pages").select("page_id", F.translate("url", "/.", "__").alias("n"))
    return rows.select("page_id", text.staged_name("n").alias("name"))


@query("X14_screenshots", "select arrival_seq, case when is_screenshot then 0 else acq_no end as acq, case when is_screenshot then date_trunc('day', timestamp) + interval 86399 second else timestamp end as timestamp from scan_record")
def _(tb):
    r = tb.view("scan_record")
    return r.select("arrival_seq", F.when(F.col("is_screenshot"), 0).otherwise(F.col("acq_no")).alias("acq"),
                    F.when(F.col("is_screenshot"), names.end_of_day("timestamp")).otherwise(F.col("timestamp")).alias("timestamp"))


@query("X15_recon_type", r"select id, case when lower(description) like '%\_ssg' escape '\' or lower(description) like '%\_sbref' escape '\' then 'split-slice-grappa_sense1' when lower(description) like '%sense1%' then '1Dgrappa_sense1' end as recon from epoch")
def _(tb):
    return tb.catalog.epoch.select("id", names.recon_type("description").alias("recon"))


@query("X16_physio_file_time", "select o_orderkey, o_orderdate + interval '1' second * (o_orderkey % 86400) + interval 120 millisecond as ts, 'mux_' || (o_orderkey % 3) as psd from orders")
def _(tb):
    rows = tb.sql("select o_orderkey, concat('PPGTrig_mux_', o_orderkey % 3, '_', date_format(o_orderdate + interval '1' second * (o_orderkey % 86400), 'MMddyyyyHH_mm_ss'), '_12') as name from {orders}")
    return rows.select("o_orderkey", text.physio_file_time("name").alias("ts"), text.physio_file_psd("name").alias("psd"))


@query("X17_bracket_list", "select id, list_sum(string_split(trim(fov, '[]'), ', ')::double[]) as total, len(string_split(fov, ', ')) as n from epoch")
def _(tb):
    values = text.bracket_list("fov")
    return tb.catalog.epoch.select("id", F.aggregate(values, F.lit(0.0), lambda a, v: a + v).alias("total"), F.size(values).cast("long").alias("n"))


@query("X18_phase_encode", "select p_partkey, case when p_size % 2 = 1 then 1 else -1 end as direction, round((p_size / 100.0)::double * 64 / 1000.0::double, 9) as readout from part")
def _(tb):
    rows = tb.base("part").selectExpr("p_partkey", "concat('te=30.00;ti=0;fa=77;ec=', p_size / 100.0, ';pe=', p_size % 2, ';x') as d")
    return rows.select("p_partkey", text.phase_direction("d").alias("direction"), F.round(text.readout_time("d", F.lit(64)), 9).alias("readout"))


@query("X19_display_names", """select uid, case when firstname is not null and lastname is not null then lastname || ', ' || firstname else lastname end as listed,
    case when firstname is not null and lastname is not null then firstname || ' ' || lastname else uid end as shown from archive_user""")
def _(tb):
    return tb.catalog.user.select("uid", names.list_name("firstname", "lastname").alias("listed"),
                                  names.display_name("firstname", "lastname", "uid").alias("shown"))


@query("X20_privilege_names", "select user_id, experiment_id, case privilege when 1 then 'Anon-Read' when 2 then 'Read-Only' when 3 then 'Read-Write' when 4 then 'Manage' end as name, privilege as value from access")
def _(tb):
    named = tb.catalog.access.withColumn("name", names.privilege_name("privilege"))
    return named.select("user_id", "experiment_id", "name", names.privilege_value("name").alias("value"))


@query("X21_default_labels", "select id, label, replace(label, ' ', '_') as name from dataset")
def _(tb):
    d = tb.catalog.dataset.select("id", names.default_label("filetype").alias("label"))
    return d.select("id", "label", names.dataset_name("label").alias("name"))


@query("X22_slice_color", "select p_partkey, '#10' || lower(to_hex(i * cast(floor(239 / greatest(n - 1, 1)) as int) + 16)) || lower(to_hex(255 - i * cast(floor(239 / greatest(n - 1, 1)) as int))) as color from (select p_partkey, cast(p_partkey % p_size as int) as i, p_size as n from part)")
def _(tb):
    return tb.base("part").selectExpr("p_partkey", "cast(p_partkey % p_size as int) as i", "p_size as n").select(
        "p_partkey", names.slice_color("i", "n").alias("color"))


@query("X23_rename_files", """select id, replace(filenames, 'qa_report.', id || '_qa.') as renamed,
    array_to_string(list_transform(case when filenames = '' then [] else string_split(filenames, ', ') end, lambda f: split_part(f, '.', 1) || '_ssg.' || substr(f, length(split_part(f, '.', 1)) + 2)), ', ') as infix from dataset""")
def _(tb):
    d = tb.catalog.dataset
    return d.select("id", F.array_join(names.rename_qa_files("filenames", F.col("id").cast("string")), ", ").alias("renamed"),
                    F.array_join(names.infix_rename("filenames", "_ssg"), ", ").alias("infix"))


@query("X24_routes", "select id, case when contains(filenames, 'gephysio') then 'physio' when contains(filenames, 'pfile') then 'pfile' else 'other' end as staged, case when filetype in ('dicom', 'pfile') then filetype end as pipeline from dataset")
def _(tb):
    d = tb.catalog.dataset
    return d.select("id", names.staged_route(F.array_join("filenames", ", ")).alias("staged"), names.pipeline_route("filetype").alias("pipeline"))
