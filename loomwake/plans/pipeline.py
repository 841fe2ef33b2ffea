"""Queries of the general data problems: rolling totals, attributes at event time, orphans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwake.functions.keys import ident, minute_text, month_text
from loomwake.operators.asof import known_at
from loomwake.operators.references import ALWAYS, unresolved
from loomwake.operators.rolling import rolling_totals
from loomwake.session import cut, table


def _rolling(spark: SparkSession, d: str) -> DataFrame:
    days = table(spark, d, "daily_notification_summary").withColumn("user_id", ident("user_id"))
    return rolling_totals(days, "user_id", "date", ["notifications_sent", "notifications_dismissed"], (7, 30), "received_at")


def p2_rolling(spark: SparkSession, d: str) -> DataFrame:
    """Every user and calendar day with its 7- and 30-day totals and averages."""
    return _rolling(spark, d).withColumn("day", F.date_format("date", "yyyy-MM-dd")).drop("date")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Days on which the last week runs at twice the month's rate and half of it was dismissed.

    The averages are compared through their integer totals, so no rounding decides a tie.
    """
    s7, s30, d7 = F.col("notifications_sent_sum_7"), F.col("notifications_sent_sum_30"), F.col("notifications_dismissed_sum_7")
    rows = _rolling(spark, d).where((F.col("nth_day") >= 30) & (s7 > 0) & (s7 * 30 >= s30 * 14) & (d7 * 2 >= s7) & F.col("user_id").isNotNull())
    return rows.select("user_id", F.date_format("date", "yyyy-MM-dd").alias("day"))


GROUP, OPT_OUT = "group_membership", "promotion_opt_out"


def _attributes_known(spark: SparkSession, d: str) -> DataFrame:
    """Each message with the membership in its group and the opt-out from its business in force at its time.

    Both attributes go together: an entity is a user with a group or a business, and a message is
    an event of each entity it names, so messages aren't read and shuffled for each attribute.
    """
    of = lambda kind, c: F.struct(F.lit(kind).alias("attribute"), ident(c).alias("entity"))
    m = table(spark, d, "messages").select(ident("message_id").alias("message_id"), ident("user_id").alias("user_id"), "created_at", F.explode(F.array(of(GROUP, "group_id"), of(OPT_OUT, "business_id"))).alias("x"))
    events = m.select("message_id", "user_id", "created_at", "x.attribute", "x.entity").where("entity is not null")
    changed = lambda t, kind, c, at, role: table(spark, d, t).select(ident("user_id").alias("user_id"), F.lit(kind).alias("attribute"), ident(c).alias("entity"), F.col(at).alias("at"), role.alias("role"))
    g = changed("group_members", GROUP, "group_id", "joined_at", F.col("role"))
    b = changed("user_business_history", OPT_OUT, "business_id", "promotions_opted_out_at", F.lit(None).cast("string"))
    return known_at(events, g.unionByName(b), ["user_id", "attribute", "entity"], "created_at", "at", ["message_id"], ["role"])


def _valid_from():
    return F.when(F.col("known_since").isNull(), "none").otherwise(minute_text("known_since"))


def p5_known(spark: SparkSession, d: str) -> DataFrame:
    """Each message with the membership and the opt-out in force at its time; once per message."""
    value = F.when(F.col("known_since").isNull(), "none").when(F.col("attribute") == GROUP, F.coalesce("role", F.lit("none"))).otherwise("opted_out")
    return _attributes_known(spark, d).select("message_id", "attribute", _valid_from().alias("valid_from"), value.alias("value")).distinct()


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Messages whose entity has a later attribute that a join to the latest values would leak."""
    late = _attributes_known(spark, d).where((F.col("latest_change") > F.col("created_at")) & F.col("message_id").isNotNull())
    return late.select("message_id", "attribute", F.when(F.col("attribute") == GROUP, _valid_from()).otherwise("none").alias("valid_from")).distinct()


#: What parts evidence ids in a list.
SEPARATORS = r"[;,|\s]+"


def _references(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Referring rows (one per record, field and key), their month and times, and the parents."""
    m = table(spark, d, "messages").select(ident("message_id").alias("message_id"), ident("business_id").alias("business_id"), ident("media_type").alias("media_type"), ident("media_id").alias("media_id"), "created_at", "received_at")
    first = [F.min("created_at").alias("created_at"), F.min("received_at").alias("received_at")]
    ref = lambda df, field, domain, record, key: df.select(F.lit(field).alias("relation"), F.lit(domain).alias("domain"), F.col(record).alias("record_id"), key.alias("key"), "created_at", "received_at")
    of_business = ref(m.where("business_id is not null").groupBy("message_id", "business_id").agg(*first), "messages.business_id", "business", "message_id", F.col("business_id"))
    of_media = ref(m.where("media_id is not null").groupBy("message_id", "media_type", "media_id").agg(*first), "messages.media_id", "media", "message_id", F.concat_ws(":", F.coalesce("media_type", F.lit("")), "media_id"))
    e = table(spark, d, "message_events").select(ident("user_id").alias("user_id"), ident("message_id").alias("message_id"), F.lit(None).cast("timestamp_ntz").alias("created_at"), "received_at")
    of_events = ref(e.where("message_id is not null").groupBy("user_id", "message_id").agg(*first), "message_events.message_id", "message", "user_id", F.col("message_id"))
    ids = F.split(F.coalesce("evidence_message_ids", F.lit("")), SEPARATORS)
    o = table(spark, d, "router_output").select(ident("message_id").alias("message_id"), F.explode(ids).alias("evidence"))
    o = o.select("message_id", ident("evidence").alias("evidence")).where("evidence is not null and evidence <> 'none'").distinct()
    when = m.groupBy("message_id").agg(*first)
    of_output = ref(o.join(when, "message_id", "left"), "router_output.evidence_message_ids", "message", "message_id", F.col("evidence"))
    refs = of_business.unionByName(of_media).unionByName(of_events).unionByName(of_output)
    refs = refs.withColumn("period", F.when(F.col("relation") == "message_events.message_id", month_text("received_at")).otherwise(month_text("created_at")))
    never = F.lit(None).cast("timestamp_ntz")
    b = table(spark, d, "business_accounts").select(F.lit("business").alias("domain"), ident("business_id").alias("key"), F.lit(ALWAYS).cast("timestamp_ntz").alias("received"), never.alias("deleted"))
    f = table(spark, d, "media_files").select(F.lit("media").alias("domain"), F.concat_ws(":", F.coalesce(ident("media_type"), F.lit("")), ident("media_id")).alias("key"), F.col("received_at").alias("received"), F.col("deleted_at").alias("deleted"))
    p = m.select(F.lit("message").alias("domain"), F.col("message_id").alias("key"), F.col("received_at").alias("received"), never.alias("deleted"))
    return refs, p.unionByName(f).unionByName(b)


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    """References to missing, deleted or late records, per referring field and month.

    The bitmaps are built per month of the earlier of creation and receipt, so that a parent
    received before that month and never deleted settles the reference; what survives them is
    compared by its exact times.
    """
    refs, parents = _references(spark, d)
    refs = cut(refs).withColumn("since", month_text(F.least("created_at", "received_at")))
    left = unresolved(refs.drop("period").withColumnRenamed("since", "period"), parents).withColumnRenamed("period", "since")
    rows = refs.join(left, ["domain", "relation", "key", "since"])
    timed = F.col("relation").isin("messages.media_id", "message_events.message_id")
    status = F.when(~F.col("parent_exists"), "missing").when((F.col("domain") == "media") & (F.col("parent_deleted") <= F.col("created_at")), "deleted").when(timed & (F.col("parent_received") > F.col("received_at")), "late")
    out = rows.withColumn("status", status).where("status is not null")
    key = F.when(F.col("domain") == "media", F.element_at(F.split("key", ":", 2), 2)).otherwise(F.col("key"))
    return out.select(F.col("relation").alias("ref_field"), "record_id", key.alias("missing_id"), "period", "status").distinct()


def p7_report(spark: SparkSession, d: str) -> DataFrame:
    """Orphan references per field, month and status."""
    return p7_found(spark, d).groupBy("ref_field", "period", "status").agg(F.count("*").alias("n_references"), F.countDistinct("missing_id").alias("n_missing_ids"))


QUERIES = {"p2_found": p2_found, "p2_rolling": p2_rolling, "p5_found": p5_found, "p5_known": p5_known, "p7_found": p7_found, "p7_report": p7_report}

_ID = "nullif(lower(trim({0}, ' ' || chr(9) || chr(10) || chr(13) || chr(160))), '')"


def _id(c: str) -> str:
    return _ID.format(c)


_DAYS = f"""
with v as (select {_id("user_id")} as user_id, date, notifications_sent as sent, notifications_dismissed as dismissed,
                  row_number() over (partition by {_id("user_id")}, date order by received_at desc nulls last, notifications_sent desc, notifications_dismissed desc) as r
           from daily_notification_summary where date is not null),
one as (select * from v where r = 1),
span as (select user_id, min(date) as lo, max(date) as hi from one group by 1),
cal as (select user_id, unnest(generate_series(lo, hi, interval 1 day))::date as date, lo from span),
dense as (select c.user_id, c.date, date_diff('day', c.lo, c.date) + 1 as nth_day, coalesce(o.sent, 0)::bigint as sent, coalesce(o.dismissed, 0)::bigint as dismissed
          from cal c left join one o on o.user_id is not distinct from c.user_id and o.date = c.date),
roll as (select *, sum(sent) over w7 as s7, sum(sent) over w30 as s30, sum(dismissed) over w7 as d7, sum(dismissed) over w30 as d30 from dense
         window w7 as (partition by user_id order by date rows between 6 preceding and current row),
                w30 as (partition by user_id order by date rows between 29 preceding and current row))
"""

_OPEN = f"""
with m as (select {_id("message_id")} as message_id, {_id("user_id")} as user_id, {_id("group_id")} as group_id, {_id("business_id")} as business_id, created_at from messages where created_at is not null),
g as (select {_id("user_id")} as user_id, {_id("group_id")} as group_id, joined_at, role from group_members where joined_at is not null),
b as (select {_id("user_id")} as user_id, {_id("business_id")} as business_id, promotions_opted_out_at as t from user_business_history where promotions_opted_out_at is not null)
"""

_PARENT = f"""
m as (select {_id("message_id")} as message_id, {_id("business_id")} as business_id, coalesce({_id("media_type")}, '') as media_type, {_id("media_id")} as media_id, created_at, received_at from messages),
pm as (select message_id, min(received_at) as first, min(created_at) as created_at from m group by 1),
pf as (select coalesce({_id("media_type")}, '') as media_type, {_id("media_id")} as media_id, min(received_at) as first, min(deleted_at) as deleted from media_files group by 1, 2),
rb as (select message_id, business_id, min(created_at) as created_at from m where business_id is not null group by 1, 2),
rf as (select message_id, media_type, media_id, min(created_at) as created_at, min(received_at) as received_at from m where media_id is not null group by 1, 2, 3),
re as (select {_id("user_id")} as user_id, {_id("message_id")} as message_id, min(received_at) as received_at from message_events group by 1, 2),
ro as (select distinct {_id("message_id")} as message_id, {_id("e")} as key from (select message_id, unnest(regexp_split_to_array(coalesce(evidence_message_ids, ''), '[;,|\\s]+')) as e from router_output))
"""

_FOUND7 = f"""
with {_PARENT},
u as (
select 'messages.business_id' as ref_field, r.message_id as record_id, r.business_id as missing_id, coalesce(strftime(r.created_at, '%Y-%m'), 'unknown') as period, 'missing' as status
from rb r where not exists (select 1 from business_accounts b where {_id("b.business_id")} = r.business_id)
union all
select 'messages.media_id', r.message_id, r.media_id, coalesce(strftime(r.created_at, '%Y-%m'), 'unknown'),
       case when p.media_id is null then 'missing' when p.deleted <= r.created_at then 'deleted' when p.first > r.received_at then 'late' end
from rf r left join pf p on p.media_type = r.media_type and p.media_id = r.media_id
union all
select 'message_events.message_id', r.user_id, r.message_id, coalesce(strftime(r.received_at, '%Y-%m'), 'unknown'),
       case when p.message_id is null then 'missing' when p.first > r.received_at then 'late' end
from re r left join pm p on p.message_id = r.message_id where r.message_id is not null
union all
select 'router_output.evidence_message_ids', r.message_id, r.key, coalesce(strftime(q.created_at, '%Y-%m'), 'unknown'), case when p.message_id is null then 'missing' end
from ro r left join pm p on p.message_id = r.key left join pm q on q.message_id = r.message_id where r.key is not null and r.key <> 'none'),
found as (select distinct * from u where status is not null)
"""

ORACLES = {
    "p2_found": _DAYS + "select user_id, strftime(date, '%Y-%m-%d') as day from roll where nth_day >= 30 and s7 > 0 and s7 * 30 >= s30 * 14 and d7 * 2 >= s7 and user_id is not null",
    "p2_rolling": _DAYS
    + """select user_id, nth_day::int as nth_day, sent as notifications_sent, s7::bigint as notifications_sent_sum_7, s7 / 7.0::double as notifications_sent_avg_7,
    s30::bigint as notifications_sent_sum_30, s30 / 30.0::double as notifications_sent_avg_30, dismissed as notifications_dismissed, d7::bigint as notifications_dismissed_sum_7,
    d7 / 7.0::double as notifications_dismissed_avg_7, d30::bigint as notifications_dismissed_sum_30, d30 / 30.0::double as notifications_dismissed_avg_30, strftime(date, '%Y-%m-%d') as day from roll""",
    "p5_found": _OPEN
    + """select distinct message_id, attribute, valid_from from (
    select m.message_id, m.created_at, 'group_membership' as attribute, coalesce(strftime(max(g.joined_at) filter (g.joined_at <= m.created_at), '%Y-%m-%d %H:%M'), 'none') as valid_from, max(g.joined_at) as latest
    from m join g on g.user_id = m.user_id and g.group_id = m.group_id group by 1, 2, m.user_id, m.group_id
    union all select m.message_id, m.created_at, 'promotion_opt_out', 'none', max(b.t) from m join b on b.user_id = m.user_id and b.business_id = m.business_id group by 1, 2, m.user_id, m.business_id)
    where latest > created_at and message_id is not null""",
    "p5_known": _OPEN
    + """, gk as (select m.message_id, m.created_at, m.user_id, m.group_id, max(g.joined_at) as since, max((g.joined_at, g.role)) as best
    from m left join g on g.user_id = m.user_id and g.group_id = m.group_id and g.joined_at <= m.created_at where m.user_id is not null and m.group_id is not null group by 1, 2, 3, 4)
    select distinct message_id, 'group_membership' as attribute, coalesce(strftime(since, '%Y-%m-%d %H:%M'), 'none') as valid_from,
      coalesce((select max(role) from g where g.user_id = gk.user_id and g.group_id = gk.group_id and g.joined_at = gk.since), 'none') as value from gk
    union select distinct m.message_id, 'promotion_opt_out', coalesce(strftime(max(b.t), '%Y-%m-%d %H:%M'), 'none'), case when max(b.t) is null then 'none' else 'opted_out' end
    from m left join b on b.user_id = m.user_id and b.business_id = m.business_id and b.t <= m.created_at where m.user_id is not null and m.business_id is not null group by m.message_id, m.created_at, m.user_id, m.business_id""",
    "p7_found": _FOUND7 + "select * from found",
    "p7_report": _FOUND7 + "select ref_field, period, status, count(*) as n_references, count(distinct missing_id) as n_missing_ids from found group by 1, 2, 3",
}
