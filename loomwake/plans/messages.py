"""Queries of message triage: texts, links, context, evidence, audits, evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwake.functions import text as X
from loomwake.functions.keys import ident
from loomwake.functions.cues import cue_counts
from loomwake.functions.patterns import CUES, SHORTENERS, STOP_WORDS
from loomwake.operators import context, enrich, evaluate, quality, ranking, retrieval
from loomwake.operators.asof import known_at
from loomwake.plans.sqlforms import ascii_pattern, ascii_words, normal_form, quoted
from loomwake.session import cut, table
from loomwake.sources import media

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], ORACLES[f.__name__] = f, sql
        return f

    return add


def _id(c: str) -> str:
    return f"nullif(lower(trim({c}, ' ' || chr(9) || chr(10) || chr(13) || chr(160))), '')"


_IDS = ("message_id", "user_id", "group_id", "business_id", "sender_user_id", "media_id")
_REST = ("conversation_type", "created_at", "message_text", "media_type", "forwarded_count", "received_at")


_KEYED = {"group": "group_id", "business": "business_id", "personal": "sender_user_id"}


def messages(spark: SparkSession, d: str, *want: str) -> DataFrame:
    """Each message once: of its first delivery the columns wanted (all without any), of equal ones the least.

    Only these are read and shuffled; ``conversation`` is made from the columns it needs.
    """
    want = want or (*_IDS, *_REST, "conversation")
    need = [c for c in (*_IDS, *_REST) if c in want and c not in ("message_id", "received_at") or "conversation" in want and c in (*_KEYED.values(), "conversation_type")]
    m = table(spark, d, "messages").select(*[ident(c).alias(c) if c in _IDS else c for c in ("message_id", "received_at", *need)])
    m = m.where("message_id is not null").groupBy("message_id").agg(F.min(F.struct("received_at", *need)).alias("x")).select("message_id", "x.*")
    if "conversation" in want:
        key = F.coalesce(*[F.when(F.col("conversation_type") == k, F.col(v)) for k, v in _KEYED.items()], "group_id", "business_id", "sender_user_id")
        m = m.withColumn("conversation", key)
    return m.select("message_id", *[c for c in want if c != "message_id"])


_M = f"""m as (select * exclude (r), coalesce(case conversation_type when 'group' then group_id when 'business' then business_id when 'personal' then sender_user_id end, group_id, business_id, sender_user_id) as conversation from (
  select {", ".join(f"{_id(c)} as {c}" for c in _IDS)}, {", ".join(_REST)},
    row_number() over (partition by {_id("message_id")} order by received_at, {_id("user_id")} nulls first, message_text) as r from messages where {_id("message_id")} is not null) where r = 1)"""


def _output_rows(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "router_output").select(ident("message_id").alias("message_id"), F.lower(F.trim("action")).alias("action"), F.lower(F.trim("message_type")).alias("message_type"), "reason", "confidence", "evidence_message_ids")
    return o.where("message_id is not null")


def output(spark: SparkSession, d: str) -> DataFrame:
    """Each routed message once, the least of its rows."""
    o = _output_rows(spark, d)
    x = ["action", "message_type", "confidence", "reason", "evidence_message_ids"]
    return o.groupBy("message_id").agg(F.min(F.struct(*x)).alias("x")).select("message_id", "x.*")


_O = f"""o as (select * exclude (r) from (select {_id("message_id")} as message_id, lower(trim(action)) as action, lower(trim(message_type)) as message_type, reason, confidence, evidence_message_ids,
  row_number() over (partition by {_id("message_id")} order by lower(trim(action)), lower(trim(message_type)), confidence, reason, evidence_message_ids) as r from router_output where {_id("message_id")} is not null) where r = 1)"""
_IDLIST = "list_filter(list_distinct(regexp_split_to_array(lower(trim(coalesce({0}, ''))), '[;,|\\s]+')), lambda x: x <> '' and x <> 'none')"

# ---------------------------------------------------------------- sources


@query(f"""with {_M} select message_id, trim(regexp_replace(coalesce(message_text, ''), '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F]', '', 'g'), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || chr(133) || chr(160) || chr(5760) || chr(8192) || chr(8193) || chr(8194) || chr(8195) || chr(8196) || chr(8197) || chr(8198) || chr(8199) || chr(8200) || chr(8201) || chr(8202) || chr(8232) || chr(8233) || chr(8239) || chr(8287) || chr(12288)) as text from m""")
def clean_texts(spark: SparkSession, d: str) -> DataFrame:
    return messages(spark, d, "message_text").select("message_id", X.clean("message_text").alias("text"))


@query("""select 'message_events' as table_name, user_id || '/' || message_id as key, count(*) as n_rows from message_events group by user_id, message_id having count(*) > 1
union all select 'media_files', media_type || '/' || media_id, count(*) from media_files group by media_type, media_id having count(*) > 1
union all select 'router_output', message_id, count(*) from router_output group by message_id having count(*) > 1""")
def duplicate_keys(spark: SparkSession, d: str) -> DataFrame:
    def of(name: str, keys: list[str]) -> DataFrame:
        return quality.duplicate_keys(table(spark, d, name), keys).select(F.lit(name).alias("table_name"), F.concat_ws("/", *keys).alias("key"), "n_rows")

    return of("message_events", ["user_id", "message_id"]).unionByName(of("media_files", ["media_type", "media_id"])).unionByName(of("router_output", ["message_id"]))


@query("""select media_type, media_id, replace(trim(file_path), '\\', '/') as path, not regexp_matches(replace(trim(file_path), '\\', '/'), '^/|^[A-Za-z]:|(^|/)\\.\\.(/|$)') and trim(file_path) <> '' as safe from media_files""")
def safe_paths(spark: SparkSession, d: str) -> DataFrame:
    f = table(spark, d, "media_files")
    return f.select("media_type", "media_id", F.replace(F.trim("file_path"), F.lit("\\"), F.lit("/")).alias("path"), media.safe_path("file_path").isNotNull().alias("safe"))


@query("""select media_type, media_id, file_path from (select *, row_number() over (partition by media_type, media_id order by received_at nulls last, file_path) as r from media_files where media_id is not null) where r = 1""")
def media_index(spark: SparkSession, d: str) -> DataFrame:
    return media.media_index(table(spark, d, "media_files"), "received_at").select("media_type", "media_id", "file_path")


#: Leading bytes of a file by its name's ending; the tables hold no content.
_STARTS = {"jpg": "FFD8FF", "jpeg": "FFD8FF", "png": "89504E470D0A1A0A", "webp": "524946460000000057454250", "wav": "524946460000000057415645", "avif": "0000001C6674797061766966", "m4a": "0000001C667479704D344120", "mp3": "494433"}


@query("select media_type, media_id, file_path, case when n in ('jpg', 'jpeg') then 'jpeg' when n in ('png', 'webp', 'wav', 'mp3') then n when n in ('avif', 'm4a') and octet_length(encode(file_path)) >= 4 then n else '' end as format from (select *, regexp_extract(lower(file_path), '\\.([a-z0-9]+)$', 1) as n from media_files)")
def media_formats(spark: SparkSession, d: str) -> DataFrame:
    """The format of every media file by its leading bytes, here made from the name's ending and the path."""
    ending = F.regexp_extract(F.lower("file_path"), r"\.([a-z0-9]+)$", 1)
    start = F.coalesce(F.create_map(*[F.lit(x) for kv in _STARTS.items() for x in kv])[ending], F.lit(""))
    head = F.substring(F.concat(start, F.hex(F.encode("file_path", "UTF-8"))), 1, 128)
    return table(spark, d, "media_files").select("media_type", "media_id", "file_path", F.coalesce(media.sniff(head)["format"], F.lit("")).alias("format"))


# ---------------------------------------------------------------- sinks and audits


@query(f"""with o as (select {_id("message_id")} as message_id, lower(trim(action)) as action, lower(trim(message_type)) as message_type, reason, confidence, evidence_message_ids from router_output where {_id("message_id")} is not null),
v as (select message_id, 'action_domain' as rule from o where coalesce(action not in ('notify', 'digest', 'mute'), true)
union select message_id, 'type_domain' from o where coalesce(message_type not in ({", ".join(repr(x) for x in quality.MESSAGE_TYPES)}), true)
union select message_id, 'reason_missing' from o where trim(coalesce(reason, '')) = ''
union select message_id, 'confidence_range' from o where not coalesce(confidence between 0 and 1, false)
union select message_id, 'confidence_digits' from o where confidence <> printf('%.9e', confidence)::double
union select message_id, 'repeated_message' from o group by 1 having count(*) > 1
union select o.message_id, 'evidence_not_canonical' from o where coalesce(evidence_message_ids, '') = '' or evidence_message_ids <> lower(trim(evidence_message_ids)) or regexp_matches(evidence_message_ids, '[,|\\s]|;;|^;|;$') or regexp_matches(evidence_message_ids, '(^|;)none;|;none')
  or (select count(*) <> count(distinct x) from (select unnest(string_split(evidence_message_ids, ';')) as x)))
select message_id, rule from v""")
def output_violations(spark: SparkSession, d: str) -> DataFrame:
    """Every rule that the routing output breaks, its rows as they came."""
    return quality.output_violations(_output_rows(spark, d))


@query(f"""with {_M}, {_O}, e as (select distinct message_id, unnest({_IDLIST.format("evidence_message_ids")}) as evidence_id from o),
j as (select e.*, q.user_id, q.created_at, h.user_id as eu, h.created_at as ea from e left join m q using (message_id) left join m h on h.message_id = e.evidence_id)
select message_id, evidence_id, rule from (select *, case when eu is null then 'missing' when not coalesce(eu = user_id, false) then 'other_user' when not coalesce(ea < created_at, false) then 'not_earlier' end as rule from j) where rule is not null""")
def evidence_violations(spark: SparkSession, d: str) -> DataFrame:
    return quality.evidence_violations(output(spark, d), messages(spark, d, "user_id", "created_at"))


_ORDERED = "list_filter(regexp_split_to_array(lower(trim(coalesce({0}, ''))), '[;,|\\s]+'), lambda x: x <> '' and x <> 'none')"


@query(f"""with {_M}, {_O}, e as (select distinct message_id, unnest({_IDLIST.format("evidence_message_ids")}) as evidence_id from o)
select message_id, evidence_id from e join m q using (message_id) join m h on h.message_id = e.evidence_id where q.user_id = h.user_id and h.message_id <> q.message_id and h.created_at < q.created_at""")
def sound_evidence(spark: SparkSession, d: str) -> DataFrame:
    """Of the evidence named in the output, what is the same user's and provably earlier."""
    named = output(spark, d).select("message_id", F.explode(quality.parse_ids("evidence_message_ids")).alias("evidence_id")).distinct()
    m = messages(spark, d, "user_id", "created_at")
    return retrieval.same_user_evidence(named, m, m)


@query(f"""with {_O}, e as (select message_id, {_ORDERED.format("evidence_message_ids")} as ids from o), f as (select message_id, list_filter(ids, lambda x, i: list_position(ids, x) = i) as ids from e)
select message_id, len(ids) as n_ids, case when len(ids) > 0 then array_to_string(ids, ';') else 'none' end as canonical from f""")
def evidence_lists(spark: SparkSession, d: str) -> DataFrame:
    """Evidence lists in their canonical form, in the order given, each id at its first place."""
    ids = quality.parse_ids("evidence_message_ids")
    return output(spark, d).select("message_id", F.size(ids).alias("n_ids"), quality.serialize_ids(ids).alias("canonical"))


@query(f"with {_O} select action, count(*) as n from o group by 1")
def action_counts(spark: SparkSession, d: str) -> DataFrame:
    return output(spark, d).groupBy("action").agg(F.count("*").alias("n"))


#: What is put behind every other message, as the texts themselves show no keys: the beginnings of tokens, by the message's digest.
_BAIT = ["app_live_", "sk-", "ghs_", "ASIA", "-----BEGIN EC PRIVATE KEY-----", "ghx_", "sk_", "AKIA-"]
_BAITED = "coalesce(message_text, '') || ' ' || ([" + ", ".join(f"'{b}'" for b in _BAIT) + "])[ascii(h[1]) % 8 + 1] || upper(h)"


@query(f"""with {_M}, s as (select message_id, {_BAITED} as t from (select message_id, message_text, sha256(message_id) as h from m)),
k as (select message_id, unnest([{", ".join(f"case when regexp_matches(t, '{p}') then '{k}' end" for k, p in X.SECRETS.items())}]) as kind from s) select message_id, kind from k where kind is not null""")
def secret_scan(spark: SparkSession, d: str) -> DataFrame:
    """Kinds of keys and tokens in each message, with what looks like a key put behind it."""
    h = F.sha2("message_id", 256)
    bait = F.element_at(F.array(*map(F.lit, _BAIT)), F.ascii(F.left(h, F.lit(1))) % 8 + 1)
    text = F.concat(F.coalesce("message_text", F.lit("")), F.lit(" "), bait, F.upper(h))
    return messages(spark, d, "message_text").select("message_id", F.explode(X.secrets(text)).alias("kind"))


_CHECKS = [("messages", "business_id", "business_accounts", "business_id"), ("user_business_history", "business_id", "business_accounts", "business_id"), ("message_events", "message_id", "messages", "message_id"), ("group_members", "group_id", "messages", "group_id"), ("daily_notification_summary", "user_id", "messages", "user_id"), ("router_output", "message_id", "messages", "message_id"), ("language_labels", "message_id", "messages", "message_id")]


@query(" union all ".join(f"select '{a}.{k}' as check_name, count(*) as n_rows, count(distinct {_id('c.' + k)}) as n_keys from {a} c where {_id('c.' + k)} is not null and not exists (select 1 from {b} p where {_id('p.' + pk)} = {_id('c.' + k)})" for a, k, b, pk in _CHECKS))
def dangling_references(spark: SparkSession, d: str) -> DataFrame:
    clean = lambda t, k: table(spark, d, t).select(ident(k).alias(k))
    return quality.union_all([quality.dangling(clean(a, k), clean(b, pk), f"{a}.{k}", k, pk) for a, k, b, pk in _CHECKS])


#: Image and voice files by type and id; groups and users have no table, so each of their tables stands in for it.
_MEDIA_CHECKS = ("image", "voice")
_MORE_CHECKS = [("messages", "group_id", "group_members", "group_id"), ("messages", "user_id", "group_members", "user_id"), ("messages", "user_id", "daily_notification_summary", "user_id"), ("group_members", "user_id", "messages", "user_id"), ("user_business_history", "user_id", "messages", "user_id")]


@query(" union all ".join([f"select 'messages.media_id:{t}' as check_name, 'media_files' as parent, count(*) as n_rows, count(distinct {_id('c.media_id')}) as n_keys from messages c where {_id('c.media_type')} = '{t}' and {_id('c.media_id')} is not null and not exists (select 1 from media_files p where {_id('p.media_type')} = '{t}' and {_id('p.media_id')} = {_id('c.media_id')})" for t in _MEDIA_CHECKS]
    + [f"select '{a}.{k}', '{b}', count(*), count(distinct {_id('c.' + k)}) from {a} c where {_id('c.' + k)} is not null and not exists (select 1 from {b} p where {_id('p.' + pk)} = {_id('c.' + k)})" for a, k, b, pk in _MORE_CHECKS]))
def dangling_media_and_users(spark: SparkSession, d: str) -> DataFrame:
    """References to media files, groups and users that another table lacks."""
    clean = lambda t, k: table(spark, d, t).select(ident(k).alias(k))
    of_type = lambda t, kind: table(spark, d, t).where(ident("media_type") == kind).select(ident("media_id").alias("media_id"))
    found = [quality.dangling(of_type("messages", t), of_type("media_files", t), f"messages.media_id:{t}", "media_id").withColumn("parent", F.lit("media_files")) for t in _MEDIA_CHECKS]
    found += [quality.dangling(clean(a, k), clean(b, pk), f"{a}.{k}", k, pk).withColumn("parent", F.lit(b)) for a, k, b, pk in _MORE_CHECKS]
    return quality.union_all(found)


_KEYS = {"messages": ["message_id"], "message_events": ["user_id", "message_id"], "media_files": ["media_type", "media_id"], "group_members": ["group_id", "user_id"], "daily_notification_summary": ["user_id", "date"], "router_output": ["message_id"]}


@query(" union all ".join(f"select '{t}' as table_name, sum(n)::bigint as n_rows, sum(n - 1)::bigint as n_duplicates from (select count(*) as n from {t} group by {', '.join(k)})" for t, k in _KEYS.items()))
def table_audit(spark: SparkSession, d: str) -> DataFrame:
    return quality.union_all([quality.duplicates(table(spark, d, t), t, k) for t, k in _KEYS.items()])


#: Messages that were to be routed: the tables say of none that it was left out, so these numbers stand for such.
_DUE = "message_id like 'msg%' and cast(right(message_id, 2) as int) <> 7"


def _incoming(spark: SparkSession, d: str) -> DataFrame:
    return messages(spark, d, "user_id").where(_DUE)


@query(f"""with {_O}, {_M}, a as (select distinct message_id from o), b as (select distinct message_id from m where {_DUE})
select message_id, 'left_only' as side from a where message_id not in (select message_id from b) union all select message_id, 'right_only' from b where message_id not in (select message_id from a)""")
def routed_difference(spark: SparkSession, d: str) -> DataFrame:
    return quality.key_difference(output(spark, d), _incoming(spark, d), "message_id")


# ---------------------------------------------------------------- texts


_NF = f"{_M}, {normal_form('m')}"
_TOKENS = f"list_distinct(list_filter(regexp_extract_all(text, '[\\pL\\pN]+'), lambda w: length(w) >= 2 and w not in ({', '.join(repr(w) for w in STOP_WORDS)})))"


@query(f"with {_NF} select message_id, text from nf")
def normalized_texts(spark: SparkSession, d: str) -> DataFrame:
    return messages(spark, d, "message_text").select("message_id", X.normalize("message_text").alias("text"))


@query(f"with {_NF} select message_id, list_sort({_TOKENS}) as tokens from nf")
def token_lists(spark: SparkSession, d: str) -> DataFrame:
    return normalized_texts(spark, d).select("message_id", F.array_sort(X.tokens("text")).alias("tokens"))


@query(f"with {_NF}, t as (select message_id, {ascii_words('text')} as t from nf) select message_id, " + ", ".join("(" + " + ".join(f"regexp_matches(t, {quoted(ascii_pattern(p))})::int" for p in ps) + f") as {g}" for g, ps in CUES.items()) + " from t")
def cue_flags(spark: SparkSession, d: str) -> DataFrame:
    """Per message how many patterns of each cue group its text matches."""
    return normalized_texts(spark, d).select("message_id", cue_counts("text").alias("c")).select("message_id", "c.*")


_ANY = ("urgency", "payment", "greeting", "lost_item")


@query(f"with {_NF}, t as (select message_id, {ascii_words('text')} as t from nf) select message_id, " + ", ".join("(" + " or ".join(f"regexp_matches(t, {quoted(ascii_pattern(p))})" for p in CUES[g]) + f") as {g}" for g in _ANY) + " from t")
def cue_any(spark: SparkSession, d: str) -> DataFrame:
    """Whether any pattern of some cue groups matches, as streams tell it: by one pattern a group, without Python."""
    return normalized_texts(spark, d).select("message_id", *[X.has_cue("text", g).alias(g) for g in _ANY])


_URL_SQL = X.URL.replace("'", "''")


@query(f"""with {_M}, u as (select distinct message_id, unnest(list_transform(regexp_extract_all(message_text, '{_URL_SQL}', 1), lambda u: regexp_replace(u, '[.,;:!?'')"]+$', ''))) as url from m),
h as (select message_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(trim(url)), '^[a-z][a-z0-9+.-]*://', ''), '[/?#].*$', ''), '^[^@]*@', ''), ':[0-9]*$', ''), '\\.+$', ''), '^www\\.', '') as host from u)
select distinct message_id, host, host in ({", ".join(repr(x) for x in SHORTENERS)}) as shortener from h where regexp_matches(host, '^[^\\s.]+(\\.[^\\s.]+)+$')""")
def link_hosts(spark: SparkSession, d: str) -> DataFrame:
    h = messages(spark, d, "message_text").select("message_id", F.explode(X.hosts("message_text")).alias("host"))
    return h.withColumn("shortener", F.col("host").isin(*SHORTENERS)).distinct()


_HOST_SQL = "regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(trim(regexp_replace({0}, '\\p{{Z}}+$', ''))), '^[a-z][a-z0-9+.-]*://', ''), '[/?#].*$', ''), '^[^@]*@', ''), ':[0-9]*$', ''), '\\.+$', ''), '^www\\.', '')"


@query(f"""with a as (select {_id("business_id")} as business_id, {_HOST_SQL.format("domain_used_by_sender")} as used, {_HOST_SQL.format("official_domain")} as official from business_accounts),
{normal_form("a", "used", "business_id", "used")}, {normal_form("a", "official", "business_id", "official")}
select business_id, u.text <> '' and o.text <> '' and (u.text = o.text or ends_with(u.text, '.' || o.text)) as within from used u join official o using (business_id)""")
def account_domains(spark: SparkSession, d: str) -> DataFrame:
    """Whether each account's sender uses its official host or one below it; hosts are compared in their ASCII form."""
    a = table(spark, d, "business_accounts").select(ident("business_id").alias("business_id"), X.ascii_host("domain_used_by_sender").alias("used"), X.ascii_host("official_domain").alias("official"))
    return a.select("business_id", F.coalesce(X.host_within("used", "official"), F.lit(False)).alias("within"))


_USERS = f"u as (select distinct user_id from (select {_id('user_id')} as user_id from messages union all select {_id('user_id')} from group_members union all select {_id('user_id')} from daily_notification_summary) where user_id is not null)"


def _users(spark: SparkSession, d: str) -> DataFrame:
    """Every user that a table names, as there is no table of users."""
    return quality.union_all([table(spark, d, t).select(ident("user_id").alias("user_id")) for t in ("messages", "group_members", "daily_notification_summary")]).where("user_id is not null").distinct()


@query(f"""with {_M}, {_USERS}, x as (select message_id, unnest(regexp_extract_all(lower(message_text), '(?:^|[^\\w@])@([a-z0-9_]+)', 1)) as user_id from m) select distinct message_id, user_id as mentioned from x semi join u using (user_id)""")
def mentions(spark: SparkSession, d: str) -> DataFrame:
    """Which users each message addresses: names behind ``@``, checked against all user ids and then as a whole word."""
    who = F.regexp_extract_all(F.lower("message_text"), F.lit(r"(?:^|[^\w@])@([a-z0-9_]+)"), F.lit(1))
    x = messages(spark, d, "message_text").select("message_id", "message_text", F.explode(F.array_distinct(who)).alias("user_id")).join(_users(spark, d), "user_id", "left_semi")
    return x.where(X.mentions("message_text", "user_id")).select("message_id", F.col("user_id").alias("mentioned")).distinct()


@query(f"""with {_M}, w as (select message_id, user_id, hour(created_at) * 60 + minute(created_at) as t, cast(regexp_extract(user_id, '([0-9]+)$', 1) as int) as n from m where created_at is not null and user_id is not null),
b as (select *, ((n * 7) % 24) * 60 as a, ((n * 7 + n % 9) % 24) * 60 + 30 * (n % 2) as z from w)
select message_id, case when a = z then true when a < z then t >= a and t < z else t >= a or t < z end as quiet from b""")
def quiet_hours(spark: SparkSession, d: str) -> DataFrame:
    """Whether each message falls into its receiver's do-not-disturb window (here made from the user's number)."""
    n = F.regexp_extract("user_id", r"([0-9]+)$", 1).cast("int")
    window = F.format_string("%02d:00-%02d:%02d", (n * 7) % 24, (n * 7 + n % 9) % 24, 30 * (n % 2))
    return messages(spark, d, "created_at", "user_id").where("created_at is not null and user_id is not null").select("message_id", X.in_window("created_at", window).alias("quiet"))


@query(f"""select {_id("business_id")} as business_id, round(case when messages_sent_30d > 0 then user_reports_30d / messages_sent_30d else 0 end, 6)::double as report_rate, round(greatest(0, least(1, case when messages_sent_30d > 0 then user_reports_30d / messages_sent_30d else 0 end * 10)), 6)::double as capped from business_accounts""")
def report_rates(spark: SparkSession, d: str) -> DataFrame:
    r = X.ratio("user_reports_30d", "messages_sent_30d")
    return table(spark, d, "business_accounts").select(ident("business_id").alias("business_id"), F.round(r, 6).alias("report_rate"), F.round(X.clamp(r * 10), 6).alias("capped"))


@query(f"""with {_M}, b as (select {_id("user_id")} as user_id, {_id("business_id")} as business_id, bool_and(allows_promotions) as allows, min(promotions_opted_out_at) as t from user_business_history group by 1, 2)
select message_id, b.user_id is not null as related, coalesce(b.user_id is not null and (coalesce(t <= created_at, t is not null) or not allows), false) as opted_out from m left join b using (user_id, business_id) where m.business_id is not null""")
def promotion_opt_outs(spark: SparkSession, d: str) -> DataFrame:
    """Whether the receiver knows the business, and had opted out of its promotions by then."""
    b = table(spark, d, "user_business_history").select(ident("user_id").alias("user_id"), ident("business_id").alias("business_id"), "allows_promotions", "promotions_opted_out_at")
    b = b.groupBy("user_id", "business_id").agg(F.bool_and("allows_promotions").alias("allows"), F.min("promotions_opted_out_at").alias("t"), F.lit(True).alias("known"))
    m = messages(spark, d, "user_id", "business_id", "created_at").where("business_id is not null").join(b, ["user_id", "business_id"], "left")
    related = F.coalesce("known", F.lit(False))
    out = related & ((F.col("t").isNotNull() & X.not_after("t", "created_at")) | ~F.coalesce("allows", F.lit(True)))
    return m.select("message_id", related.alias("related"), out.alias("opted_out"))


# What tells that a user has something to come with a business.
_COMING = r"\b(?:appointment|booking|reservation|event|clinic|trip)\b"


@query(f"select why_user_knows_account as why, coalesce(regexp_matches(replace(lower(why_user_knows_account), '_', ' '), '{_COMING}'), false) as upcoming, count(*) as n from user_business_history group by 1, 2")
def relationship_cues(spark: SparkSession, d: str) -> DataFrame:
    """How users know a business, and whether that tells of something to come."""
    upcoming = F.replace(X.normalize("why"), F.lit("_"), F.lit(" ")).rlike(_COMING)
    return table(spark, d, "user_business_history").groupBy(F.col("why_user_knows_account").alias("why")).agg(F.count("*").alias("n")).select("why", upcoming.alias("upcoming"), "n")


@query(f"""with {_M} select message_id, concat_ws(chr(10), nullif(message_text, ''), nullif(media_id, ''), nullif(conversation_type, '')) as text from m""")
def message_facts(spark: SparkSession, d: str) -> DataFrame:
    """The readable text of media facts that hold each message's own columns."""
    kind = F.coalesce("conversation_type", F.lit(""))
    facts = X.facts_wrapper("facts: ", summary=F.col("message_text"), visible_text=F.col("media_id"), signals=F.array(kind, kind, F.lit("")))
    return messages(spark, d, "message_text", "media_id", "conversation_type").select("message_id", X.facts_text(facts).alias("text"))


@query(f"""with {_M} select message_id, trim(regexp_replace(coalesce(message_text, ''), '[\\x00-\\x1F\\x7F]+', ' ', 'g'), ' ')[1:4000] as summary, greatest(0, least(1, forwarded_count - 1))::double as confidence, case when coalesce(conversation_type, '') = '' then 0 else 1 end as n_signals from m""")
def message_fact_records(spark: SparkSession, d: str) -> DataFrame:
    """Bounded facts of each message, from a JSON object of its columns."""
    kind = F.coalesce("conversation_type", F.lit(""))
    facts = F.to_json(F.struct(F.coalesce("message_text", F.lit("")).alias("summary"), F.array(kind, kind, F.lit("")).alias("signals"), (F.col("forwarded_count") - 1).cast("double").alias("confidence")))
    f = messages(spark, d, "message_text", "conversation_type", "forwarded_count").select("message_id", X.facts_normalized(facts).alias("f"))
    return f.select("message_id", "f.summary", "f.confidence", F.size("f.signals").alias("n_signals"))


@query(f"""with {_M} select message_id, concat_ws(chr(10), nullif(message_text, ''), nullif(media_id, '')) as content from m""")
def message_contents(spark: SparkSession, d: str) -> DataFrame:
    """What each message says: its text and its media's content (here the id) on lines of their own, or whichever there is."""
    return messages(spark, d, "message_text", "media_id").select("message_id", X.content("message_text", "media_id").alias("content"))


@query("select media_type, media_id, case when media_type = 'image' then 'data:image/png;base64,' || base64(encode(file_path)) when media_type = 'voice' then 'data:audio/mpeg;base64,' || base64(encode(file_path)) end as url from media_files")
def media_urls(spark: SparkSession, d: str) -> DataFrame:
    """Data URLs of media files, their path standing for the content the tables lack; none of other kinds."""
    mime = F.when(F.col("media_type") == "image", "image/png").when(F.col("media_type") == "voice", "audio/mpeg").otherwise("text/html")
    return table(spark, d, "media_files").select("media_type", "media_id", media.data_url(F.encode("file_path", "UTF-8"), mime).alias("url"))


@query("select media_type, format, count(*) as n from (select media_type, case when n in ('jpg', 'jpeg') then 'jpeg' when n in ('png', 'webp', 'wav', 'mp3') then n when n in ('avif', 'm4a') and octet_length(encode(file_path)) >= 4 then n else '' end as format from (select *, regexp_extract(lower(file_path), '\\.([a-z0-9]+)$', 1) as n from media_files)) group by 1, 2")
def media_format_counts(spark: SparkSession, d: str) -> DataFrame:
    """Media files by kind and format."""
    return media_formats(spark, d).groupBy("media_type", "format").agg(F.count("*").alias("n"))


#: Most values of a document here.
_NODES = 100


@query(f"""with {_M} select message_id, unnest(['text', 'object', 'fenced', 'cut', 'repeated', 'deep', 'too deep', 'full']) as form, unnest([coalesce(json_valid(message_text), false), true, true, false, false, true, false, false]) as valid from m""")
def message_documents(spark: SparkSession, d: str) -> DataFrame:
    """Which forms of each message are strict JSON: its text, an object of it, that in a code fence, without its end, with a repeated key, as deep as may be and deeper, and in a list too full."""
    one = F.to_json(F.struct(F.coalesce("message_text", F.lit("")).alias("text")))
    end = F.length(one) - 1
    forms = {"text": F.col("message_text"), "object": one, "fenced": F.concat(F.lit("```json\n"), one, F.lit("\n```")), "cut": F.left(one, end), "repeated": F.concat(F.left(one, end), F.lit(',"text":0}'))}
    nested = lambda n: F.concat(F.lit('{"a":' * n), one, F.lit("}" * n))
    forms |= {"deep": nested(X.JSON_DEPTH - 1), "too deep": nested(X.JSON_DEPTH), "full": F.concat(F.lit("[" + "0," * (_NODES - 2)), one, F.lit("]"))}
    x = messages(spark, d, "message_text").select("message_id", F.explode(F.array(*[F.struct(F.lit(k).alias("form"), v.alias("t")) for k, v in forms.items()])).alias("x"))
    return x.select("message_id", "x.form", X.strict_json("x.t", 2**31 - 1, nodes=_NODES).isNotNull().alias("valid"))


# ---------------------------------------------------------------- context


_FLAGS = ["message_opened", "message_replied", "notification_dismissed", "message_reported"]


@query(f"""with {_M}, u as (select {_id("user_id")} as user_id, {", ".join(f"count_if({c}) as {c}" for c in _FLAGS)} from message_events group by 1),
p as (select group_id, count(*) as member_count, count_if(role = 'admin') as admin_count from (select {_id("group_id")} as group_id, {_id("user_id")} as user_id, max(role) as role from group_members group by 1, 2) where group_id is not null and user_id is not null group by 1),
g as (select * from (select {_id("group_id")} as group_id, {_id("user_id")} as user_id, role, joined_at, messages_read_30d, group_muted_by_user, row_number() over (partition by {_id("group_id")}, {_id("user_id")} order by joined_at desc nulls last, role desc, messages_read_30d desc, group_muted_by_user desc) as r from group_members) where r = 1),
b as (select {_id("business_id")} as business_id, verified, category from business_accounts),
k as (select {_id("user_id")} as user_id, {_id("business_id")} as business_id, max(activity_count_180d) as activity from user_business_history group by 1, 2),
f as (select lower(media_type) as media_type, {_id("media_id")} as media_id, max(file_path) as file_path from media_files group by 1, 2),
s as (select user_id, list(strftime(date, '%Y-%m-%d') || '=' || sent order by date) as loads from (select {_id("user_id")} as user_id, date, max(notifications_sent) as sent from daily_notification_summary where date is not null group by 1, 2) group by 1)
select m.message_id, u.message_opened as opened, u.message_replied as replied, u.notification_dismissed as dismissed, u.message_reported as reported, p.member_count, p.admin_count, g.role, coalesce(g.group_muted_by_user, false) as muted, b.category, coalesce(b.verified, false) as verified, k.activity, f.file_path, s.loads
from m left join u on u.user_id = m.user_id left join p on p.group_id = m.group_id left join g on g.group_id = m.group_id and g.user_id = m.user_id left join b on b.business_id = m.business_id left join k on k.user_id = m.user_id and k.business_id = m.business_id
left join f on f.media_type = m.media_type and f.media_id = m.media_id left join s on s.user_id = m.user_id""")
def message_context(spark: SparkSession, d: str) -> DataFrame:
    """Each message with its receiver, group, membership, account, relationship, media and the receiver's days in order.

    The tables hold no users and groups of their own: a user's counts come from the events, a
    group's from its members.
    """
    u = table(spark, d, "message_events").groupBy(ident("user_id").alias("user_id")).agg(*[F.count_if(c).alias(c) for c in _FLAGS]).where("user_id is not null")
    g = table(spark, d, "group_members").select(ident("group_id").alias("group_id"), ident("user_id").alias("user_id"), "joined_at", "role", "messages_read_30d", "group_muted_by_user")
    each = g.where("group_id is not null and user_id is not null").groupBy("group_id", "user_id").agg(F.max("role").alias("role"))
    p = each.groupBy("group_id").agg(F.count("*").alias("member_count"), F.count_if(F.col("role") == "admin").alias("admin_count"))
    b = table(spark, d, "business_accounts").select(ident("business_id").alias("business_id"), "verified", "category")
    k = table(spark, d, "user_business_history").select(ident("user_id").alias("user_id"), ident("business_id").alias("business_id"), F.col("activity_count_180d").alias("activity"))
    f = table(spark, d, "media_files").select(F.lower("media_type").alias("media_type"), ident("media_id").alias("media_id"), "file_path")
    one = lambda name, df: (name, context.one_per_key(df, context.SIDES[name]))
    sides = dict([("users", u), ("groups", p), one("members", g), one("accounts", b), one("relations", k), one("media", f)])
    m = messages(spark, d, "user_id", "group_id", "business_id", "media_type", "media_id")
    c = context.build_context(m, sides, context.daily_lists(_days(spark, d), "user_id", "date", ["sent"]))
    no = F.lit(False)
    loads = F.transform("summaries", lambda x: F.concat(F.date_format(x["date"], "yyyy-MM-dd"), F.lit("="), x["sent"].cast("string")))
    return c.select(
        "message_id", F.col("users.message_opened").alias("opened"), F.col("users.message_replied").alias("replied"), F.col("users.notification_dismissed").alias("dismissed"), F.col("users.message_reported").alias("reported"), "groups.member_count", "groups.admin_count",
        "members.role", F.coalesce("members.group_muted_by_user", no).alias("muted"), "accounts.category", F.coalesce("accounts.verified", no).alias("verified"), "relations.activity", "media.file_path", loads.alias("loads"),
    )


_T = f"""{normal_form("m")}, t as (select *, {_TOKENS} as tk from (select m.*, nf.text from m join nf using (message_id))),
h as (select * from t where message_id like 'message%'), q as (select * from t where message_id like 'msg%' and created_at is not null and len(tk) > 0),
n as (select user_id, count(*) as n from h group by 1), df as (select user_id, token, count(*) as df from (select user_id, unnest(tk) as token from h) group by 1, 2),
w as (select df.user_id, token, df, n, 1 + ln((1 + n) / (1 + df)) as weight from df join n using (user_id))"""


def _sides(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Incoming and earlier messages with their normalised text, which is made once for both."""
    m = messages(spark, d, "user_id", "created_at", "conversation", "conversation_type", "media_type", "message_text")
    m = cut(m.withColumn("text", X.normalize("message_text")).drop("message_text"))
    return m.where("message_id like 'msg%'"), m.where("message_id like 'message%'")


@query(f"with {_M}, {_T} select user_id, token, df, n, round(weight, 6)::double as weight from w")
def token_frequencies(spark: SparkSession, d: str) -> DataFrame:
    _, h = _sides(spark, d)
    w = retrieval.token_frequencies(h.withColumn("tokens", X.tokens("text")))
    return w.select("user_id", "token", "df", "n", F.round("weight", 6).alias("weight"))


_EV = f"""{_M}, {_T}, hw as (select h.message_id, sum(weight) as hw from (select message_id, user_id, unnest(tk) as token from h where created_at is not null) h join w using (user_id, token) group by 1),
qw as (select q.message_id, sum(coalesce(weight, 1 + ln(1 + n.n))) as qw from (select message_id, user_id, unnest(tk) as token from q) q join n using (user_id) left join w using (user_id, token) group by 1),
pr as (select q.message_id, h.message_id as evidence_id, q.user_id, q.created_at as qa, h.created_at as ha, q.text = h.text and q.text <> '' as exact, list_intersect(q.tk, h.tk) as common,
  coalesce(q.conversation = h.conversation, false)::int as c1, coalesce(q.conversation_type = h.conversation_type, false)::int as c2, coalesce(q.media_type = h.media_type, false)::int as c3
  from q join h on h.user_id = q.user_id and h.created_at < q.created_at and h.message_id <> q.message_id where len(list_intersect(q.tk, h.tk)) > 0),
cw as (select message_id, evidence_id, sum(weight) as cw from (select message_id, evidence_id, user_id, unnest(common) as token from pr) join w using (user_id, token) group by 1, 2),
s as (select pr.message_id, pr.evidence_id, cw / (qw + hw - cw) as lexical, exact, 0.72 * (cw / (qw + hw - cw)) + 0.17 * c1 + 0.035 * c2 + 0.03 * c3 as base, exp(-(epoch_us(qa) - epoch_us(ha)) / 86400e6 / 45.0) as near
  from pr join cw using (message_id, evidence_id) join qw using (message_id) join hw on hw.message_id = pr.evidence_id),
r as (select message_id, evidence_id, lexical, round(greatest(0, least(1, case when exact then greatest(base, 0.96) else base end + 0.055 * near)), 6) as score from s where lexical >= 0.06 or exact),
ev as (select * from (select *, row_number() over (partition by message_id order by score desc, evidence_id) as rank from r where score >= 0.18) where rank <= 3)"""


def _evidence(spark: SparkSession, d: str) -> DataFrame:
    q, h = _sides(spark, d)
    return retrieval.similar_prior(q, h, 3)


@query(f"with {_EV} select message_id, evidence_id, round(lexical, 5)::double as lexical, score::double as score, rank::int as rank from ev")
def evidence(spark: SparkSession, d: str) -> DataFrame:
    """The best three earlier messages of the same user for every incoming message."""
    return _evidence(spark, d).select("message_id", "evidence_id", F.round("lexical", 5).alias("lexical"), "score", "rank")


_EVENTS = f"e as (select {_id('message_id')} as message_id, bool_or(message_opened) as message_opened, bool_or(message_replied) as message_replied, bool_or(notification_dismissed) as notification_dismissed, bool_or(muted_after_message) as muted_after_message, bool_or(message_reported) as message_reported from message_events group by 1)"


def _events(spark: SparkSession, d: str) -> DataFrame:
    flags = ["message_opened", "message_replied", "notification_dismissed", "muted_after_message", "message_reported"]
    return table(spark, d, "message_events").groupBy(ident("message_id").alias("message_id")).agg(*[F.bool_or(c).alias(c) for c in flags])


@query(f"""with {_EV}, {_EVENTS}, x as (select ev.message_id, greatest(0.05, score) as w, score, case when coalesce(message_replied, false) then 1.0 when coalesce(message_opened, false) then 0.55 else 0.0 end as p,
  case when coalesce(message_reported, false) then 1.25 when coalesce(muted_after_message, false) then 1.0 when coalesce(notification_dismissed, false) then 0.75 else 0.0 end as n from ev left join e on e.message_id = ev.evidence_id),
a as (select message_id, sum(w)::double as t, sum(w * p)::double as p, sum(w * n)::double as n, max(score) as top from x group by 1)
select message_id, round(greatest(0, least(1, 0.5 + 0.5 * p / t - 0.6 * n / t)), 5)::double as engagement, round(greatest(case when top >= 0.9 then 0.72 else 0 end, greatest(0, least(1, 0.25 * top + 0.8 * n / t))), 5)::double as repetition, n > p and n > 0 as rejected from a""")
def history_features(spark: SparkSession, d: str) -> DataFrame:
    f = retrieval.history_features(_evidence(spark, d), _events(spark, d))
    return f.select("message_id", F.round("engagement", 5).alias("engagement"), F.round("repetition", 5).alias("repetition"), "rejected")


@query(f"""with {_EV}, {_EVENTS}, a as (select message_id from m where media_id is not null and length(coalesce(message_text, '')) < 60),
x as (select ev.message_id, ev.evidence_id, rank, score >= case when coalesce(message_replied, false) or coalesce(notification_dismissed, false) or coalesce(muted_after_message, false) or coalesce(message_reported, false) then 0.32 else 0.36 end as named,
  a.message_id is not null and coalesce(message_opened, false) and score >= 0.32 as first from ev left join e on e.message_id = ev.evidence_id left join a on a.message_id = ev.message_id),
l as (select *, min(case when named or first then rank end) over (partition by message_id) as head from x),
y as (select *, row_number() over (partition by message_id order by rank) as r from l where named or rank = head)
select message_id, string_agg(evidence_id, ';' order by r) as evidence_message_ids from y where r <= 2 group by 1""")
def named_evidence(spark: SparkSession, d: str) -> DataFrame:
    """The ids named for each message; one with media and hardly any text counts as speaking by its media."""
    media_only = messages(spark, d, "media_id", "message_text").where("media_id is not null and length(coalesce(message_text, '')) < 60")
    n = retrieval.named_evidence(_evidence(spark, d), _events(spark, d), media_only=media_only)
    return n.select("message_id", quality.serialize_ids("evidence_ids").alias("evidence_message_ids"))


@query(f"""with v as (select {_id("user_id")} as user_id, date, max(notifications_sent) as sent from daily_notification_summary where date is not null group by 1, 2),
w as (select *, avg(sent) over (partition by user_id order by date rows between 7 preceding and 1 preceding) as mean from v)
select user_id, strftime(date, '%Y-%m-%d') as day, sent, sent >= greatest(10, 1.5 * coalesce(mean, sent)) as high from w""")
def daily_load(spark: SparkSession, d: str) -> DataFrame:
    """Days with far more notifications than the seven reported days before."""
    return retrieval.daily_load(_days(spark, d)).select("user_id", F.date_format("date", "yyyy-MM-dd").alias("day"), "sent", "high")


def _days(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "daily_notification_summary").where("date is not null").groupBy(ident("user_id").alias("user_id"), "date").agg(F.max("notifications_sent").alias("sent"))


@query(f"""with {_M}, v as (select {_id("user_id")} as user_id, date, max(notifications_sent) as sent from daily_notification_summary where date is not null group by 1, 2),
w as (select user_id, date, sent >= greatest(10, 1.5 * coalesce(avg(sent) over (partition by user_id order by date rows between 7 preceding and 1 preceding), sent)) as high from v),
x as (select m.message_id, max_by(w.high, w.date) as high from m join w on w.user_id = m.user_id and w.date <= m.created_at::date where m.created_at is not null group by 1)
select message_id, coalesce(high, false) as high from m left join x using (message_id) where m.created_at is not null and m.user_id is not null""")
def message_load(spark: SparkSession, d: str) -> DataFrame:
    """Whether the receiver of each message had a heavy day, as known on the message's date: by the last day reported until then."""
    days = retrieval.daily_load(_days(spark, d)).select("user_id", F.col("date").cast("timestamp_ntz").alias("at"), "high")
    m = messages(spark, d, "user_id", "created_at").where("created_at is not null and user_id is not null")
    k = known_at(m, days, ["user_id"], "created_at", "at", ["message_id"], ["high"])
    return k.select("message_id", F.coalesce("high", F.lit(False)).alias("high"))


@query(f"""with {_M}, s as (select message_id, forwarded_count / 10.0 as forward, length(message_text) / 200.0 as text, case when media_type <> '' then 0.5 else 0 end as media from m)
select message_id, case when coalesce(forward, -1) >= coalesce(text, -1) and coalesce(forward, -1) >= media then 'forward' when coalesce(text, -1) >= media then 'text' else 'media' end as strongest,
round(list_sort([forward, text, media], 'DESC')[1] - list_sort([forward, text, media], 'DESC')[2], 6)::double as margin from s""")
def strongest_trait(spark: SparkSession, d: str) -> DataFrame:
    """Argmax over scores with a stated order among ties, and the margin to the next."""
    s = messages(spark, d, "forwarded_count", "message_text", "media_type").select("message_id", (F.col("forwarded_count") / 10.0).alias("forward"), (F.length("message_text") / 200.0).alias("text"), F.when(F.col("media_type") != "", 0.5).otherwise(0.0).alias("media"))
    names = ["forward", "text", "media"]
    return s.select("message_id", ranking.argmax({n: F.col(n) for n in names}).alias("strongest"), F.round(ranking.margin([F.col(n) for n in names]), 6).alias("margin"))


# ---------------------------------------------------------------- evaluation

_LABELS = f"""{_O}, {_M}, latest as (select m.message_id, arg_max(h.message_id, (h.created_at, h.message_id)) as prior from m join m h on h.user_id = m.user_id and h.created_at <= m.created_at and h.message_id like 'message%' where m.message_id like 'msg%' group by 1),
labels as (select message_id, (['notify', 'digest', 'mute'])[n % 3 + 1] as action, (['personal', 'event', 'payment', 'promotion', 'business_update'])[n % 5 + 1] as message_type,
  case when n % 4 = 0 or prior is null then [] else [prior] end as evidence from (select m.message_id, prior, cast(right(m.message_id, 2) as int) as n from m left join latest using (message_id) where {_DUE}))"""
_GOLD = f"""{_LABELS}, g as (select o.message_id, o.action, o.message_type, o.confidence, {_IDLIST.format("evidence_message_ids")} as ev, l.action as gold_action, l.message_type as gold_message_type, l.evidence as gev from o join labels l using (message_id))"""


def _labels(spark: SparkSession, d: str) -> DataFrame:
    """Labels of the messages that were due, as the tables hold none: by their numbers, and the user's latest message before them."""
    n = F.right("message_id", F.lit(2)).cast("int")
    pick = lambda *names: F.element_at(F.array(*map(F.lit, names)), n % len(names) + 1)
    m = messages(spark, d, "user_id", "created_at")
    h = m.where("message_id like 'message%'").select("user_id", F.col("created_at").alias("at"), F.col("message_id").alias("prior"))
    latest = known_at(m.where(_DUE), h, ["user_id"], "created_at", "at", ["message_id"], ["prior"]).select("message_id", "prior")
    none = F.array().cast("array<string>")
    evidence = F.when((n % 4 == 0) | F.col("prior").isNull(), none).otherwise(F.array("prior"))
    return m.where(_DUE).join(latest, "message_id", "left").select("message_id", pick("notify", "digest", "mute").alias("action"), pick("personal", "event", "payment", "promotion", "business_update").alias("message_type"), evidence.alias("evidence"))


def _graded(spark: SparkSession, d: str) -> DataFrame:
    """Predictions beside their labels; those that only one side has are left to ``label_difference``."""
    o = output(spark, d).withColumn("evidence", quality.parse_ids("evidence_message_ids"))
    return evaluate.graded(_labels(spark, d), o, strict=False)


@query(f"with {_LABELS} select message_id, 'label_only' as side from labels where message_id not in (select message_id from o) union all select message_id, 'prediction_only' from o where message_id not in (select message_id from labels)")
def label_difference(spark: SparkSession, d: str) -> DataFrame:
    """Messages that have a label or a prediction, but not both."""
    return evaluate.unmatched(_labels(spark, d), output(spark, d))


@query(f"with {_GOLD} select count(*) as n, round(avg(coalesce(gold_action = action, false)::int), 9)::double as action_accuracy, round(avg(coalesce(gold_message_type = message_type, false)::int), 9)::double as type_accuracy, round(avg(coalesce(gold_action = action and gold_message_type = message_type, false)::int), 9)::double as joint_accuracy from g")
def accuracy(spark: SparkSession, d: str) -> DataFrame:
    a = evaluate.accuracy(_graded(spark, d))
    return a.select("n", *[F.round(c, 9).alias(c) for c in ("action_accuracy", "type_accuracy", "joint_accuracy")])


@query(f"with {_GOLD} select gold_action as gold, action as predicted, count(*) as n from g group by 1, 2")
def confusion_matrix(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.confusion(_graded(spark, d), "gold_action", "action")


@query(f"""with {_GOLD}, s as (select len(list_intersect(ev, gev)) as b, len(list_distinct(list_concat(ev, gev))) as u, len(ev) as p, len(gev) as g from g),
t as (select count(*) as n, avg((b = u)::int) as exact_rate, avg(case when u = 0 then 1.0 else b / u end) as mean_jaccard, coalesce(sum(b) / nullif(sum(p), 0), (sum(g) = 0)::int) as precision, coalesce(sum(b) / nullif(sum(g), 0), (sum(p) = 0)::int) as recall from s)
select n, round(exact_rate, 9)::double as exact_rate, round(mean_jaccard, 9)::double as mean_jaccard, round(precision, 9)::double as precision, round(recall, 9)::double as recall, round(case when precision + recall > 0 then 2 * precision * recall / (precision + recall) else 0 end, 9)::double as f1 from t""")
def evidence_quality(spark: SparkSession, d: str) -> DataFrame:
    e = evaluate.evidence_metrics(_graded(spark, d))
    return e.select("n", *[F.round(c, 9).alias(c) for c in ("exact_rate", "mean_jaccard", "precision", "recall", "f1")])


@query(f"""with {_GOLD}, c as (select confidence, (gold_action = action and gold_message_type = message_type)::int as hit, {" + ".join(f"(confidence >= {i / 10})::int" for i in range(1, 10))} as bin from g),
b as (select bin, count(*) as n, sum(confidence) as c, sum(hit) as h, sum((confidence - hit) ** 2) as s from c group by 1)
select sum(n)::bigint as n, round(sum(s) / sum(n), 9)::double as brier, round(sum(abs(c - h)) / sum(n), 9)::double as ece from b""")
def calibration(spark: SparkSession, d: str) -> DataFrame:
    g = _graded(spark, d).withColumn("hit", (F.col("gold_action") == F.col("action")) & (F.col("gold_message_type") == F.col("message_type")))
    c = evaluate.calibration(g, "confidence", "hit")
    return c.select("n", F.round("brier", 9).alias("brier"), F.round("ece", 9).alias("ece"))


# ---------------------------------------------------------------- enrichment


@query(f"with {_M} select sha256(message_text) as digest, count(*) as n_rows from m where message_text is not null and message_text <> '' group by 1")
def distinct_contents(spark: SparkSession, d: str) -> DataFrame:
    return enrich.distinct_contents(messages(spark, d, "message_text"), "message_text").select("digest", "n_rows")


def _length_client():
    """A stand-in for an outside service: facts about the text's length."""
    import json

    return lambda texts: [json.dumps({"chars": len(t)}) for t in texts]


@query(f"with {_M} select message_id, length(message_text) as chars from m where message_text is not null and message_text <> ''")
def enriched(spark: SparkSession, d: str) -> DataFrame:
    m = messages(spark, d, "message_text").where("message_text is not null and message_text <> ''").select("message_id", "message_text")
    e = enrich.enrich(m, "message_text", _length_client)
    return e.select("message_id", F.get_json_object("facts", "$.chars").cast("bigint").alias("chars"))


def _shaky_client():
    """A stand-in for an outside service that fails on some texts, by their length, and answers nonsense on others."""
    import json

    def ask(texts: list[str]) -> list[str]:
        if any(len(t) % 20 == 3 for t in texts):
            raise TimeoutError
        if any(len(t) % 20 == 4 for t in texts):
            raise ConnectionError
        return ["nonsense" if len(t) % 20 == 5 else json.dumps({"index": k, "chars": len(t)}) if len(texts) > 1 and all(len(x) % 20 != 5 for x in texts) else json.dumps({"chars": len(t)}) for k, t in enumerate(texts)]

    return ask


_ASKED = f"{_M}, a as (select distinct message_text, case length(message_text) % 20 when 3 then 'timeout' when 4 then 'unreachable' when 5 then 'malformed' end as error from m where message_text is not null and message_text <> '')"


def _asked(spark: SparkSession, d: str) -> DataFrame:
    return enrich.ask(enrich.distinct_contents(messages(spark, d, "message_text"), "message_text"), _shaky_client)


@query(f"with {_ASKED} select count(*) as n_contents, count_if(error is null) as n_answered, count_if(error is not null) as n_failed, count_if(error = 'timeout') as timeout, count_if(error = 'unreachable') as unreachable, count_if(error = 'malformed') as malformed, count_if(error = 'mismatched') as mismatched from a")
def enrichment_report(spark: SparkSession, d: str) -> DataFrame:
    """What became of all distinct texts sent to a service that fails on some."""
    return enrich.report(_asked(spark, d)).select("n_contents", "n_answered", "n_failed", "timeout", "unreachable", "malformed", "mismatched")


@query(f"with {_ASKED} select coalesce(error, 'none') as error, count(*) as n from a group by 1")
def failure_histogram(spark: SparkSession, d: str) -> DataFrame:
    """Failures of that service by kind."""
    return enrich.failure_counts(_asked(spark, d))
