"""SQL equivalents of the text queries that SQL can express."""

from __future__ import annotations

from loomwake.llm import codepoints as C
from loomwake.plans.sqlforms import quoted


def _id(c: str) -> str:
    return f"nullif(lower(trim({c}, ' ' || chr(9) || chr(10) || chr(13) || chr(160))), '')"


def _plain_forms() -> str:
    """Rows (character, its compatibility form) of all characters that have another, by the Unicode database."""
    import unicodedata

    rows = []
    for c in range(0x80, 0x30000):
        x = chr(c)
        if unicodedata.category(x) in ("Cn", "Cs", "Co") or x == "﻿":
            continue
        if (y := unicodedata.normalize("NFKC", x)) != x:
            rows.append(f"({quoted(x)},{quoted(y)})")
    return ",".join(rows)


_SCRIPT = {"latin": "\\p{Latin}", "cyrillic": "\\p{Cyrillic}", "greek": "\\p{Greek}"}
_PAIRS = {k.lower(): v for k, v in C.ALIKE.items()}
_COUNT = "length(regexp_replace({0}, '[^{1}]', '', 'g'))"


def _one_script(word: str, mostly_cyrillic: str) -> str:
    """A word in one script: of those it has, the one in which most of its letters are, if look-alikes can write the rest."""
    (cyr_latin, cyr), (greek_latin, greek) = _PAIRS["cyrillic"], _PAIRS["greek"]
    forms = {"latin": f"translate({word}, {quoted(cyr + greek)}, {quoted(cyr_latin + greek_latin)})", "cyrillic": f"translate({word}, {quoted(cyr_latin)}, {quoted(cyr)})", "greek": f"translate({word}, {quoted(greek_latin)}, {quoted(greek)})"}
    score = {}
    for k, form in forms.items():
        foreign = " + ".join(_COUNT.format(form, _SCRIPT[o]) for o in _SCRIPT if o != k)
        lean = {"latin": f"(not {mostly_cyrillic})::int * 0.5", "cyrillic": f"{mostly_cyrillic}::int * 0.5", "greek": "0"}[k]
        native = _COUNT.format(word, _SCRIPT[k])
        score[k] = f"case when {native} > 0 then {native} + {lean} - 1000 * ({foreign}) else -1e9 end"
    several = "(" + " + ".join(f"regexp_matches({word}, '[{s}]')::int" for s in _SCRIPT.values()) + ") > 1"
    best = f"case when ({score['latin']}) >= greatest(({score['cyrillic']}), ({score['greek']})) then {forms['latin']} when ({score['cyrillic']}) >= ({score['greek']}) then {forms['cyrillic']} else {forms['greek']} end"
    return f"case when {several} then {best} else {word} end"


def one_form(source: str, name: str, key: str, text: str) -> str:
    """A CTE ``name`` (``key``, ``text``): each text in its one form, but that emoji lose their joiners."""
    cyrillic = f"({_COUNT.format('t', _SCRIPT['cyrillic'])} * 2 > {_COUNT.format('t', ''.join(_SCRIPT.values()))})"
    return f"""{name}_map(a, b) as (values {_plain_forms()}),
{name}_raw as (select {key}, regexp_replace(coalesce({text}, ''), '[\\p{{Cf}}\\x{{FE00}}-\\x{{FE0F}}\\x{{034F}}]', '', 'g') as t from {source}),
{name}_rich as (select {key}, string_agg(coalesce({name}_map.b, ch), '' order by i) as t from (select {key}, i, substring(t, i, 1) as ch from (select {key}, t, unnest(range(1, length(t) + 1)) as i from {name}_raw where regexp_matches(t, '[^\\x00-\\x7F]')))
  left join {name}_map on {name}_map.a = ch group by 1),
{name}_said as (select {key}, nfc_normalize(coalesce(r.t, w.t)) as t from {name}_raw w left join {name}_rich r using ({key})),
{name} as (select {key}, case when regexp_matches(t, '[{_SCRIPT["cyrillic"]}{_SCRIPT["greek"]}]') and regexp_matches(t, '[{_SCRIPT["latin"]}]') then array_to_string(list_transform(regexp_extract_all(t, '[\\pL\\pM\\pN]+|[^\\pL\\pM\\pN]+'), lambda w: {_one_script("w", cyrillic)}), '') else t end as text from {name}_said)"""


# ---------------------------------------------------------------- near duplicates

_WORDS6 = f"""m as (select distinct {_id("message_id")} as message_id, message_text from messages where forwarded_count >= 1 and {_id("message_id")} is not null),
k as (select row_number() over () as n, message_id, message_text from m),
{one_form("k", "c", "n", "message_text")},
l as (select k.message_id, list_filter(list_transform(regexp_split_to_array(replace(lower(c.text), 'ß', 'ss'), '[\\s\\x0B]+'), lambda w: regexp_replace(w, '^\\pP+|\\pP+$', '', 'g')), lambda w: w <> '') as ws from k join c using (n)),
s as (select distinct message_id, list_sort(list_distinct(ws)) as ws from l where len(ws) >= 20),
r as (select min(message_id) as class_id, ws, len(ws) as n from s group by ws),
links as (select a.class_id as a, b.class_id as b from r a join r b on a.class_id < b.class_id and least(a.n, b.n) >= 0.7 * greatest(a.n, b.n) where len(list_intersect(a.ws, b.ws)) >= 0.7 * (a.n + b.n - len(list_intersect(a.ws, b.ws))) - 1e-9)"""

P6_FOUND = f"""with {_WORDS6}, x as (select s.message_id, r.class_id from s join r using (ws)),
p as (select x.message_id as i, y.message_id as j from links join x on x.class_id = links.a join x y on y.class_id = links.b union all select x.message_id, y.message_id from x join x y using (class_id))
select distinct least(i, j) as message_id_a, greatest(i, j) as message_id_b from p where i <> j"""

P6_GROUPS = f"""with recursive {_WORDS6}, e as (select a as u, b as v from links union all select b, a from links),
reach(u, v) as (select class_id, class_id from r union select reach.u, e.v from reach join e on e.u = reach.v),
g as (select u as class_id, min(v) as group_id from reach group by 1)
select s.message_id, r.class_id, g.group_id, coalesce((select count(*) from e where e.u = r.class_id), 0) as n_links from s join r using (ws) join g on g.class_id = r.class_id"""

# ---------------------------------------------------------------- containers

P8_WHOLE = "select limit_name, doc_id, true as covered, true as unsplit, true as within from documents, (select limit_name from packing_limits where limit_name is not null and capacity_tokens > 0 group by 1) where doc_id is not null"

# ---------------------------------------------------------------- leaked passages

_SPLIT = "list_filter(regexp_split_to_array(lower(text), '[\\s\\x{0085}\\x{2028}\\x{2029}]+'), lambda w: regexp_matches(w, '[\\pL\\pM\\pN]'))"
_RUNS = "array_to_string(list_transform({0}, lambda w: array_to_string(regexp_extract_all(w, '[\\pL\\pM\\pN]+'), ' ')), ' ')"

P9_RUNS = f"""with d as (select row_number() over () as n, doc_id, text from documents), i as (select row_number() over () as n, item_id, text from eval_items),
{one_form("d", "df", "n", "text")}, {one_form("i", "nf", "n", "text")},
dw as (select n, regexp_extract_all(lower(text), '[\\pL\\pM\\pN]+') as ws from df),
dt as (select n, ws, ' ' || array_to_string(ws, ' ') || ' ' as t from dw),
iw as (select n, {_SPLIT} as ws from nf),
spans as (select distinct n, {_RUNS.format("list_slice(ws, pos, pos + 15)")} as span from (select n, ws, unnest(range(1, len(ws) - 14)) as pos from iw where len(ws) >= 16)),
heads as (select distinct array_to_string(list_slice(string_split(span, ' '), 1, 5), ' ') as head, n, span from spans),
hits as (select distinct n, array_to_string(list_slice(ws, pos, pos + 4), ' ') as head from (select n, ws, unnest(range(1, len(ws) - 3)) as pos from dw))
select distinct d.doc_id, i.item_id from hits join heads using (head) join dt on dt.n = hits.n and contains(dt.t, ' ' || heads.span || ' ') join d on d.n = hits.n join i on i.n = heads.n"""

ORACLES = {"p6_found": P6_FOUND, "p6_groups": P6_GROUPS, "p8_whole": P8_WHOLE, "p9_runs": P9_RUNS}
