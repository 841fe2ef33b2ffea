"""Text forms in SQL, for the queries' SQL equivalents."""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache


def quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


@lru_cache(1)
def _folded() -> str:
    """Rows (character, its compatibility form in folded case) of all characters that change, by the Unicode database."""
    rows = []
    for c in range(0x30000):
        x = chr(c)
        if c < 0x80 and not x.isupper() or unicodedata.category(x) in ("Cn", "Cs", "Co"):
            continue
        y = unicodedata.normalize("NFKC", x).casefold()
        if y != x:
            rows.append(f"({quoted(x)},{quoted(y)})")
    return ",".join(rows)


def normal_form(source: str, name: str = "nf", key: str = "message_id", text: str = "message_text") -> str:
    """A CTE ``name`` (``key``, ``text``): compatibility form, folded case, no format characters, single blanks.

    Characters are folded one by one through a table and composed again as a whole text.
    """
    blanks = r"[\s\x0B\x1C-\x1F\x{0085}\x{1680}\x{2028}\x{2029}]+"
    return f"""{name}_map(a, b) as (values {_folded()}),
{name}_raw as (select {key}, coalesce({text}, '') as t from {source}),
{name}_rich as (select {key}, string_agg(coalesce({name}_map.b, ch), '' order by i) as t from (select {key}, i, substring(t, i, 1) as ch from (select {key}, t, unnest(range(1, length(t) + 1)) as i from {name}_raw where regexp_matches(t, '[^\\x00-\\x7F]')))
  left join {name}_map on {name}_map.a = ch group by 1),
{name} as (select {key}, trim(regexp_replace(regexp_replace(nfc_normalize(coalesce(r.t, lower(w.t))), '\\p{{Cf}}', '', 'g'), '{blanks}', ' ', 'g'), ' ') as text from {name}_raw w left join {name}_rich r using ({key}))"""


def ascii_words(text: str) -> str:
    """Text in which letters and digits outside ASCII are written with capitals and zeros, which texts in small letters lack.

    So word ends are where Unicode has them, in an engine that knows only ASCII ones.
    """
    out = f"regexp_replace(replace({text}, 'é', 'E'), '[^\\P{{Nd}}0-9]', '0', 'g')"
    for kind in "NL":
        out = f"regexp_replace({out}, '[^\\P{{{kind}}}\\x00-\\x7F]', 'X', 'g')"
    return out


def ascii_pattern(pattern: str) -> str:
    """A cue pattern for texts of ``ascii_words``."""
    return re.sub("é", "E", pattern)
