"""Text columns: cleaning, normalisation, tokens, cues, links, hosts, JSON."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomwake.functions.cues import cue_counts
from loomwake.functions.patterns import BARE_HOST_ENDINGS, CUES, STOP_WORDS
from loomwake.functions.unified import compatible

CONTROLS = r"[\x00-\x08\x0B\x0C\x0E-\x1F]"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, f) -> Column:
    """``f`` of a value that is computed once, however often ``f`` uses it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def clean(c: Column | str) -> Column:
    """Never null; without control characters other than line breaks and tabs, and without outer blanks."""
    return F.regexp_replace(F.regexp_replace(F.coalesce(col(c), F.lit("")), CONTROLS, ""), r"(?U)^\s+|\s+$", "")


def boolean(c: Column | str) -> Column:
    """``1 true yes y`` and ``0 false no n`` or nothing; anything else is null."""
    low = F.lower(F.trim(F.coalesce(col(c).cast("string"), F.lit(""))))
    return F.when(low.isin("1", "true", "yes", "y"), F.lit(True)).when(low.isin("", "0", "false", "no", "n"), F.lit(False))


def count_number(c: Column | str) -> Column:
    """A whole number of at least 0: nothing is 0, more than an int holds is cut, anything else null."""
    text = F.trim(F.coalesce(col(c).cast("string"), F.lit("")))
    n = text.try_cast("bigint")
    return F.when(text == "", F.lit(0)).when(n >= 0, F.least(n, F.lit(2**31 - 1)).cast("int"))


@F.arrow_udf(T.StringType())
def _compatible(texts: pa.Array) -> pa.Array:
    return compatible(texts)


def normalize(c: Column | str) -> Column:
    """Compatibility form, folded case, no format characters, single blanks; of the whole text, however long.

    ASCII text stays in the JVM; only other text is sent to Python.
    """
    t = F.coalesce(col(c), F.lit(""))
    ascii_only = F.trim(F.regexp_replace(F.lower(t), r"(?U)\s+", " "))
    plain = t.rlike(r"^\p{ASCII}*$")
    return F.when(plain, ascii_only).otherwise(_compatible(F.when(~plain, t)))


def tokens(c: Column | str) -> Column:
    """Distinct words of at least two letters or digits that are not too common, in order."""
    found = F.regexp_extract_all(col(c), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1))
    return F.array_distinct(F.filter(found, lambda w: (F.length(w) >= 2) & ~w.isin(*STOP_WORDS)))


def _matches(c: Column, pattern: str) -> Column:
    """The patterns are in small letters, as is normalised text; letters and word ends are taken by
    Unicode only where the text needs it, which is far slower."""
    return F.when(c.rlike(r"^\p{ASCII}*$"), c.rlike(pattern)).otherwise(c.rlike(f"(?U){pattern}"))


def cue_count(c: Column | str, group: str) -> Column:
    """How many patterns of a cue group the text matches. The text must be normalised."""
    return F.coalesce(cue_counts(col(c), (group,))[group], F.lit(0))


def has_cue(c: Column | str, group: str) -> Column:
    """Whether any pattern of a cue group matches. The text must be normalised, or in small letters."""
    return _matches(col(c), "(?:" + "|".join(f"(?:{p})" for p in CUES[group]) + ")")


# What a link or a bare host name looks like in a text.
_HOST = rf"(?:[a-z0-9](?:[a-z0-9-]{{0,61}}[a-z0-9])?\.)+(?:{'|'.join(BARE_HOST_ENDINGS)})(?:/[^\s<>()\[\]{{}}]*)?"
URL = rf"(?i)(?:^|[^@\w])((?:https?://|www\.)[^\s<>()\[\]{{}}]+|{_HOST})"


def urls(c: Column | str) -> Column:
    """Links and bare host names in the text, without closing punctuation."""
    return F.transform(F.regexp_extract_all(col(c), F.lit(URL), F.lit(1)), lambda u: F.regexp_replace(u, r"[.,;:!?')\"]+$", ""))


_HOST_FORM = r"^[^\s.]+(\.[^\s.]+)+$"


def _bare_host(c: Column | str) -> Column:
    bare = F.regexp_replace(F.lower(F.regexp_replace(col(c), r"(?U)^\s+|\s+$", "")), r"^[a-z][a-z0-9+.-]*://", "")
    bare = F.regexp_replace(F.regexp_replace(bare, r"[/?#].*$", ""), r"^[^@]*@|:\d*$", "")
    return F.regexp_replace(F.regexp_replace(bare, r"\.+$", ""), r"^www\.", "")


def host(c: Column | str) -> Column:
    """The host of a link or name: lower case, no scheme, user, port, path, final dot or leading ``www.``; null if none."""
    bare = _bare_host(c)
    return F.when(bare.rlike(_HOST_FORM), bare)


@F.arrow_udf(T.StringType())
def _ascii_host(hosts: pa.Array) -> pa.Array:
    def one(h: str | None) -> str | None:
        try:
            return h and h.encode("idna").decode("ascii")
        except UnicodeError:
            return None

    return pa.array([one(h) for h in hosts.to_pylist()], pa.string())


def ascii_host(c: Column | str) -> Column:
    """``host`` in its ASCII (IDNA) form; null if it has none. Hosts in ASCII stay in the JVM."""
    h = _bare_host(c)
    plain = h.rlike(r"^\p{ASCII}*$")
    h = F.when(plain, h).otherwise(_ascii_host(F.when(~plain, h)))
    return F.when(h.rlike(_HOST_FORM), h)


def hosts(c: Column | str) -> Column:
    """Distinct hosts the text shows, in order."""
    return F.array_distinct(F.filter(F.transform(urls(c), host), lambda h: h.isNotNull()))


def host_within(inner: Column | str, outer: Column | str) -> Column:
    """The host is the other or one of its subdomains."""
    i, o = col(inner), col(outer)
    return (i == o) | F.endswith(i, F.concat(F.lit("."), o))


def mentions(c: Column | str, user: Column | str) -> Column:
    """The text addresses this user by ``@`` and the whole name."""
    return F.regexp(col(c), F.concat(F.lit(r"(?iuU)(?<![\w@])@\Q"), F.lower(col(user)), F.lit(r"\E(?!\w)")))


def in_window(at: Column | str, window: Column | str) -> Column:
    """Whether a time of day lies in a half-open ``HH:MM-HH:MM`` window, which may pass midnight.

    Equal ends mean always; a malformed window or a null time never.
    """
    w, t = F.trim(col(window)), col(at)
    part = lambda i: F.regexp_extract(w, r"^([01]?\d|2[0-3]):([0-5]\d)\s*-\s*([01]?\d|2[0-3]):([0-5]\d)$", i).try_cast("int")
    a, b = part(1) * 60 + part(2), part(3) * 60 + part(4)
    m = F.hour(t) * 60 + F.minute(t)
    inside = F.when(a == b, F.lit(True)).when(a < b, (m >= a) & (m < b)).otherwise((m >= a) | (m < b))
    return F.coalesce(inside, F.lit(False))


def ratio(a: Column | str, b: Column | str, default: float = 0.0) -> Column:
    return F.when(col(b) > 0, col(a) / col(b)).otherwise(F.lit(default))


def clamp(c: Column | str, low: float = 0.0, high: float = 1.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), col(c)))


def not_after(a: Column | str, b: Column | str) -> Column:
    """``a <= b``, and true where either is unknown."""
    return F.coalesce(col(a) <= col(b), F.lit(True))


def content(text: Column | str, media: Column | str) -> Column:
    """The text and the media's content on lines of their own, or whichever there is."""
    return F.concat_ws("\n", F.nullif(col(text), F.lit("")), F.nullif(col(media), F.lit("")))


def bounded_signals(c: Column | str, most: int = 24, chars: int = 200) -> Column:
    """Distinct non-empty entries of a list, without controls, cut to a length and a number."""
    cleaned = F.transform(col(c), lambda s: F.substring(F.trim(F.regexp_replace(s, r"[\x00-\x1F\x7F]+", " ")), 1, chars))
    return F.slice(F.array_distinct(F.filter(cleaned, lambda s: s != "")), 1, most)


FACTS = "summary string, visible_text string, transcript string, signals array<string>"


def facts_text(c: Column | str) -> Column:
    """Readable text of a media-facts JSON object behind any prefix line: its texts and signals, one a line."""
    j = F.from_json(F.regexp_extract(col(c), r"(?s)(\{.*\})", 1), FACTS)
    return F.concat_ws("\n", F.nullif(j["summary"], F.lit("")), F.nullif(j["visible_text"], F.lit("")), F.nullif(j["transcript"], F.lit("")), F.nullif(F.array_join(bounded_signals(j["signals"]), "\n"), F.lit("")))


def facts_wrapper(prefix: str, **fields: Column) -> Column:
    """Media facts as one text: a prefix and a JSON object with its keys in order; null fields are left out."""
    return F.concat(F.lit(prefix), F.to_json(F.struct(*[fields[k].alias(k) for k in sorted(fields)])))


def facts_normalized(c: Column | str, chars: int = 4_000) -> Column:
    """A struct of bounded facts from a strict JSON object: texts cut and cleaned, confidence within 0 and 1; null if it is none."""
    text = lambda x: F.substring(F.trim(F.regexp_replace(F.coalesce(x, F.lit("")), r"[\x00-\x1F\x7F]+", " ")), 1, chars)
    made = lambda j: F.struct(*[text(j[k]).alias(k) for k in ("summary", "visible_text", "transcript", "language")], F.coalesce(bounded_signals(j["signals"]), F.array().cast("array<string>")).alias("signals"), clamp(F.coalesce(j["confidence"], F.lit(0.0))).alias("confidence"))
    of = lambda doc: F.when(doc.rlike(r"(?s)^\{.*\}$"), let(F.from_json(doc, FACTS + ", language string, confidence double"), made))
    return let(strict_json(c), of)


#: Bounds of a JSON document: characters, levels below the top, values.
JSON_CHARS, JSON_DEPTH, JSON_NODES = 128_000, 20, 5_000


def _json_nodes(bare: Column) -> Column:
    """Values in a valid document without its strings: itself, and what its lists and objects hold."""
    filled = F.regexp_count(bare, F.lit(r"[\[{]")) - F.regexp_count(bare, F.lit(r"\[\s*\]|\{\s*\}"))
    return F.lit(1) + F.regexp_count(bare, F.lit(",")) + filled


def _json_deeper(bare: Column, levels: int) -> Column:
    """Whether a valid document, without its strings, has a value more than so many levels below the top.

    Lists and objects that hold nothing further are replaced by a number, level by level.
    """
    flat = F.regexp_replace(bare, r"\[\s*\]|\{\s*\}", "0")
    for _ in range(levels):
        flat = F.regexp_replace(flat, r"\[[^\[\]{}]*\]|\{[^\[\]{}]*\}", "0")
    return F.when(F.regexp_count(bare, F.lit(r"[\[{]")) <= levels, F.lit(False)).otherwise(flat.rlike(r"[\[{]"))


def _without_strings(doc: Column) -> Column:
    return F.regexp_replace(doc, r'(?s)"[^"\\]*+(?:\\.[^"\\]*+)*+"', '""')


def strict_json(c: Column | str, chars: int = JSON_CHARS, depth: int = JSON_DEPTH, nodes: int = JSON_NODES) -> Column:
    """A JSON document, tolerating one code fence; null for prose, repeated keys, non-finite numbers and documents too long, deep or full."""
    blanks = r"^\s+|\s+$"

    def fenced(t: Column) -> Column:
        body = F.regexp_replace(F.regexp_extract(t, r"(?si)^```(?:json)?[ \t]*\n(.*)\n```$", 1), blanks, "")
        return F.when(F.length(t) <= chars, F.when(F.startswith(t, F.lit("```")), body).otherwise(t))

    def checked(doc: Column, bare: Column) -> Column:
        whole = doc.rlike(r'(?s)^(\{.*\}|\[.*\]|".*"|-?\d+(\.\d+)?([eE][+-]?\d+)?|true|false|null)$') & ~bare.rlike(r"NaN|Infinity")
        # the parser ignores what follows a value, but nothing can follow one both in a list and in an object
        alone = F.try_parse_json(F.concat(F.lit("["), doc, F.lit("]"))).isNotNull() & F.try_parse_json(F.concat(F.lit('{"":'), doc, F.lit("}"))).isNotNull()
        return F.when(whole & alone & (_json_nodes(bare) <= nodes) & ~_json_deeper(bare, depth), doc)

    text = F.regexp_replace(F.regexp_replace(col(c), "^\\ufeff", ""), blanks, "")
    return let(let(text, fenced), lambda doc: let(_without_strings(doc), lambda bare: checked(doc, bare)))


# What keys and tokens look like, by kind.
SECRETS = {
    "live_key": r"\b[a-z]{2,8}_live_[A-Za-z0-9_-]{16,}",
    "service_key": r"sk-[A-Za-z0-9_-]{20,}",
    "forge_token": r"gh[pousr]_[A-Za-z0-9]{20,}",
    "cloud_key": r"(?:AKIA|ASIA)[A-Z0-9]{16}",
    "private_key": r"-----BEGIN (?:RSA |EC |OPENSSH )?PRIVATE KEY-----",
}


def secrets(c: Column | str) -> Column:
    """Kinds of keys and tokens the text shows, in the order of ``SECRETS``."""
    return F.array_compact(F.array(*[F.when(col(c).rlike(p), F.lit(k)) for k, p in SECRETS.items()]))
