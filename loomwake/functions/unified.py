"""Compatibility form of texts, a whole Arrow batch at a time."""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import pyarrow as pa

#: A noncharacter that parts the texts of a batch while they are worked on as one.
_GAP = "￿"


@lru_cache(1)
def _format_signs() -> re.Pattern:
    """Format characters and surrogates."""
    return re.compile("[" + "".join(re.escape(chr(c)) for c in (*range(0x20000), *range(0xE0000, 0xE1000)) if unicodedata.category(chr(c)) in ("Cf", "Cs")) + "]")


def compatible(a: pa.Array) -> pa.Array:
    """NFKC, folded case, no format characters, single blanks, none at the ends; null stays null.

    The batch is one string meanwhile, so each step is one call however many texts there are.
    """
    texts = a.to_pylist()
    joined = _GAP.join(t or "" for t in texts)
    if joined.count(_GAP) >= max(len(texts), 1):  # a text holds the noncharacter itself
        done = [_one(t or "") for t in texts]
    else:
        done = _one(joined).split(_GAP)
        done = [t.strip() for t in done]
    return pa.array([None if t is None else x for t, x in zip(texts, done)], pa.string())


def _one(text: str) -> str:
    text = _format_signs().sub("", unicodedata.normalize("NFKC", text).casefold())
    return re.sub(r"\s+", " ", text).strip(" ")
