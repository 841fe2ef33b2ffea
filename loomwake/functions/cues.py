"""How many patterns of each cue group a text matches, with one pass for all 113 of them.

Every pattern needs one of some literal words; these are read off the patterns themselves. One
keyword automaton goes over a text and tells which patterns can match at all; only those are tried.
"""

from __future__ import annotations

import re
from functools import lru_cache
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomwake.functions.patterns import CUES

#: Most spellings a part of a pattern may have to count as literal words.
SPELLINGS = 256


def _spellings(node) -> set[str] | None:
    """All strings a part matches in normalised text, where blanks are single; None if too many or unknown."""
    op, arg = str(node[0]), node[1]
    if op == "LITERAL":
        return {chr(arg)}
    if op == "AT":
        return {""}
    if op == "IN":
        if all(str(o) == "LITERAL" for o, _ in arg):
            return {chr(c) for _, c in arg}
        return {" "} if len(arg) == 1 and str(arg[0][1]) == "CATEGORY_SPACE" else None
    if op == "SUBPATTERN":
        return _joined(arg[3])
    if op == "BRANCH":
        each = [_joined(b) for b in arg[1]]
        return None if None in each else set().union(*each)
    if op in ("MAX_REPEAT", "MIN_REPEAT"):
        low, high, part = arg
        one = _joined(part)
        if one == {" "}:
            return {" "} if low else {"", " "}
        if one is not None and high == 1:
            return one | {""} if low == 0 else one
    return None


def _joined(part) -> set[str] | None:
    out = {""}
    for node in part:
        one = _spellings(node)
        if one is None or len(out) * len(one) > SPELLINGS:
            return None
        out = {a + b for a, b in product(out, one)}
    return out


def needed(part) -> set[str] | None:
    """Words of which every match holds one: the best of the pattern's runs and parts; None if there are none."""
    found: list[set[str]] = []
    run = {""}
    for node in [*part, None]:
        one = _spellings(node) if node is not None else None
        if one is not None and len(run) * len(one) <= SPELLINGS:
            run = {a + b for a, b in product(run, one)}
            continue
        found.append(run)
        run = one or {""}
        if node is None or one is not None:
            continue
        op, arg = str(node[0]), node[1]
        inner = None
        if op == "SUBPATTERN":
            inner = needed(arg[3])
        elif op in ("MAX_REPEAT", "MIN_REPEAT") and arg[0] > 0:
            inner = needed(arg[2])
        elif op == "BRANCH":
            each = [needed(b) for b in arg[1]]
            inner = None if None in each else set().union(*each)
        if inner:
            found.append(inner)
    found = [x for x in found if "" not in x]
    return max(found, key=lambda x: (min(map(len, x)), -len(x)), default=None)


class Scanner:
    """The patterns of some groups and the automaton that gates them."""

    def __init__(self, groups: tuple[str, ...]):
        import ahocorasick

        self.patterns = [(k, re.compile(p, re.IGNORECASE)) for k, g in enumerate(groups) for p in CUES[g]]
        self.always, words = 0, {}
        for i, (_, p) in enumerate(self.patterns):
            for w in needed(re._parser.parse(p.pattern)) or ():
                words[w] = words.get(w, 0) | 1 << i
            if not needed(re._parser.parse(p.pattern)):
                self.always |= 1 << i
        self.n, self.automaton = len(groups), ahocorasick.Automaton()
        for w, bits in words.items():
            self.automaton.add_word(w, bits)
        self.automaton.make_automaton()

    def counts(self, texts: list[str | None]) -> np.ndarray:
        out = np.zeros((self.n, len(texts)), np.int32)
        for row, t in enumerate(texts):
            if not t:
                continue
            gate = self.always
            for _, bits in self.automaton.iter(t):
                gate |= bits
            while gate:
                low = gate & -gate
                group, pattern = self.patterns[low.bit_length() - 1]
                out[group, row] += pattern.search(t) is not None
                gate ^= low
        return out


@lru_cache(4)
def scanner(groups: tuple[str, ...]) -> Scanner:
    return Scanner(groups)


def cue_counts(c: Column | str, groups: tuple[str, ...] = tuple(CUES)) -> Column:
    """Struct of how many patterns of each group match (not how often). The text must be normalised; null has none."""
    groups = tuple(groups)

    @F.arrow_udf(T.StructType([T.StructField(g, T.IntegerType()) for g in groups]))
    def run(texts: pa.Array) -> pa.Array:
        return pa.StructArray.from_arrays([pa.array(x) for x in scanner(groups).counts(texts.to_pylist())], list(groups))

    return run(F.col(c) if isinstance(c, str) else c)
