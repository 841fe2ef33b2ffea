"""One form for visually identical text, computed on code-point arrays.

Arrow text is copied to one array of code points per batch. Lookup tables say what each code
point becomes; expansion offsets lay out replacements of any length; marks are put in order and
composed pass by pass over the whole array. Strings are touched once per batch, never per row.
"""

from __future__ import annotations

import unicodedata as U
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401

#: Kinds of variants a text can have, as bits.
COMPATIBILITY, COMBINING, INVISIBLE, SPACE, MIXED = 1, 2, 4, 8, 16
KINDS = {"compatibility": COMPATIBILITY, "combining": COMBINING, "invisible": INVISIBLE, "space": SPACE, "mixed_script": MIXED}

#: Code points from here on hold no letters or marks that need a table (tags and selectors apart).
TOP = 0x30000
#: Texts of a batch are worked on in slices of about so many code points, so that arrays stay in the cache.
SLICE = 1 << 18

# Letters that look alike. Each string holds Latin letters and, below them, the
# letters of the other script with the same shape.
ALIKE = {
    "CYRILLIC": ("aceopxysijhdqwABCEHIJKMOPSTXYFv", "асеорхуѕіјһԁԛԝАВСЕНІЈКМОРЅТХУҒѵ"),
    "GREEK": ("aoviupcyABEHIKMNOPTXYZnk", "αονιυρϲγΑΒΕΗΙΚΜΝΟΡΤΧΥΖηκ"),
}
#: Scripts told apart in words. Others count as one more script, but those written together don't.
_SCRIPTS = {"LATIN": 1, "CYRILLIC": 2, "GREEK": 3}
_TOGETHER = ("CJK", "HIRAGANA", "KATAKANA", "HANGUL", "BOPOMOFO", "KATAKANA-HIRAGANA", "HALFWIDTH", "IDEOGRAPHIC")
_ZWNJ, _ZWJ, _VS15, _VS16, _NUKTA = 0x200C, 0x200D, 0xFE0E, 0xFE0F, 0x093C


class Tables:
    """Lookup tables, built from the interpreter's Unicode database."""

    def __init__(self) -> None:
        self.ccc = np.zeros(TOP, np.uint8)
        self.script = np.zeros(TOP, np.uint8)
        self.word = np.zeros(TOP, bool)
        self.drop = np.zeros(TOP, bool)
        self.space = np.zeros(TOP, bool)
        self.pictorial = np.zeros(TOP, bool)
        self.virama = np.zeros(TOP, bool)
        self.compat = np.zeros(TOP, bool)
        length, into = np.ones(TOP, np.uint8), {}
        pairs: dict[int, int] = {}
        scripts = dict(_SCRIPTS)
        for c in range(TOP):
            if 0x3400 <= c < 0xA000 or 0xAC00 <= c < 0xE000 or 0xE000 <= c < 0xF900 or 0x17000 <= c < 0x1B000 or c >= 0x20000 and c < 0x2F800:
                if c < 0xD7A4:
                    self.word[c] = True
                continue
            s = chr(c)
            kind = U.category(s)
            if kind == "Cn":
                continue
            if kind[0] == "M":
                self.ccc[c] = U.combining(s)
                self.virama[c] = self.ccc[c] == 9
            if kind[0] in "LMN":
                self.word[c] = True
            if kind[0] == "L":
                first = U.name(s, "").split(" ", 1)[0]
                if first not in _TOGETHER and kind != "Lm":
                    self.script[c] = scripts.setdefault(first, min(len(scripts) + 1, 255))
            self.drop[c] = kind == "Cf" or c in (0x034F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x3164, 0xFFA0) or 0xFE00 <= c <= 0xFE0F or 0x180B <= c <= 0x180F
            self.space[c] = kind == "Zs" and c != 0x20
            self.pictorial[c] = kind in ("So", "Sk") and c > 0xFF
            d = U.decomposition(s)
            if d and not self.drop[c] and not self.space[c]:
                full = U.normalize("NFKD", s)
                length[c], into[c] = len(full), full
                self.compat[c] = d[0] == "<"
                parts = d.split()
                if d[0] != "<" and len(parts) == 2 and U.normalize("NFC", full) == s:
                    pairs[int(parts[0], 16) << 21 | int(parts[1], 16)] = c
        for c in (0x0600, 0x0601, 0x0602, 0x0603, 0x0604, 0x0605, 0x06DD, 0x070F, 0x08E2, 0x110BD):  # visible format signs
            self.drop[c] = False
        self.pictorial[[0x203C, 0x2049, 0x3030, 0x303D, *range(0x2190, 0x2200), *range(0x25A0, 0x2600)]] = True
        self.pictorial[0x1F3FB:0x1F400] = True
        self.length, self.start, self.expands = length, np.zeros(TOP, np.uint32), np.zeros(TOP, bool)
        self.expands[list(into)] = True
        pool: list[int] = []
        for c, full in into.items():
            self.start[c] = len(pool)
            pool += map(ord, full)
        self.pool = np.array(pool or [0], np.uint32)
        self.second = np.zeros(TOP, bool)
        self.second[[k & 0x1FFFFF for k in pairs]] = True
        self.second[[*range(0x1161, 0x1176), *range(0x11A8, 0x11C3)]] = True
        # what stays as it is next to anything: no form of another, no mark, nothing that joins what stands before it
        self.stable = ~(self.drop | self.space | self.second | (self.ccc > 0))
        self.stable[[c for c, full in into.items() if U.normalize("NFKC", chr(c)) != chr(c)]] = False
        # per code point as bits: may change, is Latin, Cyrillic, Greek, of another script
        self.traits = (~self.stable).astype(np.uint8) | np.select([self.script == 1, self.script == 2, self.script == 3, self.script > 3], [2, 4, 8, 16], 0).astype(np.uint8)
        self.pair_keys = np.array(sorted(pairs), np.uint64)
        self.pair_to = np.array([pairs[k] for k in sorted(pairs)], np.uint32)
        self.alike = np.zeros((4, TOP), np.uint32)  # per target script: the look-alike, or 0
        for name, (latin, other) in ALIKE.items():
            for a, b in zip(latin, other):
                self.alike[1, ord(b)] = ord(a)
                self.alike[scripts[name], ord(a)] = ord(b)


@lru_cache(1)
def tables() -> Tables:
    return Tables()


def code_points(a: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts end to end, and the n+1 offsets of the texts; null is empty."""
    a = a.cast(pa.large_string()).fill_null("") if not pa.types.is_large_string(a.type) or a.null_count else a
    offsets = np.frombuffer(a.buffers()[1], np.int64)[a.offset : a.offset + len(a) + 1] if len(a) else np.zeros(1, np.int64)
    raw = np.frombuffer(a.buffers()[2], np.uint8)[offsets[0] : offsets[-1]] if len(a) and a.buffers()[2] is not None else np.zeros(0, np.uint8)
    try:
        cp = np.frombuffer(raw.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    except UnicodeDecodeError:  # broken bytes become the replacement character
        fixed = [raw[i - offsets[0] : j - offsets[0]].tobytes().decode("utf-8", "replace") for i, j in zip(offsets, offsets[1:])]
        return code_points(pa.array(fixed, pa.large_string()))
    starts = np.zeros(len(raw) + 1, np.int64)
    np.cumsum((raw & 0xC0) != 0x80, out=starts[1:])
    return cp, starts[offsets - offsets[0]]


def take(cp: np.ndarray, off: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points and offsets of some of the texts."""
    sizes = np.diff(off)[rows]
    new = np.concatenate(([0], np.cumsum(sizes)))
    return cp[np.repeat(off[rows] - new[:-1], sizes) + np.arange(new[-1])], new


def to_arrow(cp: np.ndarray, off: np.ndarray) -> pa.Array:
    """The texts again."""
    width = np.zeros(len(cp) + 1, np.int64)
    np.cumsum(1 + (cp >= 0x80).astype(np.int8) + (cp >= 0x800) + (cp >= 0x10000), out=width[1:])
    data = cp.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass").encode("utf-8", "surrogatepass")
    return pa.LargeStringArray.from_buffers(len(off) - 1, pa.py_buffer(width[off].astype(np.int64).tobytes()), pa.py_buffer(data))


def _at(table: np.ndarray, cp: np.ndarray) -> np.ndarray:
    return table[np.minimum(cp, TOP - 1)]


def _keep(cp: np.ndarray, off: np.ndarray, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    total = np.zeros(len(cp) + 1, np.int64)
    np.cumsum(keep, out=total[1:])
    return cp[keep], total[off]


def _neighbours(cp: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The code point before and after each, 0 at the ends of a text."""
    before, after = np.zeros_like(cp), np.zeros_like(cp)
    before[1:], after[:-1] = cp[:-1], cp[1:]
    before[off[:-1][off[:-1] < len(cp)]] = 0
    after[off[1:][off[1:] > 0] - 1] = 0
    return before, after


def canonical(cp: np.ndarray, off: np.ndarray, all_latin: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The one form of each text: code points, offsets, and the kinds of variants it had.

    ``all_latin`` maps look-alike letters to Latin in every word, as for host names; else only
    in words that mix scripts, to the script that can write the whole word.
    """
    t, n = tables(), len(off) - 1
    kinds = np.zeros(n, np.uint8)
    row = np.repeat(np.arange(n), np.diff(off))

    def mark(where: np.ndarray, bit: int) -> None:
        kinds[row[where]] |= bit

    # 1. invisible characters, spaces
    drop = _at(t.drop, cp) | ((cp >= 0xE0000) & (cp < 0xE1000))
    if drop.any():
        before, after = _neighbours(cp, off)
        picture = lambda x: _at(t.pictorial, x) | (x == _VS16)
        emoji = (cp == _ZWJ) & picture(before) & _at(t.pictorial, after)
        digit = ((before >= 0x30) & (before <= 0x39)) | (before == 0x23) | (before == 0x2A) | (before == 0xA9) | (before == 0xAE)
        styled = ((cp == _VS16) | (cp == _VS15)) & (_at(t.pictorial, before) | (digit & ((after == 0x20E3) | (before > 0x7F))))
        flag = (cp >= 0xE0020) & (cp <= 0xE007F) & (_at(t.pictorial, before) | ((before >= 0xE0020) & (before <= 0xE007F)))
        indic = ((cp == _ZWJ) | (cp == _ZWNJ)) & _at(t.virama, before) & (_at(t.script, after) > 3)
        arabic = (cp == _ZWNJ) & (before >= 0x600) & (before < 0x780) & (after >= 0x600) & (after < 0x780)
        drop &= ~(emoji | styled | flag | indic | arabic)
        mark(drop, INVISIBLE)
        cp, off = _keep(cp, off, ~drop)
        row = row[~drop]
    blank = _at(t.space, cp)
    if blank.any():
        mark(blank, SPACE)
        cp = np.where(blank, np.uint32(0x20), cp)
    # 2. expansion by offsets
    size = _at(t.length, cp).astype(np.int64)
    changed = _at(t.expands, cp) & (cp < TOP)
    if changed.any():
        _, after = _neighbours(cp, off)
        changed &= ~((after == _VS16) & _at(t.pictorial, cp))
        size = np.where(changed, size, 1)
        mark(changed & _at(t.compat, cp), COMPATIBILITY)
        ends = np.cumsum(size)
        src = np.repeat(np.arange(len(cp)), size)
        step = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - size, size)
        out = np.where(changed[src], t.pool[np.where(changed[src], _at(t.start, cp)[src] + step, 0)], cp[src]).astype(np.uint32)
        own = ~changed[src]
        off = np.concatenate(([0], ends))[off]
        cp, row = out, row[src]
    else:
        own = np.ones(len(cp), bool)
    # 3. words that mix scripts
    cp = _one_script(t, cp, off, row, mark, all_latin)
    # 4. order of marks, composition
    ccc = _at(t.ccc, cp)
    prev = np.concatenate(([0], ccc[:-1])) if len(ccc) else ccc
    if len(cp) and ((ccc > 0) & (prev > ccc)).any():
        seg = np.cumsum(ccc == 0) + row * 2
        order = np.lexsort((ccc, seg))
        cp, ccc, own = cp[order], ccc[order], own[order]
    cp, off, own_composed, row_composed = _compose(t, cp, off, row, own)
    kinds[row_composed[own_composed]] |= COMBINING
    return cp, off, kinds


def _one_script(t: Tables, cp: np.ndarray, off: np.ndarray, row: np.ndarray, mark, all_latin: bool) -> np.ndarray:
    script = _at(t.script, cp)
    if all_latin:
        to = _at(t.alike[1], cp)
        if (m := to > 0).any():
            mark(m, MIXED)
            cp = np.where(m, to, cp)
        return cp
    if not len(cp) or len(np.unique(script[script > 0])) < 2:
        return cp
    inside = _at(t.word, cp)
    new = inside.copy()
    new[1:] &= ~inside[:-1]
    first = off[:-1][off[:-1] < len(cp)]
    new[first] |= inside[first]
    run = np.cumsum(new) - 1  # of a position inside a word
    at = np.flatnonzero(inside & (script > 0))
    if not len(at):
        return cp
    r, s = run[at], script[at]
    cut = np.flatnonzero(np.concatenate(([True], r[1:] != r[:-1])))
    lo, hi = np.minimum.reduceat(s, cut), np.maximum.reduceat(s, cut)
    mixed = lo != hi
    if not mixed.any():
        return cp
    group = np.repeat(np.arange(len(cut)), np.diff(np.append(cut, len(at))))
    m = mixed[group]
    at, g, s = at[m], group[m], s[m]
    mark(at, MIXED)
    letters = cp[at]
    total = len(cut)
    cyrillic = np.bincount(row[np.flatnonzero(script == 2)], minlength=int(row[-1]) + 1) * 2 > np.bincount(row[np.flatnonzero(script > 0)], minlength=int(row[-1]) + 1)
    word_row = np.zeros(total, np.int64)
    word_row[g] = row[at]
    best, target = np.full(total, -np.inf), np.ones(total, np.int64)
    for k in (1, 2, 3):
        native = np.bincount(g, s == k, total)
        foreign = np.bincount(g, (s != k) & (t.alike[k][letters] == 0), total)
        score = native + 0.5 * ((k == 2) == cyrillic[word_row]) * (k < 3) - 1000.0 * foreign
        better = (score > best) & (native > 0)
        best, target = np.where(better, score, best), np.where(better, k, target)
    to = t.alike[target[g], letters]
    swap = (s != target[g]) & (to > 0)
    cp = cp.copy()
    cp[at[swap]] = to[swap]
    return cp


def _compose(t: Tables, cp: np.ndarray, off: np.ndarray, row: np.ndarray, own: np.ndarray):
    """Pairs that have one letter become it; returns also which of them came from marks of the text."""
    done_own, done_row = [], []
    keys = t.pair_keys
    while len(cp):
        ccc = _at(t.ccc, cp)
        mark = np.flatnonzero((ccc > 0) | _at(t.second, cp))
        if not len(mark):
            break
        starter = np.maximum.accumulate(np.where(ccc == 0, np.arange(len(cp)), -1))[np.maximum(mark - 1, 0)]
        ok = (starter >= 0) & (starter < mark) & (row[np.maximum(starter, 0)] == row[mark])
        ok &= (starter == mark - 1) | ((ccc[mark - 1] < ccc[mark]) & (ccc[mark] > 0))
        mark, starter = mark[ok], starter[ok]
        a, b = cp[starter], cp[mark]
        key = a.astype(np.uint64) << np.uint64(21) | b.astype(np.uint64)
        pos = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
        to = np.where(keys[pos] == key, t.pair_to[pos], 0)
        to = np.where((a >= 0x1100) & (a < 0x1113) & (b >= 0x1161) & (b < 0x1176), 0xAC00 + ((a - 0x1100) * 21 + (b - 0x1161)) * 28, to)  # Korean syllables follow a rule
        to = np.where((a >= 0xAC00) & (a < 0xD7A4) & ((a - 0xAC00) % 28 == 0) & (b > 0x11A7) & (b < 0x11C3), a + b - 0x11A7, to)
        hit = to > 0
        mark, starter, to = mark[hit], starter[hit], to[hit]
        if not len(mark):
            break
        first = np.concatenate(([True], starter[1:] != starter[:-1]))
        first &= ~np.isin(starter, mark)  # a mark can't take one before it is taken itself
        mark, starter, to = mark[first], starter[first], to[first]
        done_own.append(own[mark] & (cp[mark] != _NUKTA))
        done_row.append(row[mark])
        cp = cp.copy()
        cp[starter] = to
        keep = np.ones(len(cp), bool)
        keep[mark] = False
        cp, off = _keep(cp, off, keep)
        row, own = row[keep], own[keep]
    none = np.zeros(0, np.int64)
    return cp, off, np.concatenate(done_own) if done_own else none.astype(bool), np.concatenate(done_row) if done_row else none


def slices(off: np.ndarray, size: int = SLICE) -> list[tuple[int, int]]:
    """Row ranges of about ``size`` code points."""
    cuts = [0]
    while cuts[-1] < len(off) - 1:
        cuts.append(max(cuts[-1] + 1, int(np.searchsorted(off, off[cuts[-1]] + size, "right")) - 1))
    return list(zip(cuts, cuts[1:]))


def _moved(cp: np.ndarray, off: np.ndarray, all_latin: bool) -> np.ndarray:
    """Texts outside ASCII that have a character that may change, or letters of two scripts."""
    t, lens = tables(), np.diff(off)
    filled = np.flatnonzero(lens > 0)
    traits = np.where(cp < TOP, t.traits[np.minimum(cp, TOP - 1)], np.uint8(1))
    have = np.bitwise_or.reduceat(traits, off[filled]) if len(filled) else traits[:0]
    rich = np.bitwise_or.reduceat(cp, off[filled]) >= 0x80 if len(filled) else have.astype(bool)
    latin, cyrillic, greek, other = ((have & b) > 0 for b in (2, 4, 8, 16))
    moved = rich & (all_latin | ((have & 1) > 0) | (latin & (cyrillic | greek | other)) | (cyrillic & (greek | other)) | (greek & other))
    for k in np.flatnonzero(rich & other & ~moved):  # two scripts that share a bit
        s = t.script[np.minimum(cp[off[filled[k]] : off[filled[k] + 1]], TOP - 1)]
        moved[k] = len(np.unique(s[s > 3])) > 1
    return filled[moved]


def canonical_points(a: pa.Array, all_latin: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``canonical`` of Arrow text: code points, offsets and kinds; null is empty.

    Only texts with a character that may change, or with letters of two scripts, are worked on;
    the rest are in their one form.
    """
    cp, off = code_points(a.combine_chunks() if isinstance(a, pa.ChunkedArray) else a)
    kinds = np.zeros(len(a), np.uint8)
    moved = _moved(cp, off, all_latin) if len(cp) else np.zeros(0, np.int64)
    if not len(moved):
        return cp, off, kinds
    sub, sub_off = take(cp, off, moved)
    source, begin, lens, at = [cp], off[:-1].copy(), np.diff(off), len(cp)
    for lo, hi in slices(sub_off):
        c, o, k = canonical(sub[sub_off[lo] : sub_off[hi]], sub_off[lo : hi + 1] - sub_off[lo], all_latin)
        source.append(c)
        rows = moved[lo:hi]
        begin[rows], lens[rows], kinds[rows] = at + o[:-1], np.diff(o), k
        at += len(c)
    new = np.concatenate(([0], np.cumsum(lens)))
    return np.concatenate(source)[np.repeat(begin - new[:-1], lens) + np.arange(new[-1])], new, kinds


def canonical_arrow(a: pa.Array, all_latin: bool = False) -> tuple[pa.Array, np.ndarray]:
    """``canonical_points`` as text again; null stays null."""
    a = a.combine_chunks() if isinstance(a, pa.ChunkedArray) else a
    cp, off, kinds = canonical_points(a, all_latin)
    done = to_arrow(cp, off)
    return (pa.compute.if_else(a.is_valid(), done, pa.scalar(None, pa.large_string())) if a.null_count else done), kinds
