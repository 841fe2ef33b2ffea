"""Identity numbers, cards, phones and dates that are validated and permuted within their format."""

from __future__ import annotations

import datetime as dt
import hashlib
import hmac
from collections.abc import Callable
from dataclasses import dataclass

ROUNDS = 8
#: First day and number of days among which dates are permuted.
FIRST_DAY, DAYS = dt.date(1900, 1, 1).toordinal(), dt.date(2100, 1, 1).toordinal() - dt.date(1900, 1, 1).toordinal()


def _round(key: bytes, i: int, tweak: str, half: str, modulus: int) -> int:
    return int.from_bytes(hmac.new(key, f"{i}|{tweak}|{half}".encode(), hashlib.sha256).digest()[:16], "big") % modulus


def feistel(digits: str, key: bytes, tweak: str, radix: int = 10, inverse: bool = False) -> str:
    """A keyed permutation of all strings of this length over the digits of ``radix`` (up to 26).

    Alternating unbalanced Feistel network with HMAC-SHA-256 as round function. ``radix`` 26
    permutes upper-case letters. One character is shifted by the key, none stays none.
    """
    letters = "0123456789" if radix == 10 else "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    to = {c: i for i, c in enumerate(letters)}
    v, n = [to[c] for c in digits], len(digits)
    if n < 2:
        shift = _round(key, 0, tweak, "", radix)
        return "".join(letters[(x - shift if inverse else x + shift) % radix] for x in v)
    u = n // 2
    a, b = v[:u], v[u:]

    def number(x: list[int]) -> int:
        r = 0
        for d in x:
            r = r * radix + d
        return r

    def spell(x: int, size: int) -> list[int]:
        out = []
        for _ in range(size):
            out.append(x % radix)
            x //= radix
        return out[::-1]

    for i in reversed(range(ROUNDS)) if inverse else range(ROUNDS):
        size = u if i % 2 == 0 else n - u
        m = radix**size
        if inverse:
            a, b = spell((number(b) - _round(key, i, tweak, ",".join(map(str, a)), m)) % m, size), a
        else:
            a, b = b, spell((number(a) + _round(key, i, tweak, ",".join(map(str, b)), m)) % m, size)
    return "".join(letters[x] for x in a + b)


def walk(value: str, key: bytes, tweak: str, allowed: Callable[[str], bool]) -> str:
    """``feistel`` again and again until the result is allowed: a permutation of the allowed strings."""
    out = feistel(value, key, tweak)
    while not allowed(out):
        out = feistel(out, key, tweak)
    return out


# ---------------------------------------------------------------- check digits


def luhn(payload: str) -> str:
    total = 0
    for i, c in enumerate(reversed(payload)):
        d = int(c) * (2 if i % 2 == 0 else 1)
        total += d - 9 if d > 9 else d
    return str(-total % 10)


def cpf(payload: str) -> str:
    for _ in range(2):
        n = len(payload) + 1
        rest = sum(int(c) * (n - i) for i, c in enumerate(payload)) * 10 % 11
        payload += str(rest % 10)
    return payload[-2:]


def _dihedral(a: int, b: int) -> int:
    """Product in the group of a pentagon's turns and reflections, numbered 0 to 9."""
    if a < 5:
        return (a + b) % 5 if b < 5 else 5 + (a + b - 5) % 5
    return 5 + (a - 5 - b) % 5 if b < 5 else (a - b) % 5


def verhoeff(payload: str) -> str:
    step = [1, 5, 7, 6, 2, 8, 3, 0, 9, 4]
    total = 0
    for i, c in enumerate(reversed(payload), 1):
        d = int(c)
        for _ in range(i % 8):
            d = step[d]
        total = _dihedral(total, d)
    return str(next(x for x in range(10) if _dihedral(total, x) == 0))


def dni(payload: str) -> str:
    return "TRWAGMYFPDXBNJZSQVHLCKE"[int(payload) % 23]


def insee(payload: str) -> str:
    return f"{97 - int(payload) % 97:02d}"


def snils(payload: str) -> str:
    return f"{sum(int(c) * (9 - i) for i, c in enumerate(payload)) % 101 % 100:02d}"


def _ssn(d: str) -> bool:
    return d[:3] not in ("000", "666") and d[0] != "9" and d[3:5] != "00" and d[5:] != "0000"


@dataclass(frozen=True)
class Format:
    """Digits of a payload, what they are checked by, and which payloads there are."""

    name: str
    sizes: range
    check: Callable[[str], str] | None = None
    check_size: int = 0
    allowed: Callable[[str], bool] = lambda d: True

    def splits(self, bare: str) -> tuple[str, str] | None:
        """Payload and check of a valid number without separators, else None."""
        if len(bare) not in self.sizes:
            return None
        payload, check = bare[: len(bare) - self.check_size], bare[len(bare) - self.check_size :]
        if not (payload.isascii() and payload.isdigit() and self.allowed(payload)) or self.check and self.check(payload) != check:
            return None
        return payload, check


# Identity numbers and cards by length, check and range.
FORMATS = (
    Format("card", range(13, 20), luhn, 1, lambda d: d[0] in "3456" and len(d) >= 12),
    Format("cpf", range(11, 12), cpf, 2, lambda d: len(set(d)) > 1),
    Format("aadhaar", range(12, 13), verhoeff, 1, lambda d: d[0] not in "01"),
    Format("insee", range(15, 16), insee, 2, lambda d: d[0] in "12"),
    Format("dni", range(9, 10), dni, 1),
    Format("snils", range(11, 12), snils, 2),
    Format("ssn", range(9, 10), None, 0, _ssn),
)


def format_of(value: str) -> tuple[Format, str] | None:
    """The first format in which the number is valid, and its payload."""
    bare = "".join(c for c in value if c.isalnum()).upper()
    for f in FORMATS:
        if (got := f.splits(bare)) is not None:
            return f, got[0]
    return None


def rewrite(value: str, new: str) -> str:
    """``value`` with its letters and digits replaced in order; separators and small letters stay as they are."""
    it = iter(new)
    return "".join((x.lower() if c.islower() else x) if c.isalnum() else c for c in value for x in [next(it) if c.isalnum() else c])


def permute_format(value: str, key: bytes, kind: str, keep: int = 0) -> str:
    """``value`` with its digits and letters permuted in place; the first ``keep`` digits stay."""
    digits = [i for i, c in enumerate(value) if c.isdigit() and c.isascii()][keep:]
    capitals = [i for i, c in enumerate(value) if c.isascii() and c.isalpha()]
    out = list(value)
    for at, radix in ((digits, 10), (capitals, 26)):
        plain = "".join(value[i].upper() for i in at)
        if plain:
            for i, c in zip(at, feistel(plain, key, f"{kind}|{radix}|{len(plain)}", radix)):
                out[i] = c.lower() if value[i].islower() else c
    return "".join(out)


def permute_identity(value: str, key: bytes) -> str:
    """An identity number for another: valid numbers become valid ones of their format, others stay without a valid format.

    The payload is permuted and its check digits are made anew, walking on past payloads the
    format does not have or that an earlier format claims, so different numbers stay different.
    """
    found = format_of(value)
    if found:
        f, payload = found

        def whole(p: str) -> str:
            return p + (f.check(p) if f.check else "")

        def own(p: str) -> bool:
            got = f.allowed(p) and format_of(whole(p))
            return bool(got) and got[0] is f

        return rewrite(value, whole(walk(payload, key, f"{f.name}|{len(payload)}", own)))
    out = permute_format(value, key, "id_number")
    while format_of(out):
        out = permute_format(out, key, "id_number")
    return out


# Country calling codes of one and of two digits; all others have three.
_ONE, _TWO = ("1", "7"), frozenset("20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split())


def national(value: str) -> int:
    """How many of a phone number's first digits are not of its national number: country code or trunk zero."""
    bare = "".join(c for c in value if c.isdigit() and c.isascii())
    abroad = value.lstrip(" (").startswith("+")
    if not abroad and not bare.startswith("00"):
        return 1 if bare.startswith("0") else 0
    at = 0 if abroad else 2
    at += 1 if bare[at : at + 1] in _ONE else 2 if bare[at : at + 2] in _TWO else 3
    return at + (bare[at : at + 1] == "0" and "(0)" in value)


def permute_phone(value: str, key: bytes) -> str:
    """A phone number with its national digits permuted; written with a country code or a trunk zero it gets the same ones."""
    return permute_format(value, key, "phone", national(value))


def permute_date(year: int, month: int, day: int, key: bytes) -> tuple[int, int, int]:
    """A keyed permutation of the valid days of 1900 to 2099 (cycle walking over day numbers)."""
    x = int(walk(f"{dt.date(year, month, day).toordinal() - FIRST_DAY:05d}", key, "date", lambda d: int(d) < DAYS))
    d = dt.date.fromordinal(FIRST_DAY + x)
    return d.year, d.month, d.day
