"""Personal data replaced by format-preserving pseudonyms.

Values are found by pattern and validated (check digits, ranges, calendar); each is then mapped by a keyed
Feistel permutation of all values of its format, walked until the result is valid again. So a pseudonym has
the look and length of what it stands for, check digits hold, and equal values get equal pseudonyms in every
document, with no table of them anywhere. Who has the key can map them back.
"""

from __future__ import annotations

import bisect
import datetime
import functools
import hashlib
import re
import secrets
import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

#: The setting of a session that holds the key.
KEY_SETTING = "spark.tallymark.pii.key"
ROUNDS = 10
#: Letters and digits of a value that one permutation takes; longer values are permuted block by block.
BLOCK = 64
_FIRST, _LAST = datetime.date(1900, 1, 1).toordinal(), datetime.date(2099, 12, 31).toordinal()
_ALNUM = "0123456789abcdefghijklmnopqrstuvwxyz"


#: Marks that a secret without letters and digits is permuted among.
_SIGNS = "!#$%&()*+,-./:;=?@[\\]^_`{|}~"


@functools.lru_cache(4096)
def alphabet(c: str) -> str:
    """The characters that one outside ASCII may become: letters or digits of its kind and case among the 128 around it."""
    kind = unicodedata.category(c)
    if kind[0] not in "LN":
        return c
    start = ord(c) & ~127
    return "".join(x for x in map(chr, range(start, start + 128)) if unicodedata.category(x) == kind)


class Permutation:
    """Keyed permutations of ranges of whole numbers."""

    def __init__(self, key: bytes):
        self.key = hashlib.blake2b(key, digest_size=32).digest()

    def _step(self, half: int, turn: int, bits: int, kind: str) -> int:
        data = half.to_bytes((bits + 7) // 8 + 1, "little") + bytes([turn]) + kind.encode()
        size = (bits + 7) // 8
        out = b"".join(hashlib.blake2b(data + bytes([i]), key=self.key, digest_size=min(64, size - 64 * i)).digest() for i in range(-(-size // 64)))
        return int.from_bytes(out, "little") & ((1 << bits) - 1)

    def _once(self, x: int, bits: int, kind: str, back: bool) -> int:
        left, right = x >> bits, x & ((1 << bits) - 1)
        for turn in range(ROUNDS - 1, -1, -1) if back else range(ROUNDS):
            if back:
                left, right = right ^ self._step(left, turn, bits, kind), left
            else:
                left, right = right, left ^ self._step(right, turn, bits, kind)
        return left << bits | right

    def of(self, x: int, size: int, kind: str, ok: Callable[[int], bool] = lambda _: True, back: bool = False) -> int:
        """The image of x among the numbers below ``size`` that are ok (x has to be): walks on until one is."""
        bits = max(1, -(-(size - 1).bit_length() // 2))
        while True:
            x = self._once(x, bits, kind, back)
            if x < size and ok(x):
                return x

    def text(self, value: str, kind: str, hexadecimal: bool = False, back: bool = False) -> str:
        """Digits, letters, their case and alphabet stay what they are; other characters stay themselves.

        The permutation of a block depends on all that stands before it, so equal values have equal images and values
        that only begin alike have unlike ends.
        """
        if len(value) > BLOCK:
            out, before = [], hashlib.blake2b(key=self.key, digest_size=16)
            for at in range(0, len(value), BLOCK):
                done = self.text(value[at : at + BLOCK], f"{kind}:{before.hexdigest()}", hexadecimal, back)
                out.append(done)
                before.update((done if back else value[at : at + BLOCK]).encode())
            return "".join(out)
        sets = ["" if not c.isascii() and len(alphabet(c)) < 2 else alphabet(c) if not c.isascii() else "" if not c.isalnum() else _ALNUM[:10] if c.isdigit() else _ALNUM[10:16] if hexadecimal else _ALNUM[10:] for c in value]
        if not any(sets):
            sets = [_SIGNS if kind.startswith("secret") and c in _SIGNS else "" for c in value]
        number, total = 0, 1
        for c, letters in zip(value, sets, strict=True):
            if letters:
                number = number * len(letters) + letters.index(c.lower() if c.isascii() else c)
                total *= len(letters)
        if total == 1:
            return value
        shape = "".join("9" if x == _ALNUM[:10] else ("a" if x[0] == "a" else f"<{x[0]}>") if x else c for c, x in zip(value, sets, strict=True))
        number = self.of(number, total, f"{kind}:{shape}", back=back)
        out = []
        for c, letters in zip(reversed(value), reversed(sets), strict=True):
            if letters:
                number, d = divmod(number, len(letters))
                c = letters[d].upper() if "A" <= c <= "Z" else letters[d]
            out.append(c)
        return "".join(reversed(out))


def _digits(value: str) -> str:
    return "".join(c for c in value if "0" <= c <= "9")


def _refilled(value: str, digits: str) -> str:
    """value with its digits replaced in order."""
    new = iter(digits)
    return "".join(next(new) if "0" <= c <= "9" else c for c in value)


def luhn_digit(digits: str) -> str:
    """The digit that completes a card number."""
    total = sum(d if i % 2 else (2 * d - 9 if d > 4 else 2 * d) for i, d in enumerate(map(int, reversed(digits))))
    return str(-total % 10)


def iban_rest(value: str) -> int:
    return int("".join(str(int(c, 36)) for c in value[4:] + value[:4])) % 97


def card(p: Permutation, value: str) -> str | None:
    d = _digits(value)
    if not 13 <= len(d) <= 19 or luhn_digit(d[:-1]) != d[-1]:
        return None
    new = d[0] + str(p.of(int(d[1:-1]), 10 ** (len(d) - 2), f"card{len(d)}")).zfill(len(d) - 2)
    return _refilled(value, new + luhn_digit(new))


def iban(p: Permutation, value: str) -> str | None:
    v = value.replace(" ", "")
    if not 15 <= len(v) <= 34 or iban_rest(v) != 1:
        return None
    body = p.text(v[4:], f"iban{v[:2]}")
    new = f"{v[:2]}{98 - iban_rest(v[:2] + '00' + body):02d}{body}"
    it = iter(new)
    return "".join(c if c == " " else next(it) for c in value)


def address(p: Permutation, value: str) -> str | None:
    parts = value.split(".")
    if any(int(x) > 255 or len(x) > 1 and x[0] == "0" for x in parts):
        return None
    # octets keep their width, the first also its class: 0 and 127 as they are, hosts, multicast and above
    octets = [{1: range(10), 2: range(10, 100), 3: range(100, 256)}[len(x)] for x in parts]
    a = int(parts[0])
    octets[0] = [a] if a in (0, 127) else range(224, 256) if a >= 224 else [n for n in octets[0] if 0 < n < 224 and n != 127]
    number, total = 0, 1
    for x, values in zip(parts, octets, strict=True):
        number = number * len(values) + values.index(int(x))
        total *= len(values)
    number = p.of(number, total, f"ip{'.'.join(str(len(x)) for x in parts)}:{octets[0][0]}")
    new = []
    for values in reversed(octets):
        number, i = divmod(number, len(values))
        new.append(str(values[i]))
    return ".".join(reversed(new))


def phone(p: Permutation, value: str) -> str | None:
    d = _digits(value)
    m = re.match(r"\+([0-9]{1,3})[^0-9]", value)
    code = m[1] if m else "" if value[0] != "+" else d[: min(3, max(1, len(d) - 10))]
    rest = d[len(code) :]
    if not 8 <= len(d) <= 15:
        return None
    # numbers that begin with 0 or 1 are permuted among such numbers, the others among the others
    low, lead = rest[0] in "01", 10 ** (len(rest) - 1)
    new = p.of(int(rest), 10 * lead, f"phone{code}", lambda n: (n < 2 * lead) == low)
    return _refilled(value, code + str(new).zfill(len(rest)))


def social(p: Permutation, value: str) -> str | None:
    ok = lambda n: n // 10**6 not in (0, 666) and n < 9 * 10**8 and n // 10**4 % 100 and n % 10**4
    number = int(_digits(value))
    return _refilled(value, str(p.of(number, 10**9, "social", lambda n: bool(ok(n)))).zfill(9)) if ok(number) else None


def date(p: Permutation, value: str) -> str | None:
    a, b, c = (int(x) for x in re.split(r"[-./]", value))
    if len(re.split(r"[-./]", value)[0]) == 4:
        order = (a, b, c)
    else:
        month_first = "/" in value and a <= 12
        order = (c, a, b) if month_first else (c, b, a)
    try:
        day = datetime.date(*order).toordinal()
    except ValueError:
        return None
    if not _FIRST <= day <= _LAST:
        return None
    widths = [len(x) for x in re.split(r"[-./]", value)]

    def same_width(n: int) -> bool:
        new = datetime.date.fromordinal(_FIRST + n)
        return all(w != 1 or x < 10 for w, x in zip(widths, arranged(new), strict=True))

    def arranged(new: datetime.date) -> tuple[int, int, int]:
        return (new.year, new.month, new.day) if order == (a, b, c) else (new.month, new.day, new.year) if month_first else (new.day, new.month, new.year)

    # dates written with a one-digit part are permuted among dates that can be written so
    kind = "date" + "".join(map(str, widths)) if 1 in widths else "date"
    parts = arranged(datetime.date.fromordinal(_FIRST + p.of(day - _FIRST, _LAST - _FIRST + 1, kind, same_width)))
    marks = re.findall(r"[-./]", value)
    return "".join(f"{x:0{w}d}{m}" for x, w, m in zip(parts, widths, [*marks, ""], strict=True))


def email(p: Permutation, value: str) -> str | None:
    local, _, host = value.rpartition("@")
    name, _, top = host.rpartition(".")
    if not name or not top.isalpha():
        return None
    low = lambda x: x.lower() if len(x.lower()) == len(x) else x
    return f"{p.text(low(local), 'local')}@{p.text(low(name), 'host')}.{top}"


def secret(p: Permutation, value: str) -> str | None:
    return p.text(value, "secret", hexadecimal=bool(re.fullmatch(r"[0-9a-f]+", value)))


_SECRET = re.compile(r"(?i)(?:pass(?:word|wd|phrase)?|pwd|secret|token|api[_-]?key|access[_-]?key|private[_-]?key|auth)[\"']?\s{0,16}[=:]\s*[\"']?([^\s\"'<>]{6,})")
_BEGIN = "-----BEGIN [A-Z0-9 ]{0,40}PRIVATE KEY-----"
#: Kind, what a text has to hold (any of), pattern (group 1 if it has one), pseudonym; earlier kinds win an overlap.
KINDS: list[tuple[str, tuple[str, ...], re.Pattern, Callable[[Permutation, str], str | None]]] = [
    ("key", ("AKIA", "ASIA"), re.compile(r"(?<![0-9A-Za-z])A[KS]IA([0-9A-Z]{16})(?![0-9A-Za-z])"), secret),
    ("key", ("sk-",), re.compile(r"(?<![0-9A-Za-z])sk-([0-9A-Za-z_-]{16,})"), secret),
    ("key", ("ghp_", "gho_", "ghu_", "ghs_", "ghr_"), re.compile(r"(?<![0-9A-Za-z])gh[pousr]_([0-9A-Za-z]{20,})"), secret),
    ("key", ("PRIVATE KEY-----",), re.compile(rf"{_BEGIN}((?:(?!-----BEGIN)[\s\S]){{1,20000}}?)-----END [A-Z0-9 ]{{0,40}}PRIVATE KEY-----"), secret),
    ("key", ("PRIVATE KEY-----",), re.compile(rf"{_BEGIN}(\s*[A-Za-z0-9+/=][A-Za-z0-9+/=\s]{{15,}})"), secret),
    ("email", ("@",), re.compile(r"(?<![\w.+-])[\w.+-]{1,64}@(?:[^\W_]|-){1,63}(?:\.(?:[^\W_]|-){1,63}){0,8}\.[^\W\d_]{2,24}(?![\w-])"), email),
    ("iban", (), re.compile(r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?: ?[0-9A-Z]{4}){2,7}(?: ?[0-9A-Z]{1,4})?(?![0-9A-Za-z])"), iban),
    ("card", (), re.compile(r"(?<![0-9A-Za-z.-])[0-9](?:[ -]?[0-9]){12,18}(?![0-9A-Za-z])"), card),
    ("address", (), re.compile(r"(?<![0-9A-Za-z.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9A-Za-z]|\.[0-9])"), address),
    ("date", (), re.compile(r"(?<![0-9A-Za-z./-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{1,2}([./])[0-9]{1,2}\1[0-9]{4})(?![0-9A-Za-z])"), date),
    ("social", ("-",), re.compile(r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])"), social),
    ("phone", (), re.compile(r"(?<![0-9A-Za-z])(?:\+[0-9]{1,3}[ .-]?(?:\([0-9]{1,4}\)|[0-9]{1,4})(?:[ .-]?[0-9]{2,4}){2,4}|\([0-9]{3}\) ?[0-9]{3}[ .-][0-9]{4}|[0-9]{3}[.-][0-9]{3}[.-][0-9]{4})(?![0-9A-Za-z])"), phone),
]
_DIGIT = re.compile("[0-9]")


def found(text: str, p: Permutation) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, pseudonym) of the values in a text, in order, without overlaps."""
    out: list[tuple[int, int, str, str]] = []  # in order, so only the neighbours can overlap a new one

    def add(start: int, end: int, kind: str, new: str | None) -> bool:
        at = bisect.bisect_left(out, (start,))
        free = new is not None and (at == 0 or out[at - 1][1] <= start) and (at == len(out) or end <= out[at][0])
        if free:
            out.insert(at, (start, end, kind, new))
        return free

    if "=" in text or ":" in text:
        for m in _SECRET.finditer(text):
            add(m.start(1), m.end(1), "secret", secret(p, m[1]))
    digits = _DIGIT.search(text) is not None
    for kind, needs, pattern, make in KINDS:
        if any(x in text for x in needs) if needs else digits:
            for m in pattern.finditer(text):
                g = 1 if kind == "key" else 0
                if add(m.start(g), m.end(g), kind, make(p, m[g])) or kind not in ("card", "phone"):
                    continue
                # other numbers may follow the value: try what ends at each separator, longest first
                for end in (i for i in range(m.end() - 1, m.start(), -1) if text[i] in " .-"):
                    if (part := pattern.fullmatch(text, m.start(), end)) and add(m.start(), end, kind, make(p, part[0])):
                        break
    return out


def replaced(text: str, spans: list[tuple[int, int, str, str]]) -> str:
    parts, at = [], 0
    for start, end, _, new in spans:
        parts += [text[at:start], new]
        at = end
    return "".join([*parts, text[at:]])


def session_key(spark: SparkSession) -> bytes:
    """The key that the session's setting KEY_SETTING holds; where it is unset, a random one for this session."""
    key = spark.conf.get(KEY_SETTING, None)
    if not key:
        key = secrets.token_hex(32)
        spark.conf.set(KEY_SETTING, key)
    return key.encode()


def pseudonymised(text: Column, key: bytes) -> Column:
    """struct(text, found array of struct(kind, start, end)) of a text column.

    Whole texts are searched. Who has the key can map pseudonyms back; runs with one key give one pseudonym for a value. A null text stays null and has nothing found; an empty one stays empty. Texts
    without personal data come back unchanged; lengths never change, so offsets hold for both texts.
    """

    @F.pandas_udf("struct<text:string,found:array<struct<kind:string,start:bigint,end:bigint>>>")
    def run(texts: pd.Series) -> pd.DataFrame:
        p, rows = Permutation(key), []
        for t in texts:
            spans = found(t, p) if t else []
            rows.append((replaced(t, spans) if spans else t, [{"kind": k, "start": a, "end": b} for a, b, k, _ in spans]))
        return pd.DataFrame(rows, columns=["text", "found"])

    return run(text)
