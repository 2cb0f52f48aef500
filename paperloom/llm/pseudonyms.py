"""Format-preserving pseudonyms for personal data, by a keyed Feistel network over each format.

A value is found by its shape and then validated: checksums of card and account numbers, octets of
addresses, ranges of area and social numbers, real dates. What may vary in it becomes a number in a mixed
radix, that number's halves pass the Feistel rounds, and the result is written back in the same places, so
a pseudonym is valid in the same format and as long as the value. Equal values have equal pseudonyms in
every document, whatever their separators or letter case; different values have different ones. Checksums
are computed anew; where a format has gaps (dates, social numbers), the permutation is walked until it
meets a valid value, which keeps it one to one. Where the longest card or account at a place is not valid, shorter
ones that end at a separator are tried, so an expiry, a security code or a word behind a value does not hide it;
a card or account that begins inside what would otherwise be a phone number goes first.

The key is a parameter, or the session's ``spark.paperloom.pseudonym.key``; where neither is set the session draws a
random one, which nothing else knows. Whoever has the key can undo the pseudonyms.

Edge cases: a null text stays null; an empty one has nothing to find; texts are searched whole, and values of any length
are permuted, long ones in linked blocks; repeated
rows and ids are treated row by row; an empty table gives no rows; clashing columns give way to results.
"""

from __future__ import annotations

import datetime
import hashlib
import re
import secrets
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded, plus, schema_plus, small_batches, table

#: Where a session has its key. Without one it makes its own, and its pseudonyms then link its own documents only.
KEY = "spark.paperloom.pseudonym.key"
ROUNDS = 8
#: Places that one network permutes, and characters of a value that is remembered; longer values go block by block and are not kept.
BLOCK, REMEMBERED = 64, 256
_B, _E = r"(?<![0-9A-Za-z])", r"(?![0-9A-Za-z])"
SHAPES = (
    ("email", r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]+@(?:[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?\.)+[A-Za-z]{2,}"),
    ("key", _B + r"(?:AKIA|ASIA)[0-9A-Z]{16}" + _E),
    ("secret", r"(?i:(?:password|passwd|pwd|secret|token|api[_-]?key|access[_-]?key))\s{0,3}[=:]\s{0,3}[\"']?[A-Za-z0-9+/_.\-]{8,}[\"']?"),
    ("iban", _B + r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?" + _E),
    ("ip", r"(?<![0-9A-Za-z.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9A-Za-z]|\.[0-9])"),
    ("date", r"(?<![0-9A-Za-z./-])(?:[0-9]{4}([-/.])[0-9]{1,2}\1[0-9]{1,2}|[0-9]{1,2}([-/.])[0-9]{1,2}\2[0-9]{4})(?![0-9A-Za-z]|[./-][0-9])"),
    ("ssn", r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z]|-[0-9])"),
    ("card", r"(?<![0-9A-Za-z.])[0-9](?:[ -]?[0-9]){12,18}(?![0-9A-Za-z]|\.[0-9])"),
    ("phone", r"(?<![0-9A-Za-z+.-])(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{2,4}\)[ .-]?|[0-9]{2,4}[ .-])[0-9]{3,4}[ .-][0-9]{3,4}(?:[ .-][0-9]{2,4})?(?![0-9A-Za-z]|[.-][0-9])|(?<![0-9A-Za-z+])\+[0-9]{1,3}(?:[ .-]?\(?[0-9]{1,5}\)?){2,6}" + _E),
)
FIND = re.compile("|".join(f"(?P<{kind}>{shape.replace(chr(92) + '1', '(?P=sep1)').replace(chr(92) + '2', '(?P=sep2)').replace('([-/.])', '(?P<sep1>[-/.])', 1).replace('([-/.])', '(?P<sep2>[-/.])', 1)})" for kind, shape in SHAPES))
HINT = re.compile(r"[0-9@]|(?i:passw|pwd|secret|token|key)")


class Permutation:
    """Keyed permutations of the numbers below a product of radices; ``tweak`` gives each format its own."""

    def __init__(self, key: bytes, rounds: int = ROUNDS):
        self.key, self.rounds = hashlib.blake2b(key, digest_size=32).digest(), rounds

    def _f(self, tweak: str, k: int, value: int, under: int) -> int:
        h = hashlib.blake2b(f"{tweak}/{k}/{value}".encode(), key=self.key, digest_size=(under.bit_length() + 7) // 8 + 8)
        return int.from_bytes(h.digest(), "big") % under

    def digits(self, tweak: str, values: list[int], radices: list[int]) -> list[int]:
        """Each value is below its radix; so is each result."""
        if len(values) > BLOCK:
            return self._long(tweak, values, radices)
        half = (len(values) + 1) // 2
        sizes, nums = [1, 1], [0, 0]
        for k, (v, r) in enumerate(zip(values, radices, strict=True)):
            side = k >= half
            sizes[side] *= r
            nums[side] = nums[side] * r + v
        for k in range(self.rounds):
            side = k % 2
            if sizes[side] > 1:
                nums[side] = (nums[side] + self._f(tweak, k, nums[1 - side], sizes[side])) % sizes[side]
        out = []
        for k in range(len(values) - 1, -1, -1):
            side = k >= half
            nums[side], v = divmod(nums[side], radices[k])
            out.append(v)
        return out[::-1]

    def _long(self, tweak: str, values: list[int], radices: list[int]) -> list[int]:
        """Block by block, there and back; a block's tweak is a digest of the results before it, so each depends on all values and can still be undone."""
        base, out = self._digest(tweak.encode()), list(values)
        starts = range(0, len(out), BLOCK)
        for turn, order in enumerate((starts, reversed(starts))):
            before = base
            for at in order:
                out[at : at + BLOCK] = self.digits(f"{turn}{before}", out[at : at + BLOCK], radices[at : at + BLOCK])
                before = self._digest(f"{before}{out[at : at + BLOCK]}".encode())
        return out

    def _digest(self, x: bytes) -> str:
        return hashlib.blake2b(x, key=self.key, digest_size=16).hexdigest()

    def walked(self, tweak: str, values: list[int], radices: list[int], valid: Callable[[list[int]], bool]) -> list[int]:
        values = self.digits(tweak, values, radices)
        while not valid(values):
            values = self.digits(tweak, values, radices)
        return values


def luhn(digits: list[int]) -> int:
    """Check digit that ``digits`` need behind them."""
    total = sum(d if k % 2 else sum(divmod(2 * d, 10)) for k, d in enumerate(reversed(digits)))
    return -total % 10


def iban_check(country: str, rest: str) -> int:
    return 98 - int("".join(str(int(c, 36)) for c in rest + country + "00")) % 97


def _refill(shape: str, new: str, which: str = "0123456789") -> str:
    it = iter(new)
    return "".join(next(it) if c in which else c for c in shape)


def _mixed(perm: Permutation, tweak: str, s: str, hexadecimal: bool = False) -> str:
    """Letters and digits permuted within their classes; case and everything else stays."""
    if hexadecimal and len(s) >= 12 and re.fullmatch(r"[0-9a-f]+", s):
        return "".join(f"{v:x}" for v in perm.digits(f"{tweak}x{len(s)}", [int(c, 16) for c in s], [16] * len(s)))
    at = [k for k, c in enumerate(s) if c.isalnum()]
    low = s.lower()
    got = perm.digits(f"{tweak}:{re.sub('[a-z]', 'a', re.sub('[0-9]', '0', low))}", [ord(low[k]) - (97 if low[k].isalpha() else 48) for k in at], [26 if low[k].isalpha() else 10 for k in at])
    out = list(s)
    for k, v in zip(at, got, strict=True):
        c = chr(v + (97 if low[k].isalpha() else 48))
        out[k] = c.upper() if s[k].isupper() else c
    return "".join(out)


def _email(perm: Permutation, s: str) -> str | None:
    name, _, host = s.rpartition("@")
    return f"{_mixed(perm, 'email@' + host.lower(), name)}@{host}" if any(c.isalnum() for c in name) else None


def _key(perm: Permutation, s: str) -> str:
    return s[:4] + _mixed(perm, "key", s[4:])


def _secret(perm: Permutation, s: str) -> str | None:
    m = re.fullmatch(r"(.*?[=:]\s*[\"']?)([^\"']+?)(\.*[\"']?)", s, re.S)
    return m[1] + _mixed(perm, "secret", m[2], True) + m[3] if m else None


def _iban(perm: Permutation, s: str) -> str | None:
    bare = s.replace(" ", "")
    if not 15 <= len(bare) <= 34 or iban_check(bare[:2], bare[4:]) != int(bare[2:4]):
        return None
    rest = _mixed(perm, "iban" + bare[:2], bare[4:])
    return _refill(s, f"{bare[:2]}{iban_check(bare[:2], rest):02}{rest}", bare)


def _ip(perm: Permutation, s: str) -> str | None:
    octets = s.split(".")
    if any(int(o) > 255 or o != str(int(o)) for o in octets):
        return None
    base = [(0, 10), (10, 90), (100, 156)]
    kinds = [base[len(o) - 1] for o in octets]
    got = perm.digits("ip" + "".join(str(len(o)) for o in octets), [int(o) - k[0] for o, k in zip(octets, kinds, strict=True)], [k[1] for k in kinds])
    return ".".join(str(v + k[0]) for v, k in zip(got, kinds, strict=True))


def _date(perm: Permutation, s: str) -> str | None:
    sep = re.search(r"[-/.]", s)[0]
    parts = s.split(sep)
    orders = [(0, 1, 2)] if len(parts[0]) == 4 else [(2, 1, 0), (2, 0, 1)]
    for y, m, d in orders:
        try:
            day = datetime.date(int(parts[y]), int(parts[m]), int(parts[d]))
        except ValueError:
            continue
        if day.year < 1000:
            return None
        first, last = (1900, 2099) if 1900 <= day.year <= 2099 else (1000, 9999)
        low = datetime.date(first, 1, 1).toordinal()
        n = datetime.date(last, 12, 31).toordinal() - low + 1
        side = int(n**0.5) + 1

        def shown(v: list[int]) -> list[str] | None:
            if v[0] * side + v[1] >= n:
                return None
            new = datetime.date.fromordinal(low + v[0] * side + v[1])
            if first == 1000 and 1900 <= new.year <= 2099:
                return None
            out = [""] * 3
            for k, x in ((y, new.year), (m, new.month), (d, new.day)):
                out[k] = f"{x:0{len(parts[k])}}"
                if len(out[k]) != len(parts[k]):
                    return None
            return out

        widths = f"{len(parts[m])}{len(parts[d])}"
        got = perm.walked(f"date{first}" + (widths if "1" in widths else ""), list(divmod(day.toordinal() - low, side)), [side, side], lambda v: shown(v) is not None)
        return sep.join(shown(got))
    return None


def _ssn(perm: Permutation, s: str) -> str | None:
    valid = lambda v: v[0] not in (0, 666) and v[0] < 900 and v[1] > 0 and v[2] > 0
    values = [int(x) for x in s.split("-")]
    return "{:03}-{:02}-{:04}".format(*perm.walked("ssn", values, [1000, 100, 10000], valid)) if valid(values) else None


def _card(perm: Permutation, s: str) -> str | None:
    d = [int(c) for c in s if c.isdigit()]
    if luhn(d[:-1]) != d[-1] or d[0] == 0 or len(set(d)) == 1:
        return None
    body = [d[0], *perm.digits(f"card{d[0]}/{len(d)}", d[1:-1], [10] * (len(d) - 2))]
    return _refill(s, "".join(map(str, [*body, luhn(body)])))


def _phone(perm: Permutation, s: str) -> str | None:
    m = re.match(r"\+([0-9]{1,3})(?=[ .(-])|\+(1)(?=[0-9]{10}$)", s)
    code = (m[1] or m[2]) if m else ""
    d = [int(c) for c in s if c.isdigit()][len(code) :]
    if not 8 <= len(d) + len(code) <= 15 or len(d) < 7 or (not s.startswith("+") and len(d) < 9):
        return None
    low = [0] * len(d)
    if len(d) == 10 and code in ("", "1") and d[0] > 1 and d[3] > 1:  # area and exchange start with 2 to 9
        low[0] = low[3] = 2
    got = perm.digits(f"phone{len(d)}{low[:4]}", [v - b for v, b in zip(d, low, strict=True)], [10 - b for b in low])
    return _refill(s, code + "".join(str(v + b) for v, b in zip(got, low, strict=True)))


MAKE = {"email": _email, "key": _key, "secret": _secret, "iban": _iban, "ip": _ip, "date": _date, "ssn": _ssn, "card": _card, "phone": _phone}


class Pseudonymizer:
    def __init__(self, key: bytes):
        perm = Permutation(key)
        make = lambda kind, value: MAKE[kind](perm, value)
        known = lru_cache(100_000)(make)
        self.make = lambda kind, value: (known if len(value) <= REMEMBERED else make)(kind, value)

    def __call__(self, text: str) -> tuple[str, list[tuple[str, int, int]]]:
        """The text with pseudonyms, and (kind, start, end) of each; positions hold for both texts."""
        if not HINT.search(text):
            return text, []
        out, found, at, pos = [], [], 0, 0
        while m := FIND.search(text, pos):
            kind = m.lastgroup if m.lastgroup in MAKE else next(k for k in MAKE if m[k] is not None)
            new = self.make(kind, m[0])
            if new is None:  # not valid as this kind; another may start inside
                other = self._shorter(text, m, kind) or self._others(text, m, kind)
                if other is None:
                    pos = m.start() + 1
                    continue
                kind, start, end, new = other
            else:
                start, end = m.span()
            if kind == "phone":
                kind, start, end, new = self._inside(text, start, end) or (kind, start, end, new)
            out += (text[at:start], new)
            found.append((kind, start, end))
            at = pos = end
        return "".join(out) + text[at:], found

    def _shorter(self, text: str, m: re.Match, kind: str) -> tuple[str, int, int, str] | None:
        """The longest valid value of the same kind that ends at a separator: digits or a word may follow a card or an account."""
        shape = dict(_COMPILED)[kind]
        for end in range(m.end() - 1, m.start(), -1) if kind in ("card", "iban") else ():
            if text[end] in " -" and shape.fullmatch(text, m.start(), end) and (new := self.make(kind, text[m.start() : end])) is not None:
                return kind, m.start(), end, new
        return None

    def _inside(self, text: str, start: int, end: int) -> tuple[str, int, int, str] | None:
        """The first valid card or account that begins inside a phone number: a checksum says more than a shape."""
        found = []
        for kind in ("iban", "card"):
            shape, at = dict(_COMPILED)[kind], start + 1
            while (m := shape.search(text, at)) and m.start() < end:
                got = (kind, *m.span(), new) if (new := self.make(kind, m[0])) is not None else self._shorter(text, m, kind)
                if got:
                    found.append(got)
                    break
                at = m.start() + 1
        return min(found, key=lambda f: f[1], default=None)

    def _others(self, text: str, m: re.Match, kind: str) -> tuple[str, int, int, str] | None:
        """A later kind that is valid at the same place."""
        after = False
        for k, shape in _COMPILED:
            if after and (n := shape.match(text, m.start())) and (new := self.make(k, n[0])) is not None:
                return k, *n.span(), new
            after |= k == kind
        return None


_COMPILED = [(kind, re.compile(shape)) for kind, shape in SHAPES[:5]] + [("date", re.compile(SHAPES[5][1]))] + [(kind, re.compile(shape)) for kind, shape in SHAPES[6:]]
FOUND = "array<struct<kind:string,start:bigint,end:bigint>>"


def session_key(spark: SparkSession) -> bytes:
    key = spark.conf.get(KEY, None)
    if not key:
        key = secrets.token_hex(32)
        spark.conf.set(KEY, key)
    return key.encode()


def pseudonymize(docs: DataFrame, key: bytes | None = None) -> DataFrame:
    """``docs`` with text replaced and ``found``: kind, start and end of each pseudonym, in code points."""
    small_batches(docs.sparkSession)
    key = key or session_key(docs.sparkSession)
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        change = Pseudonymizer(key)
        for batch in bounded(batches):
            got = [change(t) if t else (t, []) for t in batch.column("text").to_pylist()]
            yield plus(batch, (), {"text": pa.array([t for t, _ in got], pa.string()), "found": pa.array([[dict(zip(("kind", "start", "end"), f, strict=True)) for f in fs] for _, fs in got], kind)})

    return docs.mapInArrow(run, schema_plus(docs, (), ["text string", f"found {FOUND}"]))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = pseudonymize(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return got.select("doc_id", "text", F.size("found").cast("bigint").alias("n_found"), F.array_join(F.array_sort(F.transform("found", lambda f: f["kind"])), ",").alias("kinds"))
