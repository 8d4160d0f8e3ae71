"""Format-preserving pseudonyms of personal data and secrets.

A pattern finds candidates, a validator (checksum, calendar, ranges) decides, and a keyed Feistel network permutes the
values of the format: what comes out has the same format and passes the same validator, equal values get equal
pseudonyms in every document, and who has the key can turn them back. No table of values is kept.
"""

from __future__ import annotations

import bisect
import datetime
import functools
import hashlib
import ipaddress
import re
import string
from collections.abc import Callable
from math import isqrt, prod

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from saleskiln.llm.common import batch_udf, with_struct

ROUNDS = 10
#: Letters and digits permuted at once; longer values are permuted in blocks. Networks kept.
BLOCK, NETWORKS = 64, 20_000
#: Where a cluster keeps the key; the fallback serves tests and demonstrations only.
KEY_SETTING, DEMO_KEY = "spark.saleskiln.pii.key", "demonstration key, not secret"
KINDS = ("email", "card", "iban", "ssn", "phone", "ip", "date", "secret")
#: What names a secret, also inside a longer name (client_secret, AWS_SECRET_ACCESS_KEY), bare or quoted, in front of = or
#: a colon; and schemes of an authorization header.
SECRET_NAME = re.compile(
    r"(?i)(?:password|passwd|passphrase|pwd|secret|token|credential|(?:api|access|auth|private|signing|encryption)[_-]?key)"
    r"(?:[_-]?(?:access|api|auth|key|value|token|secret|id|string|hash))*[\"'`]?\s*(?::=|=>|[=:])\s*[\"'`]?|\b(?:bearer|basic)\s+"
)
SECRET_VALUE = re.compile(r"[A-Za-z0-9+/_~-]++(?:[.=]++[A-Za-z0-9+/_~-]++)*+")
#: How well-known keys begin; what follows is the secret.
SECRET_PREFIX = re.compile(
    r"(?<![A-Za-z0-9_-])(?:gh[pousr]_|github_pat_|glpat-|[sprk]k_(?:live|test)_|sk-|xox[abeprs]-|AIza|npm_|hf_|eyJ(?=[\w-]+\.[\w-]+\.[\w-]))([A-Za-z0-9_.-]{16,})"
)
FIRST_DAY, LAST_DAY = datetime.date(1900, 1, 1).toordinal(), datetime.date(2099, 12, 31).toordinal()
UPPER, LOWER, DIGITS = string.ascii_uppercase, string.ascii_lowercase, string.digits
#: Characters of an IBAN by country. Other countries' numbers are tried at every length.
IBAN_LENGTHS = {c: int(n) for n, cs in (part.split(":") for part in (
    "15:NO 16:BE 18:DK,FI,FO,GL,NL,FK,SD 19:MK,SI 20:AT,BA,EE,KZ,LT,LU,MN,XK 21:CH,HR,LI,LV 22:BG,BH,CR,DE,GB,GE,IE,ME,RS,VA"
    " 23:AE,GI,IL,IQ,OM,SO,TL 24:AD,CZ,ES,MD,PK,RO,SA,SE,SK,TN,VG 25:LY,PT,ST 26:IS,TR 27:BI,DJ,FR,GR,IT,MC,MR,SM"
    " 28:AL,AZ,BY,CY,DO,GT,HU,LB,NI,PL,SV 29:BR,EG,PS,QA,UA 30:JO,KW,MU,YE 31:MT,SC 32:LC 33:RU").split()) for c in cs.split(",")}  # fmt: skip
#: Numbers by pattern, in the order in which they are tried where one begins; a card in the groups of cards goes before a
#: phone, in others behind it.
NUMBERS = {
    "iban": r"[A-Z]{2}\d{2}(?:[ ]?[A-Z0-9]{4}){2,7}(?:[ ]?[A-Z0-9]{1,3})?",
    "aws": r"(?:AKIA|ASIA)[A-Z0-9]{16}",
    "ip": r"(?:\d{1,3}\.){3}\d{1,3}(?![.]\d)",
    "ip6": r"(?<!:)(?:[0-9a-f]{0,4}:){2,7}[0-9a-f]{0,4}(?![:.][0-9a-f])|(?<!:)(?:[0-9A-F]{0,4}:){2,7}[0-9A-F]{0,4}(?![:.][0-9A-F])",
    "iso": r"(?:19|20)\d\d-\d\d?-\d\d?",
    "dotted": r"\d\d?[./]\d\d?[./](?:19|20)\d\d|\d\d?-\d\d?-(?:19|20)\d\d",
    "ssn": r"\d{3}-\d{2}-\d{4}",
    "card": r"\d{13,19}|\d{4}(?P<by>[ -])\d{4}(?P=by)\d{4}(?P=by)\d{1,4}(?:(?P=by)\d{3})?|\d{4}(?P<of>[ -])\d{6}(?P=of)\d{4,5}",
    "phone": r"(?:(?:\+\d{1,3}|1)[ .-]?)?\(\d{2,4}\)[ .-]?\d{3,4}[ .-]?\d{3,4}|\+\d{1,3}(?:[ .-]?\d{2,4}){2,5}|(?:1[ .-])?\d{3}[ .-]\d{3}[ .-]\d{4}",
    "loose": r"\d(?:[ -]?\d){12,18}",
}
#: Kinds whose pattern may run on into what stands behind the value.
RUN_ON = {"iban", "card", "phone", "loose"}


class Feistel:
    """A keyed permutation of 0 .. size - 1: a network over two halves, walked until it is back inside."""

    def __init__(self, key: str, kind: str, size: int) -> None:
        self.size = size
        self.left = isqrt(size - 1) + 1 if size > 1 else 1
        self.right = -(-size // self.left)
        self.key = hashlib.blake2b(f"{kind}|{size}|{key}".encode()).digest()

    def draw(self, step: int, value: int, size: int, tweak: bytes) -> int:
        text = b"%d|%d%s" % (step, value, tweak)
        return int.from_bytes(hashlib.blake2b(text, key=self.key, digest_size=32).digest()) % size

    def once(self, value: int, back: bool, tweak: bytes) -> int:
        a, b = divmod(value, self.right)
        for step in reversed(range(ROUNDS)) if back else range(ROUNDS):
            sign = -1 if back else 1
            if step % 2:
                b = (b + sign * self.draw(step, a, self.right, tweak)) % self.right
            else:
                a = (a + sign * self.draw(step, b, self.left, tweak)) % self.left
        return a * self.right + b

    def permute(self, value: int, back: bool = False, tweak: bytes = b"") -> int:
        """Another permutation for each ``tweak``."""
        if self.size < 2:
            return value
        value = self.once(value, back, tweak)
        while value >= self.size:
            value = self.once(value, back, tweak)
        return value


def luhn_digit(payload: str) -> str:
    total = sum(sum(divmod(int(d) * (2 if k % 2 == 0 else 1), 10)) for k, d in enumerate(reversed(payload)))
    return str(-total % 10)


def iban_digits(country: str, account: str) -> str:
    number = "".join(str(int(c, 36)) for c in account + country + "00")
    return f"{98 - int(number) % 97:02d}"


def refill(shape: str, characters: str) -> str:
    """``shape`` with its letters and digits replaced in order."""
    rest = iter(characters)
    return "".join(next(rest) if c.isascii() and c.isalnum() else c for c in shape)


@functools.cache
def days_of(late: bool) -> tuple[list[int], dict[int, int]]:
    """All days behind the 12th of their months, or up to it, and the rank of each."""
    days = [d for d in range(FIRST_DAY, LAST_DAY + 1) if (datetime.date.fromordinal(d).day > 12) == late]
    return days, {d: k for k, d in enumerate(days)}


class Pseudonyms:
    """Finds and permutes. Every ``value_*`` method returns the pseudonym of a match, or None if it doesn't validate."""

    def __init__(self, key: str, back: bool = False) -> None:
        self.key, self.back = key, back
        self.networks: dict[tuple[str, int], Feistel] = {}
        # capturing groups are of no use in the search, and their names may stand only once
        some = "|".join(re.sub(r"\(\?P<\w+>\[ -\]\)|\(\?P=\w+\)", "[ -]", p) for p in NUMBERS.values())
        self.numbers = re.compile(rf"(?<![\w@/-])(?<!\d\.)(?:{some})(?!\w)")
        self.by_name = {name: re.compile(rf"(?:{p})(?!\w)") for name, p in NUMBERS.items()}
        self.makers: dict[str, tuple[str, Callable[[str], str | None]]] = {
            "iban": ("iban", self.value_iban), "aws": ("secret", lambda v: v[:4] + self.text_value("secret", v[4:])), "ip": ("ip", self.value_ip), "ip6": ("ip", self.value_ip6),
            "iso": ("date", lambda v: self.value_date(v, True)), "dotted": ("date", lambda v: self.value_date(v, False)),
            "ssn": ("ssn", self.value_ssn), "card": ("card", self.value_card), "phone": ("phone", self.value_phone), "loose": ("card", self.value_card),
        }
        self.mails = re.compile(r"(?<![\w.%+-])([A-Za-z0-9](?:[A-Za-z0-9._%+-]{0,62}[A-Za-z0-9_])?)@((?:[A-Za-z0-9-]{1,63}\.)+[A-Za-z]{2,24})(?![\w-])")

    def permute(self, kind: str, value: int, size: int, tweak: bytes = b"") -> int:
        network = self.networks.get((kind, size))
        if network is None:
            if len(self.networks) >= NETWORKS:
                self.networks.clear()
            network = self.networks[kind, size] = Feistel(self.key, kind, size)
        return network.permute(value, self.back, tweak)

    def text_value(self, kind: str, text: str, hexadecimal: bool = False) -> str:
        """Letters and digits permuted together, each within its class; other characters stay.

        More than BLOCK of them are permuted in blocks, each linked to the one before it and then to the one behind it,
        so that every block of a pseudonym depends on the whole value."""
        low = "abcdef" if hexadecimal else LOWER
        characters = [c for c in text if c.isascii() and c.isalnum()]
        if len(characters) <= BLOCK:
            return refill(text, self.block(kind, "".join(characters), low))
        count = -(-len(characters) // BLOCK)
        edges = [k * len(characters) // count for k in range(count + 1)]
        blocks = ["".join(characters[a:b]) for a, b in zip(edges, edges[1:])]
        for step in ("back", "on") if self.back else ("on", "back"):
            # what a block is linked to is what has been permuted already, and in undoing it what still is
            side = -1 if step == "on" else 1
            for k in range(count) if (step == "on") != self.back else reversed(range(count)):
                beside = blocks[k + side] if 0 <= k + side < count else ""
                blocks[k] = self.block(kind, blocks[k], low, f"|{step}|{k}|{count}|{beside}".encode())
        return refill(text, "".join(blocks))

    def block(self, kind: str, characters: str, low: str, tweak: bytes = b"") -> str:
        classes = [DIGITS if c in DIGITS else low if c in LOWER else UPPER for c in characters]
        rank = 0
        for c, letters in zip(characters, classes):
            rank = rank * len(letters) + letters.index(c)
        pattern = "".join("d" if x is DIGITS else "u" if x is UPPER else "l" for x in classes)
        rank = self.permute(f"{kind} {pattern}", rank, prod(map(len, classes)), tweak)
        out = []
        for letters in reversed(classes):
            rank, at = divmod(rank, len(letters))
            out.append(letters[at])
        return "".join(reversed(out))

    def number(self, kind: str, digits: str) -> str:
        return str(self.permute(kind, int(digits), 10 ** len(digits))).zfill(len(digits)) if digits else ""

    def value_card(self, text: str) -> str | None:
        digits = re.sub(r"\D", "", text)
        if luhn_digit(digits[:-1]) != digits[-1] or digits[0] not in "123456":
            return None
        payload = digits[0] + self.number("card", digits[1:-1])
        return refill(text, payload + luhn_digit(payload))

    def value_iban(self, text: str) -> str | None:
        plain = text.replace(" ", "")
        if not 15 <= len(plain) <= 34 or iban_digits(plain[:2], plain[4:]) != plain[2:4]:
            return None
        account = self.text_value("iban", plain[4:])
        return refill(text, plain[:2] + iban_digits(plain[:2], account) + account)

    def value_ssn(self, text: str) -> str | None:
        area, group, serial = map(int, text.split("-"))
        if not 0 < area < 900 or area == 666 or not group or not serial:
            return None
        area -= 1 + (area > 666)
        rank = self.permute("ssn", (area * 99 + group - 1) * 9999 + serial - 1, 898 * 99 * 9999)
        rank, serial = divmod(rank, 9999)
        area, group = divmod(rank, 99)
        return f"{area + 1 + (area >= 665):03d}-{group + 1:02d}-{serial + 1:04d}"

    def value_phone(self, text: str) -> str | None:
        digits = re.sub(r"\D", "", text)
        if not 7 <= len(digits) <= 15:
            return None
        # country and first digits say where a number is valid; the last six and more are the subscriber's
        kept = len(digits) - min(7, len(digits) - 1)
        return refill(text, digits[:kept] + self.number("phone", digits[kept:]))

    def value_ip(self, text: str) -> str | None:
        """Leading zeros are kept as far as numbers of three digits have any."""
        parts = text.split(".")
        if max(map(int, parts)) > 255:
            return None
        rank = self.permute("ip", int.from_bytes(bytes(map(int, parts))), 1 << 32)
        width = max((len(p) for p in parts if len(p) > 1 and p[0] == "0"), default=1)
        return ".".join(str(n).zfill(width) for n in rank.to_bytes(4))

    def value_ip6(self, text: str) -> str | None:
        """Digits stay digits and letters letters, so groups keep their lengths and ``::`` its place."""
        if sum(map(bool, text.split(":"))) < 3 or not re.search(r"\d", text):
            return None
        try:
            ipaddress.IPv6Address(text)
        except ValueError:
            return None
        new = self.text_value("ip6", text.lower(), hexadecimal=True)
        return new.upper() if text != text.lower() else new

    def value_date(self, text: str, iso: bool) -> str | None:
        """With '/' the month is read first, with '.' and '-' the day, and the other way round where that is no date.

        Days up to the 12th stay among each other, and so do later ones: a pseudonym reads in the order of its value."""
        first, mark, second, other, third = re.split(r"([-./])", text)
        numbers = [int(first), int(second), int(third)]
        orders = [(0, 1, 2)] if iso else [(2, 0, 1), (2, 1, 0)] if "/" in text else [(2, 1, 0), (2, 0, 1)]
        for order in orders:
            try:
                day = datetime.date(*(numbers[k] for k in order))
            except ValueError:
                continue
            days, ranks = days_of(day.day > 12)
            new = datetime.date.fromordinal(days[self.permute(f"date {day.day > 12}", ranks[day.toordinal()], len(days))])
            values = ["", "", ""]
            for k, value in zip(order, (new.year, new.month, new.day)):
                values[k] = str(value).zfill(2)
            return f"{values[0]}{mark}{values[1]}{other}{values[2]}"
        return None

    def found(self, text: str) -> list[tuple[int, int, str, str]]:
        """(start, stop, kind, pseudonym) of everything that validates, in order and without overlaps."""
        out: list[tuple[int, int, str, str]] = []
        if "@" in text:
            for m in self.mails.finditer(text):
                out.append((m.start(1), m.end(1), "email", self.text_value("email", m.group(1))))
        # every end of a value that is refused is refused too, so no character is looked at twice
        seen = 0
        for name in SECRET_NAME.finditer(text):
            if name.end() < seen or not (m := SECRET_VALUE.match(text, name.end())):
                continue
            value, seen = m.group(), m.end()
            if self.secret(value):
                out.append((m.start(), m.end(), "secret", self.secret_value(value)))
        for m in SECRET_PREFIX.finditer(text):
            end = m.start(1) + len(m.group(1).rstrip("."))
            if re.search(r"\d", m.group(1)):
                out.append((m.start(1), end, "secret", self.secret_value(text[m.start(1) : end])))
        if re.search(r"\d", text):
            taken, at = sorted(span[:2] for span in out), 0
            while m := self.numbers.search(text, at):
                span = self.number_at(text, m.start(), taken)
                if span:
                    out.append(span)
                at = span[1] if span else m.start() + 1
        # the longer one of what begins at one place
        out.sort(key=lambda span: (span[0], -span[1]))
        kept: list[tuple[int, int, str, str]] = []
        for span in out:
            if not kept or span[0] >= kept[-1][1]:
                kept.append(span)
        return kept

    def secret(self, value: str) -> bool:
        return len(value) >= 8 and re.search(r"[0-9]", value) is not None

    def secret_value(self, value: str) -> str:
        return self.text_value("secret", value, not re.search(r"[g-zA-Z]", value))

    def number_at(self, text: str, at: int, taken: list[tuple[int, int]]) -> tuple[int, int, str, str] | None:
        """The first kind of number that validates from ``at`` on, at its longest; of an IBAN, at its country's length
        first. A number does not reach into a span of ``taken`` (mails and secrets)."""
        behind = bisect.bisect_right(taken, (at, len(text)))
        if behind and at < taken[behind - 1][1]:
            return None
        limit = taken[behind][0] if behind < len(taken) else len(text)
        for name, pattern in self.by_name.items():
            kind, make = self.makers[name]
            m = pattern.match(text, at)
            if not m:
                continue
            ends = [m.end()]
            if name in RUN_ON:
                ends += [e for e in range(m.end() - 1, at, -1) if text[e - 1].isalnum() and not (text[e].isalnum() or text[e] == "_")]
            if name == "iban" and (length := IBAN_LENGTHS.get(text[at : at + 2])):
                ends.sort(key=lambda e: len(text[at:e].replace(" ", "")) != length)
            for end in ends:
                if end <= limit and pattern.fullmatch(text, at, end) and (new := make(text[at:end])) is not None:
                    return at, end, kind, new
        return None

    def replace(self, text: str) -> tuple[str, list[tuple[int, int, str, str]]]:
        spans = self.found(text)
        parts, at = [], 0
        for start, stop, _, new in spans:
            parts += [text[at:start], new]
            at = stop
        return ("".join(parts) + text[at:] if spans else text), spans


def key_of(docs: DataFrame) -> str:
    return docs.sparkSession.conf.get(KEY_SETTING, DEMO_KEY)


def pseudonymise(docs: DataFrame, text_column: str = "text", key: str | None = None, back: bool = False) -> DataFrame:
    """``docs`` with personal data in ``text`` replaced, and entities: kind, start and stop in the original text, and
    the pseudonym of each. ``back`` turns pseudonyms into the values they stand for. Null texts stay null and have no
    entities, as have texts without personal data, which stay as they are; numbers that fail their checksum or calendar
    are left. Equal values get equal pseudonyms wherever they stand; a column entities is replaced."""
    key = key if key is not None else key_of(docs)

    def start():
        names = Pseudonyms(key, back)
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("stop", pa.int64()), ("pseudonym", pa.string())]))

        def work(texts: list) -> pa.Array:
            rows = [names.replace(t) if t is not None else (None, []) for t in texts]
            spans = [[{"kind": k, "start": a, "stop": b, "pseudonym": p} for a, b, k, p in found] for _, found in rows]
            return pa.StructArray.from_arrays([pa.array([t for t, _ in rows], pa.string()), pa.array(spans, kind)], [text_column, "entities"])

        return work

    schema = f"`{text_column}` string, entities array<struct<kind:string,start:bigint,stop:bigint,pseudonym:string>>"
    return with_struct(docs, batch_udf(schema, start)(F.col(text_column)), [text_column, "entities"])
