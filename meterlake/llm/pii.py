"""Surrogates for personal data: keyed, type-consistent, distinct.

Entities found in the whole text are replaced by surrogates of the same type and format. Each type has a keyed
permutation of its own domain without fixed points (a Feistel network F, keyed by HMAC-SHA-256, around a step of one:
F^-1(F(x) + 1)), so the same entity has the same surrogate in every document (coreference), different entities have
different ones (distinctness) and none stays as it was, without any table of what was replaced:

* card: 13 to 19 digits with a right check digit, or 16 in a row; the first digit stays, the check digit is made anew;
* iban: with right check digits; the country stays, the check digits are made anew;
* phone: the digits after the country code, in the same layout;
* ssn: the digits of ddd-dd-dddd;
* ip: the four numbers, with leading zeros where they had some; version 6: the hexadecimal digits;
* email: letters become letters of the same script and case, digits digits; a domain that is reserved for examples stays,
  any other becomes one under the reserved .example;
* secret: hexadecimal strings after password, token, key or secret become ones of the same length and case;
* name: a known given name becomes another one of the same gender and script; a name after a title or a phrase of
  introduction keeps these and its gender, and its other parts become letters of the same script and case.

Letters of any script take part: what a letter may become are the letters of its own script and case in its block of
Unicode. A string is an entity as it is spelled: case, leading zeros and layout tell entities apart, and each format class
is mapped onto itself, so surrogates of one kind differ wherever the entities do. Collision check: should entities of
two kinds meet in one surrogate (their formats allow it only for long digit strings), the later one by kind and value
is permuted on in that text until it is free; should its cycle hold no free one, they share it. No text is refused.

Cases: null text stays null and has no entities; empty texts stay empty; repeated rows are treated alike; an empty
table gives no rows; other columns are ignored. Not found: names without title, introduction or known given name,
national phone numbers other than ddd-ddd-dddd, (ddd) ... and those that begin with 0, and postal addresses.
"""

from __future__ import annotations

import bisect
import functools
import hashlib
import hmac
import re
import unicodedata
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterlake.llm.common import mapped, slices

ROUNDS = 8
#: Signs that are permuted together; a longer string is permuted stretch by stretch, each under what precedes it.
STRETCH = 64
#: Bytes of text whose surrogates are made together, and surrogates that a task remembers.
SLICE, MEMORY = 4_000_000, 100_000

#: Given names by gender and script. Both lists of a script are domains of a permutation.
NAMES = {
    ("f", "latin"): "Alice Anna Barbara Carla Carmen Clara Claire Elena Emma Eva Greta Hannah Helen Ingrid Jane Julia Karen Laura Lena Lucy Maria Marie Mary Nina Olga Paula Rosa Sarah Sofia Susan".split(),
    ("m", "latin"): "Adam Albert Carlos Charles David Diego Felix Frank George Hans Henri Hugo Jack James Jean John Jorge Karl Louis Lucas Mark Martin Michael Oscar Paul Peter Pierre Robert Thomas William".split(),
    ("f", "cyrillic"): "Анна Вера Дарья Елена Ирина Мария Нина Ольга Софья Татьяна".split(),
    ("m", "cyrillic"): "Алексей Борис Виктор Дмитрий Иван Михаил Николай Олег Павел Сергей".split(),
}
#: Titles by gender.
TITLES = {"f": ("Mrs", "Ms", "Miss", "Frau", "Mme", "Madame", "Señora", "Sra"), "m": ("Mr", "Herr", "Monsieur", "Señor", "Sr"), "": ("Dr", "Prof")}
#: Phrases that a name follows; each may begin with a capital.
INTRODUCTIONS = ("my name is", "ich heiße", "je m'appelle", "me llamo", "меня зовут")
#: Domains that never lead to a person, and the one that others are put under.
SAFE, UNDER = ("example.com", "example.org", "example.net"), "example"
#: Alphabets whose letters stand for one another.
ALPHABETS = ("0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "абвгдежзийклмнопрстуфхцчшщъыьэюя", "АБВГДЕЖЗИЙКЛМНОПРСТУФХЦЧШЩЪЫЬЭЮЯ")

GIVEN = {n: k for k, names in NAMES.items() for n in names}
TITLE = {t: g for g, titles in TITLES.items() for t in titles}
CAPITAL = r"[^\W\d_a-zà-öø-ÿа-я][^\W\d_]+"
_TITLES = "|".join(sorted(TITLE, key=len, reverse=True))
_INTROS = "|".join(f"[{p[0].upper()}{p[0]}]{p[1:]}" for p in INTRODUCTIONS)


def by_initial(words: list[str]) -> str:
    """A pattern of the words that looks at their first letters first."""
    initials = "".join(sorted({w[0] for w in words}))
    tails = (f"(?<={c})(?:{'|'.join(sorted((w[1:] for w in words if w[0] == c), key=len, reverse=True))})" for c in initials)
    return rf"[{initials}](?<!\w[{initials}])(?:{'|'.join(tails)})"


#: Kind, what a text must hold for the pattern to be tried, and the pattern; group 1, where it took part, is the entity.
#: Look-behinds follow the first sign, so that a search can skip to what may begin an entity.
FIND: tuple[tuple[str, re.Pattern, re.Pattern], ...] = tuple(
    (kind, re.compile(hint), re.compile(pattern))
    for kind, hint, pattern in (
        ("email", r"@", r"(?<![\w.+-])[\w.+-]+@[\w-]+(?:\.[\w-]+)+"),
        ("secret", r"[=:]\s*[\"']?[0-9a-fA-F]{12}", r"(?i)(?:password|passwd|token|api_?key|key|secret)\s*[=:]\s*[\"']?([0-9a-f]{12,64})(?![0-9a-zA-Z])"),
        ("phone", r"\([0-9]{2}", r"(?<![\w+])(?:\+\d{1,3}[ .-]?)?\(\d{2,4}\)[ .-]?\d{3,4}[ .-]\d{3,4}(?!\d)"),
        ("phone", r"\+[0-9]", r"\+(?<![\w+]\+)\d{1,3}(?:[ .-]?\d{2,4}){2,4}(?!\d)"),
        ("phone", r"[0-9]{3}[.-][0-9]{3}[.-][0-9]", r"\d(?<![\w+./-]\d)(?:\d{2}-\d{3}-\d{4}|\d{2}\.\d{3}\.\d{4})(?![\w-])"),
        ("phone", r"0[0-9]{2,4}[/-][0-9]{5}", r"0(?<![\w+./-]0)\d{2,4}[/-]\d{5,8}(?![\w-])"),
        ("ssn", r"[0-9]{3}-[0-9]{2}-", r"\d(?<![\w./-]\d)\d{2}-\d{2}-\d{4}(?![\w-])"),
        ("ip", r"[0-9]\.[0-9]{1,3}\.", r"\d(?<![\d.]\d)\d{0,2}(?:\.\d{1,3}){3}(?![\d.]*\d)"),
        ("ip", r":[0-9a-fA-F]{0,4}:", r"(?<![\w:.])(?:(?:[0-9a-fA-F]{1,4}:){7}[0-9a-fA-F]{1,4}|(?:[0-9a-fA-F]{1,4}:){1,6}(?::[0-9a-fA-F]{1,4}){1,6})(?![\w:])"),
        ("card", r"[0-9]{4}[ -]?[0-9]", r"\d(?<![\d-]\d)(?:\d{12,18}|\d{3}(?:[ -]\d{4}){2}[ -]\d{1,7}|\d{3}[ -]\d{6}[ -]\d{5})(?![\d-])"),
        ("iban", r"[A-Z]{2}[0-9]{2} ?[A-Z0-9]{4}", r"[A-Z](?<!\w[A-Z])[A-Z]\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?!\w)"),
        ("name", by_initial([*TITLE, *GIVEN]) + "[. ]", rf"{by_initial([*TITLE])}\.? {CAPITAL}(?: (?!(?:{_TITLES})(?!\w)){CAPITAL})?(?!\w)"),
        ("name", by_initial([*GIVEN]) + " ", rf"{by_initial([*GIVEN])} {CAPITAL}(?!\w)"),
        ("name", "|".join(p[1:] for p in INTRODUCTIONS), rf"(?<!\w)(?:{_INTROS}) ({CAPITAL}(?: {CAPITAL})?)(?!\w)"),
    )
)


@functools.cache
def alphabet(sign: str) -> str | None:
    """The signs that may stand for a sign; None for what is neither letter nor digit, or alone of its kind."""
    for a in ALPHABETS:
        if sign in a:
            return a
    kind = unicodedata.category(sign)
    if sign.isascii() or kind not in ("Lu", "Ll", "Lt", "Lo", "Lm", "Nd"):
        return None
    script, low = unicodedata.name(sign, "").split(" ")[0], ord(sign) // 128 * 128
    like = "".join(c for c in map(chr, range(low, low + 128)) if unicodedata.category(c) == kind and unicodedata.name(c, "").split(" ")[0] == script and not any(c in a for a in ALPHABETS))
    return like if len(like) > 1 else None


class Permutation:
    """A keyed permutation of the numbers below n: a Feistel network on two halves, walked until the number is below n."""

    def __init__(self, key: bytes, n: int):
        self.n, self.key = n, key
        self.half = 1 << -(-max(1, n - 1).bit_length() // 2)

    def _round(self, r: int, right: int) -> int:
        return int.from_bytes(hmac.digest(self.key, b"%d:%d" % (r, right), "sha512"), "big")

    def __call__(self, x: int) -> int:
        while True:
            left, right = divmod(x, self.half)
            for r in range(ROUNDS):
                left, right = right, (left + self._round(r, right)) % self.half
            x = left * self.half + right
            if x < self.n:
                return x

    def back(self, x: int) -> int:
        while True:
            left, right = divmod(x, self.half)
            for r in reversed(range(ROUNDS)):
                left, right = (right - self._round(r, left)) % self.half, left
            x = left * self.half + right
            if x < self.n:
                return x

    def moved(self, x: int) -> int:
        """Another number for every number, one for one: one cycle runs through all of them."""
        return self.back((self(x) + 1) % self.n) if self.n > 1 else x


def luhn(digits: str) -> int:
    """The check digit that belongs after the digits."""
    total = sum(sum(divmod(int(d) * (2 - i % 2), 10)) for i, d in enumerate(reversed(digits)))
    return -total % 10


def iban_check(country: str, rest: str) -> str:
    """The two check digits that belong to a country and what follows them."""
    return f"{98 - int(''.join(str(int(c, 36)) for c in rest + country) + '00') % 97:02d}"


def digits_of(value: str) -> str:
    return "".join(c for c in value if c in ALPHABETS[0])


def refilled(layout: str, signs: str, taken: Callable[[str], bool]) -> str:
    """The layout with its taken signs replaced in order."""
    left = iter(signs)
    return "".join(next(left) if taken(c) else c for c in layout)


class Surrogates:
    """Surrogates under one key."""

    def __init__(self, key: bytes):
        self.key = key
        self.known: dict[tuple[str, str], str] = {}

    def moved(self, kind: str, x: int, n: int) -> int:
        return Permutation(hashlib.sha256(self.key + f"|{kind}|{n}".encode()).digest(), n).moved(x)

    def mixed(self, kind: str, numbers: list[int], sizes: list[int]) -> list[int]:
        """Numbers below their sizes become others, all together."""
        x = 0
        for number, size in zip(numbers, sizes, strict=True):
            x = x * size + number
        total = 1
        for size in sizes:
            total *= size
        x, out = self.moved(f"{kind}|{sizes}", x, total), []
        for size in reversed(sizes):
            x, number = divmod(x, size)
            out.append(number)
        return out[::-1]

    def permute(self, kind: str, signs: str, of: Callable[[str], str | None] = alphabet) -> str:
        """Signs become signs of their own alphabets, by permutations of all strings of this pattern."""
        bases = [of(c) for c in signs]
        pattern = hashlib.sha256("".join(b[0] if b else c for b, c in zip(bases, signs, strict=True)).encode())
        at = [i for i, b in enumerate(bases) if b]
        out = list(signs)
        for j in range(0, len(at), STRETCH):
            some = at[j : j + STRETCH]
            own = [bases[i] for i in some]
            numbers = self.mixed(f"{kind}|{pattern.hexdigest()}", [b.index(signs[i]) for i, b in zip(some, own, strict=True)], [len(b) for b in own])
            for i, b, number in zip(some, own, numbers, strict=True):
                out[i] = b[number]
            pattern.update("".join(signs[i] for i in some).encode())
        return "".join(out)

    def hexadecimal(self, kind: str, value: str) -> str:
        """Hexadecimal digits, with capitals and small letters where the value has such, and only there."""
        small, large = any(c.islower() for c in value), any(c.isupper() for c in value)
        base = "0123456789" + "abcdef" * small + "ABCDEF" * large
        while True:
            value = self.permute(kind, value, lambda _: base)
            if any(c.islower() for c in value) == small and any(c.isupper() for c in value) == large:
                return value

    def card(self, value: str) -> str:
        digits = digits_of(value)
        new = digits[0] + self.permute("card", digits[1:-1])
        new += str((luhn(new) + int(digits[-1]) - luhn(digits[:-1])) % 10)
        return refilled(value, new, str.isdecimal)

    def iban(self, value: str) -> str:
        signs = value.replace(" ", "")
        rest = self.permute("iban", signs[4:])
        return refilled(value, signs[:2] + iban_check(signs[:2], rest) + rest, lambda c: c != " ")

    def phone(self, value: str) -> str:
        code = re.match(r"\+\d{1,3}(?=\D)", value)
        keep = code.group(0) if code else ""
        rest = value[len(keep) :]
        return keep + refilled(rest, self.permute("phone" + keep, digits_of(rest)), lambda c: c in ALPHABETS[0])

    def ssn(self, value: str) -> str:
        return self.permute("ssn", value)

    def ip(self, value: str) -> str:
        if ":" in value:
            return refilled(value, self.hexadecimal("ip", value.replace(":", "")), lambda c: c != ":")
        parts = value.split(".")
        padded = [p[0] == "0" and len(p) > 1 for p in parts]
        numbers = self.mixed("ip", [int(p) for p in parts], [10 ** (len(p) - 1) if z else 256 for p, z in zip(parts, padded, strict=True)])
        return ".".join(str(x).zfill(len(p)) if z else str(x) for x, p, z in zip(numbers, parts, padded, strict=True))

    def email(self, value: str) -> str:
        local, _, domain = value.rpartition("@")
        low = domain.lower()
        if any(low == s or low.endswith("." + s) for s in SAFE):
            return f"{self.permute('email', local)}@{domain}"
        return f"{self.permute('email', value)}.{UNDER}"

    def secret(self, value: str) -> str:
        return self.hexadecimal("secret", value)

    def name(self, value: str) -> str:
        parts, gender, out = value.split(" "), "", []
        for i, part in enumerate(parts):
            title = TITLE.get(part.rstrip("."))
            if title is not None and i == 0 and len(parts) > 1:
                gender = title
                out.append(part)
            elif part in GIVEN:
                same = NAMES[GIVEN[part]]
                out.append(same[self.moved("".join(GIVEN[part]), same.index(part), len(same))])
            else:
                new = self.permute("name" + gender, part)
                while new in GIVEN:  # what is no given name doesn't become one
                    new = self.permute("name" + gender, new)
                out.append(new)
        return " ".join(out)

    def of(self, kind: str, value: str) -> str:
        """The entity's surrogate, the same in every text."""
        new = self.known.get((kind, value))
        if new is None:
            new = getattr(self, kind)(value)
            if len(self.known) > MEMORY:
                self.known.clear()
            self.known[kind, value] = new
        return new

    def free(self, kind: str, value: str, taken: set[str]) -> str:
        """The first of the entity's surrogates, permuted on, that is not taken; the first one where all are."""
        first = new = self.of(kind, value)
        seen = set()
        while new in taken and new not in seen:
            seen.add(new)
            new = getattr(self, kind)(new)
        return first if new in taken else new

    def replace(self, text: str) -> tuple[str, list[tuple[int, int, str, str]]]:
        """The text with surrogates, and (start, end, kind, surrogate) of each entity in the given text."""
        spans = find(text)
        if not spans:
            return text, []
        chosen = {e: self.of(*e) for e in sorted({(kind, text[a:b]) for a, b, kind in spans})}
        if len(set(chosen.values())) < len(chosen):
            taken: set[str] = set()
            for e, new in chosen.items():
                chosen[e] = new if new not in taken else self.free(*e, {*taken, *chosen.values()})
                taken.add(chosen[e])
        out, at, made = [], 0, []
        for a, b, kind in spans:
            new = chosen[kind, text[a:b]]
            out += [text[at:a], new]
            made.append((a, b, kind, new))
            at = b
        return "".join([*out, text[at:]]), made


def is_entity(kind: str, value: str) -> bool:
    """Whether what a pattern found holds what the kind's rules demand."""
    if kind == "card":
        digits = digits_of(value)
        return len(digits) == 16 or luhn(digits[:-1]) == int(digits[-1])
    if kind == "ip":
        return any(c.isdigit() for c in value) and value.count(":") > 2 if ":" in value else all(int(p) <= 255 for p in value.split("."))
    if kind == "iban":
        signs = value.replace(" ", "")
        return 15 <= len(signs) <= 34 and signs[2:4] == iban_check(signs[:2], signs[4:])
    return True


def find(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the entities, in order and apart; of those that overlap the longest, then the first."""
    spans = []
    for kind, hint, pattern in FIND:
        if hint.search(text):
            for m in pattern.finditer(text):
                a, b = m.span(1) if pattern.groups and m.group(1) is not None else m.span()
                if is_entity(kind, text[a:b]):
                    spans.append((a, b, kind))
    spans.sort(key=lambda s: (s[0] - s[1], s[0]))
    taken: list[tuple[int, int, str]] = []  # in order; a new one meets its two neighbours only
    for span in spans:
        i = bisect.bisect(taken, span)
        if (not i or taken[i - 1][1] <= span[0]) and (i == len(taken) or span[1] <= taken[i][0]):
            taken.insert(i, span)
    return taken


def pseudonymise(df: DataFrame, key: bytes, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text with surrogates, and entities: array of (start, end, kind, surrogate), for every row. The key is the caller's secret."""
    kind = df.schema[id_col].dataType.simpleString()
    span = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string()), ("surrogate", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Surrogates(key)
        for batch in batches:
            for part in slices(batch, 1, SLICE):
                texts, entities = [], []
                for text in part.column(1).to_pylist():
                    new, found = (None, []) if text is None else own.replace(text)
                    texts.append(new)
                    entities.append([dict(zip(("start", "end", "kind", "surrogate"), f, strict=True)) for f in found])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(texts, pa.string()), pa.array(entities, pa.list_(span))], names=["doc_id", "text", "entities"])

    return mapped(df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), run, f"doc_id {kind}, text string, entities array<struct<start int, end int, kind string, surrogate string>>")
