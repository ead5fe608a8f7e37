"""Personal data in texts, replaced by keyed surrogates of the same type and form.

Mentions are found text by text. An entity's surrogate is its place in a keyed permutation of all
values of its form: no two entities share one and none is its own, so mentions that mean the same stay the same in all
documents and those that do not stay apart, without a table of entities. Each letter gives way to one of
its script, vowels to vowels, digits to digits; separators, letter case, hyphens, the ending that shows a
gender, a first name's or title's gender, checksums, and the ranges of private addresses stay. ``collisions`` holds a whole table against that.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from terrafold.llm.arrow_map import map_texts, slices
from terrafold.session import ship_package

#: The key of a run; surrogates of another key cannot be matched with these.
DEFAULT_KEY = b"terrafold surrogates"
#: Passes of the permutation.
PASSES = 6

# Titles by the gender they show ("" for none), and first names by gender.
TITLES = {
    "m": "Mr Herr Monsieur Señor Sr Don Signor Г-н Господин Κύριος Sir Lord Pan".split(), "f": "Mrs Ms Miss Frau Madame Mme Señora Sra Doña Signora Г-жа Госпожа Κυρία Lady Pani".split(),
    "": "Dr Prof Professor Doctor Docteur Doktor Dra".split(),
}
FIRST_NAMES = {
    "m": "James John Robert Michael William David Thomas Peter Hans Jürgen Klaus Pierre Jean Luc Carlos José Juan Иван Сергей Дмитрий Daniel Paul Mark Andrew Kevin Brian Steven Edward Stefan Andreas Wolfgang Markus Jacques François Antoine Miguel Pedro Luis Алексей Андрей".split(),
    "f": "Mary Patricia Jennifer Linda Elizabeth Susan Sarah Anna Ursula Monika Sophie Camille Isabelle María Carmen Lucía Ольга Мария Елена Karen Nancy Margaret Lisa Emily Laura Marta Petra Sabine Claudia Heike Nathalie Claire Hélène Marie Ana Elena Pilar Татьяна Наталья".split(),
}
_TITLE = "|".join(sorted((t for ts in TITLES.values() for t in ts), key=len, reverse=True))
_FIRST = "|".join(n for ns in FIRST_NAMES.values() for n in ns)
_NAME = r"[^\W\d_][^\W\d_'’]+(?:-[^\W\d_]+)*"
#: Letters that give way to each other, beside whole runs of code points.
_VOWELS = ("aeiou", "аеиоуыэюя", "αεηιουω")

PATTERNS = (
    ("email", re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63}){0,8}\.[A-Za-z]{2,24}(?![A-Za-z0-9-])")),
    ("iban", re.compile(r"(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?!\w)", re.A)),
    ("ip", re.compile(r"(?<![\w.])(?:\d{1,3}\.){3}\d{1,3}(?!\w|\.\d)", re.A)),
    ("ip6", re.compile(r"(?<![\w:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![\w:])", re.A)),
    ("card", re.compile(r"(?<![\w+.-])\d(?:[ -]?\d){12,18}(?!\w|[.-]\d)", re.A)),
    ("ssn", re.compile(r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])", re.A)),
    ("phone", re.compile(r"(?<![\w+])\+\d{1,3}(?:[ .-]?\(\d{1,4}\))?(?:[ .-]?\d{2,4}){1,5}(?!\w)|(?<![\w(+.-])(?:\(\d{3}\) ?|\d{3}[ .-])\d{3}[ .-]\d{4}(?!\w|[.-]\d)", re.A)),
    ("name", re.compile(rf"(?<!\w)(?:(?P<title>{_TITLE})\.? (?:(?P<a>{_NAME}) )??(?P<b>{_NAME})(?: (?P<c>{_NAME}))?|(?P<first>{_FIRST}) (?P<last>{_NAME}))(?!\w)")),
)
#: Of a text with a mention of a number, two digits stand so close; of one with a network address, these.
NUMBERS, ADDRESSES = r"[0-9][ .():-]{0,3}[0-9]", r"[0-9A-Fa-f]:[0-9A-Fa-f]{1,4}:"


def likely(text: Column) -> Column:
    """Whether a text can hold a mention: no text with one fails it, and Python reads only those that pass."""
    words = [w for group in (TITLES, FIRST_NAMES) for ws in group.values() for w in ws]
    test = F.contains(text, F.lit("@")) | F.rlike(text, F.lit(NUMBERS)) | (F.contains(text, F.lit(":")) & F.rlike(text, F.lit(ADDRESSES)))
    for w in words:
        test = test | F.contains(text, F.lit(w))
    return F.coalesce(test, F.lit(False))


def luhn(digits: str) -> bool:
    return sum(sum(divmod(int(d) * (1 + i % 2), 10)) for i, d in enumerate(reversed(digits))) % 10 == 0


def iban_rest(iban: str) -> int:
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97


def _lower(s: str) -> str:
    """Letters in lower case, as far as each stays one letter."""
    return "".join(x if len(x := c.lower()) == 1 else c for c in s)


def mentions(text: str) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, entity) of what is replaced, apart and in order. Mentions that mean the same have one entity."""
    found = []
    for rank, (kind, pattern) in enumerate(PATTERNS):
        for m in pattern.finditer(text):
            s, digits = m[0], re.sub(r"\D", "", m[0])
            if kind == "name":
                title = m["title"]
                gender = next(g for g, ts in (TITLES if title else FIRST_NAMES).items() if (title or m["first"]) in ts)
                gender = gender or next((g for g, ts in FIRST_NAMES.items() if m["a"] in ts), "")
                # After a title: a surname, or a first name and a surname; only words that begin with a capital count.
                words = [x for x in (("a", "b", "c") if title else ("first", "last")) if m[x]]
                while words and not m[words[-1]][0].isupper():
                    words.pop()
                if not words or not all(m[x][0].isupper() for x in words) or (not title and len(words) < 2):
                    continue
                for x in words[:2]:
                    part = "surname" if x == words[:2][-1] else f"first_{gender}"
                    found.append((m.start(x), -m.end(x), rank, part, _lower(m[x])))
                continue
            if kind == "ip" and any(int(x) > 255 for x in s.split(".")):
                continue
            if kind == "iban" and iban_rest(s.replace(" ", "")) != 1:
                continue
            if kind == "card" and not (luhn(digits) or (len(digits) in (15, 16) and digits[0] in "3456")):
                continue
            if kind == "phone" and not 7 <= len(digits) <= 15:
                continue
            entity = _lower(s) if kind in ("email", "ip6") else s if kind == "ip" else s.replace(" ", "") if kind == "iban" else ("+" if s[0] == "+" else "") + digits
            found.append((m.start(), -m.end(), rank, kind, entity))
    out, at = [], 0
    for start, end, _, kind, entity in sorted(found):
        if start >= at:
            out.append((start, -end, kind, entity))
            at = -end
    return out


@lru_cache(4096)
def alphabet(c: str) -> str:
    """The characters that may stand in the place of ``c``: digits for digits, letters of its kind, script and case for letters, nothing else for others."""
    if c.isascii():
        for group in ("0123456789", "aeiou", "bcdfghjklmnpqrstvwxyz", "AEIOU", "BCDFGHJKLMNPQRSTVWXYZ"):
            if c in group:
                return group
        return c
    kind, low = unicodedata.category(c), c.lower()
    if kind[0] != "L":
        return c
    vowels = next((v for v in _VOWELS if low in v), None)
    run = ord(c) - ord(c) % 64
    some = [chr(x) for x in range(run, run + 64) if unicodedata.category(chr(x)) == kind and len(chr(x).lower()) == 1]
    return "".join(x for x in some if (any(x.lower() in v for v in _VOWELS)) == (vowels is not None)) or c


def whole_key(key: bytes) -> bytes:
    """A key as the hash takes it: of more than 64 bytes its digest, so all of them count."""
    return key if len(key) <= 64 else hashlib.blake2b(key).digest()


def _mixed(key: bytes, label: bytes, step: int, value: int, bits: int) -> int:
    size = (bits + 7) // 8
    raw = b"".join(hashlib.blake2b(label + b"|%d|%d|%d" % (step, i, value), key=whole_key(key)).digest() for i in range(-(-size // 64)))
    return int.from_bytes(raw[:size], "big") & ((1 << bits) - 1)


def permuted(x: int, n: int, key: bytes, label: bytes, back: bool = False) -> int:
    """A keyed permutation of the numbers below ``n``: a Feistel network of the next even number of bits, walked on until a number below ``n`` comes."""
    half = max(1, ((n - 1).bit_length() + 1) // 2)
    mask = (1 << half) - 1
    while True:
        a, b = x >> half, x & mask
        for step in reversed(range(PASSES)) if back else range(PASSES):
            if back:
                a, b = b ^ _mixed(key, label, step, a, half), a
            else:
                a, b = b, a ^ _mixed(key, label, step, b, half)
        x = a << half | b
        if x < n:
            return x


def moved(s: str, letters: list[str], key: bytes, label: str) -> str:
    """Another text with a character of ``letters[i]`` in each place i: a permutation of all such texts that leaves none where it is, if there are two."""
    n, x = 1, 0
    for c, group in zip(s, letters, strict=True):
        n, x = n * len(group), x * len(group) + group.index(c)
    if n == 1:
        return s
    tag = hashlib.blake2b(repr((label, letters)).encode(), key=whole_key(key)).digest()
    turn = 1 + _mixed(key, tag, PASSES, 0, n.bit_length() + 64) % (n - 1)
    # The texts in the order of one keyed permutation, each moved on by the same number of places.
    x = permuted((permuted(x, n, key, tag) + turn) % n, n, key, tag, True)
    out = []
    for group in reversed(letters):
        x, i = divmod(x, len(group))
        out.append(group[i])
    return "".join(reversed(out))


def _like(s: str, key: bytes, label: str) -> str:
    return moved(s, [alphabet(c) for c in s], key, label)


# The ranges of private and local addresses, by the octets that tell them.
def _private(octets: list[str]) -> int:
    """How many octets at the head of an address say that it is private; 0 of a public one."""
    return 1 if octets[0] in ("10", "127") else 2 if octets[:2] == ["192", "168"] or (octets[0] == "172" and 16 <= int(octets[1]) < 32) else 0


def surrogate(kind: str, entity: str, key: bytes = DEFAULT_KEY) -> str:
    """The surrogate of an entity, in the form of entities of its kind. Of one kind no two entities have the same."""
    if kind == "email":
        local, _, domain = entity.partition("@")
        name, _, top = domain.rpartition(".")
        return _like(local, key, "local") + "@" + _like(name, key, "domain") + "." + top  # of one domain all addresses stay in one
    if kind == "ip":
        octets = [str(int(x)) for x in entity.split(".")]
        kept = _private(octets)
        n, x = 256 ** (4 - kept), int.from_bytes(bytes(int(x) for x in octets[kept:]), "big")
        tag = ("ip" + ".".join(octets[:kept])).encode()
        while True:  # a public address walks on until it is public again
            x = permuted((permuted(x, n, key, tag) + 1) % n, n, key, tag, True)
            out = octets[:kept] + [str(b) for b in x.to_bytes(4 - kept, "big")]
            if kept or not _private(out):
                return ".".join(out)
    if kind == "ip6":
        return moved(entity, ["0123456789abcdef" if c != ":" else c for c in entity], key, "ip6")
    if kind == "iban":
        body = _like(entity[4:], key, "iban" + entity[:2])
        return entity[:2] + f"{98 - iban_rest(entity[:2] + '00' + body):02d}" + body
    if kind == "card":
        if luhn(entity):
            made = entity[0] + _like(entity[1:-1], key, "card")
            return next(x for d in "0123456789" if luhn(x := made + d))
        made = entity[0] + _like(entity[1:], key, "number")
        while luhn(made):
            made = entity[0] + _like(made[1:], key, "number")
        return made
    if kind == "phone":
        kept = 2 if entity[0] == "+" else 0
        first = "23456789" if entity[kept] in "23456789" else "01"
        return entity[:kept] + moved(entity[kept:], [first, *[alphabet(c) for c in entity[kept + 1 :]]], key, "phone" + entity[:kept])
    if kind == "ssn":
        return _like(entity, key, "ssn")
    # Names keep their last letter, which shows the gender in many languages.
    return _like(entity[:-1], key, kind) + entity[-1]


def shaped(mention: str, kind: str, core: str) -> str:
    """A surrogate in a mention's form: its separators, its letter case."""
    if kind in ("card", "ssn", "phone", "iban"):
        left = iter(core.lstrip("+"))
        return "".join(next(left) if c.isalnum() else c for c in mention)
    if kind == "ip":
        return core
    return "".join(c.upper() if m.isupper() and len(c.upper()) == 1 else c for m, c in zip(mention, core, strict=True))


_MENTIONS = StructType([StructField("entities", ArrayType(StructType([StructField(c, StringType()) for c in ("kind", "entity", "surrogate")])))])


def collisions(df: DataFrame, text: str = "text", key: bytes = DEFAULT_KEY) -> DataFrame:
    """kind, surrogate, n: surrogates that several entities of the table share, or that are the entity itself. None are expected: a check over all rows."""

    def found(texts: list) -> list:
        return [[[{"kind": k, "entity": e, "surrogate": surrogate(k, e, key)} for k, e in dict.fromkeys((k, e) for _, _, k, e in mentions(t))] for t in texts]]

    read = df.filter(likely(F.col(text))).select(F.col(text).alias("t"))
    every = map_texts(read, "t", [], _MENTIONS, lambda: found).select(F.explode("entities").alias("e")).select("e.*").distinct()
    shared = every.groupBy("kind", "surrogate").agg(F.count("*").alias("n"), F.max(F.col("entity") == F.col("surrogate")).alias("own"))
    return shared.filter("n > 1 OR own").select("kind", "surrogate", "n")


def replace_pii(df: DataFrame, text: str = "text", key: bytes = DEFAULT_KEY) -> DataFrame:
    """All columns of ``df`` with personal data in ``text`` replaced, and ``pii_kinds``, the kinds of the mentions in order.

    A null text stays null, an empty one empty; both have no mentions, as have
    texts without personal data, which stay as they are. Equal entities get equal surrogates in all rows, repeats
    and all; a column named ``pii_kinds`` is replaced. An empty table gives an empty result.
    """
    names = [c for c in df.columns if c != "pii_kinds"]
    rows = df.select(*names)
    at = names.index(text)
    schema = StructType([*rows.schema.fields, StructField("pii_kinds", ArrayType(StringType()))])
    kinds_type = to_arrow_type(ArrayType(StringType()))
    ship_package(df.sparkSession)

    def rewritten(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = lru_cache(100_000)(lambda kind, entity: surrogate(kind, entity, key))
        for batch in batches:
            for part in slices(batch, at):
                texts, kinds = [], []
                for t, may in zip(part.column(at).to_pylist(), part["__likely"].to_pylist(), strict=True):
                    seen: list[str] = []
                    if may:
                        pieces, last = [], 0
                        for start, end, kind, entity in mentions(t):
                            pieces += [t[last:start], shaped(t[start:end], kind, known(kind, entity))]
                            last = end
                            seen.append(kind)
                        t = "".join(pieces) + t[last:]
                    texts.append(t)
                    kinds.append(seen)
                columns = [pa.array(texts, c.type) if i == at else c for i, c in enumerate(part.columns[: len(names)])]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(kinds, kinds_type)], names=schema.names)

    return rows.withColumn("__likely", likely(F.col(text))).mapInArrow(rewritten, schema)
