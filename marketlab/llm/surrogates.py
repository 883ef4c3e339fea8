"""Personal data replaced by surrogates of the same kind.

Detected entities are replaced by values drawn with the caller's key: the same
entity has the same surrogate everywhere, different ones have different
surrogates. A keyed permutation of all values of an entity's format gives the
surrogate, so two entities can't collide, and lengths, separators, case, script
and accents are kept; card numbers keep a valid check digit if they had one,
phone numbers their country code. Known given names are permuted among those of
their gender and script, known family names among those of their script; other
names keep their shape, vowel for vowel and consonant for consonant.

Persons are a known given name with a family name, or a title with one to three
capitalized words. Where a person was found, their family or given name alone is
the same entity in the rest of the text. Names without a title or a known given
name aren't detected.

A collision check over the whole table groups the distinct entities by their
surrogates, and by whether a surrogate is itself an entity of the table: where
values meet, all but the first are replaced again with the next round of the
key. What still meets after ``ROUNDS``, as in a format of which most values
occur, takes its whole format to a last round of its own, whose permutation
keeps all apart; only there may a surrogate be another's value. Rounds other
than the first are kept as sorted arrays in the shared folder, which workers map;
entities travel as (kind, value), never as texts.

Nulls: a null text stays null, a null ``doc_id`` is kept. Repeated rows are
replaced alike. Empty texts have no entities; an empty table gives no rows. A
very long text is replaced whole. Other columns are kept by ``replace``.
"""

from __future__ import annotations

import hashlib
import hmac
import ipaddress
import math
import re
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Arrays, Scratch, buckets, column, put, shared_dir, slices, written

ROUNDS = 8

# Given names by script and gender, family names, and titles that state a gender.
NAMES = {
    ("latin", "f"): "Alice Anna Carmen Charlotte Clara Claire Elena Elise Emily Emma Eva Greta Hannah Ines Isabel Jane Julia Laura Lena Lucia Maria Marta Mary Nina Olivia Paula Rosa Sarah Sofia Susan".split(),
    ("latin", "m"): "Adam Alan Bruno Carlos Daniel David Diego Erik Felix Frank George Hans Henry Hugo Jack James John Jorge Jules Karl Leon Louis Lukas Mark Martin Oscar Paul Peter Robert Thomas".split(),
    ("latin", "family"): "Adler Baker Becker Bernard Brown Carter Castillo Davis Dubois Fischer Garcia Gomez Hoffmann Jones Keller Lambert Leroy Lopez Martin Meyer Miller Moreau Navarro Petit Richter Rivera Schmidt Smith Taylor Weber".split(),
    ("cyrillic", "f"): "Анна Вера Дарья Елена Ирина Мария Нина Ольга Софья Татьяна".split(),
    ("cyrillic", "m"): "Алексей Борис Виктор Дмитрий Иван Михаил Николай Олег Павел Сергей".split(),
    ("cyrillic", "family"): "Белов Волков Егоров Зайцев Козлов Лебедев Морозов Новиков Орлов Соколов".split(),
}
TITLES = {"Mr": "m", "Mrs": "f", "Ms": "f", "Miss": "f", "Herr": "m", "Frau": "f", "Monsieur": "m", "Madame": "f", "Señor": "m", "Señora": "f", "Dr": "u", "Prof": "u"}
# Country calling codes of one and two digits; all others have three.
_CODES = frozenset("1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split())

_MAIL = r"(?<![\w.+-])[A-Za-z0-9_](?:[A-Za-z0-9_.+-]*[A-Za-z0-9_])?@[A-Za-z0-9](?:[A-Za-z0-9.-]*[A-Za-z0-9])?\.[A-Za-z]{2,}"
_CARD = r"(?<![\d.+-])(?:\d{4}[ -]?){3}\d{4}(?![\d-])|(?<![\d.+-])3[47]\d{2}[ -]?\d{6}[ -]?\d{5}(?![\d-])"
_SSN = r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])"
_IP = r"(?<![\d.])(?:\d{1,3}\.){3}\d{1,3}(?![\d.]*\d)"
_PHONE = r"(?<![\w+])\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:[ .-]?\d{2,4}){1,4}(?!\d)|(?<![\w(])\(\d{3}\) ?\d{3}-\d{4}(?!\d)|(?<![\w.-])\d{3}[-.]\d{3}[-.]\d{4}(?![\d-])"
_IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"
_WORD = r"[A-ZÀ-ÖØ-ÞА-Я][^\W\d_]+(?:[’'-][^\W\d_]+)*"
_PERSON = rf"(?<!\w)(?:(?P<title>{'|'.join(TITLES)})\.? (?P<named>{_WORD}(?: {_WORD}){{0,2}})|(?P<given>{'|'.join(sorted({n for (_, g), ns in NAMES.items() if g != 'family' for n in ns}))}) (?P<family>{_WORD}))(?!\w)"
_ALL = re.compile("|".join(f"(?P<{k}>{p})" for k, p in (("mail", _MAIL), ("iban", _IBAN), ("card", _CARD), ("ssn", _SSN), ("ip", _IP), ("phone", _PHONE))))
_NAME = re.compile(_PERSON)
_HINT = re.compile(r"[@\d]")


def detect(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the entities of a text, in order, not overlapping."""
    found = []
    for m in _ALL.finditer(text) if _HINT.search(text) else ():
        kind = m.lastgroup
        if kind == "ip" and any(int(p) > 255 for p in m[0].split(".")):
            continue
        found.append((m.start(), m.end(), kind))
    free = _gaps(found)
    named: list[tuple[int, int, str]] = []
    for m in _NAME.finditer(text):
        start = m.start("named") if m["title"] else m.start("given")
        words = [(start + w.start(), start + w.end()) for w in re.finditer(r"\S+", m["named"] or m[0])]
        if not free(start, m.end()):
            continue
        *given, family = words
        if m["title"] and not given and text[slice(*family)] in _GIVEN:
            given, family = [family], None
        named += [(a, b, _given(text[a:b])) for a, b in given] + ([(*family, "family")] if family else [])
    # the same names alone, further on or before
    known = {text[a:b]: kind for a, b, kind in reversed(named)}
    if known:
        taken = _gaps(sorted(named))
        for m in re.finditer(rf"(?<![\w’'-])(?:{'|'.join(map(re.escape, sorted(known, key=lambda n: (-len(n), n))))})(?![\w’'-])", text):
            if taken(m.start(), m.end()) and free(m.start(), m.end()):
                named.append((m.start(), m.end(), known[m[0]]))
    return sorted(found + named)


def _gaps(spans: list[tuple[int, int, str]]):
    """Whether a stretch meets none of some sorted spans."""
    starts, ends = [a for a, _, _ in spans], [b for _, b, _ in spans]

    def free(start: int, end: int) -> bool:
        i = bisect_left(starts, end)
        return i == 0 or ends[i - 1] <= start

    return free


_GIVEN = {n: g for (_, g), ns in NAMES.items() if g != "family" for n in ns}


def _given(name: str) -> str:
    """The kind of a given name: by its own gender, whatever the title, so that its mentions are one entity."""
    return f"given_{_GIVEN.get(name, 'u')}"


def canonical(kind: str, value: str) -> str:
    """The form under which mentions are one entity: without case in mail addresses, without separators in numbers."""
    if kind == "mail":
        return value.lower()
    if kind in ("card", "phone", "ssn"):
        return re.sub(r"[^\d+]", "", value)
    return value.replace(" ", "") if kind == "iban" else value


# -- keyed permutations


def _prf(key: bytes, *parts: object) -> int:
    return int.from_bytes(hmac.new(key, "\x1f".join(map(str, parts)).encode(), hashlib.sha256).digest(), "big")


def permuted(x: int, size: int, key: bytes, tweak: str) -> int:
    """A keyed permutation of range(size): a Feistel network on the next larger square, walked until it is back in range."""
    if size < 2:
        return x
    side = math.isqrt(size - 1) + 1
    while True:
        left, right = divmod(x, side)
        for r in range(8):
            left, right = right, (left + _prf(key, tweak, side, r, right)) % side
        x = left * side + right
        if x < size:
            return x


_ALPHABETS = ("0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")
# Vowels, consonants and accented letters of the scripts, of which names are made.
_SOUNDS = tuple(
    part for low in ("aeiou", "bcdfghjklmnpqrstvwxyz", "äöü", "áéíóú", "àèìòù", "âêîôû", "аеиоуыэюя", "бвгджзклмнпрстфхцчшщ") for part in (low, low.upper())
)


def reformatted(value: str, key: bytes, tweak: str, fixed: int = 0, alphabets: tuple[str, ...] = _ALPHABETS) -> str:
    """``value`` with its digits and letters permuted together, each within its alphabet; other characters and the first ``fixed`` stay."""
    places = [(i, a) for i, c in enumerate(value) if i >= fixed for a in alphabets if c in a]
    number, size = 0, 1
    for i, a in places:
        number = number * len(a) + a.index(value[i])
        size *= len(a)
    shape = shaped_as(value, alphabets)
    number = permuted(number, size, key, f"{tweak}|{shape}|{value[:fixed]}")
    out = list(value)
    for i, a in reversed(places):
        number, d = divmod(number, len(a))
        out[i] = a[d]
    return "".join(out)


def shaped_as(value: str, alphabets: tuple[str, ...]) -> str:
    return "".join(next((a[0] for a in alphabets if c in a), c) for c in value)


def format_of(kind: str, value: str) -> str:
    """What a surrogate has in common with its value: all values of a format are permuted together."""
    if kind.startswith("given_") or kind == "family":
        return "known" if value in _known(kind, value) else shaped_as(value, _SOUNDS)
    fixed = {"card": 1, "iban": 2, "phone": _code(value)}.get(kind, 0)
    valid = kind == "card" and luhn(value[:-1]) == int(value[-1])
    host = value.rpartition("@")[2] if kind == "mail" else ""
    return f"{value[:fixed]}|{shaped_as(value[fixed:], _ALPHABETS)}|{valid}|{host}"


def _code(value: str) -> int:
    """Characters of a phone number that are its country code."""
    if not value.startswith("+"):
        return 0
    return next((1 + n for n in (1, 2) if value[1 : 1 + n] in _CODES), 4)


def _known(kind: str, value: str) -> list[str]:
    script = "cyrillic" if re.match(r"[А-я]", value) else "latin"
    return NAMES.get((script, "family" if kind == "family" else kind[-1]), [])


def luhn(digits: str) -> int:
    """The check digit that completes ``digits``."""
    total = sum(d if i % 2 else d * 2 - 9 * (d > 4) for i, d in enumerate(map(int, reversed(digits))))
    return -total % 10


@lru_cache(maxsize=100_000)
def surrogate(kind: str, value: str, key: bytes, turn: int = 0) -> str:
    """The replacement of a canonical value; different values of one format have different ones."""
    tweak = f"{kind}|{turn}"
    if kind == "mail":
        local, _, host = value.rpartition("@")
        return f"{reformatted(local, key, tweak + host)}@{reformatted(host.rpartition('.')[0], key, tweak + 'host')}.{host.rpartition('.')[2]}"
    if kind == "card":
        if luhn(value[:-1]) == int(value[-1]):
            body = reformatted(value[:-1], key, tweak, 1)
            return body + str(luhn(body))
        out = reformatted(value, key, tweak, 1)
        while luhn(out[:-1]) == int(out[-1]):  # stays among the numbers without a valid check digit
            out = reformatted(out, key, tweak, 1)
        return out
    if kind == "ip":
        number = int(ipaddress.ip_address(".".join(str(int(p)) for p in value.split("."))))
        return str(ipaddress.ip_address(permuted(number, 1 << 32, key, tweak)))
    if kind == "phone":
        return reformatted(value, key, tweak, _code(value))
    if kind == "iban":
        return reformatted(value, key, tweak, 2)
    if kind.startswith("given_") or kind == "family":
        names = _known(kind, value)
        if value in names:
            return names[permuted(names.index(value), len(names), key, tweak)]
        out = reformatted(value, key, tweak, 0, _SOUNDS)
        while out in names:  # stays among the names that aren't known
            out = reformatted(out, key, tweak, 0, _SOUNDS)
        return out
    return reformatted(value, key, tweak)


def shaped(kind: str, original: str, replacement: str) -> str:
    """A canonical replacement in the form of the mention: its separators, or its case."""
    if kind in ("card", "phone", "ssn", "iban"):
        fill = iter(replacement.lstrip("+") if "+" in replacement else replacement)
        return "".join(next(fill, c) if c.isalnum() else c for c in original)
    if kind == "mail" and original.isupper():
        return replacement.upper()
    return replacement


# -- the operator


def entities(docs: DataFrame, key: bytes) -> DataFrame:
    """Distinct (``kind``, ``value``) of the table, with the first ``surrogate``."""

    def run(batches) -> Iterator:
        import pyarrow as pa

        seen: set[tuple[str, str]] = set()
        for batch in slices(batches, "text"):
            fresh = []
            for text in column(batch, "text").to_pylist():
                for a, b, kind in detect(text or ""):
                    pair = (kind, canonical(kind, text[a:b]))
                    if pair not in seen:
                        seen.add(pair)
                        fresh.append((*pair, surrogate(*pair, key)))
            if len(seen) > 200_000:
                seen.clear()
            if fresh:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*fresh, strict=True)], ["kind", "value", "surrogate"])

    return docs.select("text").mapInArrow(run, "kind string, value string, surrogate string").distinct()


def redrawn(rows: DataFrame, key: bytes, turn: int) -> DataFrame:
    """``kind`` and ``value`` with the surrogate of a round."""

    def run(batches) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            kinds, values = column(batch, "kind").to_pylist(), column(batch, "value").to_pylist()
            new = [surrogate(k, v, key, turn) for k, v in zip(kinds, values, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(kinds, pa.string()), pa.array(values, pa.string()), pa.array(new, pa.string()), pa.array([turn] * len(new), pa.int32())], ["kind", "value", "surrogate", "turn"])

    return rows.select("kind", "value").mapInArrow(run, "kind string, value string, surrogate string, turn int")


def formats(rows: DataFrame) -> DataFrame:
    def run(batches) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            made = [format_of(k, v) for k, v in zip(column(batch, "kind").to_pylist(), column(batch, "value").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([column(batch, "kind"), column(batch, "value"), pa.array(made, pa.string())], ["kind", "value", "format"])

    return rows.select("kind", "value").mapInArrow(run, "kind string, value string, format string")


def collisions(found: DataFrame, key: bytes, save=written, rounds: int = ROUNDS) -> DataFrame:
    """(``kind``, ``value``, ``surrogate``, ``turn``) of all entities, with rounds in which no two have one surrogate.

    Names may become other names of the table, since a list of names is
    permuted; they only have to be distinct.
    """
    state = save(found.withColumn("turn", F.lit(0)))
    for turn in range(1, rounds + 2):
        name = F.col("kind").startswith("given") | (F.col("kind") == "family")
        own = state.select(F.col("kind").alias("k"), F.col("value").alias("v"))
        taken = state.filter(~name).join(own, (F.col("kind") == F.col("k")) & (F.col("surrogate") == F.col("v")), "left_semi").select("kind", "value")
        shared = state.groupBy("kind", "surrogate").agg(F.count("*").alias("n"), F.min("value").alias("first")).filter("n > 1")
        later = state.join(shared, ["kind", "surrogate"]).filter("value <> first").select("kind", "value")
        if turn > rounds:  # whole formats, which one permutation keeps apart
            of = save(formats(state))
            later = of.join(of.join(later, ["kind", "value"], "left_semi").select("kind", "format").distinct(), ["kind", "format"], "left_semi").select("kind", "value")
            taken = later.limit(0)
        bad = save(taken.union(later).distinct())
        if bad.isEmpty():
            break
        state = save(state.join(bad, ["kind", "value"], "left_anti").select("kind", "value", "surrogate", "turn").unionByName(redrawn(bad, key, turn)))
    return state


def _name(kind: str, value: str) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(f"{kind}\x1f{value}".encode("utf-8", "surrogatepass"))


class Turns:
    """The rounds of entities, but the first one: sorted hashes and rounds in files by range, mapped by workers."""

    def __init__(self, folder: str, sizes: dict[int, int], parts: int):
        self.folder, self.sizes, self.parts, self.read = folder, sizes, parts, None

    @classmethod
    def write(cls, state: DataFrame) -> Turns:
        spark = state.sparkSession
        folder, parts = shared_dir(spark), buckets(spark)

        def named(batches) -> Iterator:
            import pyarrow as pa

            for batch in batches:
                names = np.array([_name(k, v) for k, v in zip(column(batch, "kind").to_pylist(), column(batch, "value").to_pylist(), strict=True)], np.uint64)
                yield pa.RecordBatch.from_arrays([pa.array((names % np.uint64(parts)).astype(np.int32)), pa.array(names.view(np.int64)), column(batch, "turn")], ["part", "name", "turn"])

        def store(batches) -> Iterator:
            import pyarrow as pa

            held: dict[int, list] = {}
            for batch in batches:
                for part, name, turn in zip(*(column(batch, c).to_numpy() for c in ("part", "name", "turn")), strict=True):
                    held.setdefault(int(part), []).append((int(np.int64(name).view(np.uint64)), int(turn)))
            for part, rows in held.items():
                rows.sort()
                put(folder, f"turns-{part}", np.array([x for x, _ in rows] + [t for _, t in rows], np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array([len(r) for r in held.values()], pa.int64())], ["part", "n"])

        moved = state.filter("turn > 0").select("kind", "value", F.col("turn").cast("int")).mapInArrow(named, "part int, name long, turn int")
        sizes = moved.repartitionById(parts, "part").mapInArrow(store, "part int, n long").collect()  # a row for each part
        return cls(folder, {r.part: r.n for r in sizes}, parts)

    def __call__(self, kind: str, value: str) -> int:
        if not self.sizes:
            return 0
        name = _name(kind, value)
        n = self.sizes.get(name % self.parts, 0)
        if not n:
            return 0
        self.read = self.read or Arrays(self.folder)
        names = self.read(f"turns-{name % self.parts}", 0, n)
        i = int(np.searchsorted(names, np.uint64(name)))
        return int(self.read(f"turns-{name % self.parts}", n + i, 1)[0]) if i < n and int(names[i]) == name else 0


def rewritten(text: str, turns, key: bytes) -> tuple[str, list[tuple[int, int, str]]]:
    parts, at, spans = [], 0, detect(text)
    for a, b, kind in spans:
        value = canonical(kind, text[a:b])
        parts += [text[at:a], shaped(kind, text[a:b], surrogate(kind, value, key, turns(kind, value)))]
        at = b
    return "".join([*parts, text[at:]]), spans


def replace(docs: DataFrame, key: bytes) -> DataFrame:
    """``docs`` with surrogates in ``text``, and ``n_entities``; ``n_chars``, if there, follows the text."""
    with Scratch(docs.sparkSession) as scratch:
        turns = Turns.write(collisions(entities(docs, key), key, scratch.written))
    docs = docs.drop("n_entities")
    schema = T.StructType([*docs.schema.fields, T.StructField("n_entities", T.LongType())])

    def run(batches) -> Iterator:
        import pyarrow as pa

        for batch in slices(batches, "text"):
            i = batch.schema.get_field_index("text")
            made = [(None, []) if t is None else rewritten(t, turns, key) for t in column(batch, "text").to_pylist()]
            batch = batch.set_column(i, batch.schema.field(i), pa.array([t for t, _ in made], batch.schema.field(i).type))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([len(s) for _, s in made], pa.int64())], schema=pa.schema([*batch.schema, pa.field("n_entities", pa.int64())]))

    out = docs.mapInArrow(run, schema)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.char_length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return out
