"""Operator 11: personal data in texts.

Regular expressions propose spans, checksum validators confirm them (Luhn for card numbers, mod-97 for bank account
numbers, the value of each part for addresses), and words nearby raise or lower the score. Four kinds of base spans
have a fixed definition and always stand: ``email``, ``ip``, ``card``, ``phone``. Spans of the other kinds, and
further spans of these, stand where their score reaches 0.5. All patterns take time in proportion to the text: each
begins only where no earlier place could have begun the same match.
"""

from __future__ import annotations

import ipaddress
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from letterloom.llm.common import text_batches

#: Kinds in the order in which spans that start together are listed.
BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "iban", "ssn", "ip6")
THRESHOLD = 0.5
#: Characters before and after a span in which context words count.
NEAR = 40

# Words that make a kind likelier nearby, in the languages of the corpus.
CONTEXT = {
    "email": ("mail", "email", "contact", "kontakt", "contacto", "correo", "courriel"),
    "ip": ("ip", "address", "host", "server", "client", "adresse", "direccion"),
    "card": ("card", "credit", "visa", "mastercard", "amex", "karte", "kreditkarte", "carte", "tarjeta"),
    "phone": ("phone", "tel", "telephone", "call", "mobile", "cell", "fax", "telefon", "handy", "telefono", "movil", "portable"),
    "iban": ("iban", "account", "bank", "konto", "compte", "banque", "cuenta", "banco"),
    "ssn": ("ssn", "social", "security", "sozialversicherung"),
    "ip6": ("ip", "ipv6", "address", "host", "server", "client"),
}
# Words that make a number something else.
CONTRARY = {
    "ip": ("version", "release", "section", "chapter", "kapitel", "chapitre"),
    "card": ("isbn", "order", "invoice", "tracking", "serial", "rechnung", "facture", "factura"),
    "phone": ("isbn", "order", "invoice", "serial", "version"),
    "ssn": ("isbn", "part", "serial", "version"),
}

_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9]++(?:[\x20-][0-9]++)*+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LONG = re.compile(r"[0-9](?:[\x20-]?[0-9]){11}")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?:[\x20-][A-Z0-9]{4}){2,7}(?:[\x20-][A-Z0-9]{1,3})?)(?![A-Za-z0-9])")
_SSN = re.compile(r"(?<![0-9A-Za-z-])([0-9]{3})-([0-9]{2})-([0-9]{4})(?![0-9A-Za-z-])")
_LOCAL_PHONE = re.compile(r"(?<![0-9A-Za-z+(.-])(?:\([0-9]{3,5}\)[\x20-]?|0?[0-9]{2,4}[\x20./-])[0-9]{3,4}[\x20.-][0-9]{3,4}(?![0-9A-Za-z-])")
_SPELT = re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}\x20?[(\[{]\x20?(?:at|AT)\x20?[)\]}]\x20?[A-Za-z0-9-]{1,63}(?:\x20?[(\[{]\x20?(?:dot|DOT)\x20?[)\]}]\x20?[A-Za-z0-9-]{1,63}|\.[A-Za-z0-9-]{1,63})+")
_IP6 = re.compile(r"(?<![0-9A-Za-z:.])[0-9A-Fa-f]{0,4}(?::[0-9A-Fa-f]{0,4}){3,7}(?![0-9A-Za-z:])")
_WORD = re.compile(r"[^\W\d_]+")


@dataclass(frozen=True)
class Span:
    kind: str
    start: int
    end: int
    score: float
    base: bool


def luhn(digits: str) -> bool:
    """Whether the last digit is the check digit of a card number."""
    total = sum(map(int, digits[-1::-2])) + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return total % 10 == 0


def mod97(account: str) -> bool:
    """Whether the check digits of an account number without spaces are right."""
    turned = account[4:] + account[:4]
    return int("".join(str(int(c, 36)) for c in turned)) % 97 == 1


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def emails(text: str) -> Iterator[tuple[int, int]]:
    """What ``[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+`` finds, sought from each ``@``, since that is in no class."""
    least, at = 0, text.find("@")
    while at >= 0:
        begin = least + len(text[least:at].rstrip(_LOCAL))
        domain = _DOMAIN.match(text, at + 1) if begin < at else None
        if domain:
            yield begin, domain.end()
        least = domain.end() if domain else at + 1
        at = text.find("@", least)


def ips(text: str) -> Iterator[tuple[int, int]]:
    for m in _IP.finditer(text):
        if all(len(v := p.lstrip("0")) <= 3 and int(v or 0) <= 255 for p in m.group().split(".")):
            yield m.span()


def cards(text: str) -> Iterator[tuple[int, int]]:
    if not _LONG.search(text):
        return
    for m in _CARD.finditer(text):
        if 12 <= m.end() - m.start() <= 37 and 12 <= len(d := _digits(m.group())) <= 19 and luhn(d):
            yield m.span()


def phones(text: str) -> Iterator[tuple[int, int]]:
    if "+" not in text:
        return
    for m in _PHONE.finditer(text):
        if 9 <= sum("0" <= c <= "9" for c in m.group()) <= 15:
            yield m.span()


def accounts(text: str) -> Iterator[tuple[int, int, float]]:
    """Bank account numbers; a capital word behind one is left out where the checksum says so."""
    for m in _IBAN.finditer(text):
        found = m.group()
        while found:
            plain = found.replace(" ", "").replace("-", "")
            if 15 <= len(plain) <= 34 and mod97(plain):
                yield m.start(), m.start() + len(found), 0.8
                break
            cut = max(found.rfind(" "), found.rfind("-"))
            found = found[:cut] if cut > 0 else ""


def social_numbers(text: str) -> Iterator[tuple[int, int, float]]:
    for m in _SSN.finditer(text):
        area, group, serial = m.groups()
        if area not in ("000", "666") and area < "900" and group != "00" and serial != "0000":
            yield *m.span(), 0.5


def local_phones(text: str) -> Iterator[tuple[int, int, float]]:
    """Numbers without the code of a country: only a word nearby makes them more than numbers."""
    for m in _LOCAL_PHONE.finditer(text):
        if 9 <= len(_digits(m.group())) <= 12:
            yield *m.span(), 0.3


def spelt_emails(text: str) -> Iterator[tuple[int, int, float]]:
    if "at" in text or "AT" in text:
        for m in _SPELT.finditer(text):
            yield *m.span(), 0.6


def long_addresses(text: str) -> Iterator[tuple[int, int, float]]:
    if "::" not in text and text.count(":") < 7:
        return
    for m in _IP6.finditer(text):
        try:
            ipaddress.IPv6Address(m.group())
        except ValueError:
            continue
        if sum(map(str.isalnum, m.group())) >= 5:
            yield *m.span(), 0.6


BASE: dict[str, tuple[Callable, float]] = {"email": (emails, 0.9), "ip": (ips, 0.6), "card": (cards, 0.7), "phone": (phones, 0.8)}
FURTHER: tuple[tuple[str, Callable], ...] = (("iban", accounts), ("ssn", social_numbers), ("phone", local_phones), ("email", spelt_emails), ("ip6", long_addresses))


def adjusted(text: str, kind: str, start: int, end: int, score: float) -> float:
    """The score with what the words nearby add (0.3) or take (0.3), once each."""
    near = {w.lower() for w in _WORD.findall(text[max(0, start - NEAR) : start] + " " + text[end : end + NEAR])}
    if not near.isdisjoint(CONTEXT[kind]):
        score += 0.3
    if not near.isdisjoint(CONTRARY.get(kind, ())):
        score -= 0.3
    return round(min(1.0, max(0.0, score)), 6)


def spans(text: str, threshold: float = THRESHOLD) -> list[Span]:
    """All spans by start, then kind. Of further spans, one that overlaps a base span or an earlier one is left out."""
    found = [Span(kind, a, b, adjusted(text, kind, a, b, prior), True) for kind, (find, prior) in BASE.items() for a, b in find(text)]
    more = sorted((a, KINDS.index(kind), b, adjusted(text, kind, a, b, prior), kind) for kind, find in FURTHER for a, b, prior in find(text))
    if more:
        taken = sorted((s.start, s.end) for s in found)
        at = end = 0
        for a, _, b, score, kind in more:
            if score < threshold or a < end:
                continue
            while at < len(taken) and taken[at][1] <= a:
                at += 1
            if any(x < b and y > a for x, y in taken[at : at + 4]):
                continue
            found.append(Span(kind, a, b, score, False))
            end = b
    return sorted(found, key=lambda s: (s.start, KINDS.index(s.kind), s.end))


_SPANS = "array<struct<kind:string,start:int,end:int,score:double,base:boolean>>"


def find_personal_data(docs: DataFrame, threshold: float = THRESHOLD, *, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The ``keep`` columns and ``spans`` of every row of ``docs`` (text), from the whole text; nothing is shuffled.

    ``start`` and ``end`` (exclusive) count code points. Null and empty texts have no spans, repeated rows have each
    their own, keys may be null, and columns that are not kept are not read.
    """
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64()), ("base", pa.bool_())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin, texts in text_batches(batch.column("text")):
                found = [[vars(s) for s in spans(t, threshold)] for t in texts]
                yield pa.record_batch([*(batch.column(c).slice(begin, len(texts)) for c in keep), pa.array(found, kind)], names=[*keep, "spans"])

    types = [f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep]
    return docs.select(*keep, "text").mapInArrow(run, ", ".join([*types, f"spans {_SPANS}"]))


def listed(spans: Column) -> Column:
    """``kind:start:end`` of each span, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def report(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """Counts of base spans by kind, a digest of the base spans, and all spans as text."""
    base = F.filter("spans", lambda s: s["base"])

    def count(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["base"] & (s["kind"] == kind))).cast("long").alias(f"n_{kind}")

    counts = map(count, BASE_KINDS)
    return found.select(key, *counts, F.sha2(listed(base).cast("binary"), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))


def masked(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with each span in ``text`` written as ``[KIND]``; overlapping spans are one, named by the first. Null texts stay null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index("text")
            texts = []
            for value in batch.column("text"):
                text = value.as_py()
                out, end = [], 0
                for s in spans(text or "", threshold):
                    if s.start >= end:
                        out += [text[end : s.start], f"[{s.kind.upper()}]"]
                    end = max(end, s.end)
                texts.append(text if text is None else "".join([*out, text[end:]]))
            yield batch.set_column(at, batch.schema.field(at), pa.array(texts, batch.schema.field(at).type))

    return docs.mapInArrow(run, docs.schema)
