"""Document type, region and evidence tags as Column functions over the rule tables."""

from __future__ import annotations

import functools
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from letterloom.functions import rules
from letterloom.functions.text import col, found, once, replace, rx, split_glued, strip


def required_words(pattern: str) -> list[str]:
    """All runs of letters that every match of a pattern of the rule tables holds, the longest first."""
    plain = re.sub(r"\(\?:[^)]*\)[?*+]?", " ", pattern)  # what a group holds may vary
    plain = re.sub(r"\\.[?*+]?", " ", plain)
    plain = re.sub(r".[?*]", " ", plain)
    return sorted(set(re.findall("[a-z]+", plain)), key=lambda w: (-len(w), w)) if "|" not in plain else []


def required_word(pattern: str) -> str:
    """The longest of them; empty if none is found."""
    return next(iter(required_words(pattern)), "")


def type_text(text, filename) -> Column:
    """What the type's patterns are tried on."""
    return F.lower(F.concat(F.coalesce(col(filename), F.lit("")), F.lit("\n"), F.coalesce(col(text), F.lit(""))))


def odd_letters(both) -> Column:
    """Whether a text has one of the two letters that equal s and i whatever the case."""
    return F.contains(col(both), F.lit("\u017f")) | F.contains(col(both), F.lit("\u0131"))


def best_type(both, odd) -> Column:
    """hits * 100 + preference of the best type; under 100 where no pattern is met. No join and no shuffle, the rules are part of the expression.

    A pattern is tried only where the words that it requires stand in the text: plain searches cost a small part of
    a pattern's, and all of them less than one pattern of all words. Texts with odd letters are tried by all patterns.
    """
    both, odd, last = col(both), col(odd), len(rules.DOC_TYPES)

    def hit(pattern: str) -> Column:
        words = required_words(pattern)
        tried = found(both, pattern, "im")
        held = [F.contains(both, F.lit(w)) for w in words]
        return F.when((odd | functools.reduce(lambda a, b: a & b, held)) & tried if held else tried, 1).otherwise(0)

    return F.greatest(*(sum(map(hit, patterns), F.lit(0)) * 100 + (last - order) for order, (_, patterns, _) in enumerate(rules.DOC_TYPES) if patterns))


def type_or_none(best) -> Column:
    return F.when(col(best) >= 100, col(best)).otherwise(0)


def type_code(text, filename) -> Column:
    """As ``best_type``, 0 where no pattern is met."""
    pair = lambda b: F.struct(b.alias("both"), odd_letters(b).alias("odd"))
    return once(once(type_text(text, filename), lambda b: once(pair(b), lambda v: best_type(v["both"], v["odd"]))), type_or_none)


def doc_type(text, filename) -> Column:
    """struct(type, hits, confidence): the type with most patterns, ties by preference; an image is media whatever it says."""
    return typed(filename, type_code(text, filename))


def typed(filename, code: Column) -> Column:
    """As ``doc_type``, by ``type_code``."""
    names = F.array(*(F.lit(t) for t, _, _ in rules.DOC_TYPES))

    def result(code: Column) -> Column:
        hits = F.floor(code / 100).cast("int")
        kind = F.when(code == 0, rules.UNKNOWN_TYPE).otherwise(F.element_at(names, (F.lit(len(rules.DOC_TYPES)) - code % 100 + 1).cast("int")))
        sure = F.when(code == 0, F.lit(0)).otherwise(F.least(F.lit(100), 50 + 15 * hits))
        return F.struct(kind.alias("type"), hits.alias("hits"), (sure / 100).alias("confidence"))

    image = F.struct(F.lit(rules.MEDIA_TYPE).alias("type"), F.lit(0).alias("hits"), (F.lit(80) / 100).alias("confidence"))
    return F.when(is_image(filename), image).otherwise(once(code, result))


def is_image(filename) -> Column:
    return F.coalesce(col(filename), F.lit("")).rlike(rules.IMAGE_SUFFIX)


def relevant_fields(kind) -> Column:
    pairs = [x for name, _, fields in rules.DOC_TYPES for x in (F.lit(name), F.array(*map(F.lit, fields)).cast("array<string>"))]
    return F.try_element_at(F.create_map(*pairs), col(kind))


def irrelevant_fields(kind) -> Column:
    return F.array_except(F.array(*map(F.lit, rules.FIELDS)), relevant_fields(kind))


def region(text) -> Column:
    """struct(code, name): the first government entity decides, else a mention of the home name."""
    home = F.lit(rules.HOME_NAME)

    def named(kind: Column, name: Column) -> Column:
        code = F.when(F.contains(name, home), rules.HOME_REGION).otherwise(rules.OUTSIDE_REGION)
        return F.struct(code.alias("code"), strip(F.concat_ws(" ", kind, name)).alias("name"))

    def mentioned(t: Column) -> Column:
        here = F.struct(F.lit(rules.HOME_REGION).alias("code"), F.lit(f"KOTA {rules.HOME_NAME}").alias("name"))
        return F.when(F.contains(t, home), here).otherwise(F.struct(F.lit(rules.UNKNOWN_REGION).alias("code"), F.lit("").alias("name")))

    def judge(t: Column) -> Column:
        name = strip(replace(F.regexp_extract(t, rx(rules.ENTITY, "i"), 2), r"\s+", " "))
        return F.when(found(t, rules.ENTITY, "i"), once(name, lambda n: named(F.regexp_extract(t, rx(rules.ENTITY, "i"), 1), n))).otherwise(mentioned(t))

    return once(split_glued(F.upper(F.coalesce(col(text), F.lit("")))), judge)


def tag(text) -> Column:
    """struct(tag, keyword) of the first tag with a keyword in the text; both null without one."""
    table = F.array(*(F.struct(F.lit(t).alias("tag"), F.lit(k).alias("keyword")) for t, words in rules.TAGS for k in words))
    first = lambda low: F.get(F.filter(table, lambda r: F.contains(low, r["keyword"])), F.lit(0))
    return once(F.lower(F.coalesce(col(text), F.lit(""))), first)


def skipped_name(filename) -> Column:
    return F.lower(col(filename)).rlike("|".join(rules.SKIP_NAMES))


def evidence_id(position) -> Column:
    return F.format_string("EVD-%04d", col(position))


def split_rank(key, seed: int = 42) -> Column:
    """A place for each key in a seeded order that any SQL engine can compute."""
    return ((col(key).cast("bigint") + seed) * 48271) % 2147483647
