"""Validation, dates and scores as Column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from letterloom.functions import rules
from letterloom.functions.text import col, digits, first_match, once, replace, strip


def _two(c: Column) -> Column:
    return F.lpad(c.cast("int").cast("string"), 2, "0")


def signer_id(raw, text) -> Column:
    """struct(valid, id): an 18-digit id is judged as it is; any other is sought in the text."""
    healed = replace(first_match(text, rules.SIGNER_ID_HEALED, 0), r"\s", "")  # the groups, next to each other

    def judge(d: Column) -> Column:
        birth, joined, sex = (F.substring(d, a, n).try_cast("int") for a, n in ((1, 4), (9, 4), (15, 1)))
        plausible = birth.between(1940, 2025) & joined.between(1960, 2030) & sex.isin(1, 2)
        sought = once(healed, lambda h: F.struct(h.isNotNull().alias("valid"), h.alias("id")))
        return F.when(F.length(d) == 18, F.struct(plausible.alias("valid"), d.alias("id"))).otherwise(sought)

    return once(digits(raw), judge)


def date_iso(raw) -> Column:
    """ISO date of a written one: ISO as it is, then day, month name, year by the order of the month table, then d/m/y."""

    def read(c: Column) -> Column:
        tries = [F.when(c.rlike(r"\b\d{4}-\d{2}-\d{2}\b"), F.regexp_extract(c, r"\b\d{4}-\d{2}-\d{2}\b", 0))]
        for name, number in rules.MONTHS:
            p = rf"\b(\d{{1,2}})\s+{name}\s+(\d{{4}})\b"
            tries.append(F.when(F.contains(c, F.lit(name)) & c.rlike(p), F.concat(F.regexp_extract(c, p, 2), F.lit(f"-{number:02d}-"), F.lpad(F.regexp_extract(c, p, 1), 2, "0"))))
        p = r"\b(\d{1,2})[/\-](\d{1,2})[/\-](\d{4})\b"
        day, month = (F.regexp_extract(c, p, k).try_cast("int") for k in (1, 2))
        tries.append(F.when(c.rlike(p) & month.between(1, 12) & day.between(1, 31), F.concat(F.regexp_extract(c, p, 3), F.lit("-"), _two(month), F.lit("-"), _two(day))))
        return F.coalesce(*tries)

    return once(F.lower(strip(raw)), read)


def date_sheet(raw) -> Column:
    """struct(value, changed): a date as spreadsheets write it, made ISO; anything else is left as it is."""
    def read(s: Column) -> Column:
        iso, dmy, named = r"^(\d{4})-(\d{1,2})-(\d{1,2})$", r"^(\d{1,2})[/\-.](\d{1,2})[/\-.](\d{4})$", r"^(\d{1,2})\s+([A-Za-z]+)\s+(\d{4})$"

        def part(p: str, k: int) -> Column:
            return F.regexp_extract(s, p, k)

        a, b = part(dmy, 1).try_cast("int"), part(dmy, 2).try_cast("int")
        swapped = (b > 12) & (a <= 12)
        months = F.create_map(*(x for name, n in rules.SHEET_MONTHS for x in (F.lit(name), F.lit(f"{n:02d}"))))
        month = F.try_element_at(months, F.lower(part(named, 2)))
        new = (
            F.when(s.rlike(iso), F.concat(part(iso, 1), F.lit("-"), _two(part(iso, 2).try_cast("int")), F.lit("-"), _two(part(iso, 3).try_cast("int"))))
            .when(s.rlike(dmy), F.concat(part(dmy, 3), F.lit("-"), _two(F.when(swapped, a).otherwise(b)), F.lit("-"), _two(F.when(swapped, b).otherwise(a))))
            .when(s.rlike(named) & month.isNotNull(), F.concat(part(named, 3), F.lit("-"), month, F.lit("-"), _two(part(named, 1).try_cast("int"))))
        )
        changed = F.when(s.rlike(iso), new != s).otherwise(new.isNotNull())
        return F.struct(F.coalesce(new, s).alias("value"), changed.alias("changed"))

    return once(strip(F.coalesce(col(raw), F.lit(""))), read)


def date_variants(iso) -> Column:
    """The ways a letter may write an ISO date, normalised for the value audit; empty for what is no date."""
    p = r"^(\d{4})-(\d{2})-(\d{2})"
    y, m, d = (F.regexp_extract(F.coalesce(col(iso), F.lit("")), p, k) for k in (1, 2, 3))
    name = F.try_element_at(F.array(*map(F.lit, rules.MONTH_NAMES)), F.when(m.try_cast("int") > 0, m.try_cast("int")))
    day = d.try_cast("int").cast("string")
    join = lambda sep, *parts: F.concat_ws(sep, *parts)
    forms = F.array(join(" ", day, name, y), join(" ", d, name, y), join(" ", name, day, y), *(join(s, x, m, y) for s in " /" for x in (day, d)))  # a hyphen is normalised to a space
    return F.when(F.coalesce(col(iso), F.lit("")).rlike(p) & name.isNotNull(), forms).otherwise(F.array().cast("array<string>"))


def confidence(doc_number, agency, subject, iso_date, signer, valid, url) -> Column:
    """struct(score, hundredths, flags, review). A document without any id still gets a little for it; any flag asks for review."""
    w = rules.WEIGHTS

    def long(c, n: int) -> Column:
        return F.coalesce(F.length(strip(c)) > n, F.lit(False))

    def given(c) -> Column:
        return F.coalesce(col(c) != "", F.lit(False))

    ok = {"doc_number": long(doc_number, 5), "agency": long(agency, 3), "subject": long(subject, 3), "letter_date": given(iso_date)}
    points = sum((F.when(v, w[k]).otherwise(0) for k, v in ok.items()), F.lit(0))
    points += F.when(~given(signer), w["signer_id_absent"]).when(col(valid), w["signer_id"]).otherwise(w["signer_id_suspicious"])
    points = F.least(points + F.when(given(url), w["verification_url"]).otherwise(0), F.lit(100))
    flags = [F.when(~v, rules.FLAGS[k]) for k, v in ok.items()] + [F.when(given(signer) & ~col(valid), rules.FLAGS["signer_id"])]
    flags = F.filter(F.array(*flags), lambda x: x.isNotNull())
    result = lambda v: F.struct((v["p"] / 100).alias("score"), v["p"].alias("hundredths"), v["f"].alias("flags"), needs_review(v["p"], v["f"]).alias("review"))
    return once(F.struct(points.alias("p"), flags.alias("f")), result)


def needs_review(hundredths: Column, flags: Column) -> Column:
    return (hundredths < 70) | (F.size(flags) > 0)


def resolve(normalised, raw) -> Column:
    """The normalised value, or the raw one where there is none; empty counts as none."""
    return F.coalesce(F.nullif(col(normalised), F.lit("")), col(raw))


def scanned(words) -> Column:
    return col(words) < 30


def score_format(c) -> Column:
    return F.translate(F.format_string("%.2f", col(c).cast("double")), ".", ",")


def content_hash(normalised) -> Column:
    """Hash of a normalised text of 50 characters at least, else empty."""
    return once(normalised, lambda n: F.when(F.length(n) >= 50, F.sha2(n.cast("binary"), 256)).otherwise(""))


def page_pick(pages, limit) -> Column:
    """Zero-based pages to read: the first ``limit`` and the last; all where ``limit`` is not positive or covers them."""
    n, k = col(pages), col(limit)
    everything = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    return F.when((k <= 0) | (k >= n), everything).otherwise(F.array_union(F.slice(everything, 1, F.greatest(k, F.lit(0))), F.array(n - 1)))
