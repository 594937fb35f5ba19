"""Field extraction from a letter's text as Column functions; the first match wins, in array algebra and without a shuffle."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from letterloom.functions import rules
from letterloom.functions.text import clean_value, col, count_matches, first_match, found, line_clean, norm_agency, norm_name, normalize, once, replace, rx, strip, strip_bound, stripped_line_clean

_MARKS = " .;,"


def docnum_valid(c) -> Column:
    def valid(v: Column) -> Column:
        checks = F.length(v).between(5, 80) & F.contains(v, F.lit("/")) & found(v, r"\d") & found(v, "[A-Z]")
        checks &= ~found(v, "[a-z]{3,}-[a-z]{3,}") & ~found(v, rules.ADDRESS_IN_NUMBER, "i")
        return F.coalesce(checks, F.lit(False))

    return once(strip(c, _MARKS), valid)


def docnum_labelled(lines) -> Column:
    """The first line's labelled candidate that is a document number."""
    candidates = F.transform(col(lines), lambda x: strip(replace(first_match(x, rules.NUMBER_LABEL), rf"(?:{rules.NUMBER_CUT}).*$", "", "is"), _MARKS))
    return F.get(F.filter(candidates, docnum_valid), F.lit(0))


def docnum_fallback(text) -> Column:
    codes = F.transform(F.regexp_extract_all(col(text), F.lit(rx(rules.NUMBER_CODE)), F.lit(1)), lambda x: strip(x, _MARKS))
    return F.get(F.filter(codes, docnum_valid), F.lit(0))


def docnum(text, lines) -> Column:
    return F.coalesce(docnum_labelled(lines), docnum_fallback(text))


def header_zone(lines, of=None) -> Column:
    """Lines before the first number line among the first 15, ten at most; else the first eight. ``of``: what is taken in place of the lines."""
    taken = col(lines if of is None else of)
    place = F.array_position(F.transform(F.slice(col(lines), 1, 15), lambda x: found(x, rules.NUMBER_LINE, "i")), True)
    return once(place, lambda at: F.when(at > 0, F.slice(taken, F.lit(1), F.least(at - 1, F.lit(10)).cast("int"))).otherwise(F.slice(taken, 1, 8)))


def _agency_ok(b: Column) -> Column:
    """For a line already cleaned."""
    bad = found(b, rules.PLACEHOLDER, "i") | F.endswith(b, F.lit(":")) | found(b, rules.NOT_LETTERHEAD, "i") | found(b, rules.DOCUMENT_TITLE, "i")
    bad |= found(b, rules.FORM_LABEL, "i") | found(b, rules.SCREEN_NOISE, "i") | found(b, rules.ADDRESS, "i")
    bad |= (F.length(b) - F.length(F.replace(b, F.lit("."), F.lit(""))) > 2) | (count_matches(b, r"\b[a-z]{4,}\b") >= 4)
    return F.length(b).between(4, 110) & found(b, rules.AGENCY_WORD, "i") & ~bad  # few lines pass the second test


def agency_ok(c) -> Column:
    return once(line_clean(c), _agency_ok)


def agency(lines, clean=None) -> Column:
    """The first run of at most two letterhead lines next to each other, normalised; empty where there is none. ``clean``: of ``clean_lines``, where it is at hand."""
    zone = F.transform(header_zone(lines), line_clean) if clean is None else header_zone(lines, clean)
    marked = F.transform(zone, lambda b: F.struct(b.alias("line"), _agency_ok(b).alias("ok")))

    def take(done: Column, x: Column) -> Column:
        n = F.size(done["lines"])
        more = x["ok"] & ~done["over"]
        return F.struct(
            F.when(more, F.concat(done["lines"], F.array(x["line"]))).otherwise(done["lines"]).alias("lines"),
            (done["over"] | F.when(x["ok"], n >= 1).otherwise(n > 0)).alias("over"),
        )

    start = F.struct(F.array().cast("array<string>").alias("lines"), F.lit(False).alias("over"))
    return norm_agency(F.aggregate(marked, start, take, lambda d: F.array_join(d["lines"], " ")))


def subject_raw(text) -> Column:
    labelled = F.left(replace(strip(F.replace(first_match(text, rules.SUBJECT_LABEL, 1, "i"), F.lit("\n"), F.lit(" "))), r"\s+", " "), F.lit(200))
    return F.coalesce(labelled, *(F.when(found(text, p, "i"), value) for p, value in rules.SUBJECT_FALLBACKS))


def subject(text) -> Column:
    return once(subject_raw(text), lambda raw: F.when(raw.isNotNull(), F.left(normalize(raw), F.lit(200))))


def date_raw(text) -> Column:
    return first_match(text, rules.DATE_IN_TEXT, 1, "i")


def signer_id(text) -> Column:
    """Digits behind a label; only without any label, an id that stands alone."""
    labelled = F.regexp_replace(first_match(text, rules.SIGNER_ID_LABEL), "[^0-9]+", "")
    alone = replace(first_match(text, rules.SIGNER_ID_ALONE, 0), r"\s", "")  # its groups, next to each other
    return F.coalesce(labelled, alone)


def signer_name(lines, signer) -> Column:
    """The line above the first one with the id or its label, if it may be a name."""
    place = F.array_position(F.transform(col(lines), lambda x: F.contains(x, col(signer)) | F.contains(x, F.lit("NIP"))), True)
    above = once(place, lambda at: F.when(at > 1, F.get(col(lines), (at - 2).cast("int"))))
    usable = lambda name: (F.length(name) > 3) & ~found(name, rules.NOT_A_NAME, "i")
    return F.when(col(signer) != "", once(above, lambda name: F.when(usable(name), norm_name(name))))


_EDGE = ".,;:"


def _title_ok(b: Column) -> Column:
    bad = found(b, rules.PLACEHOLDER, "i") | found(b, rules.SENTENCE, "i") | found(b, r"\d{6,}") | found(b, rules.SCREEN_NOISE, "i")
    return F.length(b).between(3, 70) & found(b, rules.TITLE_START, "i") & ~bad & (count_matches(b, r"\b[a-z]{4,}\b") < 4)  # few lines pass the second test


def title_ok(c) -> Column:
    return once(strip(line_clean(c), _EDGE), _title_ok)


def title_join(first: Column, following: Column) -> Column:
    """A title and at most two of the lines that follow it, while it ends in an unfinished word; lines are cleaned already."""

    def take(done: Column, x: Column) -> Column:
        unfinished = (F.length(done["title"]) < 60) & found(done["title"], rules.TITLE_UNFINISHED, "i")
        stop = (x == "") | found(x, rules.SIGNER_ID_LINE, "i") | found(x, rules.PLACEHOLDER, "i") | found(x, rules.DEGREE) | (count_matches(x, r"\b[a-z]{4,}\b") >= 3)
        go = ~done["over"] & unfinished & ~stop
        return F.struct(F.when(go, F.concat_ws(" ", done["title"], x)).otherwise(done["title"]).alias("title"), (~go).alias("over"))

    start = F.struct(first.alias("title"), F.lit(False).alias("over"))
    return F.aggregate(F.slice(following, 1, 2), start, take, lambda d: strip(replace(d["title"], r"\s+", " "), _EDGE))


def title_anchor(lines, signer, name) -> Column:
    """1-based line of the signature: with an id behind its label, else with the id's digits, else with the name; 0 if none."""

    def line(test) -> Column:
        return once(F.array_position(F.transform(col(lines), test), True), lambda at: F.when(at > 0, at))

    by_id = F.when(F.coalesce(col(signer), F.lit("")) != "", line(lambda x: F.contains(F.regexp_replace(x, "[^0-9]+", ""), col(signer))))
    by_name = F.when(F.coalesce(col(name), F.lit("")) != "", line(lambda x: F.contains(F.lower(x), F.lower(col(name)))))
    return F.coalesce(line(lambda x: found(x, rules.SIGNER_ID_LINE, "i")), by_id, by_name, F.lit(0)).cast("int")


def title(lines, cleaned, anchor) -> Column:
    """The signatory's title. ``cleaned``: the lines cleaned and stripped of marks; ``anchor``: of ``title_anchor``.

    The nearest acceptable line of the five above the anchor, continued; else what follows a comma in the three
    above; else the first acceptable line anywhere; else empty.
    """
    lines, cleaned, anchor = col(lines), col(cleaned), col(anchor)
    near = F.filter(F.transform(F.sequence(F.lit(1), F.lit(5)), lambda k: anchor - k), lambda i: (i >= 1) & _title_ok(F.get(cleaned, i - 1)))
    joined = once(F.get(near, F.lit(0)), lambda at: F.when(at.isNotNull(), title_join(F.get(cleaned, at - 1), F.slice(cleaned, at + 1, F.greatest(anchor - at - 1, F.lit(0))))))
    tails = F.transform(F.filter(F.transform(F.sequence(F.lit(1), F.lit(3)), lambda k: F.when(anchor - k >= 1, F.get(lines, anchor - k - 1))), lambda x: F.contains(x, F.lit(","))), lambda x: strip(replace(x, r"^[^,]*,", "", "s")))
    tail = F.get(F.filter(tails, title_ok), F.lit(0))
    anywhere = F.get(F.filter(cleaned, _title_ok), F.lit(0))
    return F.coalesce(joined, strip(tail, _EDGE), anywhere, F.lit(""))


def clean_lines(lines) -> Column:
    """Cleaned lines, of ``text.lines``."""
    return F.transform(col(lines), stripped_line_clean)


def unmarked_lines(clean) -> Column:
    """Lines of ``clean_lines`` without marks at their ends."""
    return F.transform(col(clean), lambda x: strip_bound(x, _EDGE))


def cleaned_lines(lines) -> Column:
    return unmarked_lines(F.transform(col(lines), line_clean))


def field_confidence(c, field: str) -> Column:
    """Fixed values by presence: number .8, agency .8, subject .6, date .8, id .9."""
    return F.when(F.coalesce(col(c), F.lit("")) != "", {"doc_number": 0.8, "agency": 0.8, "subject": 0.6, "letter_date": 0.8, "signer_id": 0.9}[field]).otherwise(0.0)


def ai_needed(doc_number, agency) -> Column:
    return (F.coalesce(col(doc_number), F.lit("")) == "") | (F.coalesce(col(agency), F.lit("")) == "")


__all__ = [n for n in dir() if not n.startswith("_")] + ["clean_value"]
