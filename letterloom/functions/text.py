"""Text normalisation as Column functions. Null stays null unless said otherwise."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from letterloom.functions.rules import MISREAD, TERMS


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def once(c, body) -> Column:
    """``body`` of a value that is worked out once however often the body uses it.

    A column's name is passed on; any other expression is bound to a variable (that of a one-element array), which
    the optimizer does not copy into its uses, so expressions grow with their length and not with their repeats.
    """
    return body(F.col(c)) if isinstance(c, str) else F.get(F.transform(F.array(c), body), F.lit(0))


def rx(pattern: str, flags: str = "") -> str:
    """Unicode-aware classes and word boundaries, with further inline flags."""
    return f"(?U{flags}){pattern}"


def found(c, pattern: str, flags: str = "") -> Column:
    return col(c).rlike(rx(pattern, flags))


def first_match(c, pattern: str, group: int = 1, flags: str = "") -> Column:
    """The first match's group, null where there is none."""
    return once(c, lambda v: F.when(found(v, pattern, flags), F.regexp_extract(v, rx(pattern, flags), group)))


def replace(c, pattern: str, by: str, flags: str = "") -> Column:
    return F.regexp_replace(col(c), rx(pattern, flags), by)


def strip(c, chars: str = r"\s") -> Column:
    return replace(c, f"^[{chars}]+|[{chars}]+$", "")


def count_matches(c, pattern: str) -> Column:
    return F.size(F.regexp_extract_all(col(c), F.lit(rx(pattern)), F.lit(0)))


def strip_bound(v: Column, chars: str = r"\s") -> Column:
    """As ``strip`` of a variable or a column: only texts that begin or end in one of ``chars`` are written anew.

    The end is looked at without a search from every place; ``$`` also stands before a last line's end.
    """
    ends = rf"^(?:[{chars}]|.*+(?<=[{chars}\n\r\u0085\u2028\u2029]))"
    return F.when(found(v, ends, "s"), strip(v, chars)).otherwise(v)


_CAPS = r"\b[A-Z][A-Z.]{9,}\b"
#: Terms that hold no other one: words that need no search for several.
_SINGLE = sorted(t for t in TERMS if sum(x in t for x in TERMS) < 2)


def split_glued(c) -> Column:
    """Put spaces between known terms inside long words in capitals that hold two terms or more."""
    terms = F.split(F.lit(" ".join(TERMS)), " ")  # one literal, split once when the plan is made
    longest_first = "|".join(sorted(TERMS, key=len, reverse=True))

    def part(word: Column) -> Column:
        cut = F.trim(F.regexp_replace(F.regexp_replace(word, f"({longest_first})", " $1 "), " +", " "))
        several = F.size(F.filter(terms, lambda t: F.contains(word, t))) >= 2
        return F.when(word.isin(_SINGLE), word).when(several, once(cut, lambda x: F.when(F.exists(F.split(x, " "), lambda y: F.length(y) > 24), word).otherwise(x))).otherwise(word)

    def whole(v: Column) -> Column:
        def joined(words: Column) -> Column:
            pieces = F.zip_with(F.split(v, rx(_CAPS), -1), words, lambda x, w: F.when(w.isNull(), x).otherwise(F.concat(x, part(w))))  # words are one fewer
            return F.when(F.exists(words, lambda w: ~w.isin(_SINGLE)), F.array_join(pieces, "")).otherwise(v)

        return F.when(found(v, _CAPS), once(F.regexp_extract_all(v, F.lit(rx(_CAPS)), F.lit(0)), joined)).otherwise(v)

    return once(c, whole)


def fix_misread(c) -> Column:
    """Correct whole words that scans misread, keeping upper, capitalised or lower case."""
    known = F.create_map(*(F.lit(x) for pair in MISREAD.items() for x in pair))

    def shaped(w: Column, right: Column) -> Column:
        return F.when(w == F.upper(w), F.upper(right)).when(F.left(w, F.lit(1)).rlike("[A-Z]"), F.concat(F.upper(F.left(right, F.lit(1))), F.substring(right, 2, 1000))).otherwise(right)

    def word(w: Column) -> Column:
        return F.coalesce(once(F.try_element_at(known, F.lower(w)), lambda right: shaped(w, right)), w)

    words = lambda v: F.regexp_extract_all(v, F.lit(r"(?Us)\w+|\W+"), F.lit(0))
    return once(c, lambda v: F.when(found(v, r"\b(?:" + "|".join(map(re.escape, MISREAD)) + r")\b", "i"), F.array_join(F.transform(words(v), word), "")).otherwise(v))


def clean_value(c) -> Column:
    """Strip, drop marks at the ends (a final stop stays), make runs of white space one space; null gives an empty text."""
    c = strip(F.coalesce(col(c), F.lit("")))
    c = replace(c, r"^[\s:;.,\-–—]+", "")
    c = replace(c, r"[\s:;,\-–—]+$", "")
    return strip(replace(c, r"\s{2,}", " "))


def normalize(c) -> Column:
    return clean_value(fix_misread(split_glued(F.coalesce(col(c), F.lit("")))))


def norm_agency(c) -> Column:
    """Normalise and make immediate repeats of a word one, ignoring case."""
    return strip(replace(normalize(c), r"\b(\w+)(\s+\1\b)+", "$1", "i"), r" \-;")


def norm_name(c) -> Column:
    return replace(clean_value(c), r"\s*,\s*", ", ")


def cmp_norm_ascii(c) -> Column:
    """Comparison key of texts without accents; see ``operators.python_functions.cmp_norm`` for the general one."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(col(c), F.lit(""))), "[^a-z0-9]+", " "))


def cmp_norm_legacy(c) -> Column:
    return cmp_norm_ascii(c)


def dup_norm(c) -> Column:
    return F.trim(F.regexp_replace(F.lower(F.coalesce(col(c), F.lit(""))), "[^a-z0-9]+", " "))


def audit_norm(c) -> Column:
    """Letters, digits and slashes; the slash stands before 0, and a class of two ranges takes a tenth of the time of one of three parts, as measured."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(col(c), F.lit(""))), "[^/-9a-z]+", " "))


def digits(c) -> Column:
    return F.regexp_replace(F.coalesce(col(c), F.lit("")), r"[^0-9]+", "")


def line_clean(c) -> Column:
    """Drop a leading page mark such as ``3 / 7``, strip, split glued terms."""
    return split_glued(strip(replace(F.coalesce(col(c), F.lit("")), r"^\s*\d{1,3}\s*/\s*\d{1,3}\s+", "")))


def stripped_line_clean(v: Column) -> Column:
    """As ``line_clean`` of a variable that holds a stripped line: without a slash there is no page mark."""
    return F.when(F.contains(v, F.lit("/")), line_clean(v)).otherwise(split_glued(v))


def lines(c) -> Column:
    """Stripped lines that are not empty, in order."""
    return F.filter(F.transform(F.split(F.coalesce(col(c), F.lit("")), "\n"), lambda x: strip_bound(x)), lambda x: x != "")


def excerpt(c, length: int = 1500) -> Column:
    return F.left(F.coalesce(col(c), F.lit("")), F.lit(length))


def word_count(c) -> Column:
    return F.size(F.filter(F.split(F.coalesce(col(c), F.lit("")), r"(?U)\s+"), lambda x: x != ""))


def redact(c) -> Column:
    """Mask what looks like a key in an error message, then cut it at 200 characters."""
    c = F.regexp_replace(col(c), r"""(?i)(key=|api[_-]?key["'=:\s]+)[A-Za-z0-9._\-]{8,}""", "$1<masked>")
    return F.left(F.regexp_replace(c, r"AQ\.[A-Za-z0-9._\-]{10,}", "<masked>"), F.lit(200))


def empty_coalesce(c) -> Column:
    return strip(F.coalesce(col(c), F.lit("")))
