"""Comparison and audit verdicts, egress policy and reading choices as Column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from letterloom.functions.text import audit_norm, cmp_norm_ascii, col, digits, once
from letterloom.functions.validate import date_variants


def cmp_verdict(machine, label) -> Column:
    """exact, partial (either holds the other), wrong, empty or no_ref, of values already normalised."""
    values = F.struct(*(F.coalesce(col(x), F.lit("")).alias(n) for n, x in (("a", machine), ("b", label))))
    return once(values, lambda v: _verdict(v["a"], v["b"]))


def _verdict(a: Column, b: Column) -> Column:
    return F.when(b == "", "no_ref").when(a == "", "empty").when(a == b, "exact").when(F.contains(b, a) | F.contains(a, b), "partial").otherwise("wrong")


def cmp_value(machine, label) -> Column:
    return cmp_verdict(cmp_norm_ascii(machine), cmp_norm_ascii(label))


def cmp_legacy(machine, label) -> Column:
    a, b = cmp_norm_ascii(machine), cmp_norm_ascii(label)
    return (a != "") & (b != "") & (F.contains(b, a) | F.contains(a, b))


def aud_contains(value, text_norm) -> Column:
    """found, empty or null (still to be searched): substring, also without spaces."""
    bare = lambda c: F.replace(c, F.lit(" "), F.lit(""))
    return once(audit_norm(value), lambda n: F.when(n == "", "empty").when(F.contains(col(text_norm), n) | F.contains(bare(col(text_norm)), bare(n)), "found"))


def holds_block(text, value, least: float = 0.85) -> Column:
    """Whether ``text`` holds a block of ``value`` of at least that share of its length (0.5 or more).

    Such a block is a window of the least length that is enough, and all windows of that length share the value's
    middle: a text without the middle is passed by after one search.
    """
    def of(v: Column) -> Column:
        n = F.length(v)
        short = F.floor(n * least).cast("int")
        enough = F.when(short / n >= least, short).otherwise(short + 1)
        middle = F.substring(v, n - enough + 1, 2 * enough - n)
        windows = F.exists(F.sequence(F.lit(1), n - enough + 1), lambda i: F.contains(col(text), F.substring(v, i, enough)))
        return F.coalesce((n > 0) & F.contains(col(text), middle) & F.when(n > 0, windows), F.lit(False))

    return once(value, of)


def aud_date(iso, text_norm) -> Column:
    day = F.regexp_extract(F.coalesce(col(iso), F.lit("")), r"^(\d{4})-(\d{2})-(\d{2})", 3).try_cast("int").cast("string")
    year = F.left(F.coalesce(col(iso), F.lit("")), F.lit(4))
    near = lambda t: F.contains(t, year) & F.regexp_like(t, F.concat(F.lit(r"\b"), day, F.lit(r"\b.{0,20}"), year))  # noqa: E731 - the pattern is made for each row
    return once(text_norm, lambda t: F.when(F.exists(date_variants(iso), lambda v: F.contains(t, v)), "found").when(F.coalesce(near(t), F.lit(False)), "similar").otherwise("not_found"))


def aud_signer_id(value, text_norm) -> Column:
    d, t = digits(value), digits(text_norm)
    return F.when((d != "") & F.contains(t, d), "found").when((F.length(d) >= 12) & F.contains(t, F.left(d, F.lit(8))), "similar").otherwise("not_found")


def aud_docnum(value, text_norm) -> Column:
    """found by digits and slashes alone, else as ``aud_contains``."""
    core, text = (F.regexp_replace(F.coalesce(col(c), F.lit("")), "[^/-9]+", "") for c in (value, text_norm))
    return F.when((F.length(core) >= 5) & F.contains(text, core), "found").otherwise(aud_contains(value, text_norm))


def qr_pick_url(codes) -> Column:
    """The first code, in page order, that is a web address or speaks of a signature."""
    # fixed values: what a signature service's code contains
    return F.get(F.filter(col(codes), lambda c: c.rlike("^https?://") | F.lower(c).rlike("tte|bsre|sigap")), F.lit(0))


def egress_policy(mode, policy, has_key, is_scanned) -> Column:
    """struct(allowed, reason) of sending pages to an outside service; the first rule that applies decides."""
    rule = lambda allowed, reason: F.struct(F.lit(allowed).alias("allowed"), F.lit(reason).alias("reason"))
    mode, policy = (F.lower(F.trim(col(c))) for c in (mode, policy))
    return (
        F.when(mode == "off", rule(False, "mode off")).when(policy == "off", rule(False, "policy off")).when(~col(has_key), rule(False, "no key"))
        .when(policy == "all", rule(True, "policy all")).when((policy == "scanned_only") & col(is_scanned), rule(True, "scanned"))
        .when(policy == "scanned_only", rule(False, "has a text layer")).otherwise(rule(False, "unknown policy"))
    )


def egress_missing_meta(meta_present, allowed) -> Column:
    return F.coalesce(col(meta_present), F.lit(False)) & col(allowed)


def egress_pages(pages, limit: int = 4) -> Column:
    return F.slice(col(pages), 1, limit)


def pick_adaptive(fast_text, fast_conf, fast_lines, other_text, other_conf) -> Column:
    """True where the other reading replaces the fast one: the fast one is unsure or short, the other not empty, nearly as long, and surer or longer."""
    unsure = (col(fast_conf) < 0.8) | (col(fast_lines) < 5)
    n, m = F.length(F.coalesce(col(fast_text), F.lit(""))), F.length(F.coalesce(col(other_text), F.lit("")))
    return unsure & (m > 0) & (m >= 0.9 * n) & ((col(other_conf) > col(fast_conf)) | (m > n))


def stamp(blue_pixels) -> Column:
    return F.coalesce(col(blue_pixels) > 800, F.lit(False))


__all__ = ["aud_contains", "aud_date", "aud_docnum", "aud_signer_id", "cmp_legacy", "cmp_value", "egress_policy", "pick_adaptive", "qr_pick_url"]
