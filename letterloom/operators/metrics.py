"""Evaluation of machine values against labels, and the corpus reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from letterloom.functions import audit, classify, rules
from letterloom.functions.text import cmp_norm_ascii

VERDICTS = ("exact", "partial", "wrong", "empty", "no_ref", "na")


def long_form(records: DataFrame, *keep: str, prefixes=("m_", "l_")) -> DataFrame:
    """One row per record and field: field, machine, label. Nulls stay rows."""
    cells = F.array(*(F.struct(F.lit(f).alias("field"), *(F.col(f"{p}{f}").alias(n) for p, n in zip(prefixes, ("machine", "label"), strict=False))) for f in rules.FIELDS))
    return records.select(*keep, F.explode(cells).alias("_c")).select(*keep, "_c.*")


def labelled(records: DataFrame) -> DataFrame:
    """Records with any label value; the others are skipped by every metric."""
    return records.where(any_label())


def any_label() -> Column:
    return F.concat(*(F.coalesce(f"l_{f}", F.lit("")) for f in rules.FIELDS)) != ""


def applies(field: Column | str, doc_type: Column | str) -> Column:
    """Whether a field counts for a type; a type without a list has all fields."""
    fields = classify.relevant_fields(doc_type)
    return F.coalesce((F.size(fields) == 0) | F.array_contains(fields, F.col(field) if isinstance(field, str) else field), F.lit(True))


def verdicts(records: DataFrame) -> DataFrame:
    """letter_id, field, verdict of each cell of a labelled record."""
    cells = long_form(labelled(records), "letter_id", "filename", "doc_type")
    return cells.withColumn("verdict", F.when(applies("field", "doc_type"), audit.cmp_value("machine", "label")).otherwise("na"))


def confusion(records: DataFrame) -> DataFrame:
    return verdicts(records).groupBy("field").agg(*(F.count_if(F.col("verdict") == v).alias(v) for v in VERDICTS))


def accuracy(records: DataFrame) -> DataFrame:
    """n_ref, points (halves counted in hundredths of a percent of a cell), accuracy and strict accuracy per field, and pooled (field ``all``)."""
    c = verdicts(records).rollup("field").agg(*(F.count_if(F.col("verdict") == v).alias(v) for v in VERDICTS))
    n = F.col("exact") + F.col("partial") + F.col("wrong") + F.col("empty")
    share = lambda x: F.coalesce(F.try_divide(x * 100, n), F.lit(0.0))
    return c.select(F.coalesce("field", F.lit("all")).alias("field"), n.alias("n_ref"), share(F.col("exact") + F.col("partial") * 0.5).alias("accuracy"), share(F.col("exact").cast("double")).alias("strict"))


def prf(cells: DataFrame) -> DataFrame:
    """Legacy counts of long cells (field, machine, label): a null is no prediction, an empty text is one; substrings are right."""
    c = cells.groupBy("field").agg(
        F.count_if(audit.cmp_legacy("machine", "label") & F.col("machine").isNotNull() & F.col("label").isNotNull()).alias("correct"),
        F.count("label").alias("expected"), F.count("machine").alias("predicted"),
    )
    p, r = (F.coalesce(F.try_divide(F.col("correct") * 100.0, F.col(k).cast("double")), F.lit(0.0)) for k in ("predicted", "expected"))
    return c.withColumns({"precision": p, "recall": r}).withColumn("f1", F.coalesce(F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), F.lit(0.0)))


def delta(runs: DataFrame, first: str, second: str) -> DataFrame:
    """Accuracy of the run ``second`` less that of ``first``."""
    by = lambda n: F.max(F.when(F.col("run_name") == n, F.col("accuracy")))
    return runs.agg(F.round(by(second) - by(first), 2).alias("delta"))


def error_documents(records: DataFrame) -> DataFrame:
    """Records with wrong or empty fields, and which, in field order."""
    order = F.array(*map(F.lit, rules.FIELDS))

    def listed(v: str) -> Column:
        found = F.collect_set(F.when(F.col("verdict") == v, F.col("field")))
        return F.array_join(F.filter(order, lambda f: F.array_contains(found, f)), ",")

    out = verdicts(records).groupBy("filename").agg(listed("wrong").alias("wrong_fields"), listed("empty").alias("empty_fields"))
    return out.where("wrong_fields <> '' or empty_fields <> ''")


def label_source() -> Column:
    return F.when(~any_label(), "none").when(F.trim("verified_by") != "", "human").otherwise("pre_label")


def audit_cells(records: DataFrame) -> DataFrame:
    """letter_id, field, verdict of each machine value against its own text, cheap tests first.

    A null verdict is left to ``dedup.similar_values``, which only sees those rows.
    """
    from letterloom.functions.text import audit_norm

    with_text = records.withColumn("text_norm", audit_norm("text"))
    cells = long_form(with_text, "letter_id", "doc_type", "text_norm", prefixes=("m_",))
    v = F.col("machine")
    verdict = (
        F.when(F.coalesce(v, F.lit("")) == "", "empty").when(F.col("field") == "letter_date", audit.aud_date(v, "text_norm"))
        .when(F.col("field") == "signer_id", audit.aud_signer_id(v, "text_norm")).when(F.col("field") == "doc_number", audit.aud_docnum(v, "text_norm"))
        .otherwise(audit.aud_contains(v, "text_norm"))
    )
    return cells.withColumn("verdict", verdict).withColumn("out_of_scope", ~applies("field", "doc_type"))


def audit_totals(cells: DataFrame) -> DataFrame:
    """Counts and percentages of decided cells per field, and of all fields (field ``all``): found, similar, not_found, empty, out_of_scope, filled.

    Percentages are of the values that are not empty; cells out of scope are counted in addition to their verdict.
    """
    seen = ("found", "similar", "not_found")
    counts = cells.groupBy("field").agg(*(F.count_if(F.col("verdict") == v).alias(v) for v in (*seen, "empty")), F.count_if("out_of_scope").alias("out_of_scope"))
    counts = counts.rollup("field").agg(*(F.sum(c).alias(c) for c in (*seen, "empty", "out_of_scope")))  # of a row per field
    filled = F.col("found") + F.col("similar") + F.col("not_found")
    share = lambda v: F.coalesce(F.try_divide(F.col(v) * 100.0, filled), F.lit(0.0)).alias(f"{v}_percent")
    return counts.select(F.coalesce("field", F.lit("all")).alias("field"), *seen, "empty", "out_of_scope", filled.alias("filled"), *map(share, seen))


def _filled(f: str) -> Column:
    return F.coalesce(F.col(f"m_{f}"), F.lit("")) != ""


def field_sets(records: DataFrame) -> DataFrame:
    """relevant, filled, blank and their overlaps as arrays, by set operations on a record's fields."""
    every = F.array(*map(F.lit, rules.FIELDS))
    relevant = F.coalesce(classify.relevant_fields("doc_type"), F.array().cast("array<string>"))
    filled = F.filter(F.array(*(F.when(_filled(f), f) for f in rules.FIELDS)), lambda x: x.isNotNull())
    df = records.withColumns({"relevant": F.when(F.size(relevant) == 0, every).otherwise(relevant), "filled": filled})
    return df.withColumns({"blank": F.array_except(every, "filled"), "irrelevant": F.array_except(every, "relevant")}).withColumns(
        {"blank_irrelevant": F.array_intersect("blank", "irrelevant"), "relevant_filled": F.array_intersect("filled", "relevant")}
    )


def types_report(records: DataFrame) -> DataFrame:
    s = field_sets(records).groupBy("doc_type").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.size("relevant")).alias("relevant_cells"), F.sum(F.size("relevant_filled")).alias("filled_cells"),
        F.count_if(F.col("region") == rules.OUTSIDE_REGION).alias("outside"), F.count_if(F.length("text") < 30).alias("without_text"),
    )
    return s.orderBy(F.desc("n"), "doc_type")


def irrelevant_share(records: DataFrame) -> DataFrame:
    cells = F.sum(F.size("blank_irrelevant"))
    return field_sets(records).agg(cells.alias("cells"), F.round(cells * 100.0 / (F.count(F.lit(1)) * len(rules.FIELDS)), 1).alias("percent"))


def gap_cause() -> Column:
    complete = F.lit(True)
    for f in rules.FIELDS:
        complete &= _filled(f)
    return F.when(F.col("is_scanned"), "scan").when(complete, "complete").otherwise("not_found")


def gaps_by_field(records: DataFrame) -> DataFrame:
    return long_form(records, prefixes=("m_",)).groupBy("field").agg(F.count_if(F.coalesce("machine", F.lit("")) == "").alias("blanks"))


def gaps_by_cause(records: DataFrame) -> DataFrame:
    return records.groupBy(gap_cause().alias("cause")).agg(F.count(F.lit(1)).alias("n"))


def normalised_diff(records: DataFrame) -> Column:
    """Comma-separated fields whose label differs from the machine value after normalisation."""
    return F.concat_ws(",", *(F.when((F.col(f"l_{f}") != "") & (cmp_norm_ascii(f"l_{f}") != cmp_norm_ascii(f"m_{f}")), f) for f in rules.FIELDS))


def exact_diff() -> Column:
    return F.concat_ws(",", *(F.when((F.col(f"l_{f}") != "") & (F.col(f"l_{f}") != F.col(f"m_{f}")), f) for f in rules.FIELDS))


def missing_reasons() -> Column:
    """Map of blank field to why: not applicable, then scan, then not found."""
    relevant = classify.relevant_fields("doc_type")
    reasons = F.map_from_arrays(
        F.array(*map(F.lit, rules.FIELDS)),
        F.array(*(F.when(~_filled(f), F.when(~F.array_contains(relevant, F.lit(f)), "not applicable").when(F.col("is_scanned"), "scan").otherwise("not found")) for f in rules.FIELDS)),
    )
    return F.map_filter(reasons, lambda _, v: v.isNotNull())


def verified_status() -> Column:
    has_text = F.trim(F.coalesce("text", F.lit(""))) != ""
    return F.when(any_label(), "PRE_LABEL").when(~has_text & F.col("is_scanned"), "BELUM_TERBACA_SCAN").otherwise("BELUM_DIVERIFIKASI")  # fixed values


def record(records: DataFrame, *more: Column) -> DataFrame:
    """The nested dataset record: machine values and labels in structs of their own, no nulls, a reason for every blank; ``more`` columns follow."""
    empty = lambda c: F.coalesce(F.col(c), F.lit(""))
    return records.select(
        "filename", "is_scanned", F.struct(F.col("doc_type").alias("type")).alias("doc_type"), F.struct(F.col("region").alias("code")).alias("region"),
        F.coalesce(classify.relevant_fields("doc_type"), F.array().cast("array<string>")).alias("relevant_fields"),
        F.struct(*(empty(f"m_{f}").alias(f) for f in rules.FIELDS)).alias("metadata"), missing_reasons().alias("missing_reasons"),
        F.struct(verified_status().alias("status"), empty("verified_by").alias("verified_by"), F.struct(*(empty(f"l_{f}").alias(f) for f in rules.FIELDS)).alias("values")).alias("verified"), *more,
    )
