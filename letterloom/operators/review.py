"""Review sheets and the checks of the dataset."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from letterloom.functions import rules, validate
from letterloom.functions.text import cmp_norm_ascii
from letterloom.operators.metrics import long_form
from letterloom.operators.relations import numbered_by


def priority(doc_type: str = "doc_type") -> Column:
    place = F.array_position(F.array(*map(F.lit, rules.REVIEW_PRIORITY)), F.col(doc_type))
    return F.when(place > 0, place).otherwise(len(rules.REVIEW_PRIORITY) + 1)


def numbered(df: DataFrame) -> DataFrame:
    """``df`` with ``no``: 1 up, by type priority, then name."""
    return numbered_by(df.withColumn("_priority", priority()), "_priority", "filename").drop("_priority")


def select_for_sheet(df: DataFrame, *, open_only=False, status=None, priority_only=False, doc_type=None, exclude_outside=False, name_part=None, with_duplicates=False) -> DataFrame:
    """Seven independent, optional filters on records with status, doc_type, region, filename and duplicate_of."""
    tests = [
        (open_only, F.col("status") != "TERVERIFIKASI"), (status, F.col("status") == status), (priority_only, F.col("doc_type").isin("surat_dinas", "keputusan")),
        (doc_type, F.col("doc_type") == doc_type), (exclude_outside, F.col("region") != rules.OUTSIDE_REGION),
        (name_part, F.contains("filename", F.lit(name_part or ""))), (not with_duplicates, F.coalesce("duplicate_of", F.lit("")) == ""),
    ]
    for wanted, test in tests:
        if wanted:
            df = df.where(test)
    return df


def wide_sheet(df: DataFrame) -> DataFrame:
    return numbered(df).select(
        "no", "filename", "doc_type", "region", "pages", *(F.coalesce(f"m_{f}", F.lit("")).alias(f"machine_{f}") for f in rules.FIELDS),
        *(F.lit("").alias(f"value_{f}") for f in rules.FIELDS), F.lit("").alias("note"),
    )


def long_sheet(df: DataFrame) -> DataFrame:
    cells = long_form(numbered(df), "no", "filename", "doc_type", prefixes=("m_",))
    return cells.select("no", "filename", "doc_type", "field", F.coalesce("machine", F.lit("")).alias("machine_value"), F.lit("").alias("true_value"), F.lit("").alias("clearly_absent"))


def parse_long(sheet: DataFrame) -> DataFrame:
    """filename, field, raw, absent, same of a long sheet with ``pos``; unknown fields go, the last row of a cell wins."""
    raw = F.trim(F.coalesce("true_value", F.lit("")))
    flag = F.lower(F.trim(F.coalesce("clearly_absent", F.lit("")))).isin(*rules.YES_MARKS)
    cells = sheet.where(F.col("field").isin(*rules.FIELDS) & (F.trim("filename") != "")).withColumns({"raw": raw, "absent": flag | F.lower(raw).isin(*rules.ABSENT_MARKS), "same": F.lower(raw).isin(*rules.SAME_MARKS)})
    last = cells.groupBy("filename", "field").agg(F.max_by(F.struct("raw", "absent", "same"), "pos").alias("_c"))
    return last.select("filename", "field", "_c.*")


def parse_wide(sheet: DataFrame) -> DataFrame:
    """As ``parse_long`` of a wide sheet with ``pos`` and value_* columns."""
    cells = F.array(*(F.struct(F.lit(f).alias("field"), F.col(f"value_{f}").alias("true_value")) for f in rules.FIELDS if f"value_{f}" in sheet.columns))
    return parse_long(sheet.select("filename", "pos", F.explode(cells).alias("_c")).select("filename", "pos", "_c.*", F.lit("").alias("clearly_absent")))


def decide(cells: DataFrame) -> DataFrame:
    """cells (field, raw, absent, same, machine) with decision and value. A blank cell remains open even if it is flagged absent."""
    blank = F.coalesce("raw", F.lit("")) == ""
    typed = F.when(F.col("field") == "letter_date", validate.date_sheet("raw")["value"]).otherwise(F.col("raw"))
    machine = F.coalesce("machine", F.lit(""))
    decision = (
        F.when(blank, "remaining").when(F.col("absent"), "absent").when(F.col("same") & (machine == ""), "remaining").when(F.col("same"), "confirmed")
        .when(cmp_norm_ascii(typed) == cmp_norm_ascii(machine), "confirmed").otherwise("typed")
    )
    value = F.when(blank | F.col("absent") | (F.col("same") & (machine == "")), "").when(F.col("same"), machine).otherwise(typed)
    return cells.withColumns({"decision": decision, "value": value})


def status(decided: DataFrame) -> DataFrame:
    """filename, status and counts: verified only if no field remains."""
    n = lambda d: F.count_if(F.col("decision") == d)
    done = F.when(n("remaining") == 0, "TERVERIFIKASI").otherwise("BELUM_DIVERIFIKASI")  # fixed values
    return decided.groupBy("filename").agg(done.alias("status"), n("typed").alias("typed"), n("confirmed").alias("confirmed"), n("absent").alias("absent"))


def progress(statuses: DataFrame) -> DataFrame:
    done = F.count_if(F.col("status") == "TERVERIFIKASI")
    return statuses.agg(F.count(F.lit(1)).alias("processed"), done.alias("complete"), (F.count(F.lit(1)) - done).alias("partial"), *(F.sum(c).alias(c) for c in ("typed", "confirmed", "absent")))


def absent_reasons(reasons: Column, absent_fields: Column, annotator: str) -> Column:
    """``reasons`` with a confirmed absence in place of the reason of each absent field."""
    new = F.map_from_entries(F.transform(absent_fields, lambda f: F.struct(f, F.lit(f"confirmed absent by {annotator}"))))
    return F.map_concat(F.map_filter(reasons, lambda k, _: ~F.array_contains(absent_fields, k)), new)


def missing_required(df: DataFrame, required: list[str]) -> DataFrame:
    """filename and the required columns that are null or blank, for rows with any."""
    bad = F.concat_ws(",", *(F.when(F.coalesce(F.trim(F.col(c).cast("string")), F.lit("")) == "", c) for c in required))
    return df.select("filename", bad.alias("missing")).where("missing <> ''")


def unverified_claims(df: DataFrame) -> DataFrame:
    """Rows that claim to be verified without saying by whom."""
    return df.where((F.col("status") == "TERVERIFIKASI") & (F.trim(F.coalesce("verified_by", F.lit(""))) == ""))
