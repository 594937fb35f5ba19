"""Queries of the checks on nested documents: their schemas at any depth, and nulls anywhere.

The documents are made of the tables, and faults are planted in them by number; the oracles know only the numbers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from letterloom.functions import rules, schemas
from letterloom.operators import checks, metrics
from letterloom.operators.json_schema import violations
from letterloom.plans.registry import query, table
from letterloom.sources.letters import records

#: (remainder of letter_id by 31, pattern, replacement, path, rule that is broken then).
RECORD_FAULTS = (
    (0, r'"region":\{[^}]*\},', "", "region", "required"),
    (1, r"^\{", '{"surprise":1,', "surprise", "additionalProperties"),
    (2, r'("doc_type":\{"type":")[^"]*', "$1brochure", "doc_type/type", "enum"),
    (3, r'"confidence":[0-9.]+', '"confidence":1.5', "doc_type/confidence", "maximum"),
    (4, r'"pages_rasterized":\[', '"pages_rasterized":["x",', "pipeline/preprocess/pages_rasterized/0", "type"),
    (5, r'"has_stamp":(true|false)', '"has_stamp":null', "metadata/has_stamp", "type"),
    (6, r"\}$", "", "", "malformed"),
    (7, r'"page_count":\d+', '"page_count":-1', "page_count", "minimum"),
    (8, r',"flags":\[[^\]]*\]', "", "pipeline/validate/flags", "required"),
    (9, r'"missing_reasons":\{[^}]*\}', '"missing_reasons":{"agency":7}', "missing_reasons/agency", "type"),
    (10, r'"document_id":\d+', '"document_id":true', "document_id", "type"),
    (11, r'"sha256":"[0-9a-f]', '"sha256":"X', "sha256", "pattern"),
    (12, r'"field_confidence":\{', '"field_confidence":{"zz":-0.5,', "pipeline/extract/field_confidence/zz", "minimum"),
    (13, r'"skew_angle_deg":[-0-9.]+', '"skew_angle_deg":"straight"', "pipeline/preprocess/skew_angle_deg", "type"),
    (14, r'"values":\{', '"values":{"more":"",', "verified/values/more", "additionalProperties"),
    (15, r"^.*$", "[]", "", "type"),
    (16, r'("status":)"[^"]*"', "$1[]", "verified/status", "type"),
)


def _texts(prefix: str) -> list[Column]:
    return [F.coalesce(F.col(f"{prefix}{f}"), F.lit("")).alias(f) for f in rules.FIELDS]


def record_documents(df: DataFrame) -> DataFrame:
    """letter_id, filename, json: records with everything that the schema asks for."""
    no = F.lit(False)
    whole = F.struct(
        F.col("letter_id").alias("document_id"), "filename", F.sha2(F.col("text").cast("binary"), 256).alias("sha256"), F.octet_length("text").alias("file_size_bytes"),
        F.col("pages").alias("page_count"), "is_scanned", F.struct(F.col("doc_type").alias("type"), F.col("doc_type").alias("label"), F.lit(0.5).alias("confidence")).alias("doc_type"),
        F.struct(F.col("region").alias("code"), F.lit("").alias("name")).alias("region"), F.array(F.lit("agency")).alias("relevant_fields"),
        F.struct(*(F.lit("").alias(c) for c in ("innovation_id", "indicator_id", "evidence_tag"))).alias("manifest"),
        F.struct(
            F.struct(F.lit(12).alias("words_page_1"), "is_scanned", F.lit(1).alias("text_pages_read")).alias("inspect"),
            F.struct(F.lit(300).alias("target_dpi"), F.sequence(F.lit(1), F.col("pages")).alias("pages_rasterized"), F.lit(0.25).alias("skew_angle_deg")).alias("preprocess"),
            F.struct(F.lit("rules").alias("engine"), F.lit("text layer").alias("text_source"), F.struct(*(F.lit(0.75).alias(f) for f in rules.FIELDS)).alias("field_confidence")).alias("extract"),
            F.struct(F.lit("").alias("verification_url"), F.lit("").alias("detector")).alias("qr"),
            F.struct(no.alias("is_valid_id"), F.lit(0.5).alias("confidence_score"), no.alias("needs_review"), F.array(F.lit("short")).alias("flags")).alias("validate"),
        ).alias("pipeline"),
        F.struct(*_texts("m_"), no.alias("has_stamp"), no.alias("has_signature")).alias("metadata"), F.create_map(F.lit("agency"), F.lit("not there")).alias("missing_reasons"),
        F.struct(F.lit("PRE_LABEL").alias("status"), F.lit("").alias("verified_by"), F.struct(*_texts("l_")).alias("values")).alias("verified"), F.left("text", F.lit(40)).alias("text_excerpt"),
    )
    return df.select("letter_id", "filename", F.to_json(whole).alias("json"))


_PLANTED = ", ".join(f"({k}, '{path}', '{rule}')" for k, _, _, path, rule in RECORD_FAULTS)


@query("chk_schema", f"SELECT filename, path, rule FROM records JOIN (VALUES {_PLANTED}, (17, '', 'missing')) AS f(k, path, rule) ON letter_id % 31 = k")
def chk_schema(spark, sf_dir):
    """Records as JSON against their schema, with a fault of each kind in one of 31; two are no documents at all."""
    docs, place = record_documents(records(spark, sf_dir)), F.col("letter_id") % 31
    faulty = F.when(place != 17, F.col("json"))
    for k, pattern, by, _, _ in RECORD_FAULTS:
        faulty = F.when(place == k, F.regexp_replace("json", pattern, by)).otherwise(faulty)
    return violations(docs.withColumn("json", faulty), schemas.RECORD, "filename")


@query("chk_schema_manifest", """WITH e AS (SELECT o_custkey, o_orderkey AS k, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS VARCHAR) AS i FROM orders WHERE o_custkey IS NOT NULL)
  SELECT c_custkey AS id, 'evidences' AS path, 'minItems' AS rule FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM e)
  UNION ALL SELECT o_custkey, 'evidences/' || i || '/indicator_id', 'pattern' FROM e WHERE k % 50 = 7 UNION ALL SELECT o_custkey, 'evidences/' || i || '/page_start', 'minimum' FROM e WHERE k % 41 = 3
  UNION ALL SELECT o_custkey, 'evidences/' || i || '/colour', 'additionalProperties' FROM e WHERE k % 37 = 5 UNION ALL SELECT o_custkey, 'evidences/' || i || '/filename', 'required' FROM e WHERE k % 43 = 1""")
def chk_schema_manifest(spark, sf_dir):
    """A manifest per customer with an evidence per order: faults at every index, and manifests without evidence."""
    k = F.col("o_orderkey")
    one = F.struct(
        k.alias("k"), F.concat(F.lit("EVD-"), k).alias("evidence_id"), F.when(k % 43 != 1, F.concat(F.lit("f"), k)).alias("filename"),
        F.when(k % 50 == 7, "IND-x").otherwise(F.concat(F.lit("IND-"), F.lpad((k % 20).cast("string"), 2, "0"))).alias("indicator_id"),
        F.when(k % 41 == 3, 0).otherwise(1).alias("page_start"), F.when(k % 37 == 5, "red").alias("colour"),
    )
    lists = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.array_sort(F.collect_list(one)).alias("evidences"))
    lists = lists.withColumn("evidences", F.transform("evidences", lambda e: F.struct(*(e[c].alias(c) for c in ("evidence_id", "filename", "indicator_id", "page_start", "colour")))))
    every = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id")).join(lists, "id", "left")
    evidences = F.coalesce("evidences", F.array().cast(lists.schema["evidences"].dataType))
    document = F.struct(F.col("id").cast("string").alias("innovation_id"), F.lit("1.0").alias("manifest_version"), evidences.alias("evidences"))
    return violations(every.select("id", F.to_json(document).alias("json")), schemas.MANIFEST, "id")


@query("chk_schema_submission", """SELECT s_suppkey AS id, f.path, f.rule FROM supplier, (VALUES (90, 86, 89, 'year', 'maximum'), (7, 0, 0, 'kind', 'enum'), (5, 2, 2, 'indicators/1/claimed_parameter_id', 'anyOf'),
  (11, 3, 3, 'indicators/0/evidence_ids', 'uniqueItems'), (13, 0, 0, 'name', 'minLength'), (17, 4, 4, 'indicators/2/indicator_id', 'required'), (19, 1, 1, 'status', 'enum')) AS f(m, low, high, path, rule) WHERE s_suppkey % m BETWEEN low AND high""")
def chk_schema_submission(spark, sf_dir):
    k = F.col("s_suppkey")

    def indicator(i: int, **faults: Column) -> Column:
        own = {"indicator_id": F.lit(f"IND-0{i + 1}"), "claimed_parameter_id": F.lit(f"IND-0{i + 1}-P1"), "evidence_ids": F.array(F.lit("a"), F.lit("b")), **faults}
        return F.struct(*(v.alias(n) for n, v in own.items()))

    claims = F.array(
        indicator(0, evidence_ids=F.when(k % 11 == 3, F.array(F.lit("a"), F.lit("a"))).otherwise(F.array(F.lit("a"), F.lit("b")))),
        indicator(1, claimed_parameter_id=F.when(k % 5 == 2, "IND-02-P9").when(k % 5 == 3, F.lit(None)).otherwise("IND-02-P3")), indicator(2, indicator_id=F.when(k % 17 != 4, "IND-03")),
    )
    document = F.struct(
        k.cast("string").alias("innovation_id"), F.when(k % 13 == 0, "").otherwise(F.col("s_name")).alias("name"), F.lit("unit").alias("unit"),
        F.when(k % 7 == 0, "other").otherwise("digital").alias("kind"), (2015 + k % 90).alias("year"), F.when(k % 19 == 1, "LOST").otherwise("DRAFT").alias("status"), claims.alias("indicators"),
    )
    return violations(table(spark, sf_dir, "supplier").select(k.alias("id"), F.to_json(document).alias("json")), schemas.SUBMISSION, "id")


@query("chk_schema_assessment", """WITH e AS (SELECT o_custkey, o_orderkey AS k, o_orderstatus AS s, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS VARCHAR) AS i FROM orders)
  SELECT o_custkey AS id, 'annotations/' || i || '/label' AS path, 'enum' AS rule FROM e WHERE s = 'P' UNION ALL SELECT o_custkey, 'annotations/' || i || '/score', 'minimum' FROM e WHERE k % 29 = 0
  UNION ALL SELECT o_custkey, 'annotations/' || i || '/parameter_id', 'pattern' FROM e WHERE k % 31 = 2 UNION ALL SELECT o_custkey, 'annotations/' || i || '/evidence_ids/1', 'type' FROM e WHERE k % 23 = 4""")
def chk_schema_assessment(spark, sf_dir):
    """Annotations per customer from orders; the fault in ``evidence_ids`` is a null in a list, which a struct's JSON keeps."""
    k = F.col("o_orderkey")
    label = F.when(F.col("o_orderstatus") == "F", "FULFILLED").when(F.col("o_orderstatus") == "P", "PERHAPS").otherwise("NOT_FULFILLED")
    one = F.struct(
        k.alias("k"), F.lit("IND-01").alias("indicator_id"), F.when(k % 31 == 2, "IND-01-P4").otherwise("IND-01-P2").alias("parameter_id"), label.alias("label"),
        F.when(k % 29 == 0, -1.0).otherwise(F.col("o_totalprice")).alias("score"), F.array(F.lit("a"), F.when(k % 23 != 4, "b")).alias("evidence_ids"), F.lit("human").alias("source"),
    )
    lists = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.array_sort(F.collect_list(one)).alias("annotations"))
    plain = F.transform("annotations", lambda e: F.struct(*(e[c].alias(c) for c in ("indicator_id", "parameter_id", "label", "score", "evidence_ids", "source"))))
    document = F.struct(F.col("id").cast("string").alias("innovation_id"), F.lit("1").alias("guideline_version"), plain.alias("annotations"))
    return violations(lists.select("id", F.to_json(document).alias("json")), schemas.ASSESSMENT, "id")


_BLANK = "list_filter([" + ", ".join(f"CASE WHEN m_{f} = '' AND NOT ('{f}' = 'subject' AND letter_id % 19 = 1) THEN '{f}' END" for f in rules.FIELDS) + "], lambda x: x IS NOT NULL)"


@query("chk_no_null", f"""WITH n AS (SELECT filename, array_to_string(list_filter([CASE WHEN letter_id % 19 = 2 THEN 'region' END, CASE WHEN letter_id % 19 = 1 THEN 'metadata.subject' END,
  CASE WHEN letter_id % 19 = 6 THEN 'missing_reasons.extra' END, CASE WHEN letter_id % 19 = 3 THEN 'verified.values.agency' END, CASE WHEN letter_id % 19 = 4 THEN 'readings[1].page' END,
  CASE WHEN letter_id % 19 = 5 THEN 'readings[0].words[2]' END, CASE WHEN letter_id % 19 = 7 THEN 'readings[1]' END], lambda x: x IS NOT NULL), ',') AS nulls,
  CASE WHEN letter_id % 19 = 8 THEN array_to_string({_BLANK}, ',') ELSE '' END AS unexplained FROM records) SELECT * FROM n WHERE nulls <> '' OR unexplained <> ''""")
def chk_no_null(spark, sf_dir):
    """Nulls planted at one to three depths, in structs, arrays and maps, and reasons taken away."""
    place = F.col("letter_id") % 19
    df = metrics.record(records(spark, sf_dir)).join(records(spark, sf_dir).select("filename", "letter_id"), "filename")
    words = F.array(F.lit("a"), F.lit("b"), F.when(place != 5, "c"))
    second = F.when(place != 7, F.struct(F.when(place != 4, 2).alias("page"), F.array(F.lit("d")).alias("words")))
    df = df.withColumns({
        "region": F.when(place != 2, F.col("region")),
        "metadata": F.when(place == 1, F.col("metadata").withField("subject", F.lit(None).cast("string"))).otherwise(F.col("metadata")),
        "verified": F.when(place == 3, F.col("verified").withField("values.agency", F.lit(None).cast("string"))).otherwise(F.col("verified")),
        "readings": F.array(F.struct(F.lit(1).alias("page"), words.alias("words")), second),
        "missing_reasons": F.when(place == 8, F.create_map().cast("map<string,string>")).when(place == 6, F.map_concat("missing_reasons", F.create_map(F.lit("extra"), F.lit(None).cast("string")))).otherwise(F.col("missing_reasons")),
    })
    found = checks.nulls_and_blanks(df.drop("letter_id"))
    return found.select("filename", F.array_join("nulls", ",").alias("nulls"), F.array_join("unexplained", ",").alias("unexplained"))
