"""Queries of the text, extraction, validation and classification operators over ``letters`` and the text tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from letterloom.functions import audit, classify, extract, rules, text, validate
from letterloom.operators import python_functions
from letterloom.operators.relations import first_k
from letterloom.plans import extraction
from letterloom.plans.registry import query, table
from letterloom.sources.letters import letters, records


def _of_letters(name_: str, sql: str, **columns):
    """Register a projection of letters: letter_id and the columns."""

    @query(name_, sql)
    def run(spark, sf_dir):
        return letters(spark, sf_dir).select("letter_id", *(f().alias(c) for c, f in columns.items()))


def _of_records(name_: str, sql: str, **columns):
    @query(name_, sql)
    def run(spark, sf_dir):
        return records(spark, sf_dir).select("letter_id", *(f().alias(c) for c, f in columns.items()))


def _of_documents(name_: str, sql: str, **columns):
    @query(name_, sql)
    def run(spark, sf_dir):
        return table(spark, sf_dir, "documents").select("doc_id", *(f().alias(c) for c, f in columns.items()))


def _header():
    return F.split("text", "\n")[0]


# --- normalisation -----------------------------------------------------------------------------------------------
_of_letters("txt_split_glued", """SELECT letter_id, CASE WHEN letter_id % 6 = 0 THEN 'NOTULA RAPAT' ELSE replace(t_agency, ' DINAS PENDIDIKAN', '') END AS header FROM letters""",
            header=lambda: text.split_glued(_header()))
_of_letters("txt_fix_misread", """SELECT letter_id, replace(replace(text, 'Rapat', 'Daerah'), 'Undangan', 'DINAS') AS fixed FROM letters""",
            fixed=lambda: text.fix_misread(F.replace(F.replace("text", F.lit("Rapat"), F.lit("Dacrah")), F.lit("Undangan"), F.lit("DINASS"))))
_of_letters("txt_clean_value", """SELECT letter_id, coalesce(t_subject || '.', '') AS cleaned FROM letters""",
            cleaned=lambda: text.clean_value(F.concat(F.lit(" : - "), F.coalesce(F.replace("t_subject", F.lit(" "), F.lit("   ")), F.lit("")), F.lit("., ;"))))
_of_letters("txt_normalize", """SELECT letter_id, CASE WHEN letter_id % 6 = 0 THEN 'NOTULA RAPAT' ELSE replace(t_agency, ' DINAS PENDIDIKAN', '') END AS normal FROM letters""",
            normal=lambda: text.normalize(F.concat(F.lit(":  "), _header(), F.lit(" ;"))))
_of_letters("txt_norm_agency", """SELECT letter_id, CASE WHEN letter_id % 6 = 0 THEN 'NOTULA RAPAT' ELSE replace(t_agency, ' DINAS PENDIDIKAN', '') END || ' DINAS' AS agency FROM letters""",
            agency=lambda: text.norm_agency(F.concat(_header(), F.lit(" DINAS Dinas dinas -"))))
_of_letters("txt_norm_name", """SELECT letter_id, 'Budi Contoh ' || CAST(letter_id % 97 AS VARCHAR) || ', S.Pd., M.Pd' AS name FROM letters""",
            name=lambda: text.norm_name(F.concat(F.lit(" : "), F.replace(F.get(F.filter(F.split("text", "\n"), lambda x: F.contains(x, F.lit("S.Pd."))), F.lit(0)), F.lit(","), F.lit("   ,")), F.lit("  ,M.Pd ;"))))
_of_letters("txt_cmp_norm", """SELECT letter_id, trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')) AS key FROM letters""", key=lambda: text.cmp_norm_ascii("text"))
_of_letters("txt_cmp_norm_legacy", """SELECT letter_id, trim(regexp_replace(lower(coalesce(t_subject, '')), '[^a-z0-9]+', ' ', 'g')) AS key FROM letters""", key=lambda: text.cmp_norm_legacy("t_subject"))
_of_documents("txt_dup_norm", """SELECT doc_id, trim(regexp_replace(regexp_replace(lower(coalesce(text, '')), '[^a-z0-9 ]+', ' ', 'g'), ' +', ' ', 'g')) AS normal FROM documents""", normal=lambda: text.dup_norm("text"))
_of_documents("txt_audit_norm", """SELECT doc_id, trim(regexp_replace(lower(coalesce(text, '')), '[^a-z0-9/]+', ' ', 'g')) AS normal FROM documents""", normal=lambda: text.audit_norm("text"))
_of_letters("txt_digits", """SELECT letter_id, regexp_replace(text, '[^0-9]', '', 'g') AS digits FROM letters""", digits=lambda: text.digits("text"))
_of_letters("txt_line_clean", """SELECT letter_id, CASE WHEN letter_id % 6 = 0 THEN 'NOTULA RAPAT' ELSE replace(t_agency, ' DINAS PENDIDIKAN', '') END AS line FROM letters""",
            line=lambda: text.line_clean(F.concat(F.lit(" 10 / 11 "), _header(), F.lit("  "))))
_of_documents("txt_lines", """SELECT doc_id, len(list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '')) AS n_lines, array_to_string(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> ''), '|') AS lines FROM documents""",
              n_lines=lambda: F.size(text.lines("text")).cast("long"), lines=lambda: F.array_join(text.lines("text"), "|"))
_of_documents("txt_excerpt", """SELECT doc_id, left(coalesce(text, ''), 1500) AS excerpt FROM documents""", excerpt=lambda: text.excerpt("text"))
_of_documents("txt_word_count", r"""SELECT doc_id, len(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '')) AS words FROM documents""", words=lambda: text.word_count("text").cast("long"))
_of_letters("txt_redact", """SELECT letter_id, 'failed: key=<masked> for ' || left('https://example.org/' || repeat('x', 300), 175) AS message FROM letters""",
            message=lambda: text.redact(F.concat(F.lit("failed: key=Abc_"), F.lpad(F.col("letter_id").cast("string"), 12, "0"), F.lit(" for https://example.org/" + "x" * 300))))
_of_letters("txt_empty_coalesce", """SELECT letter_id, coalesce(trim(t_subject), '') AS value FROM letters""", value=lambda: text.empty_coalesce(F.concat(F.lit("  "), "t_subject", F.lit(" "))))


@query("txt_cmp_norm_unicode")
def txt_cmp_norm_unicode(spark, sf_dir):
    """With compatibility decomposition, which Spark lacks; tested against the standard library."""
    return table(spark, sf_dir, "documents").select("doc_id", python_functions.cmp_norm("text").alias("key"))


# --- extraction ----------------------------------------------------------------------------------------------------
@query("ext_docnum", "SELECT letter_id, t_labelled_number AS doc_number FROM letters")
def ext_docnum(spark, sf_dir):
    return extraction.with_lines(letters(spark, sf_dir)).select("letter_id", extract.docnum_labelled("lines").alias("doc_number"))


@query("ext_docnum_fallback", "SELECT letter_id, t_doc_number AS doc_number, t_doc_number IS NOT NULL AND t_labelled_number IS NULL AS by_code FROM letters")
def ext_docnum_fallback(spark, sf_dir):
    df = extraction.with_lines(letters(spark, sf_dir)).withColumns({"labelled": extract.docnum_labelled("lines"), "code": extract.docnum_fallback("text")})
    return df.select("letter_id", F.coalesce("labelled", "code").alias("doc_number"), (F.col("labelled").isNull() & F.col("code").isNotNull()).alias("by_code"))


_of_letters("ext_docnum_valid", """SELECT letter_id, true AS good, letter_id % 4 = 3 AS mixed FROM letters""",
            good=lambda: extract.docnum_valid(F.concat(F.lit(" 421/"), F.col("letter_id").cast("string"), F.lit("/ABC.D/IX/2024."))),
            mixed=lambda: extract.docnum_valid(F.when(F.col("letter_id") % 4 == 0, "16").when(F.col("letter_id") % 4 == 1, "12/34 Kelurahan Contoh").when(F.col("letter_id") % 4 == 2, "7/abc-def-Contoh").otherwise("7/ABC/2024")))


@query("ext_header_zone", """SELECT letter_id, CASE WHEN letter_id % 10 IN (0, 3) THEN least(8, len(list_filter(string_split(text, chr(10)), lambda x: x <> ''))) ELSE CASE WHEN letter_id % 6 = 0 THEN 1 ELSE 3 END + CASE WHEN letter_id % 14 = 0 THEN 1 ELSE 0 END END AS n_lines FROM letters""")
def ext_header_zone(spark, sf_dir):
    return extraction.with_lines(letters(spark, sf_dir)).select("letter_id", F.size(extract.header_zone("lines")).cast("long").alias("n_lines"))


@query("ext_agency_ok", "SELECT letter_id, letter_id % 6 <> 0 AS first_ok, false AS third_ok FROM letters")
def ext_agency_ok(spark, sf_dir):
    df = extraction.with_lines(letters(spark, sf_dir))
    return df.select("letter_id", extract.agency_ok(F.get("lines", F.lit(0))).alias("first_ok"), extract.agency_ok(F.when(F.col("letter_id") % 6 != 0, F.get("lines", F.lit(2))).otherwise("bahwa dinas")).alias("third_ok"))


@query("ext_agency", "SELECT letter_id, t_agency AS agency FROM letters")
def ext_agency(spark, sf_dir):
    return extraction.with_lines(letters(spark, sf_dir)).select("letter_id", extract.agency("lines").alias("agency"))


_of_letters("ext_subject", "SELECT letter_id, t_subject AS subject FROM letters", subject=lambda: extract.subject("text"))
_of_letters("ext_date_raw", "SELECT letter_id, t_letter_date AS written FROM letters", written=lambda: extract.date_raw("text"))
_of_letters("ext_signer_id", "SELECT letter_id, t_signer_id AS signer_id FROM letters", signer_id=lambda: extract.signer_id("text"))


@query("ext_signer_name", "SELECT letter_id, t_signer_name AS signer_name FROM letters")
def ext_signer_name(spark, sf_dir):
    df = extraction.with_lines(letters(spark, sf_dir)).withColumn("signer_id", extract.signer_id("text"))
    return df.select("letter_id", extract.signer_name("lines", "signer_id").alias("signer_name"))


_of_letters("ext_title_ok", "SELECT letter_id, letter_id % 3 = 0 AS ok FROM letters",
            ok=lambda: extract.title_ok(F.when(F.col("letter_id") % 3 == 0, "Kepala Bidang Umum,").when(F.col("letter_id") % 3 == 1, "Kepala daerah adalah pejabat").otherwise("Bapak Contoh")))
_of_letters("ext_title_join", """SELECT letter_id, CASE letter_id % 3 WHEN 0 THEN 'Kepala Badan Perencanaan Daerah' WHEN 1 THEN 'Kepala Dinas' ELSE 'Kepala Badan dan Kantor' END AS title FROM letters""",
            title=lambda: extract.title_join(F.when(F.col("letter_id") % 3 == 1, "Kepala Dinas").otherwise("Kepala Badan"), F.array(F.when(F.col("letter_id") % 3 == 0, "Perencanaan Daerah").when(F.col("letter_id") % 3 == 1, "Budi, S.Pd").otherwise("dan"), F.lit("Kantor"), F.lit("Umum"))))


@query("ext_title", "SELECT letter_id, t_signer_title AS signer_title FROM letters")
def ext_title(spark, sf_dir):
    return extraction.with_signature(letters(spark, sf_dir)).select("letter_id", "signer_title")


@query("ext_heuristic", "SELECT letter_id, t_doc_number AS doc_number, nullif(t_agency, '') AS agency, t_subject AS subject, t_letter_date AS letter_date, t_signer_name AS signer_name, nullif(t_signer_title, '') AS signer_title, t_signer_id AS signer_id, 'smart_heuristics' AS engine FROM letters")
def ext_heuristic(spark, sf_dir):
    return extraction.extract_all(letters(spark, sf_dir).select("letter_id", "text")).select("letter_id", "doc_number", "agency", "subject", "letter_date", "signer_name", "signer_title", "signer_id", "engine")


_of_letters("ext_field_conf", """SELECT letter_id, CASE WHEN t_doc_number IS NULL THEN 0.0::DOUBLE ELSE 0.8::DOUBLE END AS number_conf, CASE WHEN t_signer_id IS NULL THEN 0.0::DOUBLE ELSE 0.9::DOUBLE END AS id_conf FROM letters""",
            number_conf=lambda: extract.field_confidence("t_doc_number", "doc_number"), id_conf=lambda: extract.field_confidence("t_signer_id", "signer_id"))


@query("ext_baseline", """SELECT letter_id, CASE WHEN letter_id % 10 = 1 THEN '16 Kelurahan Contoh' WHEN letter_id % 10 = 2 THEN '5/abc-def-contoh-dua' WHEN letter_id % 10 >= 4 THEN t_doc_number || '  Lampiran : 1' END AS doc_number,
  CASE WHEN letter_id % 8 > 0 THEN 'NIP. ' || t_signer_id END AS signer_id, string_split(text, chr(10))[1] AS agency FROM letters""")
def ext_baseline(spark, sf_dir):
    return extraction.baseline(letters(spark, sf_dir)).select("letter_id", "doc_number", "signer_id", "agency")


_of_letters("ext_ai_needed", "SELECT letter_id, t_doc_number IS NULL OR t_agency = '' AS needed FROM letters", needed=lambda: extract.ai_needed("t_doc_number", "t_agency"))


@query("ext_ai_merge", """SELECT letter_id, CASE WHEN letter_id % 2 = 0 AND t_doc_number IS NULL THEN 'outside' ELSE 'local' END AS engine,
  CASE WHEN letter_id % 2 = 0 AND t_doc_number IS NULL THEN '1/AB/' || CAST(letter_id AS VARCHAR) ELSE t_doc_number END AS doc_number FROM letters""")
def ext_ai_merge(spark, sf_dir):
    names = {"doc_number": "t_doc_number", "agency": "t_agency", "subject": "t_subject", "letter_date": "t_letter_date", "signer_name": "t_signer_name", "signer_title": "t_signer_title", "signer_id": "t_signer_id"}
    local = letters(spark, sf_dir).select("letter_id", *(F.col(t).alias(f) for f, t in names.items()))
    other = local.where("letter_id % 2 = 0").withColumn("doc_number", F.coalesce("doc_number", F.concat(F.lit("1/AB/"), F.col("letter_id").cast("string"))))
    return extraction.merge_alternative(local, other).select("letter_id", "engine", "doc_number")


# --- validation ------------------------------------------------------------------------------------------------------
_of_letters("val_signer_id", "SELECT letter_id, t_signer_valid AS valid, CASE WHEN letter_id % 8 >= 2 THEN t_signer_id END AS id FROM letters",
            valid=lambda: validate.signer_id("t_signer_id", "text")["valid"], id=lambda: validate.signer_id("t_signer_id", "text")["id"])
_of_letters("val_date_iso", "SELECT letter_id, t_iso_date AS iso FROM letters", iso=lambda: validate.date_iso("t_written_date"))
_of_letters("val_date_sheet", """WITH d AS (SELECT *, lpad(split_part(t_written_date, '-', 1), 2, '0') AS a FROM letters)
  SELECT letter_id, CASE WHEN letter_id % 9 = 0 THEN '' WHEN letter_id % 9 = 5 OR (letter_id % 9 = 1 AND t_written_date LIKE '% Nop %') THEN t_written_date
    WHEN letter_id % 9 = 4 THEN split_part(t_written_date, '-', 3) || CASE WHEN a <= '12' THEN '-' || a || '-13' ELSE '-13-' || a END ELSE t_iso_date END AS value,
  letter_id % 9 IN (2, 4, 6, 7, 8) OR (letter_id % 9 = 1 AND t_written_date NOT LIKE '% Nop %') AS changed FROM d""",
            value=lambda: validate.date_sheet("t_written_date")["value"], changed=lambda: validate.date_sheet("t_written_date")["changed"])
_of_letters("val_date_variants", """SELECT letter_id, CASE WHEN t_iso_date IS NULL THEN 0 ELSE 7 END AS n, CASE WHEN t_iso_date IS NOT NULL THEN substr(t_iso_date, 9, 2) || '/' || substr(t_iso_date, 6, 2) || '/' || substr(t_iso_date, 1, 4) END AS last FROM letters""",
            n=lambda: F.size(validate.date_variants("t_iso_date")), last=lambda: F.get(validate.date_variants("t_iso_date"), F.lit(6)))


@query("val_confidence", """WITH s AS (SELECT letter_id, t_doc_number IS NOT NULL AS a, t_agency <> '' AS b, t_subject IS NOT NULL AS c, t_letter_date IS NOT NULL AS d, letter_id % 8 >= 2 AS has_id, t_signer_valid AS ok FROM letters)
  SELECT letter_id, CAST(30 * a::INT + 15 * b::INT + 15 * c::INT + 20 * d::INT + CASE WHEN NOT has_id THEN 5 WHEN ok THEN 15 ELSE 8 END AS BIGINT) AS score_hundredths,
  CAST((NOT a)::INT + (NOT b)::INT + (NOT c)::INT + (NOT d)::INT + (has_id AND NOT ok)::INT AS BIGINT) AS n_flags,
  30 * a::INT + 15 * b::INT + 15 * c::INT + 20 * d::INT + CASE WHEN NOT has_id THEN 5 WHEN ok THEN 15 ELSE 8 END < 70 OR NOT (a AND b AND c AND d) OR (has_id AND NOT ok) AS review FROM s""")
def val_confidence(spark, sf_dir):
    df = extraction.validated(extraction.extract_all(letters(spark, sf_dir).select("letter_id", "text")))
    return df.select("letter_id", F.col("hundredths").cast("long").alias("score_hundredths"), F.size("flags").cast("long").alias("n_flags"), "review")


_of_records("val_needs_review", "SELECT letter_id, pages * 20 < 70 OR m_agency = '' OR m_subject = '' AS review FROM records",
            review=lambda: validate.needs_review(F.col("pages") * 20, F.array_compact(F.array(*(F.when(F.col(f"m_{f}") == "", rules.FLAGS[f]) for f in ("agency", "subject"))))))
_of_letters("val_resolve", "SELECT letter_id, coalesce(nullif(t_iso_date, ''), t_written_date) AS value FROM letters", value=lambda: validate.resolve("t_iso_date", "t_written_date"))
_of_documents("val_scanned", r"""SELECT doc_id, len(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '')) < 30 AS scanned FROM documents""", scanned=lambda: validate.scanned(text.word_count("text")))


@query("val_scanned_4p", """SELECT conv_id, CAST(count(*) FILTER (turn_no <= 4) AS BIGINT) AS pages_read, coalesce(sum(len(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> ''))) FILTER (turn_no <= 4), 0) < 30 AS scanned
  FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS turn_no FROM conversations) GROUP BY conv_id""".replace("\\\\", "\\"))
def val_scanned_4p(spark, sf_dir):
    """Turns stand for pages: the first four of each conversation; four a task and conversation reach the shuffle, however many there are."""
    first = first_k(table(spark, sf_dir, "conversations").select("conv_id", "turn", "text"), "conv_id", "turn", 4)
    pages = first.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("pages"))
    words = F.aggregate("pages", F.lit(0), lambda n, p: n + text.word_count(p["text"]))
    return pages.select("conv_id", F.size("pages").cast("long").alias("pages_read"), validate.scanned(words).alias("scanned"))


_of_documents("val_score_format", "SELECT doc_id, replace(printf('%.2f', CAST(n_chars AS DOUBLE) / 7), '.', ',') AS shown FROM documents", shown=lambda: validate.score_format(F.col("n_chars") / 7))
_of_documents("val_sha256", """SELECT doc_id, CASE WHEN length(n) >= 50 THEN sha256(n) ELSE '' END AS hash FROM (SELECT doc_id, trim(regexp_replace(regexp_replace(lower(coalesce(text, '')), '[^a-z0-9 ]+', ' ', 'g'), ' +', ' ', 'g')) AS n FROM documents)""",
              hash=lambda: validate.content_hash(text.dup_norm("text")))
_of_records("val_page_pick", """SELECT letter_id, array_to_string(CASE WHEN k <= 0 OR k >= pages THEN range(pages) ELSE list_concat(range(greatest(k, 0)), [pages - 1]) END, ',') AS pages FROM (SELECT letter_id, pages, length(m_subject) % 5 - 1 AS k FROM records)""",
            pages=lambda: F.array_join(validate.page_pick("pages", F.length("m_subject") % 5 - 1).cast("array<string>"), ","))

# --- classification --------------------------------------------------------------------------------------------------
@query("cls_doc_type", "SELECT letter_id, t_doc_type AS type, CAST(t_type_hits AS INT) AS n_hits, CASE WHEN letter_id % 29 = 0 THEN 0.8::DOUBLE WHEN t_type_hits = 0 THEN 0.0::DOUBLE ELSE (50 + 15 * t_type_hits)::DOUBLE / 100 END AS confidence FROM letters")
def cls_doc_type(spark, sf_dir):
    found = letters(spark, sf_dir).withColumn("t", classify.doc_type("text", "filename"))
    return found.select("letter_id", "t.type", F.col("t.hits").alias("n_hits"), "t.confidence")


_of_letters("cls_image_override", "SELECT letter_id, letter_id % 29 = 0 AS image FROM letters", image=lambda: classify.is_image("filename"))

_RELEVANT = "CASE t_doc_type " + " ".join(f"WHEN '{t}' THEN '{','.join(f)}'" for t, _, f in rules.DOC_TYPES) + " END"
_of_letters("cls_relevant_fields", f"SELECT letter_id, {_RELEVANT} AS relevant, CAST(8 - len(list_filter(string_split({_RELEVANT}, ','), lambda x: x <> '')) AS INT) AS n_irrelevant FROM letters",
            relevant=lambda: F.array_join(classify.relevant_fields("t_doc_type"), ","), n_irrelevant=lambda: F.size(classify.irrelevant_fields("t_doc_type")))


@query("cls_region", "SELECT letter_id, t_region AS code, t_region_name AS name FROM letters")
def cls_region(spark, sf_dir):
    return letters(spark, sf_dir).withColumn("r", classify.region("text")).select("letter_id", "r.code", "r.name")


_TAG_TABLE = ", ".join(f"({i}, '{t}', '{k}')" for i, (t, k) in enumerate((t, k) for t, words in rules.TAGS for k in words))


@query("cls_tag", f"WITH rules(ord, tag, keyword) AS (VALUES {_TAG_TABLE}) SELECT letter_id, arg_min(tag, ord) AS tag, arg_min(keyword, ord) AS keyword FROM letters LEFT JOIN rules ON contains(lower(text), keyword) GROUP BY letter_id")
def cls_tag(spark, sf_dir):
    return letters(spark, sf_dir).withColumn("t", classify.tag("text")).select("letter_id", "t.tag", "t.keyword")


_OWNERS = [(t, f"IND-{i % 19 + 1:02d}", i) for i, (t, _) in enumerate(rules.TAGS)] + [("rkpd", "IND-19", 90), ("sosialisasi_media", "IND-01", 91)]


@query("cls_tag_indicator", f"WITH rules(ord, tag, keyword) AS (VALUES {_TAG_TABLE}), owners(tag, indicator, pos) AS (VALUES {', '.join(map(str, _OWNERS))}), "
       "first AS (SELECT tag, arg_min(indicator, pos) AS indicator FROM owners GROUP BY tag) "
       "SELECT letter_id, t.tag, indicator FROM (SELECT letter_id, arg_min(tag, ord) AS tag FROM letters LEFT JOIN rules ON contains(lower(text), keyword) GROUP BY letter_id) t LEFT JOIN first ON t.tag = first.tag")  # fmt: skip
def cls_tag_indicator(spark, sf_dir):
    """Owners are a table of rules; the first owner of a tag wins."""
    owners = spark.createDataFrame(_OWNERS, "tag string, indicator string, pos int").groupBy("tag").agg(F.min_by("indicator", "pos").alias("indicator"))
    return letters(spark, sf_dir).select("letter_id", classify.tag("text")["tag"].alias("tag")).join(F.broadcast(owners), "tag", "left").select("letter_id", "tag", "indicator")


@query("cls_skip_name", "SELECT letter_id FROM letters WHERE NOT (letter_id % 7 = 0 OR letter_id % 11 = 3)")
def cls_skip_name(spark, sf_dir):
    name = F.concat(F.when(F.col("letter_id") % 7 == 0, "Logo-").when(F.col("letter_id") % 11 == 3, "Presentasi Kelompok ").otherwise("berkas-"), "filename")
    return letters(spark, sf_dir).where(~classify.skipped_name(name)).select("letter_id")


@query("cls_evidence_id", "SELECT n_nationkey, printf('EVD-%04d', row_number() OVER (ORDER BY n_name)) AS evidence_id FROM nation")
def cls_evidence_id(spark, sf_dir):
    from letterloom.operators.relations import numbered_by

    return numbered_by(table(spark, sf_dir, "nation"), "n_name").select("n_nationkey", classify.evidence_id("no").alias("evidence_id"))


@query("cls_split", """WITH r AS (SELECT doc_id, ((doc_id + 42) * 48271) % 2147483647 AS place FROM documents), o AS (SELECT doc_id, row_number() OVER (ORDER BY place, doc_id) AS n, count(*) OVER () AS total FROM r)
  SELECT CASE WHEN n <= floor(total * 0.6) THEN 'train' ELSE 'test' END AS split, count(*) AS n, CAST(sum(doc_id) AS BIGINT) AS ids FROM o GROUP BY 1""")
def cls_split(spark, sf_dir):
    from letterloom.operators.relations import seeded_split

    return seeded_split(table(spark, sf_dir, "documents").select("doc_id"), "doc_id").groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.sum("doc_id").alias("ids"))


# --- comparison, audit, egress -----------------------------------------------------------------------------------------
_NORM = "trim(regexp_replace(lower({}), '[^a-z0-9]+', ' ', 'g'))"
_HOLD = "contains(a, b) OR contains(b, a)"
_of_records("cmp_value", f"SELECT letter_id, CASE WHEN b = '' THEN 'no_ref' WHEN a = '' THEN 'empty' WHEN a = b THEN 'exact' WHEN {_HOLD} THEN 'partial' ELSE 'wrong' END AS verdict FROM (SELECT letter_id, {_NORM.format('m_subject')} AS a, {_NORM.format('l_subject')} AS b FROM records)",
            verdict=lambda: audit.cmp_value("m_subject", "l_subject"))
_of_records("cmp_legacy", f"SELECT letter_id, a <> '' AND b <> '' AND ({_HOLD}) AS ok FROM (SELECT letter_id, {_NORM.format('m_agency')} AS a, {_NORM.format('l_agency')} AS b FROM records)",
            ok=lambda: audit.cmp_legacy("m_agency", "l_agency"))


_PLAIN = "trim(regexp_replace(lower({}), '[^a-z0-9/]+', ' ', 'g'))"


@query("aud_find", f"""WITH d AS (SELECT doc_id, {_PLAIN.format("CASE WHEN doc_id % 3 = 0 THEN replace(text, ' ', '') ELSE text END")} AS h FROM documents), b AS (SELECT item_id, {_PLAIN.format('text')} AS n FROM benchmark),
  f AS (SELECT doc_id, item_id, CASE WHEN contains(h, n) THEN 'found' ELSE 'found_without_spaces' END AS verdict FROM d JOIN b ON n <> '' AND contains(replace(h, ' ', ''), replace(n, ' ', '')))
  SELECT * FROM f UNION ALL SELECT NULL, item_id, 'not_found' FROM b WHERE n <> '' AND item_id NOT IN (SELECT item_id FROM f)""")
def aud_find(spark, sf_dir):
    """Every value of ``benchmark`` sought in every document, a third of which have lost their spaces; values that stand nowhere are rows without document."""
    from letterloom.operators.finding import find_values

    needles = table(spark, sf_dir, "benchmark").select("item_id", text.audit_norm("text").alias("needle"))
    scanned = F.when(F.col("doc_id") % 3 == 0, F.replace("text", F.lit(" "), F.lit(""))).otherwise(F.col("text"))
    found = find_values(table(spark, sf_dir, "documents").select("doc_id", scanned.alias("hay")), needles, text.audit_norm)
    nowhere = needles.where("needle <> ''").join(found.select("item_id").distinct(), "item_id", "left_anti")
    return found.unionByName(nowhere.select(F.lit(None).cast("long").alias("doc_id"), "item_id", F.lit("not_found").alias("verdict")))


_of_letters("aud_date", "SELECT letter_id, CASE WHEN letter_id % 9 IN (0, 4) THEN 'none' WHEN letter_id % 9 IN (1, 3) AND NOT (letter_id % 9 = 1 AND t_written_date LIKE '% Mei %') THEN CASE WHEN letter_id % 9 = 1 THEN 'similar' ELSE 'not_found' END WHEN letter_id % 9 = 2 AND length(t_written_date) - length(replace(t_written_date, '/', '')) = 2 AND regexp_extract(t_written_date, '/([0-9]+)/', 1)::INT < 10 THEN 'similar' ELSE 'found' END AS verdict FROM letters",
            verdict=lambda: F.when(F.col("t_iso_date").isNull(), "none").otherwise(audit.aud_date("t_iso_date", text.audit_norm("t_written_date"))))
_of_letters("aud_signer_id", "SELECT letter_id, CASE WHEN letter_id % 8 < 2 THEN 'not_found' WHEN letter_id % 3 = 0 THEN 'similar' ELSE 'found' END AS verdict FROM letters",
            verdict=lambda: F.when(F.col("letter_id") % 8 < 2, audit.aud_signer_id(F.lit("999999999999999999"), F.lit("nip 1"))).otherwise(audit.aud_signer_id(F.when(F.col("letter_id") % 3 == 0, F.concat(F.left("t_signer_id", F.lit(12)), F.lit("777777777"))).otherwise(F.col("t_signer_id")), text.audit_norm("text"))))
_of_letters("aud_docnum", "SELECT letter_id, CASE WHEN t_doc_number IS NULL THEN 'empty' ELSE 'found' END AS verdict FROM letters", verdict=lambda: audit.aud_docnum("t_doc_number", text.audit_norm("text")))

_MODES, _POLICIES = ("off", "if_needed", "always"), ("off", "all", "scanned_only", "other")
_pick = lambda values, by: F.element_at(F.array(*map(F.lit, values)), (by % len(values) + 1).cast("int"))
_of_records("egr_policy", """WITH p AS (SELECT letter_id, ['off', 'if_needed', 'always'][pages % 3 + 1] AS mode, ['off', 'all', 'scanned_only', 'other'][letter_id % 4 + 1] AS policy, verified_by <> '' AS has_key, is_scanned AS scanned FROM records)
  SELECT letter_id, mode <> 'off' AND policy <> 'off' AND has_key AND (policy = 'all' OR (policy = 'scanned_only' AND scanned)) AS allowed,
  CASE WHEN mode = 'off' THEN 'mode off' WHEN policy = 'off' THEN 'policy off' WHEN NOT has_key THEN 'no key' WHEN policy = 'all' THEN 'policy all' WHEN policy = 'other' THEN 'unknown policy' WHEN scanned THEN 'scanned' ELSE 'has a text layer' END AS reason FROM p""",
            **{k: (lambda k=k: audit.egress_policy(_pick(_MODES, F.col("pages")), _pick(_POLICIES, F.col("letter_id")), F.col("verified_by") != "", F.col("is_scanned"))[k]) for k in ("allowed", "reason")})
_of_records("egr_missing_meta", "SELECT letter_id, coalesce(CASE WHEN m_agency <> '' THEN m_subject <> '' END, false) AND is_scanned AS allowed FROM records",
            allowed=lambda: audit.egress_missing_meta(F.when(F.col("m_agency") != "", F.col("m_subject") != ""), F.col("is_scanned")))
_of_records("egr_page_cap", "SELECT letter_id, CAST(least(4, pages) AS INT) AS pages FROM records", pages=lambda: F.size(audit.egress_pages(F.sequence(F.lit(0), F.col("pages") - 1))))
_of_records("qr_pick_url", "SELECT letter_id, CASE WHEN is_scanned THEN 'cek BSrE ' || filename WHEN m_verification_url <> '' THEN m_verification_url END AS url FROM records",
            url=lambda: audit.qr_pick_url(F.array(F.col("m_subject"), F.when(F.col("is_scanned"), F.concat(F.lit("cek BSrE "), "filename")).otherwise(F.col("doc_type")), F.col("m_verification_url"))))
_of_documents("img_stamp", "SELECT doc_id, coalesce(n_chars > 800, false) AS stamp FROM documents", stamp=lambda: audit.stamp("n_chars"))
_of_letters("flt_ocr_trigger", "SELECT letter_id, length(t_agency) < 40 AND letter_id % 2 = 0 AS trigger FROM letters", trigger=lambda: (F.length("t_agency") < 40) & (F.col("letter_id") % 2 == 0))
_of_records("pick_adaptive", """SELECT letter_id, (pages / 5.0::DOUBLE < 0.8::DOUBLE OR pages < 5) AND length(l_subject) > 0 AND length(l_subject) >= 0.9::DOUBLE * length(m_subject) AND (0.7::DOUBLE > pages / 5.0::DOUBLE OR length(l_subject) > length(m_subject)) AS other FROM records""",
            other=lambda: audit.pick_adaptive("m_subject", F.col("pages") / 5, "pages", "l_subject", F.lit(0.7)))
