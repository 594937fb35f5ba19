"""Functions on invented strings: accepted and rejected cases, nulls, and the traps of the rules."""

import difflib
import unicodedata

import pytest
from pyspark.sql import functions as F

from letterloom.functions import audit, classify, extract, text, validate
from letterloom.operators import python_functions


@pytest.fixture(scope="module")
def value(spark):
    def run(column):
        return spark.range(1).select(column.alias("v")).first()["v"]

    return run


def lit_lines(*x):
    return F.array(*map(F.lit, x))


@pytest.mark.parametrize(("given", "want"), [
    ("PEMERINTAHKABUPATENCONTOH", "PEMERINTAH KABUPATEN CONTOH"), ("DINASXY", "DINASXY"), ("PEMERINTAHABC", "PEMERINTAHABC"), ("a DINASPENDIDIKANKOTA b", "a DINAS PENDIDIKAN KOTA b"),
    ("DINASBADAN" + "X" * 25, "DINASBADAN" + "X" * 25), ("", ""), (None, None), ("Dinas Kota", "Dinas Kota"),
])
def test_split_glued(value, given, want):
    assert value(text.split_glued(F.lit(given).cast("string"))) == want


@pytest.mark.parametrize(("given", "want"), [("Dacrah DACRAH dacrah", "Daerah DAERAH daerah"), ("dacrahx 1dacrah", "dacrahx 1dacrah"), ("pendidik.an", "pendidik.an"), ("", "")])
def test_fix_misread(value, given, want):
    assert value(text.fix_misread(F.lit(given))) == want


@pytest.mark.parametrize(("given", "want"), [(" :- Budi,; ", "Budi"), ("S.Pd.", "S.Pd."), ("a   b\n\nc\nd", "a b c\nd"), (None, ""), ("", "")])
def test_clean_value(value, given, want):
    assert value(text.clean_value(F.lit(given).cast("string"))) == want


def test_names(value):
    assert value(text.norm_agency(F.lit("DINAS Dinas DINAS PENDIDIKAN -"))) == "DINAS PENDIDIKAN"
    assert value(text.norm_name(F.lit(": Budi ,S.Pd.  , M.Pd."))) == "Budi, S.Pd., M.Pd."
    assert value(text.redact(F.lit("api_key='ABCDEFGH12' AQ.abcdefghij123 x"))) == "api_key='<masked>' <masked> x"


@pytest.mark.parametrize(("given", "ok"), [
    ("421.2/125/KBH/UPT.A/XII/2024", True), ("16", False), ("2 Contoh 90111", False), ("1/2 Kelurahan Contoh", False), ("12/34", False), ("sdi-contoh/dua-x", False), ("1/abc-defg/X", False), (None, False),
])
def test_document_number(value, given, ok):
    assert value(extract.docnum_valid(F.lit(given).cast("string"))) is ok


@pytest.mark.parametrize(("lines", "want"), [
    (("PEMERINTAH KOTA CONTOH", "DINAS PENDIDIKAN", "Nomor : 1"), "PEMERINTAH KOTA CONTOH DINAS PENDIDIKAN"), (("PEMERINTAHKOTACONTOH", "x"), "PEMERINTAH KOTA CONTOH"),
    (("Nomor : 1", "DINAS PENDIDIKAN"), ""), (("PERATURAN DINAS",), ""), (("bahwa dinas itu",), ""), (("Jalan Dinas 3",), ""), (("Nama Sekolah",), ""), (("${kop} DINAS",), ""), (("DINAS A", "Jalan B", "BADAN C"), "DINAS A"), ((), ""),
])
def test_agency(value, lines, want):
    assert value(extract.agency(lit_lines(*lines).cast("array<string>"))) == want


@pytest.mark.parametrize(("lines", "signer", "name", "want"), [
    (("Kepala Sekolah", "Budi, S.Pd.", "NIP. 196001012000011001"), "196001012000011001", "Budi", "Kepala Sekolah"), (("Kepala Badan", "Perencanaan Daerah", "Budi", "NIP. 196001012000011001"), "x", None, "Kepala Badan Perencanaan Daerah"),
    (("Kepala daerah adalah pejabat", "isi"), None, None, ""), (("isi surat", "Budi, Sekretaris Daerah", "NIP. 196001012000011001"), "x", None, "Sekretaris Daerah"), (("isi", "Camat Contoh", "lain"), None, None, "Camat Contoh"),
])
def test_title(value, lines, signer, name, want):
    arr = lit_lines(*lines)
    anchor = extract.title_anchor(arr, F.lit(signer).cast("string"), F.lit(name).cast("string"))
    assert value(extract.title(arr, extract.cleaned_lines(arr), anchor)) == want


@pytest.mark.parametrize(("raw", "body", "valid", "kept"), [
    ("196001012000011001", "", True, "196001012000011001"), ("189901012000011001", "196001012000011001", False, "189901012000011001"), ("12", "NIP 19600101 200001 1 001", True, "196001012000011001"),
    (None, "", False, None), ("196013012000011001", "", True, "196013012000011001"), (None, "196013012000011001", False, None),
])
def test_signer_id(value, raw, body, valid, kept):
    got = value(validate.signer_id(F.lit(raw).cast("string"), F.lit(body)))
    assert (got["valid"], got["id"]) == (valid, kept)


@pytest.mark.parametrize(("raw", "iso"), [
    ("2024-99-01", "2024-99-01"), ("3 September 2024", "2024-09-03"), ("3 nop 2024", "2024-11-03"), ("99 mei 2024", "2024-05-99"), ("1 des 2024 dan 2 jan 2023", "2023-01-02"), ("5/13/2024", None), ("5-1-2024", "2024-01-05"), (None, None), ("", None),
])
def test_date_iso(value, raw, iso):
    assert value(validate.date_iso(F.lit(raw).cast("string"))) == iso


@pytest.mark.parametrize(("raw", "out", "changed"), [("1/9/2025", "2025-09-01", True), ("9-13-2025", "2025-09-13", True), ("1 Sep 2025", "2025-09-01", True), ("1 nop 2025", "1 nop 2025", False), ("2025-9-1", "2025-09-01", True), ("2025-09-01", "2025-09-01", False), ("", "", False), (None, "", False)])
def test_date_sheet(value, raw, out, changed):
    got = value(validate.date_sheet(F.lit(raw).cast("string")))
    assert (got["value"], got["changed"]) == (out, changed)


def test_confidence(value):
    def score(*six, valid=False):
        *fields, url = six
        return value(validate.confidence(*(F.lit(x).cast("string") for x in fields), F.lit(valid), F.lit(url).cast("string")))

    nothing = score(None, None, None, None, None, None)
    assert nothing["hundredths"] == 5 and len(nothing["flags"]) == 4 and nothing["review"]
    full = score("123456", "abcd", "abcd", "2024-01-01", "1", "https://x", valid=True)
    assert full["score"] == 1.0 and not full["review"]
    assert score("123456", "abcd", "abcd", "2024-01-01", "1", None)["review"]  # a flag asks for review, whatever the score
    assert score("12345", "abc", "abc", "x", None, None)["hundredths"] == 25


@pytest.mark.parametrize(("body", "name", "want"), [
    ("undangan rapat", "a.pdf", "surat_dinas"), ("berita acara serah", "a.pdf", "berita_acara"), ("undangan, berita acara", "a.pdf", "berita_acara"), ("isi", "foto.JPG", "bukti_media"), ("", "", "tidak_diketahui"), ("peraturan daerah dan surat keputusan", "x", "peraturan"),
])
def test_doc_type(value, body, name, want):
    assert value(classify.doc_type(F.lit(body), F.lit(name)))["type"] == want


@pytest.mark.parametrize(("body", "code", "name"), [
    ("Pemerintah Kota Makassar", "kota_makassar", "KOTA MAKASSAR"), ("PEMERINTAHKABUPATENCONTOH", "luar_kota_makassar", "KABUPATEN CONTOH"), ("di makassar", "kota_makassar", "KOTA MAKASSAR"), ("", "tidak_diketahui", ""), (None, "tidak_diketahui", ""),
])
def test_region(value, body, code, name):
    assert tuple(value(classify.region(F.lit(body).cast("string")))) == (code, name)


def test_audit_and_policy(value):
    assert value(audit.aud_date(F.lit("2024-09-03"), F.lit("tanggal 3 september 2024"))) == "found"
    assert value(audit.aud_date(F.lit("2024-09-03"), F.lit("3 di bulan 2024"))) == "similar"
    assert value(audit.aud_docnum(F.lit("421/2/XY"), F.lit("no 421/2/ zz"))) == "found"
    assert value(audit.aud_signer_id(F.lit("196001012000011001"), F.lit("nip 19600101 x"))) == "similar"
    rule = audit.egress_policy(F.lit("if_needed"), F.lit("scanned_only"), F.lit(True), F.lit(False))
    assert value(rule)["allowed"] is False
    assert value(validate.page_pick(F.lit(10), F.lit(3))) == [0, 1, 2, 9] and value(validate.page_pick(F.lit(2), F.lit(0))) == [0, 1]


def test_python_functions(spark):
    pairs = [("abc def " * 40, "abc dxf " * 40), ("", ""), (None, "x"), ("abcd", "bcd")]
    df = spark.createDataFrame(pairs, "a string, b string")
    got = df.select(python_functions.similarity(F.col("a"), F.col("b")).alias("r"), python_functions.longest_block_share(F.col("a"), F.col("b")).alias("s")).collect()
    for (a, b), r in zip(pairs, got, strict=True):
        m = difflib.SequenceMatcher(None, a or "", b or "")
        assert r["r"] == m.ratio() and r["s"] == m.find_longest_match(0, len(a or ""), 0, len(b or "")).size / max(1, len(b or ""))
    words = ["Élan vital", "ﬁne", None, "A--b"]
    keys = [r["k"] for r in spark.createDataFrame([(w,) for w in words], "w string").select(python_functions.cmp_norm("w").alias("k")).collect()]
    assert keys == ["e lan vital", "fine", "", "a b"] and unicodedata.normalize("NFKD", "É") != "É"


def test_patterns_are_tried_where_their_word_stands(spark):
    from letterloom.functions import rules
    from letterloom.functions.classify import required_word

    patterns = [p for _, own, _ in rules.DOC_TYPES for p in own]
    assert all(required_word(p) for p in patterns)
    assert [required_word(p) for p in (r"https?://", r"petunjuk\s+(?:teknis|operasional)", r"^\s*hal\s*:", "a|b")] == ["http", "petunjuk", "hal", ""]
    texts = ["ſurat Undangan", "BERıTA acara", "surat  tugas", "link: x", "petunjuk\nteknis", "Keputusan kepala", "hal : a", "x\n hal: b", ""]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select(classify.type_code("t", F.lit("f")).alias("c"), F.lower(F.concat(F.lit("f\n"), "t")).alias("b"))
    last = len(rules.DOC_TYPES)
    plain = F.lit(0)
    for order, (_, own, _) in enumerate(rules.DOC_TYPES):
        hits = sum((F.col("b").rlike(f"(?Uim){p}").cast("int") for p in own), F.lit(0))
        plain = F.greatest(plain, F.when(hits > 0, hits * 100 + last - order).otherwise(0))
    got = [tuple(r) for r in df.select("c", plain.alias("p")).collect()]
    assert all(c == p for c, p in got) and sum(c > 0 for c, _ in got) == 8
