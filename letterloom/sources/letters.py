"""The derived relation ``letters``: one invented letter per order, with what a perfect reader would extract from it.

The text and the truth columns are computed from the columns of orders, customer and nation; the truth is never
read from the text. The statement is plain SQL that Spark and DuckDB both run.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from letterloom.shared import dealt

_MONTHS = ("Januari", "Februari", "Maret", "April", "Mei", "Juni", "Juli", "Agustus", "September", "Oktober", "November", "Desember")
_SHORT = ("Jan", "Feb", "Mar", "Apr", "Mei", "Jun", "Jul", "Agt", "Sep", "Okt", "Nop", "Des")


def _case(expr: str, values) -> str:
    return f"CASE {expr} " + " ".join(f"WHEN {i + 1} THEN '{v}'" for i, v in enumerate(values)) + " END"


def _text(expr: str) -> str:
    return f"CAST({expr} AS STRING)"


_JOINED = "{orders} JOIN {customer} ON o_custkey = c_custkey JOIN {nation} ON c_nationkey = n_nationkey"

LETTERS = f"""
WITH base AS (
  SELECT o_orderkey AS k, {_text("day(o_orderdate)")} AS d, month(o_orderdate) AS m, {_text("year(o_orderdate)")} AS y,
    lpad({_text("day(o_orderdate)")}, 2, '0') AS dd, lpad({_text("month(o_orderdate)")}, 2, '0') AS mm, o_orderdate,
    CASE WHEN c_nationkey % 5 = 0 THEN 'MAKASSAR' ELSE 'CONTOH ' || chr(65 + c_nationkey) || 'A' END AS place, c_nationkey AS nk, c_custkey AS ck
  FROM {_JOINED}
), parts AS (
  SELECT *,
    '421.' || {_text("k % 7")} || '/' || {_text("k % 1000 + 1")} || '/UPT.N' || {_text("nk")} || '/' || y AS number,
    'Undangan Rapat ' || {_text("k")} AS topic,
    d || ' ' || {_case("m", _MONTHS)} || ' ' || y AS long_date,
    d || ' ' || {_case("m", _SHORT)} || ' ' || y AS short_date,
    'Budi Contoh ' || {_text("k % 97")} || ', S.Pd.' AS person,
    '19' || {_text("60 + k % 30")} || lpad({_text("1 + k % 12")}, 2, '0') || lpad({_text("1 + k % 28")}, 2, '0')
      || '20' || lpad({_text("k % 20")}, 2, '0') || lpad({_text("1 + k % 12")}, 2, '0') || {_text("1 + k % 2")} || lpad({_text("k % 1000")}, 3, '0') AS good_id
  FROM base
), cases AS (
  SELECT *,
    CASE WHEN k % 8 = 2 THEN '1899' || substr(good_id, 5, 14) ELSE good_id END AS full_id,
    CASE k % 5 WHEN 0 THEN 'Kepala Badan' || chr(10) || 'Perencanaan Daerah' WHEN 1 THEN 'Kepala Sekolah' WHEN 2 THEN 'Sekretaris Daerah'
      WHEN 4 THEN 'Lurah adalah pejabat' ELSE 'Hormat kami' END AS title_lines,
    CASE k % 9 WHEN 0 THEN NULL WHEN 1 THEN short_date WHEN 2 THEN d || '/' || {_text("m")} || '/' || y WHEN 3 THEN y || '-' || mm || '-' || dd
      WHEN 4 THEN d || '-13-' || y WHEN 5 THEN 'tertanggal ' || long_date ELSE long_date END AS t_written_date
  FROM parts
)
SELECT k AS letter_id,
  'letter-' || lpad({_text("k")}, 8, '0') || CASE WHEN k % 11 = 0 THEN ' (1)' ELSE '' END || CASE WHEN k % 29 = 0 THEN '.png' ELSE '.pdf' END AS filename,
  CASE WHEN k % 6 = 0 THEN 'NOTULA RAPAT' WHEN k % 6 = 1 THEN 'PEMERINTAHKOTA' || replace(place, ' ', '') || chr(10) || 'DINAS PENDIDIKAN' || chr(10) || 'Jalan Contoh'
    ELSE 'PEMERINTAH KOTA ' || place || chr(10) || 'DINAS PENDIDIKAN' || chr(10) || 'Jalan Contoh' END || chr(10)
  || CASE WHEN k % 14 = 0 THEN 'SURAT PERNYATAAN' || chr(10) ELSE '' END
  || CASE WHEN k % 10 = 1 THEN 'Nomor : 16 Kelurahan Contoh' || chr(10) WHEN k % 10 = 2 THEN 'Nomor : 5/abc-def-contoh-dua' || chr(10)
       WHEN k % 10 >= 4 THEN 'Nomor : ' || number || '  Lampiran : 1' || chr(10) ELSE '' END
  || CASE WHEN k % 7 <> 0 THEN 'Perihal : ' || topic || chr(10) || 'Yth. Pimpinan' || chr(10) ELSE '' END
  || CASE WHEN t_written_date IS NOT NULL THEN t_written_date || chr(10) ELSE '' END
  || CASE k % 4 WHEN 0 THEN 'Bersama ini kami kirim laporan kegiatan' WHEN 1 THEN 'Bersama ini kami kirim berita acara' WHEN 3 THEN 'Bersama ini kami kirim nota dinas' ELSE 'Bersama ini kami kirim berkas' END
  || CASE WHEN k % 10 = 3 THEN ' menurut ' || number || ' terlampir' ELSE '' END
  || CASE WHEN k % 12 = 0 THEN ' di Makassar' ELSE '' END || chr(10)
  || title_lines || chr(10) || person || chr(10)
  || CASE WHEN k % 8 = 0 THEN '' WHEN k % 8 = 1 THEN 'NIP. ' || substr(full_id, 1, 17) ELSE 'NIP. ' || full_id END AS text,
  CASE WHEN k % 10 >= 3 THEN number END AS t_doc_number,
  CASE WHEN k % 10 >= 4 THEN number END AS t_labelled_number,
  CASE WHEN k % 6 = 0 AND k % 10 = 0 THEN 'Kepala Badan' WHEN k % 6 = 0 THEN '' ELSE 'PEMERINTAH KOTA ' || CASE WHEN k % 6 = 1 THEN replace(place, ' ', '') ELSE place END || ' DINAS PENDIDIKAN' END AS t_agency,
  CASE WHEN k % 7 <> 0 THEN topic || ' Yth. Pimpinan' WHEN k % 14 = 0 THEN 'Surat Pernyataan' END AS t_subject,
  CASE WHEN k % 9 >= 5 OR (k % 9 = 1 AND m = 5) THEN long_date END AS t_letter_date,
  t_written_date,
  CASE WHEN k % 9 IN (0, 4) THEN NULL ELSE y || '-' || mm || '-' || dd END AS t_iso_date,
  CASE WHEN k % 8 >= 2 THEN full_id WHEN k % 8 = 1 THEN substr(full_id, 1, 17) END AS t_signer_id,
  k % 8 > 2 AS t_signer_valid,
  CASE WHEN k % 8 >= 1 THEN person END AS t_signer_name,
  CASE WHEN k % 5 = 0 AND k % 8 = 0 THEN 'Kepala Badan' WHEN k % 5 = 0 THEN 'Kepala Badan Perencanaan Daerah' WHEN k % 5 = 1 THEN 'Kepala Sekolah' WHEN k % 5 = 2 THEN 'Sekretaris Daerah' ELSE '' END AS t_signer_title,
  CASE WHEN k % 6 = 0 AND k % 12 = 0 THEN 'kota_makassar' WHEN k % 6 = 0 THEN 'tidak_diketahui' WHEN place = 'MAKASSAR' THEN 'kota_makassar' ELSE 'luar_kota_makassar' END AS t_region,
  CASE WHEN k % 6 = 0 AND k % 12 = 0 THEN 'KOTA MAKASSAR' WHEN k % 6 = 0 THEN ''
    ELSE 'KOTA ' || trim(substr(CASE WHEN k % 6 = 1 THEN replace(place, ' ', '') ELSE place END || ' DINAS PENDIDIKAN JALAN CONTOH', 1, 25)) END AS t_region_name,
  CASE WHEN k % 29 = 0 THEN 'bukti_media' WHEN k % 7 <> 0 THEN 'surat_dinas' WHEN k % 6 = 0 AND k % 4 = 0 THEN 'laporan' WHEN k % 14 = 0 THEN 'surat_pernyataan'
    WHEN k % 4 = 1 THEN 'berita_acara' WHEN k % 4 = 3 THEN 'surat_dinas' WHEN k % 6 = 0 OR k % 4 = 0 THEN 'laporan' ELSE 'tidak_diketahui' END AS t_doc_type,
  CASE WHEN k % 29 = 0 THEN 0 WHEN k % 7 <> 0 AND k % 4 = 3 THEN 3 WHEN k % 7 <> 0 OR (k % 6 = 0 AND k % 4 = 0) THEN 2
    WHEN k % 14 = 0 OR k % 4 IN (0, 1, 3) OR k % 6 = 0 THEN 1 ELSE 0 END AS t_type_hits,
  k % 3 <> 0 AS has_label, CASE WHEN k % 5 = 0 THEN 'ann-' || {_text("k % 4")} ELSE '' END AS verified_by, o_orderdate AS received
FROM cases
"""


#: A record per letter: what the machine found (now and then nothing, too much or something else) and what people labelled.
_FIELDS = (("doc_number", "t_doc_number"), ("agency", "t_agency"), ("subject", "t_subject"), ("letter_date", "t_iso_date"), ("signer_name", "t_signer_name"), ("signer_title", "t_signer_title"), ("signer_id", "t_signer_id"))

RECORDS = (
    "SELECT letter_id, filename, text, t_doc_type AS doc_type, t_region AS region, CASE WHEN has_label THEN verified_by ELSE '' END AS verified_by, "
    "CAST(1 + letter_id % 5 AS INT) AS pages, letter_id % 9 = 2 AS is_scanned, "
    + ", ".join(f"CASE WHEN (letter_id + {n}) % 17 = 3 THEN '' WHEN (letter_id + {n}) % 17 = 5 THEN coalesce({t}, '') || ' extra' WHEN (letter_id + {n}) % 17 = 7 THEN 'zzz' ELSE coalesce({t}, '') END AS m_{f}" for n, (f, t) in enumerate(_FIELDS))
    + ", CASE WHEN letter_id % 4 = 1 THEN 'https://example.org/' || CAST(letter_id AS STRING) ELSE '' END AS m_verification_url, "
    + ", ".join(f"CASE WHEN has_label THEN coalesce({t}, '') ELSE '' END AS l_{f}" for f, t in _FIELDS)
    + ", CASE WHEN has_label AND letter_id % 8 = 1 THEN 'https://example.org/' || CAST(letter_id AS STRING) ELSE '' END AS l_verification_url "
    + f"FROM ({LETTERS})"
)


#: Bytes of code of a function that the JVM still compiles.
METHOD = 8_000


def derive(spark: SparkSession, sf_dir: str, statement: str) -> DataFrame:
    """Run a statement of this module over the input tables that it names.

    The tables are joined first and the narrow rows dealt by their number: a text takes much more time than its row
    has bytes, so neither the files nor the sizes of a join's shuffle say how many tasks there should be. Generated
    functions longer than ``METHOD`` would run without being compiled by the JVM, several times slower; with the limit
    Spark splits such projections into smaller ones.
    """
    spark.conf.set("spark.sql.codegen.hugeMethodLimit", METHOD)
    orders, customer, nation = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("orders", "customer", "nation"))
    joined = spark.sql(f"SELECT o_orderkey, o_orderdate, c_custkey, c_nationkey FROM {_JOINED}", orders=orders, customer=customer, nation=nation)
    return spark.sql(statement.replace(_JOINED, "{joined}"), joined=dealt(joined, "o_orderkey", orders.count()))


def letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derive(spark, sf_dir, LETTERS)


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derive(spark, sf_dir, RECORDS)


def as_duckdb(statement: str) -> str:
    return statement.format(orders="orders", customer="customer", nation="nation")
