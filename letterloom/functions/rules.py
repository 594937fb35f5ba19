"""Rule tables of official correspondence. Everything here is a fixed value that results depend on."""

from __future__ import annotations

#: The eight fields of a letter, in order.
FIELDS = ("doc_number", "agency", "subject", "letter_date", "signer_name", "signer_title", "signer_id", "verification_url")

#: Office terms that lose their spaces in scans.
TERMS = (
    "PEMERINTAH", "KABUPATEN", "KECAMATAN", "KELURAHAN", "PROVINSI",
    "KEPUTUSAN", "PERATURAN", "SERTIFIKAT", "SEKRETARIAT", "PENDIDIKAN",
    "KEBUDAYAAN", "KEUANGAN", "KESEHATAN", "PEKERJAAN", "PERUMAHAN",
    "PENANAMAN", "PENGENDALIAN", "LINGKUNGAN", "PERENCANAAN", "PEMBANGUNAN",
    "RISET", "INOVASI", "DAERAH", "DINAS", "BADAN", "KANTOR", "SEKOLAH",
    "KEPALA", "WALIKOTA", "BUPATI", "GUBERNUR", "MENTERI", "DIREKTUR",
    "CAMAT", "LURAH", "PEGAWAI", "NEGERI", "SWASTA", "NOMOR", "TENTANG",
    "TANGGAL", "LAMPIRAN", "PERIHAL", "NOTA", "SURAT", "UNDANGAN",
    "PERNYATAAN", "BERITA", "ACARA", "LAHIR", "KETERANGAN", "UPT", "UPTD",
    "SD", "SMP", "SMA", "SMK", "TK", "PAUD", "SPF", "SDN", "PUSKESMAS",
    "RUMAH", "SAKIT", "BANK", "DESA", "KOTA", "ALAMAT", "TELEPON",
)

#: Words that scans misread, in lower case. The one with a dot can never be a whole word.
MISREAD = {
    "dacrah": "daerah", "pcratu": "peraturan", "pcmcrintah": "pemerintah", "pemcrintah": "pemerintah",
    "kabupatcn": "kabupaten", "kccamatan": "kecamatan", "kclurahan": "kelurahan", "pendidik.an": "pendidikan",
    "keputusan": "keputusan", "scrtifikat": "sertifikat", "dinass": "dinas", "inovasl": "inovasi",
    "daorah": "daerah", "pcnyataan": "pernyataan", "tcntang": "tentang", "scbagai": "sebagai", "rnakassar": "makassar",
}

#: Month names in the order in which they are tried.
MONTHS = (
    ("januari", 1), ("jan", 1), ("februari", 2), ("peb", 2), ("feb", 2), ("maret", 3), ("mar", 3), ("april", 4), ("apr", 4),
    ("mei", 5), ("juni", 6), ("jun", 6), ("juli", 7), ("jul", 7), ("agustus", 8), ("agt", 8), ("agu", 8), ("september", 9),
    ("sep", 9), ("oktober", 10), ("okt", 10), ("november", 11), ("nop", 11), ("nov", 11), ("desember", 12), ("des", 12),
)
#: Month names of the review sheet, which lacks two of the abbreviations.
SHEET_MONTHS = tuple((name, n) for name, n in MONTHS if name not in ("peb", "nop"))
MONTH_NAMES = ("januari", "februari", "maret", "april", "mei", "juni", "juli", "agustus", "september", "oktober", "november", "desember")

#: Patterns of document numbers.
NUMBER_LABEL = r"\b(?:Nomor|NOMOR|No)\s*[:.]?\s*(.{3,90})"
NUMBER_CUT = r"\s{2,}|Lampiran|Sifat|Perihal|Hal|TENTANG|Tanggal|Tgl|Tentang"
NUMBER_CODE = r"\b(\d{1,4}(?:\.\d{1,4}){0,3}/[0-9A-Za-z.\-]+(?:/[0-9A-Za-z.\-]+){1,5})\b"
NUMBER_LINE = r"^\s*(?:Nomor|NOMOR|No)\s*[:.]"
ADDRESS_IN_NUMBER = (
    r"(kelurahan|kel\.|kecamatan|kec\.|jalan|jl\.|kota|kabupaten|provinsi|telepon|telp\.?|fax|email|pos-el|kode\s*pos|"
    r"website|www\.|http|\brt\b|\brw\b|\bnpsn\b|nip\b)"
)

#: What a letterhead line must and must not be.
NOT_LETTERHEAD = r"^(?:[a-z]\.|bahwa|menimbang|mengingat|dalam|untuk|pada|pasal|ayat|dengan|berdasarkan|sebagaimana|setelah|terhitung)\b"
DOCUMENT_TITLE = (
    r"\b(?:PERATURAN|KEPUTUSAN|SURAT PERNYATAAN|SURAT KETERANGAN|SURAT TUGAS|KERTAS KERJA|RENCANA KERJA|RENCANA KEGIATAN|"
    r"LAPORAN|MANUAL|PETUNJUK|PROPOSAL|BERITA ACARA|UNDANG-UNDANG|STANDAR OPERASIONAL|SOP)\b"
)
SCREEN_NOISE = (
    r"(?:\b\d{1,2}[:.]\d{2}\s*(?:AM|PM)\b|https?://|\b\d{1,2}/\d{1,2}/\d{2,4}\b|"
    r"\b(?:Pemilihan|Pengumuman|Beranda|Login|Unduh|Cari)\b)"
)
ADDRESS = r"\b(?:jl\.?\s|jalan|telp|telepon|email|pos-?el|fax|kode pos|website|kelurahan|kecamatan|kec\.)\b"
AGENCY_WORD = (
    r"\b(?:PEMERINTAH|PEMKOT|PEMKAB|WALIKOTA|BUPATI|GUBERNUR|DINAS|BADAN|UPT|SEKOLAH|SD|SDI|SDN|SMP|SMA|SMK|SLB|KOMUNITAS|"
    r"KEMENTERIAN|KANTOR|SEKRETARIAT|BALAI|RUMAH SAKIT|PUSKESMAS|KELURAHAN)\b"
)
PLACEHOLDER = r"\$\{|\{\{|TTD_PENGIRIM"
FORM_LABEL = (
    r"^(?:Nama|Nama\s+Sekolah|Nama\s+Kegiatan|Nama\s+Pejabat|Kode|Tahun|Bulan|Program|Kegiatan|Sub\s+Kegiatan|Sumber\s+Dana|"
    r"Rincian|Uraian|No|Unit|Alamat|Keterangan|Volume|Satuan)\b"
)

#: What a signatory's title must and must not be.
TITLE_START = (
    r"^(?:Plt\.?|Pelaksana\s+Tugas|Kepala|Sekretaris|Lurah|Camat|Direktur|Ketua|Koordinator|Penanggung\s+Jawab|Manajer|"
    r"Pengelola|Bendahara|Pejabat|Wali\s+Kota|Bupati|Gubernur|Dekan|Rektor|Kepala\s+UPT)\b"
)
SENTENCE = (
    r"\b(?:adalah|merupakan|yaitu|yakni|dalam\s+penyelenggaraan|untuk|pada\s+ayat|sebagaimana|dimaksud|tersebut|wajib|berhak|"
    r"melakukan|menyelenggarakan|tentang|berdasarkan|serta|melalui)\b"
)
TITLE_UNFINISHED = r"\b(?:Kepala|Badan|Dinas|UPT|UPTD|Sekolah|Bidang|Bagian|Seksi|Sub\s+Bagian|Kantor|Balai|Layanan|dan|serta)$"
SIGNER_ID_LINE = r"(?:NIP|Nip)\.?\s*[:.]?\s*[0-9 ]{12,}"
DEGREE = r"\bS\.(?:Pd|H|T|Si|Kom|E|Ag|Sos)\b|\bM\.(?:Pd|H|Si|T)\b"
NOT_A_NAME = r"pembina|golongan|nip"
SIGNER_ID_LABEL = r"(?:NIP|Nip)\.?\s*[:.]?\s*([0-9 ]{18,22})"
SIGNER_ID_ALONE = r"\b(19\d{6}|20\d{6})\s?([012]\d{5})\s?([12])\s?(\d{3})\b"
SIGNER_ID_HEALED = r"\b(19\d{2}|20\d{2})(0[1-9]|1[0-2])([0-2]\d|3[01])\s*(19\d{2}|20\d{2})(0[1-9]|1[0-2])\s*([12])\s*(\d{3})\b"
SUBJECT_LABEL = r"(?:Perihal|Hal|TENTANG)\s*[:.]?\s*([^\n\r]+(?:\n[^\n\r]+)?)"
SUBJECT_FALLBACKS = (
    (r"SURAT\s+PERNYATAAN", "Surat Pernyataan"),
    (r"KEPUTUSAN\s+KEPALA", "Keputusan Kepala Dinas / Pejabat"),
    (r"RASIO\s+PENGADUAN", "Rasio Pengaduan"),
    (r"SOSIALISASI\s+TIM", "Sosialisasi Tim Penggerak Genting"),
)
DATE_IN_TEXT = r"\b(\d{1,2}\s+(?:Januari|Februari|Maret|April|Mei|Juni|Juli|Agustus|September|Oktober|November|Desember)\s+\d{4})\b"

#: Flags and weights (hundredths) of the confidence score.
FLAGS = {
    "doc_number": "Missing or incomplete Nomor Surat", "agency": "Missing Instansi", "subject": "Missing Perihal",
    "letter_date": "Missing or invalid date", "signer_id": "NIP format suspicious",
}
WEIGHTS = {"doc_number": 30, "agency": 15, "subject": 15, "letter_date": 20, "signer_id": 15, "signer_id_suspicious": 8, "signer_id_absent": 5, "verification_url": 5}

#: Document types with their patterns and the fields that apply, in order of preference on ties.
DOC_TYPES = (
    ("peraturan", (r"peraturan\s+wali\s+kota", r"peraturan\s+daerah", r"peraturan\s+bupati", r"peraturan\s+menteri", r"lembaran\s+daerah"),
     ("doc_number", "agency", "subject", "letter_date", "verification_url")),
    ("keputusan", (r"keputusan\s+kepala", r"\bsurat\s+keputusan\b", r"\bsk\b", r"menimbang\s*:", r"mengingat\s*:"), FIELDS),
    ("surat_pernyataan", (r"surat\s+pernyataan", r"yang\s+bertanda\s+tangan\s+di\s+bawah\s+ini"), FIELDS),
    ("berita_acara", (r"berita\s+acara", r"risalah"),
     ("doc_number", "agency", "subject", "letter_date", "signer_name", "signer_id", "verification_url")),
    ("surat_dinas", (r"\bsurat\s+undangan\b", r"\bundangan\b", r"\bnota\s+dinas\b", r"\bpemberitahuan\b", r"\bsurat\s+tugas\b", r"^\s*hal\s*:", r"perihal\s*:"), FIELDS),
    ("anggaran", (r"dokumen\s+pelaksanaan\s+anggaran", r"rencana\s+kerja\s+dan\s+anggaran", r"\brkas\b", r"\brka\s+skpd\b", r"\bdpa\b", r"kode\s+rekening", r"belanja\s+modal", r"penerimaan\s+dan\s+belanja"),
     ("agency", "letter_date")),
    ("sop", (r"standar\s+operasional\s+prosedur", r"\bsop\b", r"standar\s+pelayanan", r"maklumat\s+pelayanan"), ("agency", "doc_number", "letter_date")),
    ("manual_book", (r"manual\s+book", r"\bmanual\b", r"petunjuk\s+(?:teknis|operasional)", r"buku\s+panduan", r"cara\s+penggunaan"), ("agency",)),
    ("laporan", (r"laporan\s+(?:hasil|akhir|kegiatan|monev|monitoring)", r"rekapitulasi", r"survei\s+kepuasan", r"\bskm\b", r"buku\s+tamu", r"daftar\s+hadir", r"notula", r"realisasi"),
     ("agency", "letter_date", "subject")),
    ("sertifikat", (r"sertifikat", r"piagam", r"penghargaan"), ("agency", "letter_date", "signer_name", "signer_title")),
    ("bukti_media", (r"\binstagram\b", r"\bfacebook\b", r"\bwhatsapp\b", r"tangkapan\s+layar", r"\blink\b", r"https?://", r"dokumentasi\s+kegiatan"), ("agency", "subject")),
    ("tidak_diketahui", (), ()),
)
UNKNOWN_TYPE, MEDIA_TYPE = "tidak_diketahui", "bukti_media"
IMAGE_SUFFIX = r"(?i)\.(png|jpg|jpeg|tif|tiff)$"
#: Types in the order in which people review them; others come last.
REVIEW_PRIORITY = ("surat_dinas", "keputusan", "peraturan", "surat_pernyataan", "sertifikat", "anggaran", "laporan", "manual_book", "bukti_media", "tidak_diketahui")

#: Region codes and the government-entity pattern.
HOME_NAME, HOME_REGION, OUTSIDE_REGION, UNKNOWN_REGION = "MAKASSAR", "kota_makassar", "luar_kota_makassar", "tidak_diketahui"
ENTITY = r"PEMERINTAH\s+(?:DAERAH\s+)?(KOTA|KABUPATEN|PEMKOT|PEMKAB)\s+([A-Z][A-Z\s]{2,24})"

#: Evidence tags and their keywords, the first match wins.
TAGS = (
    ("rkpd", ("rencana kerja pemerintah daerah", "rkpd")),
    ("dpa_rka", ("dokumen pelaksanaan anggaran", "rkas", "rencana kerja dan anggaran", "rka skpd")),
    ("regulasi", ("peraturan wali kota", "peraturan daerah", "perwali", "perda", "peraturan bupati")),
    ("sk_tim", ("tim inovasi", "susunan tim", "tim kerja", "tim efektif", "pembentukan tim")),
    ("sk_pelaksana", ("pelaksana operasional", "penetapan pelaksana")),
    ("skb_jejaring", ("keputusan bersama", "skb", "lintas dinas", "berita acara pemanfaatan")),
    ("pks_mou", ("perjanjian kerja sama", "naskah perjanjian", "nota kesepahaman", "memorandum", "mou")),
    ("replikasi", ("replikasi", "kaji tiru", "alih teknologi")),
    ("notula_bimtek", ("bimbingan teknis", "bimtek", "notula", "daftar hadir", "workshop", "fgd")),
    ("sop_sla", ("standar pelayanan", "standar operasional prosedur", "sla", "flowchart", "waktu penyelesaian")),
    ("sop_manual", ("manual book", "manual", "petunjuk teknis", "petunjuk operasional", "sop")),
    ("portal_informasi", ("layanan informasi", "portal", "website", "hotline")),
    ("rekap_pengaduan", ("pengaduan", "komplain", "sp4n", "lapor")),
    ("integrasi_sistem", ("integrasi", "interoperabilitas", "single sign", "sso", "rest api")),
    ("sosialisasi_media", ("sosialisasi", "undangan", "publikasi")),
    ("laporan_monev", ("monitoring dan evaluasi", "monev", "survei kepuasan", "skm")),
    ("rekap_penerima", ("buku tamu", "penerima manfaat", "register penerima", "jumlah pengguna")),
    ("milestone", ("milestone", "kronologi", "uji coba", "peluncuran")),
    ("rancang_bangun", ("rancang bangun", "proposal inovasi", "latar belakang masalah")),
)
SKIP_NAMES = ("logo", "ppt", "presentasi kelompok")
#: The highest score of indicators IND-01 to IND-19, and the mandatory ones.
INDICATOR_MAX = (9, 6, 6, 3, 6, 6, 3, 3, 3, 3, 3, 6, 3, 6, 9, 6, 6, 3, 6)
MANDATORY = (1, 2, 16, 17, 19)

#: Marks on the review sheet.
ABSENT_MARKS = ("-", "--", "tidak ada", "tidak_ada", "n/a", "na")
SAME_MARKS = ("=", "sama", "sama dengan mesin")
YES_MARKS = ("ya", "y", "yes", "1", "true")
