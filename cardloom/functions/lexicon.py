"""Word lists, tables and patterns of the card domain."""

# Words that are never part of a person's name.
NAME_STOPWORDS = """
laki perempuan islam kristen hindu budha katolik protestan konghucu
wni wna kawin belum cerai pelajar mahasiswa pegawai swasta buruh
petani wiraswasta provinsi kabupaten kota kecamatan kelurahan desa
republik indonesia daerah istimewa nik nama alamat agama pekerjaan
golongan darah berlaku hingga hidup seumur status perkawinan
kewarganegaraan tempat lahir tanggal jenis kelamin rtrw rt rw
kel des kec no nomor kepala keluarga hubungan dalam pencatatan
sipil kependudukan dinas dikeluarkan yogyakarta jakarta bandung
surabaya medan bekasi depok tangerang bogor bali badung denpasar
sleman bantul klaten magelang semarang solo malang palembang
makassar balikpapan samarinda manado pontianak banjarmasin pekanbaru
jambi kp rawa banteng barat timur utara selatan jl jalan gg
gang lr lorong blok bl perum perumahan griya komplek kav
kavling ckr cikaret sei sungai komp metro jaya polda polri
driving licence license surat izin mengemudi sim kab mhs
""".split()

# Words of lines behind an identity number that hold no name.
NUMBER_STOPWORDS = """
kabupaten kota kecamatan kelurahan desa
pelajar mahasiswa status perkawinan pekerjaan
kewarganegaraan wni alamat darah berlaku
nama tempat lahir provinsi republik indonesia
""".split()

# Words of lines in capitals that hold no name.
CAPITAL_STOPWORDS = """
kabupaten kota kecamatan kelurahan desa provinsi
republik indonesia pelajar mahasiswa pekerjaan
perkawinan kewarganegaraan wni berlaku bekasi
jakarta bandung surabaya medan tangerang depok
bogor semarang karawang jawa barat timur
tengah selatan utara sulawesi sumatera kalimantan
""".split()

# Cities for the birth place, in the order in which they are tried.
CITIES = """
bekasi jakarta bandung surabaya medan tangerang
depok bogor semarang palembang makassar yogyakarta
solo malang denpasar manado balikpapan samarinda
pontianak banjarmasin pekanbaru jambi mataram ambon
jayapura ternate kupang kendari karawang cikarang
cimahi sukabumi tasikmalaya cirebon serang cilegon
magelang klaten kudus jember kediri blitar pasuruan
mojokerto probolinggo batu purwokerto tegal pekalongan
salatiga madiun tulungagung banyuwangi situbondo
""".split()

# Cities that raise the quality score of a text.
SCORE_CITIES = """
bekasi jakarta bandung surabaya medan tangerang
depok bogor semarang yogyakarta karawang cikarang
cimahi sukabumi tasikmalaya cirebon serang cilegon
solo malang denpasar palembang makassar balikpapan
samarinda pontianak banjarmasin pekanbaru mataram
""".split()

# Keywords that raise the quality score of a text.
KEYWORDS = """
nama nik alamat lahir pekerjaan kewarganegaraan
kawin berlaku kecamatan kelurahan kabupaten provinsi
kartu keluarga surat ijin izin mengemudi indonesia
driving licence wanita laki
""".split()

# Letters that OCR puts in place of digits, (from, to) for each field.
NIK_DIGITS = ("OolLIisSbBzZGgAaDd", "001111558822660044")
KK_DIGITS = ("OolLIisSbBzZGgAaDdYyPpFfCcUuVv?", "0011115588226600004499000000007")
SIM_DIGITS = ("OolLIisSbBzZ", "001111558822")
RTRW_DIGITS = ("OolLIisSaA", "0011115500")
WORD_DIGITS = ("LlIiOoDZzSsbGB?A", "1111000225566874")

# Patterns over upper-case text that tell the kind of card.
KK_PATTERNS = (
    r"KARTU\s+KELUARGA",
    r"NAMA\s+KEPALA\s+KELUARGA",
    r"KEPALA\s+KELUARGA",
    r"NO\s*[\.\:]?\s*KK\b",
    r"NOMOR\s+KK",
    r"STATUS\s+HUBUNGAN",
    r"HUBUNGAN\s+DALAM\s+KELUARGA",
    r"HUBUNGAN\s+KELUARGA",
    r"PENCATATAN\s+SIPIL",
    r"DINAS\s+KEPENDUDUKAN",
)
SIM_PATTERNS = (
    r"SURAT\s+I[ZJ]IN\s+MENGEMU",
    r"I[ZJ]IN\s+MENGEMU",
    r"SURAT\s+I[ZJ]IN",
    r"SURAT\s+[IJ]IN",
    r"MENGEMU[N]?[DO][I1]?",
    r"GOLONGAN\s+[ABC]",
    r"POLR[I1]",
    r"DRIVING\s+LICEN[SC]E?",
    r"DRIVING",
    r"SIM\s+[ABC]\b",
)
KTP_PATTERNS = (
    r"\bN\s*[I1]\s*K\b",
    r"PROV[I1]NS[I1]",
    r"TANDA\s+PENDUDUK",
    r"KARTU\s+TANDA",
    r"\bKTP\b",
    r"REPUBLIK\s+INDONESIA",
    r"JENIS\s+KELAMIN",
    r"GOL\s*[.\s]*DARAH",
    r"BERLAKU\s+HINGGA",
    r"KECAMATAN",
    r"KELURAHAN",
    r"KABUPATEN",
    r"SEUMUR\s+HIDUP",
)

# Fields that a card of each kind should have, seconds of manual work, file kinds and folders.
RELEVANT_FIELDS = {
    "ktp": ("nama", "nik", "tempat_lahir", "tanggal_lahir", "jenis_kelamin", "alamat"),
    "kk": ("nomor_kk", "nama_kepala", "desa_kelurahan", "kecamatan", "kabupaten_kota", "provinsi", "rtrw", "alamat"),
    "sim": ("no_sim", "nama", "tanggal_lahir", "alamat"),
}
MANUAL_SECONDS = {"ktp": 82, "kk": 78, "sim": 74, "unknown": 78}
MANUAL_SECONDS_DEFAULT = 40
IMAGE_EXTENSIONS = (".jpg", ".jpeg", ".png", ".bmp", ".tiff", ".tif")
SKIPPED_FOLDERS = ("KTP", "KK", "SIM", "ERROR", "logs", "metadata")
FILE_NAME = r"^(ktp|kk|sim)_[a-z][a-z0-9_]{1,99}\.(jpg|jpeg|png|bmp|tiff|tif)$"
TEMPLATE_VARIABLES = """
jenis JENIS nama NAMA nik nik6 tgl tgl_compact
tempat jk tanggal timestamp
nokk nokk6 kepala KEPALA desa kecamatan kabupaten provinsi rtrw
""".split()
EVALUATED_FIELDS = """
nama nik tempat_lahir tanggal_lahir jenis_kelamin jenis_dokumen alamat nomor_kk nama_kepala
desa_kelurahan kecamatan kabupaten_kota provinsi rtrw no_sim
""".split()


# Letters in fused RT/RW numbers; other letters go.
RTRW_FUSED = ("OolLIiSsUuGgtT", "00111155000011")

# Patterns of header fields on family cards, tried in order.
HEADER_PATTERNS = {
    "desa_kelurahan": (
        r"Desa\s*/\s*Kelurahan\s*[:\-=.\s]\s*([A-Za-z][A-Za-z\s]{2,30}?)(?=\s+(?:Kec|Kab|Prov|No\b)|[\n$])",
        r"Desa\s*/\s*Ke[lt]urahan\s*[:\-=1.]\s*([A-Za-z][A-Za-z\s]{2,25}?)(?=\s+(?:Kec|Kab|Prov)|\n|$)",
        r"Dexa\s*/\s*Kelurahan\s*[:\-—.]?\s*([A-Za-z][A-Za-z\s]{2,25}?)(?=\s+(?:Kec|Kab)|\n|$)",
        r"Desaf?kelurahan\s*[:\-—#.]?\s*([A-Za-z][A-Za-z]{2,20})",
        r"(?:Gesal[A-Za-z]{3,12}|Desalk[A-Za-z]{2,10})\s*[.\s,]*\s+([A-Z][A-Za-z\s]{2,25}?)(?=\n|$|\s+(?:Kec|Kab))",
        r"(?<![A-Za-z])DESA\s+([A-Z][A-Za-z]{2,20}(?:\s+[A-Z][A-Za-z]{2,20})?)(?=\n|$|\s+(?:Kec|Kab|Prov))",
    ),
    "kecamatan": (
        r"Kecamatan\s*[:\-=.]?\s*([A-Za-z][A-Za-z\s]{2,30}?)(?=\s+(?:Kab|Kota|Prov)|[\n$])",
        r"Kecamatan\s*[:\-=.]?\s*1?\s*([A-Za-z][A-Za-z\s]{2,25}?)(?=\s+(?:Kab|Kota)|\n|$)",
        r"Kecarnatan\s*([A-Za-z][A-Za-z\s]{2,25}?)(?=\s+(?:Kab|Kota)|\n|$)",
        r"(?<![A-Za-z])Kec\b\.?\s*[:\-.]?\s*([A-Za-z][A-Za-z\s]{2,25}?)(?=\s+(?:Kab|Kota)|\n|$)",
        r"(?<![A-Za-z])KEC\.?\s+([A-Za-z][A-Za-z\s]{2,25}?)(?=\n|$|\s+(?:Kab|Kota|Prov))",
    ),
    "kabupaten_kota": (
        r"Kabupaten\s*/?\s*Kota\s*[:\-=.]?\s*([A-Za-z][A-Za-z\s]{2,25}?)(?=\n|$|\s+Prov)",
        r"Kabupaten\s*/?\s*Kota\s*:\s*([A-Za-z][A-Za-z\s]{2,25}?)(?=\n|$|\s+Prov)",
        r"Kabupaton\s*/?\s*Kota\s*([A-Za-z][A-Za-z\s]{2,20}?)(?=\n|$|\s+Prov)",
        r"Kab\.?\s*/?\s*Kota\s*[:\-.]?\s*([A-Za-z][A-Za-z\s]{2,20}?)(?=\n|$|\s+Prov)",
        r"Kabupaten\s*[:\-.]?\s*([A-Za-z][A-Za-z\s]{2,25}?)(?=\n|$|\s+Prov)",
        r"(?<![A-Za-z])KAB\.?\s+([A-Za-z][A-Za-z\s]{2,25}?)(?=\n|$|\s+(?:Prov|Kode))",
    ),
    "provinsi": (
        r"[Pp]rovinsi\s*[:\-=.1]?\s*\d?([A-Za-z][A-Za-z\s]{2,30}?)(?=\s*(?:No\.?\s*\d|Jenis|Nama\s+Lengkap|$)|\n)",
        r"Provins[il]\s*[:\-=.]?\s*\d?([A-Za-z][A-Za-z\s]{2,25}?)(?=\n|$)",
        r"Prov\.\s*[:\-.]?\s*\d?([A-Za-z][A-Za-z\s]{2,25}?)(?=\n|$)",
        r"(?:Ansi|Anis|Provins)\s*[.:\-]?\s*([A-Za-z][A-Za-z\s]{3,30}?)(?=\n|$)",
    ),
}
# Words that are labels and never part of a header field.
HEADER_STOP = "KECAMATAN KABUPATEN KOTA PROVINSI DESA KELURAHAN RT RW RTRW ALAMAT NO NOMOR JENIS GOLONGAN NAMA PEKERJAAN".split()

# The number of a family card behind a label, on a line of its own, and without a label; lines that hold other numbers.
FAMILY_NUMBER_LABELLED = r"(?:NOMOR\s+KK|No\.?\s*KK|N[o0]\.\s*KK)\s*[:\-]?\s*([0-9A-Za-z?][0-9A-Za-z?\s]{10,28})(?:\n|$|[^0-9A-Za-z?\s])"
FAMILY_NUMBER_LINE = r"^N[o0u][a\.\-]?\s*[:\-]?\s*"
FAMILY_NUMBER_VALUE = r"([?#*@!~\^$]{0,2}[0-9][0-9A-Za-z?\s]{11,26})$"
FAMILY_NUMBER_FREE = r"(?<![A-Za-z0-9])[?#*]{0,2}[1-9][0-9A-Za-z?]{13,17}(?![A-Za-z0-9])"
OTHER_NUMBER_LINE = r"\b(?:NIK|Nomor\s+Induk|Tempat|Lahir|Berlaku|Kecamatan|Kelurahan|Provinsi|Kabupaten|Golongan|Status|Pekerjaan|Kewarganegaraan)\b"

# Readings of the label of a family's head, first and second word.
HEAD_FIRST = """
Kepala Kopala Kopata Kodata Kopaia Kofata Kapala Kapata Kopat
Nara\\s+Kapala SEK\\s+Namis Kopsia Kofuarya Kopat
""".split()
HEAD_SECOND = """
Keluarga Kotarga Kofuarga Kovarya Kovarga Kelinrgai Kekiarya
Kotinga Ketiarga Kelirga Kolatoa Koturga Koluarga Kaliarga
Kotlarga Kairon Karol Kainon Karya Kairga Kolarga
""".split()
# Misread labels that stand on a line above the name.
HEAD_NOISE = """
Kopata Kodata Kopaia Kofata Kapala Kopala Kapata Kopsia
Koturga Kotinga Kelunga Kotarga Kofuarga Kovarya Kovarga
Kelinrgai Kekiarya Koluarga Kaliarga Kotlarga Kolatoa Ketiarga
Kelirga Nara\\s+Kapala SEK\\s+Namis Direnfaturaban
""".split()
# Words that a head's name never has: labels, places and misread labels.
HEAD_SKIP = """
desa desm kelurahan kecamatan kabupaten kota
desafkelurahan desmkolurehan no nomor
desnfaturahan desn padanaan padanman
""".split()
HEAD_PLACES = """
mekarwangi cikarang barat timur bekasi jakarta bandung
kelurahan kecamatan kabupaten provinsi jawa keluarga
kartu desa no nomor rt rw surabaya medan
tangerang depok bogor karawang
kopata kodata kopaia kofata kapala kopala kapata
kopsia koturga kotinga kelunga kotarga kofuarga
kovarya kovarga kelinrgai kekiarya koluarga kaliarga
kotlarga kolatoa ketiarga kelirga kopat kairon
direnfaturaban desafkelurahan desmkolurehan
kecam kelur kabup provin miahan sioaraua sidarua
sidaraia buana karol kainon padanaan padanman
sumedang paseh
gesalkarang gesalkeuran gesalkeluran desalkeluran
gesalk desalk keuran keluran
maju sejahtera bangun makmur mandiri sentosa
""".split()
# Words in capitals that a line with a head's name has not, and more of them below a misread label.
HEAD_CAPITALS = """
KELUARGA KARTU ARTU PROVINSI JAWA BARAT
TIMUR SELATAN UTARA TENGAH PEMERINTAH REPUBLIK
INDONESIA DIRENFATURABAN DESAFKELURAHAN DESMKOLUREHAN
KOPATA KODATA KOPAIA KOFATA KAPALA KOPALA KAPATA
KOPSIA KOTURGA KOTINGA KELUNGA KOTARGA KOLATOA
""".split()
HEAD_BELOW = """
DUSUN DSN DSUN JALAN GANG BLOK PERUM KOMP KOMPLEK
GRIYA PERUMAHAN KAVLING KAV KAMPUNG KP SIOARAUA
KOFUARGA KOVARYA KOVARGA KELINRGAI KEKIARYA KOLUARGA KALIARGA
KOTLARGA KETIARGA KELIRGA MAAN
""".split()
