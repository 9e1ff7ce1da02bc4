"""Golden values of scalar functions, and the demo documents from text to record."""

import pytest
from pyspark.sql import functions as F

from cardloom.functions import addresses as ax
from cardloom.functions import family
from cardloom.functions import fields as fx
from cardloom.functions import names as nx
from cardloom.functions import text as tx
from cardloom.operators import evaluate, naming, records, vote
from cardloom.sources import files, sinks

DEMO = {
    "ktp_tirta": "PROVINSI JAWA BARAT\nKABUPATEN BEKASI\nNIK : 3216081203990007\nNama : Tirta Wibawa\nTempat/Tgl Lahir : BEKASI, 12-03-1999\nJenis Kelamin : LAKI-LAKI\nAlamat : JL. MERDEKA NO. 1 RT 001/002\nKecamatan : CIKARANG BARAT\nBerlaku Hingga : SEUMUR HIDUP",
    "kk_ayu": "KARTU KELUARGA\nNo KK : 5103060512010001\nNama Kepala Keluarga : Ayu Pertiwi Kumalasari\nDesa/Kelurahan : KEROBOKAN KAJA\nKecamatan : KUTA UTARA\nKabupaten/Kota : BADUNG\nStatus Hubungan Dalam Keluarga\nDinas Kependudukan Dan Pencatatan Sipil",
    "sim_budi": "SURAT IZIN MENGEMUDI\nPOLRI\nNama : Budi Santoso\nTempat/Tgl Lahir : JAKARTA, 10-06-1990\nJenis Kelamin : LAKI-LAKI\nGolongan : B1\nBerlaku Hingga : 17-08-2030",
    "unknown_doc": "SURAT KETERANGAN\nDokumen tidak dikenal oleh sistem.\nFile ini akan masuk ke folder ERROR/.",
}


def values(spark, inputs, function):
    """Results of a Column function, in order of the inputs."""
    rows = spark.createDataFrame(list(enumerate(inputs)), "i int, x string").select("i", function(F.col("x")).alias("y")).collect()
    return [r.y for r in sorted(rows)]


@pytest.mark.parametrize(
    ("function", "pairs"),
    [
        (fx.nik, {"NIK : 3216O812O399OOO7": "3216081203990007", "no number": ""}),
        (tx.normalize_city, {"PATENBEKASI": "BEKASI", "SHEKASI": "BEKASI", "Paris": "PARIS"}),
        (tx.normalize_date, {"1/2/2003": "01-02-2003", "1 2 2003": "01-02-2003"}),
        (tx.normalize_for_compare, {"12/03/1999": "12-03-1999", "LAKI-LAKI": "laki-laki", "tirta_wibawa": "tirtawibawa"}),
        (tx.clean_name, {"Nama : Budi Santoso": "budi_santoso", "": ""}),
        (tx.is_plausible_name, {"dan": False, "kp_rawa_banteng": False, "budi_santoso": True}),
        (fx.rt_rw, {"RT.045/RW.011": "045/011", "RTRW 0451011": "045/011"}),
        (family.to_16_digits, {"321608120399000": "3216081203990000", "32160812039900": "32160812039900", "3216081203990": "", "03216081203990": ""}),
    ],
)
def test_golden(spark, function, pairs):
    assert values(spark, pairs, function) == list(pairs.values())


@pytest.mark.parametrize(
    ("function", "pairs"),
    [
        (
            nx.name_after_number,
            {
                "3216081203990007\n::: 12 -- 9\nPROVINSI BALI\nTIRTA WIBAWA": "tirta_wibawa",
                "NIK\n1\n2\n3\n4\nBudi Santoso": "budi_santoso",
                "NIK\n1\n2\n3\n4\n5\nBudi Santoso": "",
                "Budi Santoso\n3216081203990007": "",
                "": "",
            },
        ),
        (nx.name_in_capitals, {'\"TIRTA WIBAWA\nx': "tirta_wibawa", "Tirta Wibawa": "", "JAWA BARAT\nBUDI SANTOSO 1": "", "x\n" * 15 + "TIRTA WIBAWA": ""}),
        (
            nx.name_on_licence,
            {"1223-0301-000680\n12 - 3\nTIRTA WIBAWA": "tirta_wibawa", "x\n1. SRI REJEKI": "sri_rejeki", "POLRI\n2. Foo Barita\nBudi Santoso": "budi_santoso", "Budi Santoso": ""},
        ),
        (ax.clean_licence_address, {"4. JL. MERDEKA NO.54": "JL. MERDEKA NO.54", "5) KP RAWA | BANTENG 12": "KP RAWA BANTENG", "JALAN ANU XX": "JALAN ANU"}),
        (ax.licence_address_below_gender, {"PRIA\nKP RAWA BANTENG\nRT.05/01 CKR BARAT\nKAB. BEKASI": "KP RAWA BANTENG RT.05/01 CKR BARAT", "WANITA\nKAB. BEKASI\nJL ANU": "", "JL ANU": ""}),
        (ax.licence_address_elsewhere, {"4. JL. MERDEKA NO.54\n5. RT.001/RW.004 DESA KEDIRI": "JL. MERDEKA NO.54 RT.001/RW.004 DESA KEDIRI", "x\nKP RAWA\nBLOK A5": "KP RAWA BLOK A5", "POLDA JL": ""}),
        (ax.family_address, {"Alamat : PERUM GRIYA 5 Kecamatan X": "PERUM GRIYA 5", "Alamat\nJL. ANU*1": "JL. ANU 1", "Alamat : abc": "", "a\nDSN MAWAR": "DSN MAWAR", "": ""}),
    ],
)
def test_unlabelled_values(spark, function, pairs):
    assert values(spark, pairs, function) == list(pairs.values())


def test_licence_address_of_later_variants(spark):
    """The first variant has none below a gender, so its numbered line counts; later ones only add what is below a gender."""
    head = "SURAT IZIN MENGEMUDI\nPOLRI\nGOLONGAN A\n"
    rows = [(1, 1, head + "4. JL. SATU", "sim"), (1, 2, head + "4. JL. DUA", "sim"), (1, 3, head + "PRIA\nJL. TIGA LIMA", "sim")]
    found = records.candidates(spark.createDataFrame(rows, "doc_id long, ord long, text string, kind string"))
    addresses = found.where("field = 'alamat_sim'").orderBy("ord").select("value", "weight").collect()
    assert [tuple(r) for r in addresses] == [("JL. SATU", 1), ("JL. TIGA LIMA", 1)]
    assert records.settle(found).first().alamat_sim == "JL. SATU"


@pytest.mark.parametrize(
    ("function", "pairs"),
    [
        (
            family.family_number,
            {
                "NOMOR KK: 51O3O6O5l2OlOOO4\nx": "5103060512010004",
                "No. 5103060512010004": "5103060512010004",
                "No.\n?2140120212753\n": "72140120212753",
                "x\n5103060512010004 y": "5103060512010004",
                "NIK 5103060512010004": "",
                "5103060512010004 5103060512010005 5103060512010005": "5103060512010005",
                "No KK : 5103060512010004\nx 5103060512010005": "5103060512010004",
            },
        ),
        (family.head_behind_label, {"Nama Kepala Keluarga : Tirta Wibawa / Desa X": "TIRTA WIBAWA", "Kopata Kotinga\nGunadarma": "GUNADARMA", "Kepala Keluarga\nNo 12": "", "": ""}),
        (family.head_below_number, {"No. 3216081203990007\n\nTIRTA WIBAWA Desa X": "TIRTA WIBAWA", "TIRTA WIBAWA\nNo. 3216081203990007": "", "No. 3216\nJAWA BARAT\nTIRTA WIBAWA: x": "TIRTA WIBAWA"}),
        (family.head_in_capitals, {"KARTU KELUARGA\nTirta Wibawa": "TIRTA WIBAWA", "tirta wibawa": "", "Tirta Wibawa 1": ""}),
        (family.head_below_noise, {"Kopata Kelunga\nxx 12\nGunadarma": "GUNADARMA", "x\nGunadarma": ""}),
        (family.head_in_table, {"1. TIRTA WIBAWA 3216081203990007 L KEPALA KELUARGA": "TIRTA WIBAWA", "2 TIRTA WIBAWA KEPALA KELUARGA": ""}),
        (family.head_from_header, {"Nama Kepala Keluarga : Tirta Wibawa": "tirta_wibawa", "x": ""}),
        (fx.rt_rw, {"RTRW\n045011": "045/011", "005/001 Kabupaten X": "005/001", "00SI0U1 Kabupaten": "005/001", "RTRW : 04": "", "005/001": ""}),
        (fx.birth_place, {"BEKASI, 12.03.1999": "Bekasi", "JAKARTA A, 12-03-1999": "Jakarta", "JAKARTA-12-03\nx\n1999": "Jakarta", "JAKARTA-12-03\nx": ""}),
        (
            fx.address,
            {
                "Alamat : JL A\nRT 1\nAlamat : JL B": "JL A",
                "Alamat\nJL SATU\nBLOK DUA\nNO TIGA\nX": "JL SATU BLOK DUA NO TIGA",
                'Alamat "Jl.Mawar': "Jl.Mawar",
                "Alamat : A1\n\nB2\nC3": "A1 B2 C3",
                "LAMAT : X": "",
                "MAMAT * KP RAWA\nKECAMATAN X": "KP RAWA KECAMATAN X",
            },
        ),
        (fx.licence_number, {"12230301000680": "1223-0301-000680", "No. SIM : 122303010006": "1223-0301-0006", "No. SIM : 12": ""}),
        (fx.name_from_label, {"NAMA 12 : \nNama Tirta Wibawa": "tirta_wibawa", "Nama : Tirta": "tirta", "Nama Tirta : 1": "tirta"}),
    ],
)
def test_ways_without_clean_labels(spark, function, pairs):
    assert values(spark, pairs, function) == list(pairs.values())


@pytest.mark.parametrize(
    ("field", "pairs"),
    [
        ("desa_kelurahan", {"Dexa/Kelurahan: KUTA\n": "KUTA", "Gesalkeuran  KUTA RAYA\n": "KUTA RAYA", "DESA SUKAMAJU": "SUKAMAJU", "Desafkelurahan # KUTA": "KUTA"}),
        ("kecamatan", {"Kec. KUTA UTARA\n": "KUTA UTARA", "KEC KUTA Kab X": "KUTA", "Kecarnatan KUTA\n": "KUTA"}),
        ("kabupaten_kota", {"Kabupaton/Kota BADUNG": "BADUNG", "KAB. BADUNG Prov": "BADUNG", "Kab/Kota : BADUNG": "BADUNG"}),
        ("provinsi", {"Provinsl : BALI": "BALI", "Ansi . JAWA BARAT\n": "JAWA BARAT", "Prov. 3JAWA BARAT": "JAWA BARAT"}),
    ],
)
def test_header_patterns(spark, field, pairs):
    assert values(spark, pairs, lambda x: fx.header_field(x, field)) == list(pairs.values())


def test_demo_scores(spark):
    assert values(spark, DEMO.values(), tx.quality_score) == [168, 86, 130, 35]


def test_demo_records(spark):
    texts = spark.createDataFrame([(i, "raw", 6, t) for i, t in enumerate(DEMO.values())] + [(9, "raw", 6, None)], "doc_id long, label string, psm int, text string")
    ktp, kk, sim, other, empty = sorted(records.build_records(texts).collect())
    assert (ktp.jenis_dokumen, ktp.status, ktp.nama, ktp.nik, ktp.tempat_lahir, ktp.tanggal_lahir, ktp.jenis_kelamin) == ("ktp", "VALID", "tirta_wibawa", "3216081203990007", "Bekasi", "12-03-1999", "LAKI-LAKI")
    assert ktp.alamat == "JL. MERDEKA NO. 1 RT 001/002 Kecamatan : CIKARANG BARAT"
    assert (kk.jenis_dokumen, kk.nama, kk.nomor_kk, kk.desa_kelurahan, kk.kecamatan, kk.kabupaten_kota, kk.provinsi) == ("kk", "AYU PERTIWI KUMALASARI", "5103060512010001", "KEROBOKAN KAJA", "KUTA UTARA", "BADUNG", "")
    assert (kk.fields_filled, kk.fields_total, kk.field_completeness) == (5, 8, 0.62)
    assert (sim.jenis_dokumen, sim.nama, sim.tempat_lahir, sim.tanggal_lahir, sim.no_sim, sim.field_completeness) == ("sim", "budi_santoso", "Jakarta", "10-06-1990", "", 0.75)
    assert (other.jenis_dokumen, other.status) == (empty.jenis_dokumen, empty.status) == ("unknown", "ERROR")


def test_vote_ties_go_to_the_first(spark):
    rows = spark.createDataFrame([(1, "b", 0), (1, "a", 1), (1, "a", 2), (1, "b", 3), (2, "", 0)], "doc_id long, v string, ord long")
    assert [tuple(r) for r in vote.vote(rows, "doc_id", "v", "ord").collect()] == [(1, "b", 2)]


def test_templates(spark):
    assert naming.validate_template("{jenis}_{nope}") == ["nope"]
    with pytest.raises(ValueError, match="empty"):
        naming.validate_template(" ")
    rows = spark.createDataFrame([("ktp", "Budi  Santoso", "a.JPG", "s"), ("ktp", "budi santoso", "b.jpg", "s"), ("unknown", "", "c.PNG", "s")], "jenis_dokumen string, nama string, nama_file_asli string, subfolder string")
    for c in ("nik", "tempat_lahir", "tanggal_lahir", "jenis_kelamin", "nomor_kk", "nama_kepala", "desa_kelurahan", "kecamatan", "kabupaten_kota", "provinsi", "rtrw"):
        rows = rows.withColumn(c, F.lit(""))
    paths = [r.path for r in naming.suffix_duplicates(naming.plan_paths(rows), "nama_file_asli").orderBy("nama_file_asli").collect()]
    assert paths == ["KTP/ktp_budi_santoso/ktp_budi_santoso.jpg", "KTP/ktp_budi_santoso/ktp_budi_santoso_1.jpg", "ERROR/s/c.PNG"]


def test_truth_file(spark, tmp_path):
    (tmp_path / "t.csv").write_text("﻿Nama_File, kepala_keluarga\na.jpg, X \na.jpg,Y\n,Z\n", encoding="utf-8")
    assert [tuple(r) for r in files.read_truth(spark, str(tmp_path / "t.csv")).select("nama_file", "nama_kepala").collect()] == [("a.jpg", "Y")]
    (tmp_path / "u.csv").write_text("x\n1\n")
    with pytest.raises(ValueError, match="nama_file"):
        files.read_truth(spark, str(tmp_path / "u.csv"))


def test_scan_and_recognise(spark, tmp_path):
    for name in ("a/x.JPG", "KTP/y.jpg", "a/z.txt"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(b"pixels")
    found = files.scan_images(spark, str(tmp_path))
    assert [r.path.rsplit("/", 2)[1:] for r in found.select("path").collect()] == [["a", "x.JPG"]]
    rows = files.recognise(found, lambda content, mode: f"{len(content)} {mode}").collect()
    assert sorted(r.text for r in rows) == ["6 11", "6 3", "6 6"]


def test_sinks(spark, tmp_path):
    from cardloom.plans import cards

    rows = evaluate.completeness(cards.records(spark, "/root/testdata/sf0.001"))
    sinks.export(rows, str(tmp_path), "both")
    assert spark.read.json(str(tmp_path / "summary")).count() == rows.count()
    assert spark.read.csv(str(tmp_path / "hasil_ocr"), header=True).columns == sinks.FLAT_COLUMNS
    matched = evaluate.match_truth(cards.truth(spark, "/root/testdata/sf0.001"), rows)
    page = sinks.report(rows, evaluate.field_scores(matched))
    assert "MACRO AVERAGE" in page and "<script" not in page
    assert sinks.violations(rows).count() > 0
    sinks.export(rows.limit(0), str(tmp_path / "none"))
    assert not (tmp_path / "none").exists()


def test_orientation_needs_a_margin(spark):
    rows = spark.createDataFrame([(1, 0, 100), (1, 90, 129), (2, 0, 100), (2, 180, 116), (3, 0, 10), (3, 90, 10)], "doc long, angle int, score int")
    assert {r.doc: r.angle for r in vote.pick_orientation(rows, "doc").collect()} == {1: 0, 2: 180, 3: 0}
