"""A made-up batch to try the engine on: texts of four documents and the true values of three."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

DEMO = {
    "KTP_A/ktp_tirta.jpg": ("PROVINSI JAWA BARAT", "KABUPATEN BEKASI", "NIK : 3216081203990007", "Nama : Tirta Wibawa", "Tempat/Tgl Lahir : BEKASI, 12-03-1999", "Jenis Kelamin : LAKI-LAKI", "Alamat : JL. KENARI NO. 4", "RT/RW 003/004", "Kecamatan : CIKARANG BARAT", "Berlaku Hingga : SEUMUR HIDUP"),
    "KK_A/kk_wulan.jpg": ("KARTU KELUARGA", "No KK : 5103061107150002", "Nama Kepala Keluarga : Wulan Pertiwi", "Alamat : JL. MAWAR 8", "RT/RW 001/002", "Desa/Kelurahan : KEROBOKAN KAJA", "Kecamatan : KUTA UTARA", "Kabupaten/Kota : BADUNG", "Provinsi : BALI", "Dinas Kependudukan Dan Pencatatan Sipil"),
    "SIM_A/sim_galih.jpg": ("SURAT IZIN MENGEMUDI", "POLRI", "1342-0907-000415", "Nama : Galih Permana", "Tempat/Tgl Lahir : JAKARTA, 09-07-1991", "Jenis Kelamin : LAKI-LAKI", "Golongan : B1", "Berlaku Hingga : 17-08-2030"),
    "LAIN/unknown_doc.jpg": ("SURAT KETERANGAN", "Dokumen tidak dikenal oleh sistem."),
}
TRUTH = (
    "nama_file,nama,nik,tempat_lahir,tanggal_lahir,jenis_kelamin,jenis_dokumen,nomor_kk,nama_kepala",
    "ktp_tirta.jpg,tirta_wibawa,3216081203990007,Bekasi,12-03-1999,LAKI-LAKI,ktp,,",
    "kk_wulan.jpg,,,,,,kk,5103061107150002,WULAN PERTIWI",
    "sim_galih.jpg,galih_permana,,Jakarta,09-07-1991,LAKI-LAKI,sim,,",
)


def demo_texts(spark: SparkSession) -> DataFrame:
    """``doc_id, path, label, psm, text`` with one variant for each document."""
    rows = [(i, path, "raw_gray", 6, "\n".join(lines)) for i, (path, lines) in enumerate(DEMO.items())]
    return spark.createDataFrame(rows, "doc_id bigint, path string, label string, psm int, text string")


def write_truth(root: str) -> str:
    """``ground_truth.csv`` below ``root``."""
    os.makedirs(root, exist_ok=True)
    path = os.path.join(root, "ground_truth.csv")
    with open(path, "w", encoding="utf-8") as f:
        f.write("\n".join(TRUTH) + "\n")
    return path
