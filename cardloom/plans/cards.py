"""Made-up cards over the ``customer`` table, as SQL that Spark and DuckDB both run.

Five text variants per card, with look-alike letters and wrong digits in some, so that votes have ties and disagreement.  ``{variants}``
is the one place where the engines' SQL differs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

CARDS = """
SELECT doc_id, CAST(variant AS BIGINT) AS variant, truth, CASE truth
  WHEN 'ktp' THEN CASE WHEN doc_id % 3 = 0 THEN 'PROVINSI JAWA BARAT' || chr(10) || 'NIK : ' || n || chr(10) || nm || chr(10) || 'SH' || upper(city) || '. ' || replace(born, '-', '.') || chr(10) || 'Jenis Kelamin : ' || jk || chr(10)
      || 'Alamat "Jl.Merdeka No ' || CAST(doc_id % 90 AS STRING) || chr(10) || chr(10) || 'BLOK A' || chr(10) || 'GANG DUA' || chr(10) || 'KECAMATAN X' || chr(10) || 'Berlaku Hingga'
    WHEN doc_id % 3 = 1 THEN 'PROVINSI JAWA BARAT' || chr(10) || 'NIK : ' || n || chr(10) || 'NAMA ' || nm || chr(10) || upper(city) || '-' || substr(born, 1, 5) || chr(10) || 'x' || chr(10) || substr(born, 7, 4) || chr(10) || 'MAMAT : JL A' || chr(10) || 'RT 1' || chr(10) || 'Alamat : JL B'
    ELSE 'PROVINSI JAWA BARAT' || chr(10) || 'KABUPATEN ' || upper(city) || chr(10) || 'NIK : ' || n || chr(10) || 'Nama : ' || nm || chr(10)
    || 'Tempat/Tgl Lahir : ' || upper(city) || ', ' || born || chr(10) || 'Jenis Kelamin : ' || jk || chr(10)
    || 'Alamat : JL. MERDEKA NO. ' || CAST(doc_id % 90 AS STRING) || chr(10) || 'RT/RW 001/002' || chr(10) || 'Kecamatan : CIKARANG BARAT' || chr(10) || 'Berlaku Hingga : SEUMUR HIDUP' END
  WHEN 'kk' THEN CASE doc_id % 16 WHEN 4 THEN 'KARTU KELUARGA' || chr(10) || 'No.' || chr(10) || n || chr(10) || 'Kopata Kotinga' || chr(10) || nm || chr(10) || 'DESA KEROBOKAN' || chr(10) || 'KEC KUTA UTARA' || chr(10)
      || 'KAB. ' || upper(city) || chr(10) || 'Provinsl : BALI' || chr(10) || '0' || CAST(doc_id % 9 + 1 AS STRING) || '1/0O2 Kabupaten' || chr(10) || 'Dinas Kependudukan Dan Pencatatan Sipil'
    WHEN 8 THEN 'KARTU KELUARGA' || chr(10) || n || chr(10) || 'Dexa/Kelurahan : KEROBOKAN' || chr(10) || 'Kec. KUTA' || chr(10) || 'Kabupaton/Kota ' || upper(city) || chr(10) || 'Ansi : JAWA BARAT' || chr(10)
      || '00SI0U1 Kecamatan' || chr(10) || '1. ' || upper(nm) || ' 3216082501030001 L BEKASI ISLAM KEPALA KELUARGA'
    WHEN 12 THEN 'KARTU KELUARGA' || chr(10) || 'No.' || n || chr(10) || upper(nm) || ' Desa X' || chr(10) || 'RT.045/RW.01' || CAST(doc_id % 9 AS STRING) || chr(10) || 'Gesalkeuran KEROBOKAN KAJA' || chr(10) || 'Kecarnatan KUTA' || chr(10)
      || 'Kab/Kota : ' || upper(city) || chr(10) || 'Prov. 3BALI' || chr(10) || 'Status Hubungan Dalam Keluarga'
    ELSE 'KARTU KELUARGA' || chr(10) || 'No KK : ' || n || chr(10) || 'Nama Kepala Keluarga : ' || nm || chr(10) || 'RTRW : 04' || CAST(doc_id % 9 + 1 AS STRING) || '1011' || chr(10)
    || 'Desa/Kelurahan : KEROBOKAN KAJA' || chr(10) || 'Kecamatan : KUTA UTARA' || chr(10) || 'Kabupaten/Kota : ' || upper(city) || chr(10) || 'Provinsi : BALI' || chr(10) || 'Dinas Kependudukan Dan Pencatatan Sipil' END
  WHEN 'sim' THEN 'SURAT IZIN MENGEMUDI' || chr(10) || 'POLRI' || chr(10) || CASE doc_id % 3 WHEN 0 THEN substr(n, 1, 14) WHEN 1 THEN 'No. SIM : ' || substr(n, 1, 12) ELSE substr(n, 1, 4) || '-' || substr(n, 5, 4) || '-' || substr(n, 9, 6) END || chr(10) || 'Nama : ' || nm || chr(10)
    || 'Tempat/Tgl Lahir : S' || upper(city) || ', ' || born || chr(10) || 'Jenis Kelamin : ' || jk || chr(10) || 'Golongan : B1'
  ELSE 'SURAT KETERANGAN' || chr(10) || 'Dokumen tidak dikenal oleh sistem.' END AS text
FROM (
  SELECT *, CASE WHEN (doc_id + variant) % 5 = 0 THEN substr(number, 1, 15) || CAST(variant AS STRING) WHEN (doc_id + variant) % 3 = 0 THEN translate(number, '015', 'OIS') ELSE number END AS n,
    CASE WHEN (doc_id * 3 + variant) % 4 = 0 THEN name || ' Putra' WHEN (doc_id + variant) % 7 = 0 THEN 'Xx' ELSE name END AS nm,
    CASE doc_id % 4 WHEN 0 THEN 'kk' WHEN 1 THEN 'ktp' WHEN 2 THEN 'sim' ELSE 'unknown' END AS truth
  FROM (
    SELECT c_custkey AS doc_id, {variants} AS variant, '3216' || lpad(CAST((c_custkey * 7919) % 999999999999 AS STRING), 12, '0') AS number,
      CASE c_custkey % 7 WHEN 0 THEN 'Budi Santoso' WHEN 1 THEN 'Sri Rejeki' WHEN 2 THEN 'Tirta Wibawa' WHEN 3 THEN 'Rina' WHEN 4 THEN 'Agus Salim Wijaya' WHEN 5 THEN 'Dewi Lestari' ELSE 'Hendra Gunawan' END AS name,
      CASE c_custkey % 5 WHEN 0 THEN 'Bekasi' WHEN 1 THEN 'Jakarta' WHEN 2 THEN 'Denpasar' WHEN 3 THEN 'Solo' ELSE 'Nowhere' END AS city,
      lpad(CAST(c_custkey % 28 + 1 AS STRING), 2, '0') || '-' || lpad(CAST(c_custkey % 12 + 1 AS STRING), 2, '0') || '-' || CAST(1950 + c_custkey % 50 AS STRING) AS born,
      CASE WHEN c_custkey % 2 = 0 THEN 'LAKI-LAKI' ELSE 'PEREMPUAN' END AS jk
    FROM customer
  ) a
) b
"""

#: Records as a batch leaves them, and true values for some of them.
RECORDS = """
SELECT c_custkey AS doc_id, '/in/' || substr(c_mktsegment, 1, 4) || '/img_' || CAST(c_custkey AS STRING) || '.JPG' AS path_asal,
  'img_' || CAST(c_custkey - c_custkey % 50 / 49 AS STRING) || '.JPG' AS nama_file_asli,
  CASE WHEN c_custkey % 11 = 0 THEN 'Bad Name.jpg' WHEN c_custkey % 13 = 0 THEN 'sim_wrong_kind.jpg' WHEN c_custkey % 17 = 0 THEN '' ELSE jenis || '_name_' || CAST(c_custkey % 40 AS STRING) || '.jpg' END AS nama_file_baru,
  substr(c_mktsegment, 1, 4) AS subfolder, jenis AS jenis_dokumen,
  CASE c_custkey % 10 WHEN 0 THEN 'ERROR' WHEN 1 THEN 'DRY-RUN-VALID' WHEN 2 THEN 'DRY-RUN-ERROR' ELSE 'VALID' END AS status,
  CASE WHEN c_custkey % 6 = 0 THEN '' ELSE 'budi_santoso' END AS nama, CASE WHEN c_custkey % 3 = 0 THEN '' ELSE '3216' || lpad(CAST(c_custkey AS STRING), 12, '0') END AS nik,
  CASE WHEN c_custkey % 5 = 0 THEN '' ELSE 'Bekasi' END AS tempat_lahir, CASE WHEN c_custkey % 7 = 0 THEN '' ELSE '25-01-2003' END AS tanggal_lahir,
  CASE WHEN c_custkey % 2 = 0 THEN 'LAKI-LAKI' ELSE 'PEREMPUAN' END AS jenis_kelamin, CASE WHEN c_custkey % 9 = 0 THEN '' ELSE 'JL. MERDEKA' END AS alamat,
  CASE WHEN jenis = 'kk' THEN '5103' || lpad(CAST(c_custkey AS STRING), 12, '0') ELSE '' END AS nomor_kk, CASE WHEN jenis = 'kk' THEN 'SRI REJEKI' ELSE '' END AS nama_kepala,
  CASE WHEN jenis = 'kk' THEN 'KEROBOKAN KAJA' ELSE '' END AS desa_kelurahan, CASE WHEN jenis = 'kk' AND c_custkey % 3 = 0 THEN 'KUTA UTARA' ELSE '' END AS kecamatan,
  CASE WHEN jenis = 'kk' THEN 'BADUNG' ELSE '' END AS kabupaten_kota, CASE WHEN c_custkey % 4 = 1 THEN '' ELSE 'BALI' END AS provinsi, CASE WHEN jenis = 'kk' THEN '045/011' ELSE '' END AS rtrw,
  CASE WHEN jenis = 'sim' THEN '1223-0301-000680' ELSE '' END AS no_sim, CAST(c_custkey % 977 + 100 AS STRING) || ' ms' AS waktu_proses
FROM (SELECT *, CASE c_custkey % 4 WHEN 0 THEN 'kk' WHEN 1 THEN 'ktp' WHEN 2 THEN 'sim' ELSE 'unknown' END AS jenis FROM customer) c
""".replace("c_custkey - c_custkey % 50 / 49", "c_custkey - CASE WHEN c_custkey % 50 = 49 THEN 1 ELSE 0 END")

TRUTH = """
SELECT CASE WHEN o_orderkey % 5 = 0 THEN 'none_' || CAST(o_orderkey AS STRING) ELSE 'img_' || CAST(o_orderkey AS STRING) || '.JPG' END AS nama_file,
  CASE WHEN o_orderkey % 8 = 0 THEN '' ELSE 'Budisantoso' END AS nama, '3216' || lpad(CAST(o_orderkey AS STRING), 12, '0') AS nik, CASE WHEN o_orderkey % 4 = 0 THEN 'Jakarta' ELSE 'BEKASI' END AS tempat_lahir,
  '25/01/2003' AS tanggal_lahir, 'laki-laki' AS jenis_kelamin, CASE o_orderkey % 4 WHEN 0 THEN 'kk' WHEN 1 THEN 'ktp' WHEN 2 THEN 'sim' ELSE 'unknown' END AS jenis_dokumen, '' AS alamat,
  '' AS nomor_kk, 'Sri  Rejeki' AS nama_kepala, 'Kerobokan Kaja' AS desa_kelurahan, 'KUTA UTARA' AS kecamatan, '' AS kabupaten_kota, 'Bali' AS provinsi, '045-011' AS rtrw, '' AS no_sim
FROM orders
"""

#: Paths of files below an input folder.
PATHS = """
SELECT c_custkey AS doc_id, 'in/' || CASE c_custkey % 6 WHEN 0 THEN 'KTP' WHEN 1 THEN 'batch/ERROR/x' WHEN 2 THEN 'ktp' WHEN 3 THEN 'logs' ELSE 'batch_A' END || '/file_' || CAST(c_custkey AS STRING)
  || CASE c_custkey % 5 WHEN 0 THEN '.jpg' WHEN 1 THEN '.PNG' WHEN 2 THEN '.txt' WHEN 3 THEN '.TIF' ELSE '' END AS path FROM customer
"""

SPARK_VARIANTS, DUCKDB_VARIANTS = "explode(sequence(0, 4))", "unnest(range(5))"
DUCKDB_CARDS = CARDS.replace("{variants}", DUCKDB_VARIANTS)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table that is small for the work its rows cost, dealt over all cores."""
    return table(spark, sf_dir, name).repartition(spark.sparkContext.defaultParallelism)


def run_sql(spark: SparkSession, sf_dir: str, sql: str, source: str = "customer", dealt: bool = False) -> DataFrame:
    """The SQL over one table; a small table whose rows cost much work is spread over all cores first."""
    rows = spread(spark, sf_dir, source) if dealt else table(spark, sf_dir, source)
    return spark.sql(sql.replace("{variants}", SPARK_VARIANTS).replace(f"FROM {source}", f"FROM {{{source}}}"), **{source: rows})


def cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_id, variant, truth, text``."""
    return run_sql(spark, sf_dir, CARDS, dealt=True)


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_sql(spark, sf_dir, RECORDS)


def truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_sql(spark, sf_dir, TRUTH, "orders")


def paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_sql(spark, sf_dir, PATHS)
