"""Moves, sinks, settings, images, listings, the drop folder and the command line."""

import json
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from cardloom import __main__ as command
from cardloom.functions import imaging
from cardloom.operators import evaluate, listing, naming, orientation, records
from cardloom.plans import cards, demo
from cardloom.sources import files, images, sinks
from cardloom.streaming import drop_folder


def suffixed(spark, names, existing=()):
    plan = spark.createDataFrame([(i, "d", n) for i, n in enumerate(names)], "i int, folder string, file string")
    there = spark.createDataFrame([("d", n) for n in existing], "folder string, file string") if existing else None
    return [r.path[2:] for r in naming.suffix_duplicates(plan, "i", existing=there).orderBy("i").collect()]


def test_suffixes_avoid_files_and_other_rows(spark):
    assert suffixed(spark, ["x.jpg", "x.jpg", "y.PNG", "y.PNG"]) == ["x.jpg", "x_1.jpg", "y.PNG", "y_1.png"]
    assert suffixed(spark, ["x.jpg", "x.jpg"], ["x.jpg", "x_2.jpg"]) == ["x_1.jpg", "x_3.jpg"]
    assert suffixed(spark, ["x.jpg", "x.jpg", "x_1.jpg"]) == ["x.jpg", "x_2.jpg", "x_1.jpg"]
    assert suffixed(spark, ["x.JPG", "x.JPG", "x.jpg", "x.jpg"]) == ["x.JPG", "x_1.jpg", "x.jpg", "x_2.jpg"]


def test_moves_tell_what_became_of_them(spark, tmp_path):
    for name in ("in/a.jpg", "in/b.jpg", "KTP/b.jpg", "KTP/d.jpg"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(name)
    rows = [(str(tmp_path / f"in/{n}.jpg"), f"KTP/{n}.jpg") for n in "abcd"]
    plan = spark.createDataFrame(rows, "path_asal string, path string")
    told = lambda: {r.path[4]: r.outcome for r in naming.apply_plan(plan, str(tmp_path), str(tmp_path / "moves")).collect()}
    assert told() == {"a": "moved", "b": "target exists", "c": "no source", "d": "already moved"}
    assert (tmp_path / "KTP/a.jpg").read_text() == "in/a.jpg" and (tmp_path / "KTP/b.jpg").read_text() == "KTP/b.jpg"
    assert told()["a"] == "already moved"
    there = {(r.folder, r.file) for r in naming.existing_files(spark, str(tmp_path / "KTP")).collect()}
    assert there == {("", "a.jpg"), ("", "b.jpg"), ("", "d.jpg")}


@pytest.fixture(scope="module")
def rows(spark):
    return evaluate.completeness(cards.records(spark, "/root/testdata/sf0.001")).cache()


def test_a_file_for_each_record(spark, rows, tmp_path):
    shared = sinks.write_each(rows, str(tmp_path / "each"))
    written = list((tmp_path / "each").iterdir())
    assert len(written) + sum(r.records - 1 for r in shared.collect()) == rows.count()
    own = json.loads(written[0].read_text())
    assert "nama_file_asli" in own and all(f.suffix == ".json" for f in written)


def test_report_files(spark, rows, tmp_path):
    root = str(tmp_path)
    scores = evaluate.field_scores(evaluate.match_truth(cards.truth(spark, "/root/testdata/sf0.001"), rows))
    as_json, as_csv = sinks.write_scores(scores, root, "t")
    table = open(as_csv, encoding="utf-8").read()
    assert table.startswith("\ufefffield,precision") and table.rstrip().splitlines()[-1].startswith("MACRO AVERAGE") and table.rstrip().endswith(",,,")
    assert set(json.load(open(as_json))) == {"per_field", "macro_precision", "macro_recall", "macro_f1_score"}
    names = sinks.write_naming(rows, root, "t")
    assert json.load(open(names[0]))["invalid"] == sinks.violations(rows).count() > 0 and len(names) == 2
    figures = json.load(open(sinks.write_metrics(rows, root, "t")))
    assert figures["batch"]["total"] == rows.count() == sum(figures["progress"].values())
    page = open(sinks.write_report(rows.limit(20), root, "t", scores), encoding="utf-8").read()
    assert page.count("<tr>") > 20 and page.endswith("</html>")


def test_what_the_report_shows(spark):
    row = [("kk", "a", "", "1", "", "", "X", "Y", "", "", "001/002", "<b>.jpg", "DRY-RUN-VALID", 0.625), ("sim", "b", "c", "1", "2", "3", "", "", "", "", "", "e", "VALID", 1.0)]
    data = spark.createDataFrame(row, "jenis_dokumen string, nama string, nama_kepala string, nik string, nomor_kk string, no_sim string, desa_kelurahan string, kecamatan string, kabupaten_kota string, provinsi string, rtrw string, nama_file_asli string, status string, field_completeness double")
    a, b = sorted(sinks.document_rows(data).collect())
    assert (a.kind, a.name, a.number, a.details, a.filled, a.badge) == ("KK", "a", "1", "Kel: X | Kec: Y | RT/RW: 001/002", 62, "PREVIEW")
    assert (b.name, b.number, b.details, b.badge) == ("b", "3", "No. SIM: 3", "VALID")


def test_settings(tmp_path):
    path = str(tmp_path / "c.json")
    files.write_settings_template(path)
    assert files.load_settings(path) == files.DEFAULTS
    (tmp_path / "c.yaml").write_text("export: csv\n_note: x\nwhat: 1\n")
    with pytest.warns(UserWarning, match="what"):
        assert files.load_settings(str(tmp_path / "c.yaml")) == files.DEFAULTS | {"export": "csv"}
    (tmp_path / "d.json").write_text("{")
    for name, error in (("d.json", ValueError), ("none.json", FileNotFoundError)):
        with pytest.raises(error):
            files.load_settings(str(tmp_path / name))
    (tmp_path / "c.txt").write_text("")
    with pytest.raises(ValueError, match="txt"):
        files.load_settings(str(tmp_path / "c.txt"))


def test_confidence_of_six_fields(spark):
    text = "\n".join(demo.DEMO["KTP_A/ktp_tirta.jpg"])
    data = spark.createDataFrame([(1, text), (1, text), (1, text.replace("Tirta Wibawa", "Galih Permana")), (1, ""), (2, "")], "doc_id long, text string")
    a, b = sorted(records.confidence_scores(data).collect())
    assert a.confidence_scores == {"nama": 50.0, "nik": 75.0, "tempat_lahir": 75.0, "tanggal_lahir": 75.0, "jenis_kelamin": 75.0, "jenis_dokumen": 75.0} and a.mean_confidence == 70.8
    assert b.confidence_scores["nama"] == 0.0 and b.confidence_scores["jenis_dokumen"] == 100.0


def test_light_and_shadow():
    flat = np.full((60, 80), 200, np.uint8)
    half = flat.copy()
    half[:, :40] = 120
    corner = flat.copy()
    corner[:30, :40] = 150
    assert [imaging.uneven_light(x) for x in (flat, half, corner)] == [False, True, True]
    lit = imaging.without_shadow(half)
    assert lit.dtype == np.uint8 and abs(float(lit[:, :20].mean()) - float(lit[:, 60:].mean())) < 15
    assert set(np.unique(imaging.binarised(half))) == {0, 255} and 120 <= imaging.otsu_threshold(half) < 200
    assert imaging.equalised(half).min() == 0 and imaging.equalised(half).max() == 255 and (imaging.equalised(flat) == flat).all()
    assert imaging.brightened(flat) is None and imaging.brightened(np.full((2, 2), 60, np.uint8))[0, 0] == int((60 / 255) ** 0.5 * 255)
    assert imaging.scaled_size(400, 300) == (1600, 1200) and imaging.scaled_size(800, 10) == (800, 10) and imaging.scaled(flat).shape == (1200, 1600)
    lines = np.zeros((100, 100), np.uint8)
    lines[::10] = 1
    assert imaging.projection_score(lines, 0) > imaging.projection_score(lines, 20)
    assert [label for label, _ in imaging.variants(half)] == ["otsu", "raw_gray", "shadow", "shadow_otsu", "shadow_eq"]
    assert len(imaging.variants_again(half)) == 9


def exif(value, order="<"):
    tiff = (b"II" if order == "<" else b"MM") + struct.pack(order + "HIH", 42, 8, 1) + struct.pack(order + "HHIHH", 0x0112, 3, 1, value, 0)
    body = b"Exif\0\0" + tiff
    return b"\xff\xd8\xff\xe1" + struct.pack(">H", len(body) + 2) + body + b"\xff\xda\x00\x02"


def test_orientation_tag():
    assert [imaging.exif_orientation(exif(v, o)) for v in (1, 6, 8) for o in "<>"] == [1, 1, 6, 6, 8, 8]
    assert [imaging.exif_orientation(x) for x in (b"", b"\xff\xd8", exif(9), exif(6)[:20])] == [1, 1, 1, 1]
    x = np.arange(6).reshape(2, 3)
    assert imaging.upright(x, 6).tolist() == [[3, 0], [4, 1], [5, 2]] and imaging.upright(x, 3).tolist() == [[5, 4, 3], [2, 1, 0]] and imaging.upright(x, 2).tolist() == [[2, 1, 0], [5, 4, 3]]
    assert imaging.upright(imaging.upright(x, 5), 5).tolist() == x.tolist() and imaging.upright(x, 8).tolist() == [[2, 5], [1, 4], [0, 3]]


def bitmap(pixels):
    """A grey picture as an uncompressed 24-bit BMP file."""
    h, w = pixels.shape
    body = b"".join(b"".join(bytes([v] * 3) for v in row) + b"\0" * (-3 * w % 4) for row in pixels[::-1].tolist())
    return b"BM" + struct.pack("<IHHI", 54 + len(body), 0, 0, 54) + struct.pack("<IiiHHIIiiII", 40, w, h, 1, 24, 0, len(body), 0, 0, 0, 0) + body


def test_images_become_variants_and_texts(spark, tmp_path):
    picture = np.full((10, 14), 220, np.uint8)
    picture[3:6, 2:9] = 30
    (tmp_path / "a").mkdir()
    (tmp_path / "a/x.bmp").write_bytes(bitmap(picture))
    (tmp_path / "a/broken.bmp").write_bytes(b"no picture")
    (tmp_path / "ERROR").mkdir()
    (tmp_path / "ERROR/y.bmp").write_bytes(bitmap(picture))
    found = images.decode(spark, str(tmp_path))
    assert [(r.path.rsplit("/", 1)[1], r.height, r.width, r.channels, r.orientation) for r in found.collect()] == [("x.bmp", 10, 14, 3, 1)]
    made = images.variants(found)
    assert {r.label for r in made.select("label").collect()} >= {"otsu", "raw_gray"}

    def read(image, mode):
        if mode == 3:
            raise OSError("no text")
        return f"{image.shape[1]}"

    texts = images.recognise(made.where("label = 'otsu'"), read).collect()
    assert sorted((r.psm, r.text) for r in texts) == [(6, "1600"), (11, "1600")]


def test_decisions_on_angles(spark):
    cases = [(12.0, 5.0, 1.0, 40.0, 13.0), (9.0, 5.0, 0.5, 40.0, 5.0 + 40.0), (None, None, None, 15.0, 0.0), (None, 0.4, None, None, 0.0), (None, 20.0, -1.0, 40.0, 19.0)]
    data = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, a double, b double, c double, d double, want double")
    got = data.select("want", orientation.skew(F.col("a"), F.col("b"), F.col("c"), F.col("d")).alias("got"), orientation.skew(F.col("a"), F.col("b"), F.col("c"), F.col("d"), True).alias("skipped")).collect()
    assert [r.got for r in got] == [r.want for r in got] and got[1].skipped == 5.0
    scores = spark.createDataFrame([(5.0, 100, 74), (5.0, 100, 75), (0.1, 100, 1), (5.0, 0, 0)], "angle double, before int, after int")
    assert [r.k for r in scores.select(orientation.keep_straightened(F.col("angle"), F.col("before"), F.col("after")).alias("k")).collect()] == [False, True, True, True]
    turned = spark.createDataFrame([(100, 121), (100, 120)], "a int, b int").select(orientation.upside_down(F.col("a"), F.col("b")).alias("o"))
    assert [r.o for r in turned.collect()] == ["rotated_180", "upright"]
    angles = spark.createDataFrame([(1, a) for a in (1.0, 2.0, 9.0, 90.0)] + [(2, 5.0)], "k int, angle double")
    assert {r.k: r.angle for r in orientation.median_angle(angles, "k", "angle", 3).collect()} == {1: 5.5}
    assert {r.k: r.angle for r in orientation.dominant_angle(angles, "k", "angle").collect()} == {1: 2.5, 2: 7.5}
    quick = spark.createDataFrame([(1, 6, 5), (1, 11, None), (2, 6, None)], "doc int, psm int, score int")
    assert {r.doc: r.score for r in orientation.quick_score(quick, ["doc"]).collect()} == {1: 5, 2: 0}
    assert orientation.second_pass(spark.range(2)).distinct().count() == 72


def test_logs_and_listings(spark, tmp_path):
    for stamp, line in (("1", "x [OK] y"), ("2", "plain")):
        log = listing.logger(str(tmp_path), stamp, "test")
        log.info(line)
        log.debug("detail")
    for h in list(log.handlers):
        h.close()
        log.removeHandler(h)
    rows = [(r.file, r.tag) for r in listing.read_logs(spark, str(tmp_path)).collect()]
    assert rows[0][0] == "proses_2.log" and ("proses_1.log", "OK") in rows and ("proses_1.log", "DEBUG") in rows
    names = spark.createDataFrame([("laporan_1.html",), ("laporan_2.html",), ("z.html",)], "name string")
    assert listing.latest(names).first().name == "laporan_2.html" and listing.latest(names.limit(0)).first().name is None
    data = spark.createDataFrame([("  abc ",), ("",), (None,)], "t string").select(listing.snippet(F.col("t"), 2).alias("s"), listing.shortened(F.col("t"), 3).alias("c"))
    assert [tuple(r) for r in data.collect()] == [("ab", "  a..."), ("(kosong)", "-"), ("(kosong)", "-")]
    tags = spark.createDataFrame([("=====",), ("Nama : x",), ("PSM 6",), ("an error",), ("x",)], "t string").select(listing.explain_tag(F.col("t")).alias("t"))
    assert [r.t for r in tags.collect()] == ["HEAD", "FIELD", "STRAT", "WARN", "PLAIN"]
    a, b = spark.createDataFrame([(1,), (1,)], "k int"), spark.createDataFrame([(1,), (2,)], "k int")
    assert sorted(r.k for r in listing.append_new(a, b, ["k"]).collect()) == [1, 1, 2]
    took = spark.sql("SELECT timestamp'2024-01-01 00:00:00' AS a, timestamp'2024-01-01 00:00:01.2345' AS b").select(listing.elapsed(F.col("a"), F.col("b")).alias("e"))
    assert took.first().e == "1234 ms"
    assert "50.0%" in listing.box("T", [[("rate", "50.0%"), ("n", 3)]])


def test_drop_folder(spark, tmp_path):
    source = str(tmp_path / "in")
    texts = demo.demo_texts(spark).select("doc_id", "label", "psm", "text")
    texts.where("doc_id < 2").write.parquet(source)
    for checkpoint in ("one", "one", "two"):
        drop_folder.stream_records(spark, source, str(tmp_path / "out"), str(tmp_path / checkpoint)).awaitTermination()
        if checkpoint == "one":
            texts.where("doc_id = 2").write.mode("append").parquet(source)
    got = spark.read.parquet(str(tmp_path / "out"))
    assert got.where("nama = 'tirta_wibawa'").count() == 2 and got.select("run").distinct().count() == 2


def test_command_line(spark, tmp_path, capsys):
    assert command.main(["template-help"]) == 0 and "{nik6}" in capsys.readouterr().out
    assert command.main(["settings", str(tmp_path / "c.json")]) == 0
    assert command.main(["run", "x", "y", "--file-template", "{nope}"]) == 2
    assert command.main(["demo", "--truth", str(tmp_path)]) == 0
    assert "tirta_wibawa" in capsys.readouterr().out
    for path in demo.DEMO:
        (tmp_path / path).parent.mkdir(exist_ok=True)
        (tmp_path / path).write_text(path)
    demo.demo_texts(spark).write.parquet(str(tmp_path / "texts"))
    args = [str(tmp_path / "texts"), str(tmp_path), "--ground-truth", str(tmp_path / "ground_truth.csv"), "--export", "both"]
    assert command.main(["run", *args, "--stamp", "a", "--dry-run"]) == 0
    assert (tmp_path / "KTP_A/ktp_tirta.jpg").exists() and not (tmp_path / "KTP").exists()
    assert command.main(["run", *args, "--stamp", "b", "--config", str(tmp_path / "c.json")]) == 0
    assert (tmp_path / "KTP/ktp_tirta_wibawa/ktp_tirta_wibawa.jpg").read_text() == "KTP_A/ktp_tirta.jpg"
    assert (tmp_path / "ERROR/LAIN/unknown_doc.jpg").exists() and (tmp_path / "metadata/laporan_b.html").exists()
    assert json.load(open(tmp_path / "metadata/f1_score_b.json"))["per_field"]["nomor_kk"]["f1"] == 1.0
