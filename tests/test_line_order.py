"""Order of lines in files that are split, and of rows in several files."""

import pytest

from cardloom.operators import listing
from cardloom.sources import files


def test_lines_keep_their_places_in_split_logs(spark, tmp_path):
    (tmp_path / "logs").mkdir()
    want = {}
    for name, n in (("proses_1.log", 400), ("proses_2.log", 3), ("proses_3.log", 0)):
        want[name] = [f"line {i} {'x' * (i * 37 % 90)}" for i in range(n)]
        (tmp_path / "logs" / name).write_text("".join(x + "\n" for x in want[name]))
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        text = spark.read.option("pathGlobFilter", "*.log").text(f"{tmp_path}/logs")
        assert text.rdd.getNumPartitions() > 5
        rows = listing.read_logs(spark, str(tmp_path)).collect()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert [(r.file, r.line_no, r.line) for r in rows] == [(n, i, x) for n in sorted(want, reverse=True) for i, x in enumerate(want[n])]


def test_last_row_wins_over_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text("nama_file,nama\nx,1\nx,2\n" + "".join(f"f{i},v\n" for i in range(500)) + "y,\"two\nlines\"\n")
    (tmp_path / "b.csv").write_text("nama_file,nama\nx,3\n ,4\n")
    got = {r.nama_file: r.nama for r in files.read_truth(spark, str(tmp_path)).where("nama_file NOT LIKE 'f%'").collect()}
    assert got == {"x": "3", "y": "two\nlines"}
    assert {r.nama_file: r.nama for r in files.read_truth(spark, str(tmp_path / "a.csv")).collect()}["x"] == "2"
    with pytest.raises(FileNotFoundError):
        files.read_truth(spark, str(tmp_path / "none.csv"))
