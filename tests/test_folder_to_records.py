"""From a folder of images to records and moved files, with a made-up OCR hook."""

import os
import struct

import numpy as np

from cardloom import __main__ as command
from cardloom.functions.text import quality_score  # noqa: F401
from cardloom.plans import demo
from cardloom.sources import files, images


def bitmap(h, w):
    pixels = np.full((h, w), 220, np.uint8)
    pixels[h // 3 : h // 2, w // 4 : w // 2] = 30
    body = b"".join(b"".join(bytes([v] * 3) for v in row) + b"\0" * (-3 * w % 4) for row in pixels[::-1].tolist())
    return b"BM" + struct.pack("<IHHI", 54 + len(body), 0, 0, 54) + struct.pack("<IiiHHIIiiII", 40, w, h, 1, 24, 0, len(body), 0, 0, 0, 0) + body


def test_folder_to_records(spark, tmp_path):
    for name, size in {"in/card.bmp": (10, 20), "in/low.bmp": (10, 10), "none.bmp": (20, 10)}.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(bitmap(*size))
    good = max((r.text for r in demo.demo_texts(spark).collect() if "NIK" in r.text), key=len)

    def read(image, mode):
        h, w = image.shape
        if h > w:
            raise OSError("no text")
        return good if w > h else f"x {mode}"

    rows = images.texts_of_folder(spark, str(tmp_path), read)
    labels = {}
    for r in rows.collect():
        assert r.doc_id == r.path
        labels.setdefault(r.path, set()).add((r.label, r.psm, r.text))
    assert set(labels) == {"in/card.bmp", "in/low.bmp", "none.bmp"}
    assert {t for *_, t in labels["in/card.bmp"]} == {good} and not any(n.startswith("sh_") for n, *_ in labels["in/card.bmp"])
    again = {n for n, *_ in labels["in/low.bmp"] if n.startswith("sh_")}
    assert again >= {"sh_fb15_plain", "sh_fb20_otsu", "sh_fb10_eq"} and len({p for _, p, _ in labels["in/low.bmp"]}) == 3
    assert labels["none.bmp"] == {("raw_gray", 6, "")}

    own = dict(files.DEFAULTS)
    done = {r.path_asal: r for r in command.batch(rows, str(tmp_path), own, "s").collect()}
    assert done["in/card.bmp"].status == "VALID" and done["in/card.bmp"].jenis_dokumen == "ktp"
    assert done["in/low.bmp"].status == done["none.bmp"].status == "ERROR"
    assert (tmp_path / done["in/card.bmp"].path).read_bytes() == bitmap(10, 20) and not (tmp_path / "in/card.bmp").exists()
    assert (tmp_path / done["none.bmp"].path).read_bytes() == bitmap(20, 10)
    # what has been filed isn't read again
    assert images.texts_of_folder(spark, str(tmp_path), read).where("path NOT LIKE '%ERROR%' AND path NOT LIKE 'K%'").count() == 0


def test_hooks_have_names():
    assert command.hook("os.path:join") is os.path.join
