"""Addresses of driving licences and family cards, as native Columns over cleaned text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cardloom.functions.names import filled_lines
from cardloom.functions.text import first_of, let, strip, with_next

# What tells an address, what ends one on a licence, and the number of a licence's field.
LICENCE_WORD = r"(?iU)\b(?:KP|JL|JALAN|PERUM|DUSUN|GANG|GG|BLOK|RT|RW|KAV|KOMPLEK)\b"
LICENCE_STOP = r"(?iU)\b(?:PELAJAR|MHS|METRO|POLDA|SIM|BERLAKU|SURAT|MENGEMUDI|LICENSE|DRIVING)\b|\bINDONESI"
LICENCE_GENDER = r"(?iU)\b(?:PRIA|WANITA|LAKI|PEREMPUAN)\b"
FIELD_NUMBER = r"^\s*\d+\s*[.)]\s*(?:[A-Z]\.\s*)?"
FAMILY_WORD = "PERUM|JL|JALAN|KP|GANG|GG|DUSUN|DSN|DSUN"

#: Characters of an address on a licence at least.
LEAST = 5


def _squeeze(x: Column) -> Column:
    return strip(F.regexp_replace(x, r"(?U)\s+", " "))


def _long_enough(x: Column) -> Column:
    return let(x, lambda own: F.when(F.length(own) >= LEAST, own).otherwise(""))


def clean_licence_address(x: Column) -> Column:
    """Without field number, a number at the end that belongs to no label, one or two capitals at the end, and symbols."""
    labelled = lambda own: own.rlike(r"(?i)(?:NO|KM|RT|RW|KAV|BLOK|GG|GANG)\s*[.:]?\s*\d+\s*$")
    bare = F.regexp_replace(F.replace(x, F.lit("|"), F.lit(" ")), FIELD_NUMBER, "")
    own = let(bare, lambda own: F.when(labelled(own), own).otherwise(F.regexp_replace(own, r"\s+[\d.]+\s*$", "")))
    return _squeeze(F.regexp_replace(F.regexp_replace(own, r"(?U)\b[A-Z]{1,2}\b\s*$", ""), r"(?U)[^\w\s/.\-]", " "))


def licence_address_below_gender(text: Column) -> Column:
    """Up to two of the three lines below the first one with a gender, until one that ends an address."""
    start = F.struct(F.lit(0).alias("taken"), F.lit("").alias("value"))

    def step(s, x):
        ended = x.rlike(LICENCE_STOP) | x.rlike(r"(?iU)KAB\.|KAB\b|KABUPATEN|KOTA\b")
        grown = lambda own: F.struct((s["taken"] + 1).alias("taken"), strip(F.concat_ws(" ", s["value"], own)).alias("value"))
        more = let(clean_licence_address(x), lambda own: F.when(own == "", s).otherwise(grown(own)))
        return F.when(s["taken"] >= 2, s).when(ended, F.struct(F.lit(2).alias("taken"), s["value"].alias("value"))).otherwise(more)

    def below(rows, at):
        return F.when(at > 0, _long_enough(F.aggregate(F.slice(rows, at + 1, F.lit(3)), start, step, lambda s: s["value"]))).otherwise("")

    def read(rows):
        return let(F.array_position(F.transform(rows, lambda x: x.rlike(LICENCE_GENDER)), True).cast("int"), lambda at: below(rows, at))

    return let(filled_lines(text), read)


def licence_address_elsewhere(text: Column) -> Column:
    """Numbered lines with an address word, else the first line with one; the line behind may go on with it."""
    word = lambda x: x.rlike(LICENCE_WORD) & ~x.rlike(LICENCE_STOP)
    open_ = lambda y: (y != "") & ~y.rlike(LICENCE_STOP) & ~y.rlike(r"(?i)KAB\.|KABUPATEN")

    def numbered(s, p):
        goes_on = open_(p["y"]) & ~p["y"].rlike("(?i)PEDAGANG|PELAJAR") & (p["y"].rlike(LICENCE_WORD) | p["y"].rlike(FIELD_NUMBER))
        more = F.when(goes_on, clean_licence_address(p["y"])).otherwise("")
        both = lambda own: F.when(own != "", F.concat(s, F.filter(F.array(own, more), lambda v: v != ""))).otherwise(s)
        return F.when((F.size(s) < 2) & p["x"].rlike(FIELD_NUMBER) & word(p["x"]), let(clean_licence_address(p["x"]), both)).otherwise(s)

    fields = lambda pairs: F.aggregate(pairs, F.expr("CAST(array() AS array<string>)"), numbered, lambda s: _long_enough(_squeeze(F.array_join(s, " "))))

    def plain(p):
        more = F.when(open_(p["y"]) & p["y"].rlike(LICENCE_WORD), clean_licence_address(p["y"])).otherwise("")
        return _long_enough(_squeeze(F.concat_ws(" ", clean_licence_address(p["x"]), more)))

    anywhere = lambda pairs: F.transform(F.slice(F.filter(pairs, lambda p: word(p["x"])), 1, 1), plain)
    # the passes below find nothing on a card that has no address word at all
    read = lambda pairs: first_of(fields(pairs), F.get(anywhere(pairs), 0))
    return F.when(text.rlike(LICENCE_WORD), let(with_next(filled_lines(text)), read)).otherwise("")


def clean_family_address(x: Column) -> Column:
    """From the first address word to the next label of a place; without such a word the whole, if it has five characters."""
    plain = lambda y: strip(F.regexp_replace(y, r"[^A-Za-z0-9\s./]", " "))
    cut = lambda found: F.regexp_replace(found, r"(?is)\s+(?:Kecamatan|Kelurahan|Kabupaten|Kota).*$", "")
    return let(x, lambda own: let(F.regexp_extract(own, f"(?i)(?:{FAMILY_WORD}).+", 0), lambda found: F.when(found != "", plain(cut(found))).otherwise(_long_enough(plain(own)))))


def family_address(text: Column) -> Column:
    """Of the first line with the address label (its value, or the next line), unless a line before it has an address word."""

    def read(p):
        behind = F.regexp_extract(p["x"], r"(?i)Alamat\s*:?\s*(.*)$", 1)

        def raw(label):
            beside = let(behind, lambda b: F.when(F.length(strip(b)) > 3, b).otherwise(p["y"]))
            own = F.when(label, clean_family_address(beside)).when(p["x"].rlike(f"(?i){FAMILY_WORD}|BLOK"), clean_family_address(p["x"])).otherwise("")
            return F.struct(label.alias("label"), own.alias("value"))

        return let(p["x"].rlike(r"(?iU)\bAlamat\b"), raw)

    ends = F.filter(F.transform(with_next(filled_lines(text)), read), lambda r: r["label"] | (r["value"] != ""))
    return F.coalesce(F.get(F.transform(ends, lambda r: r["value"]), 0), F.lit(""))
