"""Kind of a card and its fields, as native Columns over cleaned text; a missing value is the empty string."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from cardloom.functions import lexicon as lx
from cardloom.functions.text import clean_name, digits, first, first_of, first_value, let, lines, normalize_city, normalize_date, one_of, plausible, strip, words

# Labels that end an address, and the label of a birth line.
ADDRESS_STOP = r"\b(RT|RW|KEL|DESA|KEC|AGAMA|PEKERJAAN|STATUS|KEWARGANEGARAAN|BERLAKU|GOLONGAN)\b"


BIRTH_LABEL = r"TEMPAT.{0,10}(TGL|TANGGAL)?.{0,5}LAHIR"
#: Lines of an address, and its characters, at most.
ADDRESS_LINES, ADDRESS_LENGTH = 3, 200


def _hits(upper: Column, patterns) -> Column:
    return reduce(lambda a, b: a + b, [upper.rlike("(?U)" + p).cast("int") for p in patterns])


def classify(text: Column) -> Column:
    """``kk``, ``sim``, ``ktp`` or ``unknown``: one family-card pattern decides, two of the others do, then one."""

    def of(upper):
        kk = upper.rlike("(?U)" + "|".join(lx.KK_PATTERNS))
        return F.when(kk, "kk").otherwise(let(_hits(upper, lx.SIM_PATTERNS), lambda sim: F.when(sim >= 2, "sim").otherwise(let(_hits(upper, lx.KTP_PATTERNS), lambda ktp: few(sim, ktp)))))

    few = lambda sim, ktp: F.when(ktp >= 2, "ktp").when(sim >= 1, "sim").when(ktp >= 1, "ktp").otherwise("unknown")
    return let(F.upper(text), of)


def _province(number: Column) -> Column:
    return (F.length(number) >= 15) & number.rlike("^[1-9][0-9]")


def nik(text: Column) -> Column:
    """Identity number: behind its label, else the first run of letters and digits that reads as one, else digits with gaps."""
    read = lambda x: digits(F.regexp_replace(x, r"\s", ""), lx.NIK_DIGITS)
    labelled = read(F.regexp_extract(text, r"(?iu)\bN\s*[I1]\s*K\s*[:\-]?\s*([\dOolLIisSbBzZGgAaDd\s]{14,22})", 1))
    fused = F.transform(F.regexp_extract_all(F.regexp_replace(text, r"\s", ""), F.lit("([0-9A-Za-z]{14,18})"), F.lit(1)), lambda c: digits(c, lx.NIK_DIGITS))
    gaps = digits(F.regexp_extract(text, r"(\d[\d\-\s]{13,19}\d)", 1))
    cut = lambda x: F.left(x, F.lit(16))
    long_ = let(labelled, lambda d: F.when(F.length(d) >= 15, cut(d)))
    return first_of(long_, cut(first(F.filter(fused, _province))), let(gaps, lambda d: F.when(_province(d), cut(d))))


def birth_date(text: Column) -> Column:
    """On the line with the birth label, else anywhere, else day and month at a line's end with a year on one of the next three."""
    pattern = r"(\d{1,2}[-/\s]\d{1,2}[-/\s]\d{4})"
    labelled = first_value(lines(text), lambda x: F.when(F.upper(x).rlike(BIRTH_LABEL), F.regexp_extract(x, pattern, 1)))
    anywhere = F.regexp_extract(text, r"(?U)\b(\d{1,2}[-/]\d{1,2}[-/]\d{4})\b", 1)
    split = r"[,\.\-:]\s*(\d{1,2})[-/\.](\d{2})\s*$"

    def parted(rows):
        year = lambda i: first_value(F.slice(rows, i + 2, F.lit(3)), lambda y: F.regexp_extract(y, r"(?U)\b((?:19|20)\d{2})\b", 1))

        def date(x, i):
            day = F.lpad(F.regexp_extract(x, split, 1), 2, "0")
            return F.when(x.rlike(split), let(year(i), lambda y: F.when(y != "", F.concat_ws("-", day, F.regexp_extract(x, split, 2), y))))

        return first(F.filter(F.transform(rows, date), lambda d: d.isNotNull()))

    return first_of(normalize_date(labelled), normalize_date(anywhere), let(F.filter(lines(text), lambda x: strip(x) != ""), parted))


def birth_place(text: Column) -> Column:
    """Title-case place: on the line with the birth label, else the last word before a date, else before day and month at a line's end with
    a year on one of the next three."""
    read = lambda x: strip(F.regexp_replace(F.regexp_extract(x, r":\s*([^,\-]*)", 1), r"[^A-Za-z\s]", ""))
    labelled = first_value(lines(text), lambda x: F.when(F.upper(x).rlike(BIRTH_LABEL), let(read(x), lambda p: F.when(F.length(p) > 2, p))))
    last = lambda x: F.element_at(F.concat(F.array(F.lit("")), F.filter(words(x), lambda w: F.length(w) >= 2)), -1)
    # the words before a date are looked for only where one stands: they are tried from every letter on
    date = r"[,\.\-:]\s*\d{1,2}[-/\.]\d{2}[-/\.]\d{4}"
    before = F.when(text.rlike(date), F.regexp_extract(text, r"([A-Za-z][A-Za-z\s]{0,25})[,\.\-:]+\s*\d{1,2}[-/\.]\d{2}[-/\.]\d{4}", 1)).otherwise("")
    split = r"([A-Za-z][A-Za-z\s]{0,20})[,\.\-:]+\s*\d{1,2}[-/\.]\d{2}\s*$"

    def parted(rows):
        year = lambda i: F.exists(F.slice(rows, i + 2, F.lit(3)), lambda y: y.rlike(r"(?U)\b(?:19|20)\d{2}\b"))
        return first(F.filter(F.transform(rows, lambda x, i: F.when(x.rlike(r"[-/\.]\d{2}\s*$") & x.rlike(split) & year(i), last(F.regexp_extract(x, split, 1)))), lambda p: p != ""))

    place = first_of(labelled, last(before), let(F.filter(lines(text), lambda x: strip(x) != ""), parted))
    return let(place, lambda p: F.when(p == "", "").otherwise(F.initcap(F.lower(normalize_city(p)))))


def gender(text: Column) -> Column:
    return let(F.upper(text), _gender)


def _gender(upper: Column) -> Column:
    return (
        F.when(upper.rlike(r"LAKI\s*[-]\s*LAKI|LAKI\s+LAKI|\bLELAKI\b|\bPRIA\b"), "LAKI-LAKI")
        .when(upper.rlike(r"PEREMPUAN|\bWANITA\b"), "PEREMPUAN")
        .otherwise("")
    )


def name_from_label(text: Column) -> Column:
    """Slug of what stands behind a name label, behind a colon or without one, of the first such line that gives one."""
    label = lambda x: let(F.upper(x), lambda u: u.rlike(r"\bNA\s*MA?\b") & ~u.rlike(r"KEPALA\s+KELUARGA"))
    ways = lambda x: first_of(clean_name(F.regexp_extract(x, ":(.*)", 1)), clean_name(F.regexp_extract(x, r"(?i)NA\s*MA?\s+([A-Za-z ]{3,})", 1)))
    return first_value(lines(text), lambda x: F.when(label(x), ways(x)))


def address(text: Column) -> Column:
    """Values behind address labels and the filled lines after them, three in all, until another label; at most 200 characters."""
    start = F.struct(F.lit(0).alias("state"), F.lit(0).alias("taken"), F.lit("").alias("value"))  # state: 0 before, 1 in the address, 2 behind it
    behind = r"""(?i)\b(?:ALAMAT|MAMAT)\b\s*[:"\u2019\u2018'*#@\uff1a]?\s*(.+)"""

    def read(s, line, told):
        label, stop = told["label"], told["stop"]

        def grow(part):
            n = s["taken"] + (part != "").cast("int")
            ended = ~label & (stop | (n >= ADDRESS_LINES))
            return F.struct(F.when(ended, 2).otherwise(1).alias("state"), n.alias("taken"), strip(F.concat_ws(" ", s["value"], part)).alias("value"))

        stopped = F.struct(F.lit(2).alias("state"), s["taken"].alias("taken"), s["value"].alias("value"))
        grown = let(F.when(label, strip(F.regexp_extract(line, behind, 1))).otherwise(strip(line)), grow)
        return F.when((s["state"] == 0) & ~label, s).when(~label & (s["state"] == 1) & stop, stopped).otherwise(grown)

    def step(s, line):
        # a line before the address is looked at for its label alone
        kind = lambda upper: F.struct(upper.rlike(r"\bALAMAT\b|\bMAMAT\b").alias("label"), ((s["state"] == 1) & upper.rlike(ADDRESS_STOP)).alias("stop"))
        return F.when(s["state"] == 2, s).otherwise(let(let(strip(F.upper(line)), kind), lambda told: read(s, line, told)))

    joined = F.aggregate(lines(text), start, step, lambda s: s["value"])
    return F.left(F.regexp_replace(joined, r"\s+", " "), F.lit(ADDRESS_LENGTH))


def header_field(text: Column, field: str) -> Column:
    """One of the header fields in upper case; the first pattern with a value of three letters or more counts."""

    def value(pattern):
        found = F.regexp_replace(strip(F.regexp_extract(text, "(?im)" + pattern, 1)), r"\s*[:\-—#\d\.]\s*$", "")
        return F.array_join(F.filter(words(found), lambda w: ~one_of(F.upper(w), lx.HEADER_STOP)), " ")

    # one match after the other, and none after the first that holds
    ways = [let(value(p), lambda v: F.when(F.length(v) >= 3, F.upper(v))) for p in lx.HEADER_PATTERNS[field]]
    return F.coalesce(*ways, F.lit(""))


def rt_rw(text: Column) -> Column:
    """``RRR/WWW`` from explicit labels, from fused digits behind a label, before the name of a regency, or from fused digits before one."""
    pad = lambda x: F.when(F.length(x) < 3, F.lpad(x, 3, "0")).otherwise(x)
    within = lambda a, b: F.coalesce(a.try_cast("int").between(1, 200) & b.try_cast("int").between(1, 50), F.lit(False))

    def both(pattern):
        part = lambda k: let(F.regexp_extract(text, pattern, k), pad)
        return F.when(text.rlike(pattern), F.concat_ws("/", part(1), part(2)))

    def fused(number):
        def cut(d):
            part = lambda at, n: F.substring(d, at, n)
            seven = [(part(1, 3), part(5, 3)), (part(2, 3), part(5, 3)), (part(1, 3), part(4, 3))]
            split = F.coalesce(*[F.when(within(a, b), F.concat_ws("/", a, b)) for a, b in seven], F.concat_ws("/", part(1, 3), part(4, 3)))
            return F.when(F.length(d) == 7, split).when(F.length(d) >= 6, F.concat_ws("/", part(1, 3), part(4, 3)))

        return let(number, cut)

    label = r"(?i)(?:RTRW|RTIRW|BURW|RT[I1]?RW)"
    read = lambda x: digits(x, lx.RTRW_FUSED)

    def slashed(x):
        a, b = (read(F.regexp_extract(x, r"([0-9A-Za-z]{2,4})\s*/\s*([0-9A-Za-z]{2,4})", k)) for k in (1, 2))
        long_ = lambda p: (F.length(p["a"]) >= 2) & (F.length(p["b"]) >= 2) & within(p["a"], p["b"])
        joined = let(F.struct(a.alias("a"), b.alias("b")), lambda p: F.when(long_(p), F.concat_ws("/", pad(p["a"]), pad(p["b"]))))
        return F.when(F.contains(x, F.lit("/")) & x.rlike("(?i)Kabupaten|Kota|BEKASI|JAKARTA"), joined)

    return first_of(
        both(r"(?i)RT[/I\s.]*RW[.\s:]*(\d{2,3})[/\s\-](\d{2,3})"),
        both(r"(?i)RT\.?(\d{2,3})/RW\.?(\d{2,3})"),
        fused(digits(F.regexp_extract(text, label + r"\s*[:\-]?\s*([0-9A-Za-z]{4,10})\b", 1), lx.RTRW_DIGITS)),
        fused(digits(F.regexp_extract(text, label + r"\s*\n\s*([0-9A-Za-z]{4,10})", 1), lx.RTRW_DIGITS)),
        first_value(lines(text), slashed),
        first_value(lines(text), lambda x: fused(read(F.regexp_extract(x, r"(?i)([0-9A-Za-z]{6,8})\s+(?:Kabupaten|Kecamatan)", 1)))),
    )


def licence_number(text: Column) -> Column:
    """``4-4-6`` digits: three parts with dashes in the first twelve filled lines, else fourteen digits in the first eight, else
    twelve or more behind the label in the first ten."""
    pattern = r"([0-9A-Za-z]{3,5})\s*[-–]\s*([0-9A-Za-z]{3,7})\s*[-–]?\s*([0-9A-Za-z]{3,8})"

    def joined(a, every):
        head = F.when(F.length(a) < 4, F.lpad(a, 4, "0")).otherwise(F.left(a, F.lit(4)))
        rest = F.substring(every, 5, 99)
        middle = F.left(rest, F.lit(4))
        tail = F.substring(rest, 5, 6)
        tail = F.when(F.length(rest) >= 6, F.lpad(tail, 6, "0")).otherwise(F.rpad(tail, 6, "0"))
        return F.when(F.length(every) >= 10, F.concat_ws("-", head, F.lpad(middle, 4, "0"), tail))

    def dashed(x):
        part = lambda y, k: digits(F.regexp_extract(y, pattern, k), lx.SIM_DIGITS)
        own = lambda y: let(part(y, 1), lambda a: F.when(F.length(a) >= 2, let(F.concat(a, part(y, 2), part(y, 3)), lambda every: joined(a, every))))
        return F.when(x.rlike("[-–]"), let(F.regexp_replace(x, r"^[^\d]+", ""), own))

    cut = lambda d: F.concat_ws("-", F.substring(d, 1, 4), F.substring(d, 5, 4), F.substring(d, 9, 6))

    def fused(x):
        return let(digits(F.regexp_replace(x, r"\s+", ""), lx.SIM_DIGITS), lambda d: F.when((F.length(d) >= 14) & ~d.startswith("0"), cut(d)))

    def labelled(x):
        own = let(digits(F.regexp_extract(x, r"[:\-]\s*(.*)$", 1), lx.SIM_DIGITS), lambda d: F.when(F.length(d) >= 12, cut(d)))
        return F.when(x.rlike(r"(?iU)\bNo\.?\s*SIM\b"), own)

    def read(rows):
        return first_of(*[first_value(F.slice(rows, 1, n), f) for n, f in ((12, dashed), (8, fused), (10, labelled))])

    return let(F.filter(F.transform(lines(text), strip), lambda x: x != ""), read)
