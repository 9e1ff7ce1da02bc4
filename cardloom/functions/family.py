"""Number and head of a family card, as native Columns over cleaned text; each has a chain of ways, from labels to what stands free."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cardloom.functions import lexicon as lx
from cardloom.functions.names import filled_lines, first_behind
from cardloom.functions.text import digits, first, first_of, first_value, is_plausible_name, let, lines, literal_array, most_frequent, one_of, strip, with_next

HEAD_LABEL = rf"(?:Nama\s+)?(?:{'|'.join(lx.HEAD_FIRST)})\s+(?:{'|'.join(lx.HEAD_SECOND)})"


def to_16_digits(raw: Column) -> Column:
    """Family-card number from noisy characters: 16 digits, 15 with a zero behind, 14 as they are; a leading zero is none."""

    def judge(d):
        ok = lambda x: x.rlike("^[1-9][0-9]")
        n = F.length(d)
        skipped = F.when((n == 17) & ok(F.substring(d, 2, 16)), F.substring(d, 2, 16)).when((n == 18) & ok(F.substring(d, 3, 16)), F.substring(d, 3, 16))
        return (
            F.when((n == 16) & ok(d), d)
            .when(n > 16, F.coalesce(skipped, F.when(ok(d), F.left(d, F.lit(16))), F.lit("")))
            .when((n == 15) & ok(d), F.concat(d, F.lit("0")))
            .when((n == 14) & ok(d), d)
            .otherwise("")
        )

    return let(digits(F.regexp_replace(raw, "[^0-9A-Za-z?]", ""), lx.KK_DIGITS), judge)


def family_number(text: Column) -> Column:
    """The most frequent number behind a label, on a line that starts as one or below such a line; where there is none, of
    the free runs of characters that read as one."""
    labelled = to_16_digits(F.regexp_extract(text, "(?i)" + lx.FAMILY_NUMBER_LABELLED, 1))
    line = "(?i)" + lx.FAMILY_NUMBER_LINE

    def beside(p):
        below = F.when(p["x"].rlike(line + "$"), F.regexp_extract(p["y"], "^" + lx.FAMILY_NUMBER_VALUE, 1))
        return to_16_digits(F.coalesce(F.nullif(F.regexp_extract(p["x"], line + lx.FAMILY_NUMBER_VALUE, 1), F.lit("")), below, F.lit("")))

    rows = F.transform(lines(text), strip)
    near = most_frequent(F.concat(F.array(labelled), F.transform(with_next(rows), beside)))
    free = F.filter(lines(text), lambda x: ~x.rlike("(?i)" + lx.OTHER_NUMBER_LINE))
    runs = F.flatten(F.transform(free, lambda x: F.regexp_extract_all(x, F.lit(lx.FAMILY_NUMBER_FREE), F.lit(0))))
    return let(near, lambda own: F.when(own != "", own).otherwise(most_frequent(F.transform(runs, to_16_digits))))


def _name(parts: Column) -> Column:
    """The words in upper case, at most four, if they read as a name."""

    def judge(own):
        slug = F.lower(F.array_join(own, "_"))
        return F.when((F.size(own) > 0) & is_plausible_name(slug), F.upper(F.array_join(F.slice(own, 1, 4), " "))).otherwise("")

    return let(parts, judge)


def _words(x: Column, least: int = 2) -> Column:
    return F.regexp_extract_all(x, F.lit("([A-Za-z]{%d,})" % least), F.lit(1))


def _cut(x: Column, pattern: str) -> Column:
    """What stands before the first match."""
    return F.regexp_replace(x, "(?is)" + pattern + ".*$", "")


def _none_of(parts: Column, values) -> Column:
    return ~F.arrays_overlap(parts, literal_array(values))


def head_behind_label(text: Column) -> Column:
    """Behind the label or a misreading of it, else on the next line."""
    stop = [*lx.HEAD_SKIP, *lx.HEAD_PLACES]

    def read(p):
        behind = F.regexp_replace(p["x"], rf"(?i)^.*?(?:{HEAD_LABEL})\s*[:\-—\?]?\s*", "")
        behind = _cut(_cut(behind, r"\s*[:/]\s*(?:Desa|Desm|Kel|Kec|Kabupaten|Provinsi|Desnfaturahan|Desn)"), r"\s*[—–]")
        plain = lambda x, n: F.filter(F.split(F.regexp_replace(x, r"[^A-Za-z\s]", " "), r"\s+"), lambda w: F.length(w) >= n)
        own = let(F.filter(plain(behind, 2), lambda w: ~one_of(F.lower(w), stop)), lambda w: F.when(F.size(w) <= 4, _name(w)).otherwise(""))

        def below(w):
            enough = F.size(w).between(2, 4) | ((F.size(w) == 1) & (F.length(F.get(w, 0)) >= 5))
            lower = F.transform(w, lambda x: F.lower(x))
            return F.when(enough & _none_of(lower, lx.HEAD_SKIP) & ~p["y"].rlike(r"\d"), _name(w)).otherwise("")

        next_ = let(F.filter(plain(p["y"], 3), lambda w: ~one_of(F.lower(w), lx.HEAD_PLACES)), below)
        return first_of(own, next_)

    return first_value(with_next(filled_lines(text)), lambda p: F.when(p["x"].rlike("(?i)" + HEAD_LABEL), read(p)))


def head_below_number(text: Column) -> Column:
    """On one of the nine lines below a line with a number."""
    number = lambda x: (x.rlike(r"(?i)N[oua][.\-\s]*[:\-]?\s*[0-9?(]") | x.rlike(r"[0-9]{4}[0-9A-Za-z?)(]{10,}")) & x.rlike("[0-9]{4,}")

    def value(x):
        own = _cut(strip(F.regexp_replace(x, "^[^A-Za-z]+", "")), r"\s+(?:Desa|Desai|Desaf|Desm|Dexa|Desnfaturahan|Kelurahan|Desn)")
        own = strip(_cut(strip(_cut(own, ":")), r"\s*[—–]"))

        def judge(own, w):
            free = _none_of(F.transform(w, lambda y: F.lower(y)), lx.HEAD_PLACES)
            return F.when(F.size(w).between(1, 5) & free & ~own.rlike(r"\d{3,}"), _name(w)).otherwise("")

        return let(own, lambda o: let(_words(o), lambda w: judge(o, w)))

    return first_behind(filled_lines(text), number, value, 9)


def head_in_capitals(text: Column) -> Column:
    """Two to four capitalised words on one of the first twelve lines."""

    def value(x):
        own = strip(_cut(_cut(strip(F.regexp_replace(x, "^[^A-Za-z]+", "")), r"\s+(?:Desa|Desai|/Kelurahan|Kecamatan)"), ":"))

        def judge(own, w):
            capital = F.forall(w, lambda y: y.rlike("^[A-Z]"))
            free = _none_of(F.transform(w, lambda y: F.upper(y)), lx.HEAD_CAPITALS)
            return F.when(F.size(w).between(2, 4) & capital & free & ~own.rlike(r"\d"), F.upper(F.array_join(w, " "))).otherwise("")

        return let(own, lambda o: let(_words(o, 3), lambda w: judge(o, w)))

    return first_value(F.slice(filled_lines(text), 1, 12), value)


def head_below_noise(text: Column) -> Column:
    """On one of the eight lines below the first misread label."""

    def value(x):
        def judge(w):
            free = _none_of(F.transform(w, lambda y: F.upper(y)), [*lx.HEAD_CAPITALS, *lx.HEAD_BELOW])
            return F.when(F.size(w).between(1, 4) & free & ~x.rlike(r"\d{2,}"), _name(w)).otherwise("")

        return let(_words(x), judge)

    def below(rows):
        at = F.array_position(F.transform(rows, lambda x: x.rlike(f"(?i){'|'.join(lx.HEAD_NOISE)}")), True).cast("int")
        return let(at, lambda k: F.when(k > 0, first_value(F.slice(rows, k + 1, F.lit(8)), value)).otherwise(""))

    return let(filled_lines(text), below)


def head_in_table(text: Column) -> Column:
    """On a row of the members' table that starts with 1 and names the head."""

    def value(x):
        own = strip(_cut(strip(F.regexp_replace(x, r"^\s*1[\s.|]+", "")), r"\s+\d{5,}"))
        return let(F.filter(_words(own), lambda w: ~one_of(F.lower(w), lx.HEAD_PLACES)), lambda w: F.when(F.size(w).between(1, 5), _name(w)).otherwise(""))

    return first_value(filled_lines(text), lambda x: F.when(x.rlike(r"^\s*1[\s.|]+") & x.rlike(r"(?i)KEPALA\s+KELUARGA"), value(x)))


#: The ways to the head, in the order in which they count.
HEAD_WAYS = {"behind_label": head_behind_label, "below_number": head_below_number, "in_capitals": head_in_capitals, "below_noise": head_below_noise, "in_table": head_in_table}


def family_head(text: Column) -> Column:
    """Name of the family's head in upper case, by the first way that gives one."""
    return first_of(*[way(text) for way in HEAD_WAYS.values()])


def head_from_header(text: Column) -> Column:
    """Slug of what stands behind the colon of the first line with the head's label that gives one."""
    from cardloom.functions.text import clean_name

    rows = F.filter(lines(text), lambda x: F.upper(x).rlike(r"KEPALA\s+KELUARGA") & F.contains(x, F.lit(":")))
    return first(F.filter(F.transform(rows, lambda x: clean_name(F.regexp_extract(x, ":(.*)", 1))), lambda n: n != ""))
