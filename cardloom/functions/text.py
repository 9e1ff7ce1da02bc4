"""Column functions on recognised text; all native, none needs a UDF."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from cardloom.functions import lexicon as lx


#: All white space that Unicode knows.
WHITE = "\t\n\x0b\x0c\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def strip(x: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.btrim(x, F.lit(WHITE))


def words(x: Column) -> Column:
    """Words between runs of white space."""
    return F.filter(F.split(x, r"(?U)\s+", -1), lambda w: w != "")


def lines(x: Column) -> Column:
    return F.split(x, "\n", -1)


def first(values: Column) -> Column:
    """First element, or the empty string."""
    return F.coalesce(F.get(values, 0), F.lit(""))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often ``body`` uses it."""
    return F.get(F.transform(F.array(value), body), 0)


def filled(value: Column) -> Column:
    """The value, computed once; null if it is empty."""
    return F.get(F.filter(F.array(value), lambda x: x != ""), 0)


def first_filled(values: Column) -> Column:
    """First element that is neither null nor empty, or the empty string."""
    return first(F.filter(values, lambda x: x != ""))


def first_value(rows: Column, value: Callable[[Column], Column]) -> Column:
    """First ``value`` of a row that is neither null nor empty, or the empty string; rows behind it are not read."""
    return F.aggregate(rows, F.lit(""), lambda s, x: F.when(s != "", s).otherwise(F.coalesce(value(x), F.lit(""))))


def most_frequent(values: Column) -> Column:
    """The non-empty value that occurs most often, of equal ones the one that comes first; else the empty string."""

    def pick(own):
        times = F.transform(own, lambda x: F.size(F.filter(own, lambda y: y == x)))
        return let(times, lambda n: first(F.slice(own, F.greatest(F.array_position(n, F.array_max(n)), F.lit(1)).cast("int"), F.lit(1))))

    return F.coalesce(let(F.filter(values, lambda x: F.coalesce(x, F.lit("")) != ""), pick), F.lit(""))


def with_next(rows: Column) -> Column:
    """Each line ``x`` with the one behind it, ``y``; the last has none."""
    return let(rows, lambda r: F.zip_with(r, F.slice(r, 2, F.greatest(F.size(r), F.lit(1))), lambda x, y: F.struct(x.alias("x"), F.coalesce(y, F.lit("")).alias("y"))))


def first_of(*candidates: Column) -> Column:
    """First candidate that is neither null nor empty, else the empty string."""
    return F.coalesce(*map(filled, candidates), F.lit(""))


def digits(x: Column, table: tuple[str, str] | None = None) -> Column:
    """Digits of ``x`` after its look-alike letters became digits."""
    return F.regexp_replace(F.translate(x, *table) if table else x, "[^0-9]", "")


def word_digits(x: Column) -> Column:
    """``x`` with letters and signs that stand for digits as those digits; other characters stay."""
    return F.translate(x, *lx.WORD_DIGITS)


def literal_array(values) -> Column:
    """Array of words without blanks; one literal, so that plans stay short."""
    return F.split(F.lit(" ".join(values)), " ")


def one_of(word: Column, values) -> Column:
    """Is the word among words that have neither blanks nor commas?"""
    return F.find_in_set(word, F.lit(",".join(values))) > 0


def clean_text(x: Column) -> Column:
    """ASCII, line feeds, tabs and accented Latin letters; other characters become blanks, which are squeezed."""
    # of ASCII only control characters go, and one class is tried faster than five ranges
    other = F.regexp_replace(x, "[^\\x20-\\x7E\\n\\t\\u00C0-\\u024F]", " ")
    kept = F.when(x.rlike("[^\\x00-\\x7F]"), other).otherwise(F.regexp_replace(x, "\\p{Cntrl}(?<![\n\t])", " "))
    # most texts have nothing to squeeze
    has = lambda y, part: F.contains(y, F.lit(part))
    blanks = lambda y: F.when(has(y, "  ") | has(y, "\t"), F.regexp_replace(y, "[ \t]+", " ")).otherwise(y)
    feeds = lambda y: F.when(has(y, "\n\n\n"), F.regexp_replace(y, "\n{3,}", "\n\n")).otherwise(y)
    return strip(let(let(kept, blanks), feeds))


def quality_score(x: Column) -> Column:
    """Weighted score of recognised text: words, keywords, numbers and names add, noisy lines and short tokens take away."""
    count = lambda pattern: F.regexp_count(x, F.lit(pattern)).cast("int")
    name = r"^[A-Z][A-Z\s]{3,35}$"

    def scored(p):
        lower, trimmed = p["lower"], p["trimmed"]
        found = lambda values: F.size(F.filter(literal_array(values), lambda v: F.contains(lower, v)))
        numbers = 6 * count(r"\d{2}[-/]\d{2}[-/]\d{4}") + 6 * count(r"(?U)(?=\d)\b\d{14,16}\b") + 3 * count(r"(?U)(?=\d)\b\d{10,13}\b")
        base = F.least(count(r"\p{Alpha}{4,}"), F.lit(60)) + 8 * found(lx.KEYWORDS) + numbers
        names = F.size(F.filter(trimmed, lambda y: (F.length(y) >= 5) & y.rlike(name) & let(F.size(words(y)), lambda n: n.between(2, 5))))
        numbered = F.size(F.filter(trimmed, lambda y: y.rlike(r"^\d+\.\s+[A-Z][A-Z\s]{3,35}$")))
        extra = 15 * names + 12 * numbered + 10 * count(r"\d{1,2}[-/.]\d{1,2}[-/.]\d{4}") + 10 * found(lx.SCORE_CITIES)
        filled = F.size(F.filter(trimmed, lambda y: y != ""))
        noisy = F.size(F.filter(trimmed, lambda y: (y != "") & ~y.rlike(r"\p{Alpha}{3,}")))
        # tokens with three letters or digits are counted where they stand; the others are short
        tokens, long_ = count(r"(?U)\S+"), count(r"(?U)(?<!\S)[^\sA-Za-z0-9]*+[A-Za-z0-9](?:[^\sA-Za-z0-9]*+[A-Za-z0-9]){2}\S*+")
        excess = let(tokens, lambda n: F.coalesce(F.try_divide((n - long_).cast("double"), n) - 0.5, F.lit(0.0)))

        def total(q):
            noise = (q["base"] * (noisy / F.greatest(F.lit(1), filled)) * F.lit(0.9)).cast("int")
            both = q["base"] + q["extra"]
            return both - noise - (both * F.greatest(F.lit(0.0), excess)).cast("int")

        return let(F.struct(base.alias("base"), extra.alias("extra")), total)

    parts = F.struct(F.lower(x).alias("lower"), F.transform(lines(x), strip).alias("trimmed"))
    return let(parts, scored)


def slugify(x: Column, sep: str = "_") -> Column:
    low = F.regexp_replace(F.lower(strip(F.coalesce(x, F.lit("")))), "[^a-z0-9]+", sep)
    return F.regexp_replace(low, f"^[{sep}\\-]+|[{sep}\\-]+$", "")


def normalize_for_compare(x: Column) -> Column:
    """Form in which extracted and true values are compared; underscores disappear."""
    low = F.replace(F.lower(strip(x)), F.lit("/"), F.lit("-"))
    return strip(F.regexp_replace(F.regexp_replace(low, r"[^a-z0-9\- ]", ""), r"\s+", " "))


def normalize_date(x: Column) -> Column:
    """``DD-MM-YYYY`` with padded day and month; other shapes stay as they are."""
    pad = lambda y: F.when(F.length(y) < 2, F.lpad(y, 2, "0")).otherwise(y)

    def joined(own):
        parts = F.split(F.regexp_replace(strip(own), r"[\s/]", "-"), "-", -1)
        return let(parts, lambda p: F.when(F.size(p) == 3, F.concat_ws("-", pad(F.get(p, 0)), pad(F.get(p, 1)), F.get(p, 2))).otherwise(own))

    return let(x, joined)


def clean_name(x: Column) -> Column:
    """Slug of at most five words that may belong to a name."""
    # what stands between ASCII letters becomes one blank
    text = F.btrim(F.regexp_replace(x, r"\P{Alpha}+", " "))
    kept = lambda own: F.filter(F.split(F.lower(own), " ", -1), lambda w: (F.length(w) >= 2) & ~one_of(w, lx.NAME_STOPWORDS))
    return let(text, lambda own: F.when(F.length(own) < 3, "").otherwise(F.array_join(F.slice(kept(own), 1, 5), "_")))


def is_plausible_name(slug: Column) -> Column:

    def judge(own):
        plain = F.replace(own, F.lit("_"), F.lit(""))
        vowels = let(plain, lambda p: F.coalesce(F.try_divide(F.regexp_count(p, F.lit("(?i)[aeiou]")).cast("double"), F.length(p)), F.lit(1.0)))

        def shaped(parts):
            free = F.size(F.filter(parts, lambda w: ~one_of(w, lx.NAME_STOPWORDS)))
            few = F.size(parts).between(1, 4) & F.forall(parts, lambda w: F.length(w) >= 3)
            return few & (free >= F.when(F.size(parts) > 2, 2).otherwise(1))

        return (F.length(own) >= 5) & let(F.split(own, "_", -1), shaped) & (vowels >= 0.20)

    return let(slug, judge)


def plausible(slug: Column) -> Column:
    """The slug if it reads as a name, else the empty string."""
    return let(slug, lambda own: F.when(is_plausible_name(own), own).otherwise(""))


def normalize_city(x: Column) -> Column:
    """City of the list that a noisy reading stands for, in upper case; the reading itself if none does.

    Tried in turn: the whole, a city inside it, the rest after one to four leading letters, and endings of four to seven letters.
    """
    cities = literal_array(lx.CITIES)

    def city(low):
        inside = F.when(low.rlike("|".join(lx.CITIES)), F.get(F.filter(cities, lambda c: F.contains(low, c)), 0))

        def ending(n):
            # the first city that has the reading's last letters as its own last ones
            own = [c for c in lx.CITIES if len(c) >= n]
            at = F.array_position(literal_array([c[-n:] for c in own]), F.right(low, F.lit(n)))
            return F.when(F.length(low) >= n, F.get(literal_array(own), at.cast("int") - 1))

        return F.coalesce(F.when(one_of(low, lx.CITIES), low), inside, *map(ending, range(4, 8)))

    def named(own):
        return let(F.lower(strip(own)), lambda low: F.when(low == "", own).otherwise(F.coalesce(city(low), own)))

    return F.upper(let(x, named))
