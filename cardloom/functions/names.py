"""Names that have no label: behind a card's number, in capitals, or at their place on a driving licence.

Each rule is one pass over the lines; the state of the pass is the distance to the last trigger and the name found.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from cardloom.functions import lexicon as lx
from cardloom.functions.text import clean_name, digits, first_of, first_value, let, lines, one_of, plausible, strip

#: Largest share of a line that may be neither letters nor blanks.
NOISE = 0.40


def filled_lines(text: Column) -> Column:
    return F.filter(F.transform(lines(text), strip), lambda x: x != "")


def first_behind(rows: Column, trigger: Callable[[Column], Column], value: Callable[[Column], Column], within: int) -> Column:
    """First non-empty ``value`` of a line that has a ``trigger`` among the ``within`` lines before it."""
    far = 1 << 30
    start = F.struct(F.lit(far).alias("gap"), F.lit("").alias("found"))

    def step(s, x):
        found = F.when(s["gap"] < within, value(x)).otherwise("")
        grown = F.struct(F.when(trigger(x), 0).otherwise(F.least(s["gap"], F.lit(far - 1)) + 1).alias("gap"), found.alias("found"))
        return F.when(s["found"] != "", s).otherwise(grown)  # lines behind the one that gave a value are not read

    return F.aggregate(rows, start, step, lambda s: s["found"])


def name_after_number(text: Column) -> Column:
    """Slug of the first plausible line among the five behind a line that reads as an identity number or has its label."""

    def number(x):
        long_ = let(F.regexp_replace(x, r"[\s\-]", ""), lambda p: (F.length(p) >= 14) & (F.length(digits(p, lx.NIK_DIGITS)) >= 13))
        # shorter lines have no fourteen characters left
        return ((F.length(x) >= 14) & long_) | F.upper(x).rlike(r"(?U)(?=N)\bN\s*[I1]\s*K\b")

    stop = "|".join(lx.NUMBER_STOPWORDS)

    def value(x):
        quiet = F.length(F.regexp_replace(x, r"[\p{Alpha}\s]+", "")) <= NOISE * F.length(x)
        # a stop word counts where no letter stands beside it
        free = ~F.lower(x).rlike(f"(?<![a-z])(?:{stop})(?![a-z])")
        return F.when(x.rlike("[A-Za-z]") & quiet & free, plausible(clean_name(x))).otherwise("")

    return first_behind(filled_lines(text), number, value, 5)


def name_in_capitals(text: Column) -> Column:
    """Slug of the first of fifteen lines that has two to four words of three letters or more, all capitals, and no digit."""

    def value(x):
        bare = ~F.regexp_replace(x, "^[^A-Za-z]+", "").rlike(r"\d")

        def judge(parts):
            slug = F.lower(F.array_join(parts, "_"))
            capital = F.forall(parts, lambda w: (w == F.upper(w)) & ~one_of(F.lower(w), lx.CAPITAL_STOPWORDS))
            return F.when(F.size(parts).between(2, 4) & bare & capital, plausible(slug)).otherwise("")

        return let(F.regexp_extract_all(x, F.lit("([A-Za-z]{3,})"), F.lit(1)), judge)

    return first_value(F.slice(filled_lines(text), 1, 15), value)


def name_on_licence(text: Column) -> Column:
    """Slug behind the licence's number, else in the field numbered 1, else behind the heading."""
    number = lambda x: x.rlike(r"\d{3,4}[\s\-]+\d{3,6}[\s\-]*\d{3,8}|\d{10,16}")
    heading = lambda x: F.upper(x).rlike("POLR[I1]|MENGEMUDI")
    field = r"^1[\s.]+([A-Z][A-Za-z\s]{2,35})$"

    def read(rows):
        behind = first_behind(rows, number, lambda x: F.when(x.rlike(r"^[\d\s\-.]+$"), "").otherwise(plausible(clean_name(x))), 4)
        numbered = first_value(rows, lambda x: F.when(x.startswith("1"), plausible(clean_name(F.regexp_extract(x, field, 1)))))
        below = first_behind(rows, heading, lambda x: F.when(x.rlike(r"""^[\d|!.,#"'\-()\[\]]"""), "").otherwise(plausible(clean_name(x))), 1 << 30)
        return first_of(behind, numbered, below)

    return let(filled_lines(text), read)


def unlabelled_name(text: Column, kind: Column) -> Column:
    """Name by the rules of a card's kind; empty for kinds that have none."""
    return (
        F.when(kind == "ktp", first_of(name_after_number(text), name_in_capitals(text)))
        .when(kind == "sim", name_on_licence(text))
        .otherwise("")
    )
