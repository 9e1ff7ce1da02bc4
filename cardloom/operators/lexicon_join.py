"""Words against a lexicon that is a table, however large it and the texts are.

A bitmap of the lexicon, of a size that doesn't depend on it, comes first: a word whose bit isn't set is in no lexicon and needs no shuffle.  What is left, words of the lexicon and a few
that share a bit with one, meets the lexicon in a merge join.  The words that a sample shows to be very frequent, ``HOT`` at most, are met by the part of the lexicon that has these
words, which is broadcast for that reason, so no task gets all the rows of one word.  The sample decides where a word is looked up, not what is found.

Defined results
* words are compared as they are; a null word is in no lexicon; a word that the lexicon repeats counts once; an empty lexicon has no word;
* rows that repeat stay; other columns are carried, whatever they are called.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits of the map: 2048 bitmaps of 4 KB at most.
BITS = 1 << 26
#: Frequent words that are looked up in a broadcast at most, and one row in so many that is read to find them.
HOT, SAMPLE = 1000, 64
#: The same for words of whole texts, where each word that is met there is neither shuffled nor sorted: some 8 MB.
HOT_OF_TEXTS = 1 << 16
#: Rows of the sample from which a word is frequent.
LEAST = 20


def _place(word: Column) -> Column:
    return F.pmod(F.xxhash64(word), F.lit(BITS))


def bitmap(lexicon: DataFrame) -> DataFrame:
    """``bucket, bits`` of a table ``word``."""
    at = _place(F.col("word"))
    return lexicon.groupBy(F.bitmap_bucket_number(at).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("bits"))


def frequent(words: DataFrame) -> DataFrame:
    """``word``: the most frequent words of a sample of the rows of ``word, row``."""
    few = words.where(F.pmod(F.xxhash64("row", "word"), F.lit(SAMPLE)) == 0)
    return _most(few, HOT)


def _most(few: DataFrame, n: int) -> DataFrame:
    return few.groupBy("word").count().where(F.col("count") >= LEAST).orderBy(F.desc("count"), "word").limit(n).select("word")


def _is_set(word: Column) -> Column:
    at = F.bitmap_bit_position(_place(word))
    byte = F.conv(F.hex(F.substring("bits", F.shiftright(at, 3).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return F.coalesce(F.getbit(byte, F.pmod(at, F.lit(8)).cast("int")) == 1, F.lit(False))


def marked(rows: DataFrame, word: str, lexicon: DataFrame, entry: str, row: Column, found: str = "found") -> DataFrame:
    """``rows`` with a boolean column ``found``: is the word in the lexicon?  ``row`` is anything that tells rows with the same word apart; it spreads the sample."""
    names = rows.columns
    inner = rows.select(F.struct(*names).alias("own"), F.col(word).alias("word"), F.xxhash64(row).alias("row"))
    entries = lexicon.select(F.col(entry).alias("word")).where("word IS NOT NULL").distinct()
    # 8 MB at most
    tried = inner.join(F.broadcast(bitmap(entries)), F.bitmap_bucket_number(_place(F.col("word"))) == F.col("bucket"), "left").select("own", "word", "row", _is_set(F.col("word")).alias("may"))
    hot = frequent(inner.where("word IS NOT NULL").select("word", "row"))
    there = entries.withColumn("there", F.lit(True))
    # HOT words at most
    known = F.broadcast(hot.join(there, "word", "left").select(F.col("word").alias("hot"), F.coalesce("there", F.lit(False)).alias("in_lexicon")))
    told = tried.join(known, F.col("word") == F.col("hot"), "left")
    done = told.where("NOT may OR in_lexicon IS NOT NULL").select("own", (F.col("may") & F.coalesce("in_lexicon", F.lit(False))).alias(found))
    rest = told.where("may AND in_lexicon IS NULL").select("own", "word")
    met = rest.join(there.hint("merge"), "word", "left").select("own", F.coalesce("there", F.lit(False)).alias(found))
    return done.unionByName(met).select(*[F.col("own")[n].alias(n) for n in names], found)


def lexicon_counts(texts: DataFrame, key: str, text: str, lexicon: DataFrame, entry: str) -> DataFrame:
    """``key, n_words, n_known``: ASCII words of each text, in lower case, and how many of them are in the lexicon (whose entries are in lower case).

    Texts are cut into words once and words are told where they are read: frequent ones by a broadcast of ``HOT_OF_TEXTS`` rows at most, the others by the bitmap.  Only those whose bit is set are
    shuffled, beside one row for each text, and meet the lexicon in a merge join.
    """
    words = F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit("([A-Za-z]+)"), F.lit(1))
    cut = lambda own: own.select(F.col(key).alias("key"), F.explode_outer(words).alias("word")).withColumn("word", F.lower("word"))
    there = lexicon.select(F.col(entry).alias("word")).where("word IS NOT NULL").distinct().withColumn("there", F.lit(True))
    # whole texts of a sample: the others needn't be cut for it
    hot = _most(cut(texts.where(F.pmod(F.xxhash64(key), F.lit(SAMPLE)) == 0)).where("word IS NOT NULL"), HOT_OF_TEXTS)
    known = hot.join(there, "word", "left").select(F.col("word").alias("hot"), F.coalesce("there", F.lit(False)).alias("in_lexicon"))
    told = cut(texts).join(F.broadcast(known), F.col("word") == F.col("hot"), "left")
    unsure = F.when(F.col("in_lexicon").isNull(), F.col("word"))
    # 8 MB at most
    told = told.join(F.broadcast(bitmap(there)), F.bitmap_bucket_number(_place(unsure)) == F.col("bucket"), "left")
    open_word = F.when(F.col("in_lexicon").isNull() & _is_set(F.col("word")), F.col("word")).alias("word")
    counts = told.groupBy("key", open_word).agg(F.count(told["word"]).alias("n"), F.count_if("in_lexicon").alias("n_known"))
    # a text's own row has no word to look up: it goes anywhere
    by = F.coalesce("word", F.xxhash64("key").cast("string")).alias("by")
    met = counts.select("key", "n", "n_known", F.col("word").isNotNull().alias("is_open"), by).join(there.hint("merge"), F.col("by") == F.col("word"), "left")
    out = met.groupBy("key").agg(F.sum("n").alias("n_words"), F.sum(F.when(F.col("is_open") & F.col("there"), F.col("n")).otherwise(F.col("n_known"))).alias("n_known"))
    return out.withColumnRenamed("key", key)
