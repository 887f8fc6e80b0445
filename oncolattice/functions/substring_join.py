"""Which texts contain which needles, without comparing all with all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .text import unnest

GRAM = 3


def _chars(text: Column) -> Column:
    return F.array_remove(F.split(text, ""), "")


def _grams(text: Column, n: Column | int) -> Column:
    """Distinct substrings of length n."""
    width = F.lit(n) if isinstance(n, int) else n
    places = F.when(F.length(text) >= width, F.sequence(F.lit(1), F.length(text) - width + 1)).otherwise(F.array().cast("array<int>"))
    chars = F.transform(F.array(_chars(text)), lambda c: F.transform(places, lambda p: F.array_join(F.slice(c, p, width), "")))
    return F.array_distinct(F.element_at(chars, 1))


def _inner_words(text: Column) -> Column:
    """Words with a blank on both sides within the text."""
    parts = F.split(text, " ")
    return F.array_remove(F.array_distinct(F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 2, F.lit(0)))), "")


def _anchored(texts: DataFrame, low: DataFrame, keys_of_text: Column, keys_of_needle: Column) -> DataFrame:
    """Pairs found by an equi-join on each needle's rarest key, then compared.

    While keys are counted a needle goes by 128 bits of hash, as it stands once for each of its keys.
    """
    name = [F.xxhash64("needle", "_low").alias("_a"), F.xxhash64(F.reverse("needle"), F.length("needle")).alias("_b")]
    wanted = low.select(*name, F.explode(keys_of_needle).alias("_key"))
    held = unnest(texts, ["text_id"], keys_of_text, "_key").drop("_pos")
    counts = held.join(wanted.select("_key").distinct(), "_key", "left_semi").groupBy("_key").agg(F.count("*").alias("_texts"))
    rarest = (wanted.join(counts, "_key", "left").groupBy("_a", "_b")
              .agg(F.min(F.struct(F.coalesce("_texts", F.lit(0)).alias("k"), F.col("_key").alias("key"))).alias("m"))
              .filter(F.col("m.k") > 0).select("_a", "_b", F.col("m.key").alias("_key"))
              .join(low.select("needle", "_low", *name), ["_a", "_b"]).select("needle", "_low", "_key"))
    candidates = held.join(rarest, "_key").select("text_id", "needle", "_low")
    return candidates.join(texts.select("text_id", F.lower("text").alias("_text")), "text_id").filter(
        F.col("_text").contains(F.col("_low"))).select("text_id", "needle")


def _by_part(texts: DataFrame, low: DataFrame) -> DataFrame:
    """Pairs of needles of one or two words, by the words of the texts.

    A text that holds the needle has a word that holds the needle's longest part. So the distinct words of
    the texts, far fewer than their places, meet the parts by grams, and the texts meet these words whole.
    A needle of blanks only has an empty part, and every text is compared with it.
    """
    parts = low.withColumn("_part", F.array_max(F.transform(F.split("_low", " "), lambda p: F.struct(F.length(p).alias("n"), p.alias("p"))))["p"])
    held = unnest(texts, ["text_id"], F.array_distinct(F.split(F.lower("text"), " ")), "_word").drop("_pos")
    vocabulary = held.select(F.col("_word").alias("text_id"), F.col("_word").alias("text")).filter("text <> ''").distinct()
    wanted = parts.filter("_part <> ''").select(F.col("_part").alias("needle"), F.col("_part").alias("_low")).distinct()
    width = F.least(F.length("_low"), F.lit(GRAM))
    grams = F.array_distinct(F.concat(*[_grams(F.col("text"), n) for n in range(1, GRAM + 1)]))
    words = _anchored(vocabulary, wanted, grams, _grams(F.col("_low"), width)).select(F.col("text_id").alias("_word"), F.col("needle").alias("_part"))
    found = held.join(words.join(parts, "_part"), "_word").select("text_id", "needle", "_low").distinct()
    sure = found.filter(~F.col("_low").contains(" ")).select("text_id", "needle")
    blank = parts.filter("_part = ''").select("needle", "_low", F.lit(1).alias("_k")).join(texts.select("text_id", F.lit(1).alias("_k")), "_k").select("text_id", "needle", "_low")
    maybe = found.filter(F.col("_low").contains(" ")).unionByName(blank)
    checked = maybe.join(texts.select("text_id", F.lower("text").alias("_text")), "text_id").filter(F.col("_text").contains(F.col("_low")))
    return sure.unionByName(checked.select("text_id", "needle"))


def contains_pairs(texts: DataFrame, needles: DataFrame) -> DataFrame:
    """(text_id, needle) for ``texts(text_id, text)`` that contain a non-empty ``needles(needle)``, ignoring case.

    A text that holds a needle of three words or more holds its inner words whole; one that holds a shorter
    needle has a word that holds a part of it. So texts and needles meet by an equi-join on words and only
    then are compared. One plan serves any number of needles, and nothing runs while planning.
    """
    low = needles.select("needle", F.lower("needle").alias("_low")).distinct().filter("_low <> ''")
    wordy = low.filter(F.size(_inner_words(F.col("_low"))) > 0)
    other = low.filter(F.size(_inner_words(F.col("_low"))) == 0)
    by_word = _anchored(texts, wordy, _inner_words(F.concat(F.lit(" "), F.lower("text"), F.lit(" "))), _inner_words(F.col("_low")))
    return by_word.unionByName(_by_part(texts, other))


def top_matches(texts: DataFrame, needles: DataFrame, order: list[str], k: int) -> DataFrame:
    """The first k texts per distinct needle by ``order`` (columns of texts), with ``rank``.

    Ranks do not depend on who asks, so they are found once per distinct needle. An
    empty needle matches every text and gets the k first of all.
    """
    pairs = contains_pairs(texts, needles)
    rank = Window.partitionBy("needle").orderBy(*order, "text_id")
    hits = pairs.join(texts.drop("text"), "text_id").withColumn("rank", F.row_number().over(rank)).filter(F.col("rank") <= k)
    first = texts.drop("text").orderBy(*order, "text_id").limit(k).withColumn("_k", F.lit(1))
    empty = needles.filter("needle = ''").select("needle").distinct().withColumn("_k", F.lit(1)).join(first, "_k").drop("_k").withColumn("rank", F.row_number().over(rank))
    return hits.unionByName(empty)
