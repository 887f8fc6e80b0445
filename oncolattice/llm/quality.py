"""Quality rules as a short-circuit cascade, in DataFrame functions only."""

from __future__ import annotations

import time

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arrays import written

SAMPLE = 1000  # documents on which cost and selectivity of the rules are estimated, the first that come
SAMPLE_CHARS = 100_000  # longer texts stay out of the sample, which passes the driver
SPACE = r"[ \t\n\x0B\f\r]+"

WINDOW = 200  # words of a stretch in which different words are counted, so that the share does not sink with length
# scripts that put no spaces between words: a "word" there is a clause or a line
UNSPACED = r"[\\p{IsHan}\\p{IsHiragana}\\p{IsKatakana}\\p{IsThai}\\p{IsLao}\\p{IsKhmer}\\p{IsMyanmar}\\p{IsTibetan}]"

#: Further rules: name -> SQL over the columns of `features` that is true for a document to reject.
RULES = {
    "symbols": "10 * n_symbols > n_words",
    "repeated_lines": "2 * n_dup_lines > size(lines)",
    "word_length": f"word_chars < 2 * n_words or (word_chars > 15 * n_words and "
                   f"3 * (length(text) - length(regexp_replace(text, '{UNSPACED}', ''))) < word_chars)",
    "shouting": r"10 * (length(text) - length(regexp_replace(text, '\\p{Lu}', ''))) > 4 * word_chars",
    "few_letters": r"2 * size(filter(words, w -> w rlike '\\p{L}')) < n_words",
    "few_words": f"20 * aggregate(sequence(1, greatest(size(words), 1), {WINDOW}), 0, (a, i) -> a + size(array_distinct(slice(words, i, {WINDOW})))) < n_words",
}
BASE = "n_words < 10 or 100 * n_repeat_words > 20 * n_words"


def _let(value: Column, body) -> Column:
    """`body` of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def _once(df: DataFrame, **columns: Column) -> DataFrame:
    """`df` with columns that are computed once per row: a generator keeps filters and later projections
    from repeating them inside other expressions."""
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


def features(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """All columns of `docs` with text, words, lines and the base counts beside them under `__doc`."""
    row = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("__doc"),
                      F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text"))
    cut = _once(row, words=F.filter(F.split("text", SPACE), lambda w: w != ""),
                lines=F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^ \t\n\x0B\f\r]")))
    n = F.size("words")
    gram = F.transform(F.sequence(F.lit(0), n - 5), lambda i: F.xxhash64(*[F.col("words")[i + k] for k in range(5)]))
    # equal windows have equal hashes, so most documents are done here; the others are compared word by word
    repeats = F.when(n >= 6, _let(gram, lambda g: F.size(F.array_distinct(g)) < F.size(g))).otherwise(False)

    def covered(grams: Column) -> Column:
        def same(k):
            return (k >= 0) & (k < F.size(grams))
        places = F.filter(F.transform(grams, lambda x, k: F.when(
            (same(k - 1) & (F.get(grams, k - 1)["g"] == x["g"])) | (same(k + 1) & (F.get(grams, k + 1)["g"] == x["g"])), x["i"])),
            lambda p: p.isNotNull())
        return F.aggregate(F.sort_array(places), F.struct(F.lit(0).alias("n"), F.lit(0).alias("to")),
                           lambda a, p: F.struct((a["n"] + p + 5 - F.greatest(p, a["to"])).alias("n"), (p + 5).alias("to")), lambda a: a["n"])

    pairs = F.transform(F.sequence(F.lit(1), n - 4), lambda i: F.struct(F.concat_ws(" ", F.slice("words", i, 5)).alias("g"), i.alias("i")))
    return _once(
        cut, n_words=n.cast("long"),
        word_chars=F.length(F.translate("text", " \t\n\x0b\f\r", "")).cast("long"),
        n_symbols=(F.length("text") - F.length(F.translate("text", "#*$%&|<>", ""))).cast("long"),
        n_dup_lines=(F.size("lines") - F.size(F.array_distinct("lines"))).cast("long"),
        n_repeat_words=F.when(repeats, _let(F.sort_array(pairs), covered)).otherwise(0).cast("long"))


def cascade_order(sample: DataFrame, rules: dict[str, str]) -> list[str]:
    """Rules by rejections per second on the sample, each counted on what the rules before it leave."""
    held = written(sample)

    def seconds(rule: str) -> float:
        start = time.perf_counter()
        held.agg(F.sum(F.expr(f"cast({rule} as int)"))).first()
        return time.perf_counter() - start

    seconds("true")
    idle = min(seconds("true") for _ in range(2))
    cost = {name: max(seconds(rule) - idle, 1e-3) for name, rule in rules.items()}
    # at most 2 ** rules groups, whatever the size of the sample
    groups = held.groupBy(*[F.coalesce(F.expr(rule), F.lit(False)).alias(f"r{i}") for i, rule in enumerate(rules.values())]).count().collect()
    names, order = list(rules), []
    while len(order) < len(names):
        gain = {n: sum(g["count"] for g in groups if g[f"r{names.index(n)}"] and not any(g[f"r{names.index(o)}"] for o in order))
                for n in names if n not in order}
        order.append(max(gain, key=lambda n: (gain[n] / cost[n], -cost[n])))
    return order


def quality(docs: DataFrame, rules: dict[str, str] | None = None, base: str = BASE, sample_rows: int = SAMPLE, text_col: str = "text") -> DataFrame:
    """Every document (as struct `__doc`) with its counts, base_failed, rejected_by and kept.

    Words are cut at ASCII white space. word_chars counts code points in words, n_symbols the characters
    #*$%&|<>, n_dup_lines the \\n-split lines with a word that equal an earlier line, n_repeat_words the words
    inside 5-word windows found at least twice in the text. `rules` map names to SQL over these columns,
    words, lines and text; a rule that gives null does not reject. They run after the base rule as one CASE,
    so a document is tested until the first rejection; the order is estimated on `sample_rows` documents
    and changes only the work done and which rule is named, never `kept`. Null, empty and blank texts have no words
    and fail the base rule. few_words compares the different words of stretches of WINDOW words, added up over the whole
    text, with its words, so a long text is judged like its parts; word_length spares texts of which a third or more is
    written in scripts without spaces. Repeated rows are judged alike; an empty table gives an empty result.
    """
    rules = RULES if rules is None else rules
    counted = features(docs, text_col)
    judged = counted.select("*", F.coalesce(F.expr(base), F.lit(False)).alias("base_failed"))
    text = F.col(text_col).cast("string")
    # take() reads as few partitions as it needs; a limit inside a plan would cut and shuffle every partition
    taken = docs.select(text.alias("text")).where(F.length("text") <= SAMPLE_CHARS).take(sample_rows) if len(rules) > 1 else []
    sample = docs.sparkSession.createDataFrame([(t.text,) for t in taken], "text string")
    order = cascade_order(features(sample).select("text", "words", "lines", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
                          .where(f"not ({base})"), rules) if len(rules) > 1 else list(rules)
    case = F.when(F.col("base_failed"), F.lit("base"))
    for name in order:
        case = case.when(F.expr(rules[name]), F.lit(name))
    return judged.select("__doc", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
                         case.alias("rejected_by")).withColumn("kept", F.col("rejected_by").isNull())
