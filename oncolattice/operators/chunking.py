"""Documents to typed chunks.

A document is one row and stays one row until its chunks are exploded, so
chunking is a narrow projection without a shuffle. Sentences are cut into windows by
folding over word counts only: the fold carries two integers and the spans found
so far, and the texts are sliced afterwards.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.prefix import running_start
from ..functions.text import U, any_term, lits, strip, unnest, words

# --------------------------------------------------------------------------
# Patterns and limits
# --------------------------------------------------------------------------
DEFAULT_SECTION = "Introducción"
HEADING = r"\n(#{1,3}\s+.+)\n"
CODE = r"(```[\w]*\n[\s\S]*?```)"
TABLE = r"(\|[^\n]+\|\n(?:\|[-| :]+\|\n)?(?:\|[^\n]+\|\n?)+)"
ALGORITHM = (r"((?:(?:NODO[-_]\d+|ENTRADA:|ACCIÓN:|COMENTARIO[-_]\w*):.*\n"
             r"(?:.*\n){0,30}?)(?=\n#{1,3}\s|\z))")
SENTENCE_GAP = r"(?<=[.!?])\s+(?=[A-ZÁÉÍÓÚÑ])"
TYPE_PATTERNS = {
    "algorithm": r"(?:NODO[-_]\d|ENTRADA:|ACCIÓN:|SÍ\s*→|→|algorithm|flowchart|decision|paso\s+\d)",
    "criteria": r"(?:IHC\s*[0-9+]+|ISH|ratio|señales/célula|score|tinción|staining)",
    "recommendation": r"(?:recomienda|should|must|guideline|recomend|se debe)",
    "fractal_mapping": r"(?:fractal|lacun|dimension|D0|D1|multifractal|entropía)",
    "qa": r"(?:calidad|quality|control|validation|QA|EQA|proficiency|aseguramiento)",
    "ontology": r"(?:owl:|rdfs:|her2:|frac:|ncit:|namespace|@prefix|subClassOf|equivalentClass)",
    "table": r"^\|.+\|$",
}
# A word that every hit of the type's pattern holds, in lower case
TYPE_WORDS = {
    "algorithm": ["nodo", "entrada:", "acción:", "→", "algorithm", "flowchart", "decision", "paso"],
    "criteria": ["ihc", "ish", "ratio", "señales/célula", "score", "tinción", "staining"],
    "recommendation": ["recom", "should", "must", "guideline", "se debe"],
    "fractal_mapping": ["fractal", "lacun", "dimension", "d0", "d1", "entropía"],
    "qa": ["calidad", "quality", "control", "validation", "qa", "proficiency", "aseguramiento"],
    "ontology": ["owl:", "rdfs:", "her2:", "frac:", "ncit:", "namespace", "@prefix", "subclassof", "equivalentclass"],
    "table": ["|"],
}
FOLDED = ("ſıİ\u212a", "siik")  # count as plain letters when case is ignored
MIN_WINDOW_CHARS = 50
MIN_ALGORITHM_CHARS = 80
MIN_PAGE_WORDS = 60

DOT_ALL_BUT_NEWLINE = "(?d)"
# Stands for the opening bracket of a placeholder until chunk numbers are known.
OPEN = "\ue000"


def content_type(text: Column) -> Column:
    """CHK11: the type with most pattern hits; earlier types win ties, none is general.

    Counting with the patterns is dear, looking for their fixed words is not: a type whose words are all absent
    is not counted. The words are looked for where letters that only match when case is ignored (long s,
    i with and without dot, Kelvin sign) are folded, so no hit of a pattern is missed.
    """
    def typed(t, low):
        scored = []
        for rank, (name, pattern) in enumerate(TYPE_PATTERNS.items()):
            flags = "(?md)" if name == "table" else "(?iU)"
            hits = F.when(any_term(low, TYPE_WORDS[name]), F.regexp_count(t, F.lit(flags + pattern))).otherwise(0)
            scored.append(F.struct(hits.alias("hits"), F.lit(-rank).alias("order"), F.lit(name).alias("name")))
        return _let(F.array_max(F.array(*scored)), lambda best: F.when(best["hits"] > 0, best["name"]).otherwise("general"))
    # folded and counted once also where this column ends up in a filter, which shares no work between its parts
    return _let(text, lambda t: _let(F.lower(F.translate(t, *FOLDED)), lambda low: typed(t, low)))


def sentences(text: Column) -> Column:
    """CHK6: sentences of the trimmed text."""
    return F.split(strip(text), U + SENTENCE_GAP)


def window_spans(counts: Column, size: int, overlap: int) -> Column:
    """Word spans (start, len) of the windows over sentences of the given word counts.

    A window closes before the sentence that would take it beyond ``size``; the
    next one opens with its last ``overlap`` words. Sentences are never cut.
    """
    if overlap < 1:
        raise ValueError("overlap must be at least one word")
    span = "array<struct<start:int,len:int>>"
    start = F.struct(F.lit(0).alias("start"), F.lit(0).alias("len"), F.array().cast(span).alias("out"))

    def step(acc, n):
        kept = F.least(F.lit(overlap), acc["len"])
        close = (acc["len"] + n > size) & (acc["len"] > 0) & (n > 0)
        return F.struct(
            F.when(close, acc["start"] + acc["len"] - kept).otherwise(acc["start"]).alias("start"),
            (F.when(close, kept).otherwise(acc["len"]) + n).alias("len"),
            F.when(close, F.concat(acc["out"], F.array(F.struct(acc["start"].alias("start"), acc["len"].alias("len")))))
            .otherwise(acc["out"]).alias("out"))

    def finish(acc):
        last = F.array(F.struct(acc["start"].alias("start"), acc["len"].alias("len")))
        return F.when(acc["len"] > 0, F.concat(acc["out"], last)).otherwise(acc["out"])

    return F.aggregate(counts, start, step, finish)


def _let(value: Column, body) -> Column:
    """Evaluate ``value`` once and use it in ``body``."""
    return F.element_at(F.transform(F.array(value), body), 1)


def windows(text: Column, size: int = 500, overlap: int = 100) -> Column:
    """CHK7: overlapping windows of whole sentences, those of 50 characters or more."""
    def slices(sentence_words):
        flat = F.flatten(sentence_words)
        spans = window_spans(F.transform(sentence_words, lambda w: F.size(w)), size, overlap)
        return _let(flat, lambda all_words: F.transform(
            spans, lambda s: F.array_join(F.slice(all_words, s["start"] + 1, s["len"]), " ")))
    texts = _let(F.transform(sentences(text), words), slices)
    return F.filter(texts, lambda t: F.length(t) >= MIN_WINDOW_CHARS)


def sections(text: Column, keep_text: bool = False) -> Column:
    """CHK1 and CHK2: array of (section, text) between the headings of a document.

    A stretch that itself opens with a heading mark has no text of its own and is
    left out; with ``keep_text`` its leading heading lines name the section instead.
    """
    head = DOT_ALL_BUT_NEWLINE + U + HEADING
    title = lambda h: strip(F.regexp_replace(h, U + r"^#{1,3}\s+", ""))
    names = F.concat(lits([DEFAULT_SECTION]), F.transform(F.regexp_extract_all(text, F.lit(head), F.lit(1)), title))
    parts = F.zip_with(names, F.split(text, head, -1), lambda n, t: F.struct(n.alias("section"), t.alias("text")))
    if keep_text:
        lead = DOT_ALL_BUT_NEWLINE + r"^(?:#{1,3}[ \t]+.+(?:\n|\z))+"

        def unlead(part):
            opening = F.regexp_extract(part["text"], lead, 0)
            last = F.element_at(F.split(strip(opening), "\n"), -1)
            return F.struct(
                F.when(opening != "", title(last)).otherwise(part["section"]).alias("section"),
                F.when(opening != "", F.substring(part["text"], F.length(opening) + 1, F.length(part["text"])))
                .otherwise(part["text"]).alias("text"))
        parts = F.transform(parts, unlead)
    else:
        parts = F.filter(parts, lambda p: ~p["text"].rlike(U + r"^#{1,3}\s+"))
    return F.filter(parts, lambda p: strip(p["text"]) != "")


def blocks(text: Column, pattern: str) -> Column:
    """CHK3-CHK5: all blocks a pattern finds, whole."""
    return F.regexp_extract_all(text, F.lit(DOT_ALL_BUT_NEWLINE + U + pattern), F.lit(1))


def _mark(kind: str, stem: Column, number: Column) -> Column:
    return F.concat(F.lit(OPEN + kind + "_"), stem, F.lit("_c"), F.format_string("%04d", number), F.lit("]"))


def _residue(text: Column, found: Column, pattern: str, marks) -> Column:
    """Text with each found block replaced by ``marks(block, place)``."""
    pieces = F.split(text, DOT_ALL_BUT_NEWLINE + U + pattern, -1)
    tail = F.concat(F.transform(found, marks), F.array(F.lit("")))
    return F.array_join(F.zip_with(pieces, tail, lambda p, m: F.concat(p, m)), "")


def _numbered(kinds, contents):
    return F.transform(contents, lambda c: F.struct(F.lit(kinds).alias("kind"), c.alias("content")))


def chunk_markdown(docs: DataFrame, size: int = 500, overlap: int = 100, keep_text: bool = False,
                   appendix=()) -> DataFrame:
    """CHK1-CHK8, CHK11, CHK12: chunks of Markdown documents (source_doc, text).

    Per section: fenced code, tables, decision text, then windows over what is
    left, where each block leaves a placeholder with its chunk id. Numbers run
    through the document. A block found twice keeps two chunks and one placeholder.
    Every chunk of a document named in ``appendix`` is of type technical_appendix.
    """
    stem = F.regexp_replace("source_doc", r"(?<=.)\.[^.]+$", "")
    first = lambda found, b: (F.array_position(found, b) - 1).cast("int")
    long = lambda b: F.length(strip(b)) >= MIN_ALGORITHM_CHARS

    def cut_code(p):
        found = blocks(p["text"], CODE)
        return F.struct(p["section"].alias("section"), found.alias("code"), p["text"].alias("text"))

    def cut_tables(p):
        rest = _residue(p["text"], p["code"], CODE, lambda b: _mark("CODE_BLOCK", F.col("_stem"), first(p["code"], b)))
        return _let(rest, lambda t: F.struct(p["section"].alias("section"), p["code"].alias("code"),
                                             blocks(t, TABLE).alias("tables"), t.alias("text")))

    def cut_algorithms(p):
        rest = _residue(p["text"], p["tables"], TABLE, lambda b: _mark(
            "TABLE", F.col("_stem"), F.size(p["code"]) + first(p["tables"], b)))
        return _let(rest, lambda t: F.struct(p["section"].alias("section"), p["code"].alias("code"), p["tables"].alias("tables"),
                                             blocks(t, ALGORITHM).alias("steps"), t.alias("text")))

    def cut_windows(p):
        kept = F.filter(p["steps"], long)
        rest = _residue(p["text"], p["steps"], ALGORITHM, lambda b: F.when(long(b), _mark(
            "ALGO_BLOCK", F.col("_stem"), F.size(p["code"]) + F.size(p["tables"]) + first(kept, b))).otherwise(b))
        return F.struct(p["section"].alias("section"), F.concat(
            _numbered("code_block", F.transform(p["code"], strip)), _numbered("table", F.transform(p["tables"], strip)),
            _numbered("algorithm", F.transform(kept, strip)), _numbered("text", windows(rest, size, overlap))).alias("chunks"))

    staged = (
        docs.select("source_doc", stem.alias("_stem"), sections(F.col("text"), keep_text).alias("_parts"))
        .withColumn("_parts", F.transform("_parts", cut_code))
        .withColumn("_parts", F.transform("_parts", cut_tables))
        .withColumn("_parts", F.transform("_parts", cut_algorithms))
        .withColumn("_parts", F.transform("_parts", cut_windows))
    )
    counts = F.transform("_parts", lambda p: F.size(p["chunks"]))
    starts = F.aggregate(counts, F.array(F.lit(0)), lambda acc, n: F.concat(acc, F.array(F.element_at(acc, -1) + n)))
    with_start = F.zip_with("_parts", F.slice(starts, F.lit(1), F.size("_parts")), lambda p, s: F.transform(
        p["chunks"], lambda c: F.struct(p["section"].alias("section"), s.alias("start"), c["kind"].alias("kind"), c["content"].alias("content"))))
    rows = unnest(staged, ["source_doc", "_stem"], F.flatten(with_start), "_c", "_n")

    mark = OPEN + r"(CODE_BLOCK|TABLE|ALGO_BLOCK)_([^" + OPEN + r"]*?)_c(\d{4,})\]"
    content = F.col("_c.content")
    kinds = F.regexp_extract_all(content, F.lit(mark), F.lit(1))
    numbers = F.regexp_extract_all(content, F.lit(mark), F.lit(3))
    ids = F.zip_with(kinds, numbers, lambda k, n: F.concat(
        F.lit("["), k, F.lit("_"), F.col("_stem"), F.lit("_c"),
        F.format_string("%04d", n.cast("int") + F.col("_c.start")), F.lit("]")))
    filled = F.array_join(F.zip_with(F.split(content, mark, -1), F.concat(ids, F.array(F.lit(""))), lambda p, m: F.concat(p, m)), "")
    return (
        rows.withColumn("content", F.when(content.contains(OPEN), filled).otherwise(content))
        .select(
            F.concat("_stem", F.lit("_c"), F.format_string("%04d", F.col("_n"))).alias("chunk_id"), "source_doc",
            F.col("_c.section").alias("section"), "content",
            F.when(F.col("source_doc").isin(list(appendix)), "technical_appendix")
            .when(F.col("_c.kind").isin("table", "algorithm"), F.col("_c.kind"))
            .otherwise(content_type(F.col("content"))).alias("content_type"),
            F.lit(None).cast("int").alias("page_ref"),
            F.when(F.col("_c.kind") != "text", F.create_map(F.lit("block_type"), F.col("_c.kind")))
            .otherwise(F.create_map().cast("map<string,string>")).alias("metadata"))
    )


def page_chunk_id(doc: Column, page: Column, number: Column) -> Column:
    """CHK10: id of a short page's chunk."""
    return F.concat(F.regexp_replace(F.lower(doc), "[^a-z0-9]", "_"), F.format_string("_p%04d_c%04d", page, number))


def page_pieces(text: Column, short: Column, size: int = 500, overlap: int = 100) -> Column:
    """CHK9: a page under 60 words whole, a longer one in windows."""
    return F.when(short, F.array(strip(text))).otherwise(windows(text, size, overlap))


def chunk_pages(pages: DataFrame, size: int = 500, overlap: int = 100) -> DataFrame:
    """CHK9 and CHK10 over (source_doc, page_num, text); numbers run through the document.

    Pieces are counted in a narrow pass that keeps no text; page numbers and counts are shuffled for the
    running numbers, in stretches of pages, so that one huge document does not end up in one task. Then
    page texts are shuffled once, to meet their numbers, and cut.
    """
    full = pages.filter(strip(F.col("text")) != "").select("source_doc", "page_num", "text")
    short = (F.length("text") < 2 * MIN_PAGE_WORDS - 1) | (F.size(words(F.col("text"))) < MIN_PAGE_WORDS)  # so many words need that many characters
    counts = full.select("source_doc", "page_num", F.size(page_pieces(F.col("text"), short, size, overlap)).alias("_k"))
    starts = running_start(counts, "source_doc", "page_num", "_k", "_first").drop("_k")
    rows = unnest(full.join(starts, ["source_doc", "page_num"]).withColumn("_short", short), ["source_doc", "page_num", "_short", "_first"],
                  page_pieces(F.col("text"), F.col("_short"), size, overlap), "content", "_n")
    number = (F.col("_first") + F.col("_n")).cast("int")
    stem = F.regexp_replace("source_doc", r"(?<=.)\.[^.]+$", "")
    return rows.select(
        F.when(F.col("_short"), page_chunk_id(F.col("source_doc"), F.col("page_num"), number))
        .otherwise(F.concat(stem, F.format_string("_c%04d", number))).alias("chunk_id"),
        "source_doc", F.concat(F.lit("Page "), F.col("page_num").cast("string")).alias("section"), "content",
        content_type(F.col("content")).alias("content_type"), F.lit(None).cast("int").alias("page_ref"),
        F.create_map().cast("map<string,string>").alias("metadata"))


def all_chunks(markdown: DataFrame, pages: DataFrame) -> DataFrame:
    """CHK13: chunks of both sources."""
    return markdown.unionByName(pages)


def stored_text(col: Column, chars: int | None = None) -> Column:
    """CHK14: text as kept on the chunk node, whole unless a number of characters is given."""
    return col if chars is None else F.substring(col, 1, chars)
