"""Personal data: base patterns, and words that give away an entity by their co-occurrence with it in the corpus.

An entity is a value found by the base patterns, a term any word of the corpus outside such findings. Over the
documents of the corpus, a term t predicts an entity e with P(e | t) = n(t, e) / n(t). The estimate is discounted by
its own evidence, (d - 1) / d where term and entity meet in d different texts (the share of the meetings that is left
when one text is held out), so words that meet an entity in a single text tell nothing and copies of a text add
nothing. The term then reveals log(P(e | t) N / n(e)) of the entity's information log(N / n(e)). A term that reveals
too large a share, and makes the entity at least as likely as not, is generalised wherever it stands in the corpus, and removed if it never occurs without the entity.
"""

from __future__ import annotations

import itertools
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import ALNUM, LOWER, chunks, text_bytes, word_hashes, words, written

KINDS = ("email", "ip", "card", "phone", "general", "removed")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")

THRESHOLD = 0.8   # share of an entity's information above which a term is not left as it is
CERTAINTY = 0.5   # discounted P(e | t) below which a term is left, so that words of other documents are not taken for one entity's
BROADCAST = 1_000_000  # so many terms (8 bytes) may be sent to all tasks; more are joined by a shuffle


def _luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = int(d) * (1 + k % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def scan(text: str) -> list[tuple[int, int, str]]:
    """Base findings (start, end, kind) by kind, then start."""
    found, done = [], 0
    at = text.find("@")
    while at >= 0:  # the leftmost match around each @, in time linear in the text
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            found.append((start, m.end(), "email"))
            done = m.end()
        else:
            done = at + 1 if start < at else done
        at = text.find("@", max(at + 1, done))
    if DIGIT.search(text):
        found += [(*m.span(), "ip") for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
        for m in CARD.finditer(text):
            if m.end() - m.start() >= 16:
                digits = re.sub("[^0-9]", "", m[0])
                if 16 <= len(digits) <= 19 and _luhn(digits):
                    found.append((*m.span(), "card"))
        if "+" in text:
            found += [(*m.span(), "phone") for m in PHONE.finditer(text) if 8 <= len(DIGIT.findall(m[0])) <= 15]
    return found


HOLE = "\uffff"  # stands for a finding, so that no part of a word that it cuts becomes a term


def _entity(text: str, start: int, end: int, kind: str) -> str:
    return f"{kind}:{text[start:end].lower() if kind == 'email' else re.sub('[^0-9.+]', '', text[start:end])}"


def _terms(text: str, found: list) -> list[str]:
    """Words of a text outside all findings."""
    parts, at = [], 0
    for start, end, _ in sorted(found):
        parts.append(text[at:max(at, start)])
        at = max(at, end)
    return [w for w in set(TERM.findall(HOLE.join([*parts, text[at:]]))) if HOLE not in w]


def _hashes(terms: list[str]) -> np.ndarray:
    data, offsets = text_bytes(pa.array(terms, pa.string()))
    return word_hashes(LOWER[data], offsets[:-1], offsets[1:]) if terms else np.zeros(0, np.uint64)


SPANS = "array<struct<start: long, end: long, kind: string>>"
SPAN = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string())]))


def detect(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Base findings of every document, its entities, and for documents with entities the hashes of their terms."""

    def run(batches):
        for batch in batches:
            base, entities, terms = [], [], []
            for text in batch.column(2).to_pylist():
                found = scan(text) if text else []
                base.append([{"start": s, "end": e, "kind": k} for s, e, k in found])
                entities.append(sorted({_entity(text, *f) for f in found}))
                terms.append(np.unique(_hashes(_terms(text, found))).view(np.int64).tolist() if found else [])
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], batch.column(3), pa.array(base, SPAN), pa.array(entities, pa.list_(pa.string())),
                                              pa.array(terms, pa.list_(pa.int64()))], ["key", "doc_id", "hash", "base", "entities", "terms"])

    text = F.col(text_col).cast("string")
    return (docs.select(F.xxhash64(F.col(id_col), text).alias("key"), F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("hash"))
            .mapInArrow(run, f"key long, doc_id long, hash long, base {SPANS}, entities array<string>, terms array<long>"))


def _document_counts(docs: DataFrame, terms: np.ndarray | None, text_col: str) -> DataFrame:
    """In how many documents each term occurs (of `terms`, sorted hashes, or of all)."""
    wanted = docs.sparkSession.sparkContext.broadcast(terms)

    def run(batches):
        known = wanted.value
        total = None if known is None else np.zeros(len(known), np.int64)
        for batch in batches:
            data, offsets = text_bytes(batch.column(0))
            parts = [np.zeros(0, np.uint64)]
            for first, last in chunks(offsets):
                low = LOWER[data[offsets[first]:offsets[last]]]
                starts, ends, row = words(low, offsets[first:last + 1] - offsets[first], ALNUM)
                hashed = word_hashes(low, starts, ends)
                doc = np.repeat(np.arange(last - first), np.diff(row))
                if known is not None:
                    at = np.minimum(np.searchsorted(known, hashed), len(known) - 1)
                    same = known[at] == hashed
                    hashed, doc = hashed[same], doc[same]
                order = np.lexsort((hashed, doc))
                hashed, doc = hashed[order], doc[order]
                fresh = np.ones(len(hashed), bool)
                fresh[1:] = (hashed[1:] != hashed[:-1]) | (doc[1:] != doc[:-1])
                parts.append(hashed[fresh])
            term, n = np.unique(np.concatenate(parts), return_counts=True)
            if total is not None:  # one row a term for the whole task
                total[np.searchsorted(known, term)] += n
                continue
            yield pa.RecordBatch.from_arrays([pa.array(term.view(np.int64)), pa.array(n.astype(np.int64))], ["term", "n"])
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(known[total > 0].view(np.int64)), pa.array(total[total > 0])], ["term", "n"])

    found = docs.select(F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).mapInArrow(run, "term long, n long")
    return found.groupBy("term").agg(F.sum("n").alias("n_t"))


def disclosing(docs: DataFrame, found: DataFrame, threshold: float, certainty: float, text_col: str) -> DataFrame:
    """Terms that reveal at least `threshold` of some entity's information with `certainty`: term, kind, and the share."""
    n = float(found.count())
    # one row per different text with findings; an entity of a single text has no term that could be told from chance
    texts = (found.where(F.size("entities") > 0).groupBy("hash")
             .agg(F.count("*").alias("copies"), F.first("entities").alias("entities"), F.first("terms").alias("terms")))
    texts = written(texts)
    sizes = (texts.select("copies", F.explode("entities").alias("entity")).groupBy("entity")
             .agg(F.sum("copies").alias("n_e"), F.count("*").alias("texts")).where((F.col("texts") > 1) & (F.col("n_e") < n)).drop("texts"))
    sizes = written(sizes)
    held = texts.select("hash", F.explode("entities").alias("entity")).join(sizes.select("entity"), "entity").groupBy("hash").agg(F.collect_list("entity").alias("held"))
    met = (texts.join(held, "hash").select("copies", "held", F.explode("terms").alias("term")).select("copies", "term", F.explode("held").alias("entity"))
           .groupBy("entity", "term").agg(F.sum("copies").alias("n_et"), F.count("*").alias("d")).where("d > 1"))
    # n_t is at least what the texts with findings show, and the share sinks with n_t: most pairs end here
    seen = texts.select("copies", F.explode("terms").alias("term")).groupBy("term").agg(F.sum("copies").alias("n_t"))
    pairs = written(met.join(sizes, "entity").join(seen, "term").where((_share(n) >= threshold) & (_told() >= certainty)).drop("n_t"))
    terms = pairs.select("term").distinct()
    if pairs.isEmpty():
        return docs.sparkSession.createDataFrame([], "term long, kind string, share double")
    counts = _document_counts(docs, _few(terms), text_col)
    return (pairs.join(counts, "term").withColumn("share", _share(n)).where((F.col("share") >= threshold) & (_told() >= certainty))
            # a word may reveal several entities: the stronger measure holds
            .groupBy("term").agg(F.max(F.when(F.col("n_t") <= F.col("n_et"), "removed").otherwise("general")).alias("kind"), F.max("share").alias("share")))


def _told():
    """Discounted P(e | t) from n_et, n_t and d."""
    return F.col("n_et") / F.col("n_t") * (F.col("d") - 1) / F.col("d")


def _share(n: float):
    """Part of an entity's information that a term reveals, from n_et, n_t, n_e and d; `n` documents."""
    return F.log(_told() * n / F.col("n_e")) / F.log(n / F.col("n_e"))


def _few(terms: DataFrame) -> np.ndarray | None:
    """Sorted hashes of `terms` (a distinct column term), or None if they are too many to send to all tasks."""
    if terms.count() > BROADCAST:
        return None
    return np.sort(terms.toArrow().column(0).to_numpy().view(np.uint64))


def _places(docs: DataFrame, terms: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Every place of `terms` (term, kind) in every document: key, start, end, kind."""
    wanted = docs.sparkSession.sparkContext.broadcast(_few(terms.select("term")))

    def run(batches):
        known = wanted.value
        for batch in batches:
            data, offsets = text_bytes(batch.column(1))
            keys = batch.column(0).to_numpy()
            for first, last in chunks(offsets):
                raw = data[offsets[first]:offsets[last]]
                at = offsets[first:last + 1] - offsets[first]
                low = LOWER[raw]
                starts, ends, row = words(low, at, ALNUM)
                hashed = word_hashes(low, starts, ends)
                doc = np.repeat(np.arange(last - first), np.diff(row))
                if known is not None:
                    near = np.minimum(np.searchsorted(known, hashed), len(known) - 1)
                    same = known[near] == hashed
                    starts, ends, hashed, doc = starts[same], ends[same], hashed[same], doc[same]
                points = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
                base = points[at[:-1]][doc]
                yield pa.RecordBatch.from_arrays([pa.array(keys[first + doc]), pa.array(hashed.view(np.int64)), pa.array(points[starts] - base), pa.array(points[ends] - base)],
                                                 ["key", "term", "start", "end"])

    text = F.col(text_col).cast("string")
    placed = docs.select(F.xxhash64(F.col(id_col), text).alias("key"), F.coalesce(text, F.lit("")).alias("text")).mapInArrow(run, "key long, term long, start long, end long")
    # rows with the same id and text share a key, so places are made distinct
    return placed.join(terms.select("term", "kind"), "term").groupBy("key", "start", "end").agg(F.max("kind").alias("kind"))


def _merged(found: DataFrame) -> DataFrame:
    """key, doc_id, base, and spans: base ones and those of `extra` outside them, by kind, then start."""
    rank = {k: r for r, k in enumerate(KINDS)}

    def run(batches):
        for batch in batches:
            spans = []
            for base, extra in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                if extra and base:
                    starts, ends = (np.sort(np.array([x[c] for x in base])) for c in ("start", "end"))
                    # a word is free if as many findings end before it as start before its end
                    extra = [x for x in extra if np.searchsorted(ends, x["start"], "right") == np.searchsorted(starts, x["end"], "left")]
                spans.append(sorted(base + (extra or []), key=lambda x: (rank[x["kind"]], x["start"])))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(spans, SPAN)], ["key", "doc_id", "base", "spans"])

    return found.select("key", "doc_id", "base", "extra").mapInArrow(run, f"key long, doc_id long, base {SPANS}, spans {SPANS}")


def personal_data(docs: DataFrame, threshold: float = THRESHOLD, certainty: float = CERTAINTY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Personal data of every whole text: key, doc_id, base and spans as arrays of (start, end, kind).

    Places are code points, end exclusive. base has emails, IP addresses, card and phone numbers; spans adds every
    place, in any document, of a word that reveals at least `threshold` of the information of an entity, with `certainty` or more, kind general, or
    occurs only with it, kind removed, unless it lies inside a base finding. Both are sorted by kind as listed in KINDS,
    then start. Null and empty texts have none. Each row stands for itself; `key` is a hash of id and text, so
    repeated rows share it. Counts are over all rows; copies of one text are one piece of evidence. An entity of one
    text, or of every document, is told by no word. Other columns are ignored. Words and texts are compared by 64-bit
    hashes, A-Z of words lower-cased.
    """
    found = written(detect(docs, id_col, text_col))
    told = written(disclosing(docs, found, threshold, certainty, text_col))
    if told.isEmpty():
        return found.select("key", "doc_id", "base", F.col("base").alias("spans"))  # scan() sorts them already
    extra = _places(docs, told, id_col, text_col).groupBy("key").agg(F.collect_list(F.struct("start", "end", "kind")).alias("extra"))
    return _merged(found.join(extra, "key", "left"))


def sanitise(text: str, spans: list[tuple[int, int, str]]) -> str:
    """Text with findings replaced by their kind, general words by a class, removed ones by nothing. Overlaps are joined.

    There is no dictionary of more general terms: the class is the word's own form, [number] with a digit,
    [name] with a capital letter in front, else [word].
    """
    out, at = [], 0
    for start, end, kind in sorted(spans):
        if end <= at:
            continue
        out.append(text[at:max(at, start)])
        if start >= at:
            word = text[start:end]
            form = "number" if DIGIT.search(word) else "name" if word[:1].isupper() else "word"
            out.append("" if kind == "removed" else f"[{form if kind == 'general' else kind}]")
        at = end
    return "".join([*out, text[at:]])


def sanitised(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """`docs` with personal data taken out of the text; a null text stays null, all rows and columns stay."""
    found = personal_data(docs, id_col=id_col, text_col=text_col, **options).where(F.size("spans") > 0).dropDuplicates(["key"]).select("key", "spans")
    keyed = docs.select(F.xxhash64(F.col(id_col), F.col(text_col).cast("string")).alias("key"), F.struct(*[docs[c] for c in docs.columns]).alias("doc"))

    at, width = [c.lower() for c in docs.columns].index(text_col.lower()), len(docs.columns)

    def run(batches):
        for batch in batches:  # the columns of docs, then text and spans, told by place and not by name
            new = [t if not s or t is None else sanitise(t, [(x["start"], x["end"], x["kind"]) for x in s])
                   for t, s in zip(batch.column(width).to_pylist(), batch.column(width + 1).to_pylist())]
            yield pa.RecordBatch.from_arrays([pa.array(new, pa.string()) if i == at else batch.column(i) for i in range(width)], batch.schema.names[:width])

    joined = keyed.join(found, "key", "left").select("doc.*", F.col(f"doc.{text_col}").cast("string"), "spans")
    joined = joined.toDF(*docs.columns, *_free(docs.columns, 2))
    return joined.mapInArrow(run, docs.withColumn(text_col, F.col(text_col).cast("string")).schema)


def _free(names: list[str], n: int) -> list[str]:
    """`n` names that are not among `names`, in any case."""
    taken = {x.lower() for x in names}
    return list(itertools.islice((x for x in (f"extra{k}" for k in itertools.count()) if x not in taken), n))
