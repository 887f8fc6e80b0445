"""Extractor output to typed entities and relations.

A chunk's raw answer is one row; its entities and relations stay arrays on that row until a
caller explodes them, so parsing and filtering never shuffle.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import strip, unnest
from ..sources.vocabulary import CANONICAL_URIS, NODE_TYPES, PREDICATES

# --------------------------------------------------------------------------
# Skipped types, thresholds, blocklist
# --------------------------------------------------------------------------
SKIP_TYPES = ["ontology", "technical_appendix"]
FALLBACK_TYPE = "ClinicalCategory"
ENTITY_FLOOR, RELATION_FLOOR = 0.6, 0.5
PERSON = r"[A-Z][a-záéíóúñ]+ [A-Z][a-záéíóúñ]+(?:\s+[A-Z][a-záéíóúñ]+)?"
SOFTWARE = (
    r"(?:Python|Java(?:Script)?|TypeScript|Docker|Git(?:Hub)?|LangChain|LangGraph|"
    r"FastAPI|Neo4j|Ollama|OpenAI|Anthropic|Claude|GPT|LLM|RAG|Vector|Redis|"
    r"Celery|Kafka|AWS|Azure|GCP|Kubernetes|Terraform|Grafana|Prometheus|"
    r"Framework|Library|API|SDK|REST|GraphQL|gRPC|HTTP|HTTPS|JSON|YAML|XML|"
    r"React|Vue|Angular|Node(?:\.js)?|npm|pip|conda|Poetry)")
PLACES = (r"(?:Ciudad|City|Country|Pa[ií]s|Region|Hospital|Universidad|University|"
          r"Institute|Company|Corp|Inc|Ltd|GmbH)")
BLOCKLIST = {
    # any case everywhere, terms may run on into a longer word
    "parity": rf"(?iU)^(?:{PERSON}|{SOFTWARE}[\s\-\w]*|{PLACES}[\s\-\w]*)$",
    # names by their capitals, terms only as whole words
    "strict": rf"(?U)^(?:{PERSON}|(?i:{SOFTWARE})(?:[\s\-]+[\s\-\w]*)?|(?i:{PLACES})(?:[\s\-]+[\s\-\w]*)?)$",
}


# ---- running an extractor ----------------------------------------------------
def dictionary_answers(content: Column, labels: Iterable[str] = tuple(CANONICAL_URIS)) -> Column:
    """Offline extractor: an entity for each known label that a text contains, as the answer of a model would be."""
    known = F.array(*[F.struct(F.lit(f"e{n}").alias("id"), F.lit(label).alias("label"), F.lit(FALLBACK_TYPE).alias("type")) for n, label in enumerate(labels)])
    found = F.filter(known, lambda e: content.contains(e["label"]))
    return F.to_json(F.struct(found.alias("entities"), F.array().cast("array<string>").alias("relations")))


def select_chunks(chunks: DataFrame, skip_types=tuple(SKIP_TYPES)) -> DataFrame:
    """EXT1: chunks worth sending; done before the Python stage, where filters cannot be pushed."""
    return chunks.filter(~F.col("content_type").isin(list(skip_types)))


def run_extractor(chunks: DataFrame, extractor: Callable[[list[str]], list[str]] | None = None) -> DataFrame:
    """EXT2: raw answer per chunk from a batch callable, or from the dictionary without one.

    A failing batch is halved until the failing chunks stand alone; these are tried once more and then
    give a row with an error, so one bad chunk costs one row. An empty answer is asked for once more on its own.
    """
    if extractor is None:
        return chunks.select("chunk_id", "section", dictionary_answers(F.coalesce("content", F.lit(""))).alias("raw"),
                             F.lit(None).cast("string").alias("call_error"))

    def ask(texts: list) -> list[tuple[str, str | None]]:
        try:
            raw = list(extractor(texts))
            if len(raw) != len(texts):
                raise ValueError(f"{len(raw)} answers for {len(texts)} texts")
            return [(r or "", None) for r in raw]
        except Exception as exc:  # noqa: BLE001 - reported on the row
            if len(texts) == 1:
                return [("", f"extractor call failed: {exc}")]
            half = len(texts) // 2
            return ask(texts[:half]) + ask(texts[half:])

    def batches(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            texts = part["content"].tolist()
            answers = ask(texts) if texts else []
            for n, (raw, _) in enumerate(answers):
                if not raw.strip():
                    answers[n] = ask([texts[n]])[0]
            yield pd.DataFrame({"chunk_id": part["chunk_id"], "section": part["section"], "raw": [a for a, _ in answers],
                                "call_error": pd.Series([e for _, e in answers], index=part.index, dtype="object")})

    return chunks.select("chunk_id", "section", "content").mapInPandas(
        batches, "chunk_id string, section string, raw string, call_error string")


# ---- parsing -----------------------------------------------------------------
def clean_json(raw: Column) -> Column:
    """EXT3: answer without thinking spans and code fences."""
    text = strip(F.regexp_replace(strip(raw), "(?s)<think>.*?</think>", ""))
    text = F.regexp_replace(text, r"(?U)^```(?:json)?\s*", "")
    return strip(F.regexp_replace(text, r"(?U)\s*```$", ""))


def _type(obj: Column, path: str) -> Column:
    return F.schema_of_variant(F.try_variant_get(obj, path, "variant"))


def _text(obj: Column, path: str) -> Column:
    return F.try_variant_get(obj, path, "string")


def _is_text(obj: Column, path: str) -> Column:
    return F.coalesce(_type(obj, path) == "STRING", F.lit(False))


def _text_or_none(obj: Column, path: str) -> Column:
    return F.coalesce(_type(obj, path), F.lit("VOID")).isin("VOID", "STRING")


def _confidence(obj: Column) -> Column:
    """Number between 0 and 1, numbers as text included; 1 when absent, null when unusable."""
    value = F.try_variant_get(obj, "$.confidence", "double")
    return F.when(_type(obj, "$.confidence").isNull(), F.lit(1.0)).when(value.between(0.0, 1.0), value)


def _members(root: Column, path: str) -> Column:
    return F.coalesce(F.try_variant_get(root, path, "array<variant>"), F.array().cast("array<variant>"))


def _entities(root: Column) -> Column:
    """EXT5: usable entities in answer order."""
    def usable(e):
        label_type = F.coalesce(_type(e, "$.label"), F.lit("STRING"))
        return (_is_text(e, "$.id") & (label_type == "STRING") & _text_or_none(e, "$.definition")
                & _text_or_none(e, "$.source_quote") & _text_or_none(e, "$.candidate_uri") & _confidence(e).isNotNull())

    def typed(e):
        kind = _text(e, "$.type")
        return F.struct(
            _text(e, "$.id").alias("id"), F.coalesce(_text(e, "$.label"), F.lit("")).alias("label"),
            F.when(kind.isin(NODE_TYPES), kind).otherwise(FALLBACK_TYPE).alias("type"),
            _text(e, "$.definition").alias("definition"), _text(e, "$.source_quote").alias("source_quote"),
            _text(e, "$.candidate_uri").alias("candidate_uri"), _confidence(e).alias("confidence"))
    return F.transform(F.filter(_members(root, "$.entities"), usable), typed)


def _relations(root: Column) -> Column:
    """EXT6: relations with a known predicate and both ends."""
    def usable(r):
        return (_is_text(r, "$.subject_id") & _is_text(r, "$.object_id") & _text_or_none(r, "$.evidence")
                & F.coalesce(_text(r, "$.predicate").isin(PREDICATES), F.lit(False)) & _confidence(r).isNotNull())

    def typed(r):
        return F.struct(_text(r, "$.subject_id").alias("subject_id"), _text(r, "$.predicate").alias("predicate"),
                        _text(r, "$.object_id").alias("object_id"), _confidence(r).alias("confidence"),
                        _text(r, "$.evidence").alias("evidence"))
    return F.transform(F.filter(_members(root, "$.relations"), usable), typed)


def parse(raw: DataFrame) -> DataFrame:
    """EXT4-EXT6: (chunk_id, section, entities, relations, error, raw_response).

    An answer that is no JSON object gives empty lists and an error with its first
    200 characters; an empty answer gives empty lists without one.
    """
    root = F.try_parse_json("_clean")
    failed = (strip(F.col("raw")) != "") & F.coalesce(~F.schema_of_variant("_root").startswith("OBJECT"), F.lit(True))
    call_error = F.col("call_error") if "call_error" in raw.columns else F.lit(None).cast("string")
    return (
        raw.withColumn("_clean", clean_json(F.col("raw")))
        .withColumn("_root", root)
        .withColumn("error", F.coalesce(call_error, F.when(
            failed, F.concat(F.lit("JSONDecodeError | raw[:200]="), F.substring("raw", 1, 200)))))
        .select("chunk_id", "section", _entities(F.col("_root")).alias("entities"), _relations(F.col("_root")).alias("relations"),
                "error", F.when(F.col("error").isNotNull(), F.col("raw")).alias("raw_response"))
    )


# ---- filters -----------------------------------------------------------------
def _closed(relations, ids):
    return F.filter(relations, lambda r: F.array_contains(ids, r["subject_id"]) & F.array_contains(ids, r["object_id"]))


def _ids(entities):
    return F.transform(entities, lambda e: e["id"])


def filter_domain(parsed: DataFrame, mode: str = "parity") -> DataFrame:
    """EXT7 and EXT8: drop blocklisted labels, then relations that lost an end."""
    kept = F.filter("entities", lambda e: ~e["label"].rlike(BLOCKLIST[mode]))
    return parsed.withColumn("entities", kept).withColumn("relations", _closed("relations", _ids("entities")))


def filter_confidence(parsed: DataFrame, entity_floor: float = ENTITY_FLOOR, relation_floor: float = RELATION_FLOOR) -> DataFrame:
    """EXT9 and EXT10: drop ids never seen at the entity floor, weak and orphaned relations."""
    strong = _ids(F.filter("entities", lambda e: e["confidence"] >= entity_floor))
    return (
        parsed.withColumn("_strong", strong)
        .withColumn("entities", F.filter("entities", lambda e: F.array_contains("_strong", e["id"])))
        .withColumn("relations", F.filter(_closed("relations", F.col("_strong")), lambda r: r["confidence"] >= relation_floor))
        .drop("_strong")
    )


def extract(chunks: DataFrame, extractor=None, skip_types=tuple(SKIP_TYPES), mode: str = "parity") -> DataFrame:
    """EXT1-EXT10 in one go."""
    return filter_confidence(filter_domain(parse(run_extractor(select_chunks(chunks, skip_types), extractor)), mode))


def totals(extractions: DataFrame) -> DataFrame:
    """EXT11: entities, relations and errors."""
    return extractions.agg(F.coalesce(F.sum(F.size("entities")), F.lit(0)).alias("entities"),
                           F.coalesce(F.sum(F.size("relations")), F.lit(0)).alias("relations"), F.count("error").alias("errors"))


def entity_rows(extractions: DataFrame) -> DataFrame:
    """One row per entity with its place in the answer."""
    return unnest(extractions, ["chunk_id", "section"], F.col("entities"), "e", "pos").select(
        "chunk_id", "section", "pos", F.col("e.id").alias("local_id"), "e.label", "e.type", "e.definition", "e.source_quote",
        "e.candidate_uri", "e.confidence")


def relation_rows(extractions: DataFrame) -> DataFrame:
    return unnest(extractions, ["chunk_id"], F.col("relations"), "r", "pos").select("chunk_id", "pos", "r.*")
