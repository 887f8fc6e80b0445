"""Labels to canonical URIs and stable node ids.

Exact tiers are joins against the curated dictionary (tens of rows), which Spark
broadcasts because it is a local relation of known size; the fuzzy tier works on the distinct
labels still open and is joined back. A larger dictionary passed in is joined without a hint:
broadcast when it measures small, split on skewed labels when not.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.similarity import candidates, sequence_match
from ..functions.text import strip
from ..sources import vocabulary as v

# Trusted prefixes, cutoff
TRUSTED = ["NCIt:", "her2:", "snomed:"]
CUTOFF = 0.75


def normalize_label(label: Column) -> Column:
    """RES6: runs of hyphens and spaces as one underscore."""
    return F.regexp_replace(strip(label), r"(?U)[-\s]+", "_")


def local_uri(label: Column) -> Column:
    """RES5: fallback URI from a safe form of the label."""
    safe = F.regexp_replace(strip(F.lower(label)), "[^a-z0-9_]", "_")
    return F.concat(F.lit("her2:"), F.regexp_replace(safe, "^_+|_+$", ""))


def node_id(label: Column) -> Column:
    """RES7: node id from a label."""
    text = F.replace(F.replace(strip(label), F.lit(">"), F.lit("gt")), F.lit("<"), F.lit("lt"))
    text = F.replace(F.translate(text, "()", ""), F.lit("%"), F.lit("pct"))
    text = F.regexp_replace(F.regexp_replace(text, r"(?U)[-\s/]+", "_"), "[^a-zA-Z0-9_]", "_")
    return F.regexp_replace(text, "^_+|_+$", "")


def trusted_uri(candidate: Column) -> Column:
    """RES1: a supplied URI with a known prefix."""
    ok = F.lit(False)
    for prefix in TRUSTED:
        ok = ok | candidate.startswith(prefix)
    return F.when(ok, candidate)


def exact_match(entities: DataFrame, dictionary: DataFrame, snomed: DataFrame) -> DataFrame:
    """RES2: adds exact_uri and exact_snomed from the label, else from its normal form."""
    known = dictionary.select(F.col("label").alias("_label"), F.col("uri").alias("_uri"))
    terms = known.join(snomed.select(F.col("label").alias("_label"), "snomed_uri"), "_label", "left")

    def side(suffix):
        return terms.select(*[F.col(c).alias(c + suffix) for c in terms.columns])
    return (
        entities.join(side("1"), F.col("label") == F.col("_label1"), "left")
        .join(side("2"), normalize_label(F.col("label")) == F.col("_label2"), "left")
        .withColumn("exact_uri", F.coalesce("_uri1", "_uri2"))
        .withColumn("exact_snomed", F.when(F.col("_uri1").isNotNull(), F.col("snomed_uri1")).otherwise(F.col("snomed_uri2")))
        .drop("_label1", "_uri1", "snomed_uri1", "_label2", "_uri2", "snomed_uri2")
    )


def case_insensitive(entities: DataFrame, dictionary: DataFrame) -> DataFrame:
    """RES4: adds ci_uri, the first dictionary entry equal but for case."""
    low = dictionary.groupBy(F.lower("label").alias("_low")).agg(F.min_by("uri", "ord").alias("ci_uri"))
    return entities.join(low, F.lower("label") == F.col("_low"), "left").drop("_low")


def fuzzy_match(entities: DataFrame, open_label: Column, dictionary: list[tuple[str, str]] | DataFrame) -> DataFrame:
    """RES3: adds fuzzy_uri for rows whose ``open_label`` is not null: by the label, else by its normal form.

    Distinct forms only are compared, with a dictionary of any size; see ``sequence_match``.
    """
    if not isinstance(dictionary, DataFrame):
        dictionary = v.local_df(entities.sparkSession, [("label", v._STR), ("uri", v._STR)], list(dictionary))
    rows = entities.withColumn("_open", open_label).withColumn("_normal", normalize_label(F.col("_open")))
    forms = rows.select(F.explode(F.array("_open", "_normal")).alias("label")).filter("label <> ''").distinct()
    best = sequence_match(forms, dictionary, CUTOFF)

    def side(column, uri):
        return best.select(F.col("label").alias(column), F.col("uri").alias(uri))
    return (rows.join(side("_open", "_uri1"), "_open", "left").join(side("_normal", "_uri2"), "_normal", "left")
            .withColumn("fuzzy_uri", F.coalesce("_uri1", "_uri2")).drop("_open", "_normal", "_uri1", "_uri2"))


def levenshtein_match(labels: DataFrame, dictionary: DataFrame, cutoff: float = CUTOFF) -> DataFrame:
    """RES3, edit-distance mode: (label, fuzzy_uri, score) for distinct labels.

    Score is 1 - distance / longer length. An edit spoils at most two pairs of neighbouring characters,
    so labels at the cutoff share one when the longer has over 2 / (2 cutoff - 1) characters, and a
    character when it is shorter; they meet by these. The greater dictionary label wins ties.
    """
    short = 2 / (2 * cutoff - 1) if cutoff > 0.5 else float("inf")
    longer = F.greatest(F.length("label"), F.length("_known"))
    pairs = candidates(labels.filter(F.length("label") > 0), dictionary, short)
    score = (1.0 - F.levenshtein("label", "_known") / longer).alias("score")
    return (pairs.select("label", "_known", F.col("uri").alias("fuzzy_uri"), score).filter(F.col("score") >= cutoff)
            .groupBy("label").agg(F.max(F.struct("score", "_known", "fuzzy_uri")).alias("m"))
            .select("label", F.col("m.fuzzy_uri").alias("fuzzy_uri"), F.col("m.score").alias("score")))


def resolve(entities: DataFrame, fuzzy: str = "sequence", dictionary: DataFrame | None = None,
            snomed: DataFrame | None = None, seed_uris: DataFrame | None = None) -> DataFrame:
    """RES1-RES8 over entity rows: adds resolved_uri, ncit_uri, snomed_uri and id.

    Order of trust: supplied URI, exact, fuzzy, equal but for case, local. ``fuzzy`` is
    ``sequence``, ``levenshtein`` or ``off``. The default dictionaries are the curated ones; others may be of any size.
    """
    spark = entities.sparkSession
    words = dictionary if dictionary is not None else v.canonical_df(spark)
    step = exact_match(entities, words, snomed if snomed is not None else v.snomed_df(spark))
    step = case_insensitive(step, words).withColumn("_trusted", trusted_uri(F.col("candidate_uri")))
    open_label = F.when(F.col("_trusted").isNull() & F.col("exact_uri").isNull(), F.col("label"))
    if fuzzy == "sequence":
        step = fuzzy_match(step, open_label, words)
    elif fuzzy == "levenshtein":
        step = step.join(levenshtein_match(step.select(open_label.alias("label")).filter("label is not null"), words).drop("score"), "label", "left")
    else:
        step = step.withColumn("fuzzy_uri", F.lit(None).cast("string"))
    seeds = seed_uris if seed_uris is not None else v.seed_uri_df(spark)
    uri = F.coalesce("_trusted", "exact_uri", "fuzzy_uri", "ci_uri", local_uri(F.col("label")))
    return (
        step.withColumn("resolved_uri", uri)
        .withColumn("ncit_uri", F.when(F.col("resolved_uri").startswith("NCIt:"), F.col("resolved_uri")))
        .withColumn("snomed_uri", F.when(F.col("resolved_uri").startswith("snomed:"), F.col("resolved_uri"))
                    .when(F.col("_trusted").isNull() & F.col("exact_uri").isNotNull(), F.col("exact_snomed")))
        .join(seeds.withColumnRenamed("uri", "resolved_uri"), "resolved_uri", "left")
        .withColumn("id", F.coalesce("seed_id", node_id(F.col("label"))))
        .drop("_trusted", "exact_uri", "exact_snomed", "fuzzy_uri", "ci_uri", "seed_id")
    )


def dedupe(resolved: DataFrame) -> DataFrame:
    """RES9: one row per (chunk_id, resolved_uri): the first of highest confidence.

    Definitions of later rows are appended with a bar where they differ from what is
    there; those before the winner are dropped. Winners are found by partial
    aggregation; only non-empty definitions travel, and they end in one cell anyway.
    """
    fields = [c for c in resolved.columns if c not in ("chunk_id", "resolved_uri")]
    later = F.filter(F.array_sort("_defs"), lambda d: d["pos"] > F.col("_w.pos"))
    merged = F.aggregate(later, F.col("_w.definition"), lambda acc, d: F.when(
        (acc != "") & (d["definition"] != acc), F.concat(acc, F.lit(" | "), d["definition"])).otherwise(acc))
    return (
        resolved.groupBy("chunk_id", "resolved_uri").agg(
            F.max_by(F.struct(*fields), F.struct("confidence", -F.col("pos"))).alias("_w"),
            F.collect_list(F.when(F.col("definition") != "", F.struct("pos", "definition"))).alias("_defs"))
        .withColumn("_definition", merged)
        .select("chunk_id", "resolved_uri", *[F.col("_definition").alias(c) if c == "definition" else F.col(f"_w.{c}").alias(c) for c in fields])
    )


def rewrite_relations(relations: DataFrame, resolved: DataFrame) -> DataFrame:
    """RES10: relation ends from answer-local ids to node ids; unknown ids stay.

    A local id maps to the id of the row that won its URI in the chunk; of repeated
    local ids the last counts. One shuffle by chunk serves all steps: the ids of a chunk, as many as one
    answer has, become a map, and relations meet it once.
    """
    rows = resolved.select("chunk_id", "resolved_uri", "local_id", "id", "confidence", "pos").repartition("chunk_id")
    best = Window.partitionBy("chunk_id", "resolved_uri")
    won = rows.withColumn("winner", F.max_by("id", F.struct("confidence", -F.col("pos"))).over(best))
    local = won.filter("local_id is not null").groupBy("chunk_id", "local_id").agg(F.max_by("winner", "pos").alias("winner"))
    ids = local.groupBy("chunk_id").agg(F.map_from_entries(F.collect_list(F.struct("local_id", "winner"))).alias("_ids"))

    def end(column):
        return F.coalesce(F.try_element_at("_ids", F.col(column)), F.col(column)).alias(column)
    met = relations.join(ids, "chunk_id", "left")
    return met.select(*[end(c) if c in ("subject_id", "object_id") else F.col(c) for c in relations.columns])


def count_local(resolved: DataFrame) -> DataFrame:
    """RES11: rows whose URI stayed local."""
    return resolved.agg(F.count_if(F.col("resolved_uri").startswith("her2:") & F.col("ncit_uri").isNull()).alias("unresolved"))
