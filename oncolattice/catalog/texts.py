"""Registered queries: document sources, chunking, extraction output."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import chunking as k
from ..sources import documents as docs
from . import duck_inputs as d, inputs as i
from .registry import query, table

# ---- sources ---------------------------------------------------------------
_PRIORITY = ["conv_00000007.md", "conv_00000003.md"]
_EXCLUDE = ["conv_00000002.md"]


@query("SRC1", """SELECT source_doc, CASE source_doc WHEN 'conv_00000007.md' THEN 0::BIGINT WHEN 'conv_00000003.md' THEN 1 ELSE 2 END AS priority_rank,
 len(text) AS n_chars FROM markdown_docs WHERE source_doc <> 'conv_00000002.md'""", ("markdown_docs",))
def src1(spark, path):
    return docs.reading_order(i.markdown_docs(spark, path), _EXCLUDE, _PRIORITY).select(
        "source_doc", "priority_rank", F.length("text").cast("bigint").alias("n_chars"))


@query("SRC2", r"SELECT source_doc, page_num, len(text) AS n_chars FROM page_rows WHERE regexp_replace(text, '\s+', '', 'g') <> ''", ("page_rows",))
def src2(spark, path):
    return docs.page_texts(i.page_rows(spark, path)).select(
        "source_doc", F.col("page_num").cast("bigint").alias("page_num"), F.length("text").cast("bigint").alias("n_chars"))


_TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@query("SRC3", " UNION ALL ".join(f"SELECT '{t}.parquet' AS name, 'parquet' AS format, count(*) AS n_rows FROM {t}" for t in _TABLES if t != "labels"))
def src3(spark, path):
    """Files of the data folder with the rows read from each."""
    files = docs.manifest(spark, path, {"parquet": "*.parquet"}, ["labels.parquet"]).select("name", "format")
    rows = None
    for t in _TABLES:
        own = i.read(spark, path, t).agg(F.count("*").alias("n_rows")).select(F.lit(f"{t}.parquet").alias("name"), "n_rows")
        rows = own if rows is None else rows.unionByName(own)
    return files.join(rows, "name").select("name", "format", "n_rows")


# ---- Markdown chunking in SQL ----------------------------------------------
table("md_sections", r"""
SELECT source_doc, stem, seg, CASE WHEN seg = 1 THEN 'Introducción' ELSE trim(regexp_replace(string_split(b, chr(2))[1], '^#{1,3}\s+', '')) END AS section,
 CASE WHEN seg = 1 THEN b ELSE string_split(b, chr(2))[2] END AS text
FROM (SELECT source_doc, stem, unnest(bs) AS b, generate_subscripts(bs, 1) AS seg FROM (
 SELECT source_doc, stem, string_split(regexp_replace(text, '\n(#{1,3}\s+.+)\n', chr(1) || '\1' || chr(2), 'g'), chr(1)) AS bs FROM markdown_docs))""",
      "markdown_docs")
table("md_segments", r"""SELECT * FROM md_sections
 WHERE NOT regexp_matches(text, '^#{1,3}\s+') AND regexp_replace(text, '\s+', '', 'g') <> ''""", "md_sections")
_CODE, _TAB = k.CODE, k.TABLE
_ALG = r"((?:(?:NODO[-_]\d+|ENTRADA:|ACCIÓN:|COMENTARIO[-_]\w*):.*\n(?:.*\n){0,30}?))(?:\n#{1,3}\s|\z)"


def _marks(kind, arr, pos):
    return (f"list_transform(range(len({arr}) + 1), lambda q: CASE WHEN q < len({arr}) THEN '[{kind}_' || stem || '_c' || "
            f"lpad(({pos} + list_position({arr}, {arr}[q + 1]) - 1)::VARCHAR, 4, '0') || ']' ELSE '' END)")


def _fill(pattern, arr, kind, pos):
    pieces = f"string_split(regexp_replace(text, '{pattern}', chr(3), 'g'), chr(3))"
    return (f"array_to_string(list_transform(list_zip({pieces}, {_marks(kind, arr, pos)}), lambda z: z[1] || coalesce(z[2], '')), '')")


table("md_code", f"SELECT *, regexp_extract_all(text, '{_CODE}', 1) AS code FROM md_segments", "md_segments")
table("md_t1", f"SELECT source_doc, stem, seg, section, code, {_fill(_CODE, 'code', 'CODE_BLOCK', 0)} AS text FROM md_code", "md_code")
table("md_tab", f"SELECT *, regexp_extract_all(text, '{_TAB}', 1) AS tabs FROM md_t1", "md_t1")
table("md_t2", f"SELECT source_doc, stem, seg, section, code, tabs, {_fill(_TAB, 'tabs', 'TABLE', 'len(code)')} AS text FROM md_tab", "md_tab")
table("md_alg", f"SELECT *, list_filter(regexp_extract_all(text, '{_ALG}', 1), lambda x: len(regexp_replace(x, '^\\s+|\\s+$', '', 'g')) >= 80) AS algs FROM md_t2", "md_t2")
# the decision text ends the segment, so one replacement is enough here
table("md_t3", "SELECT source_doc, stem, seg, section, code, tabs, algs, CASE WHEN len(algs) > 0 THEN replace(text, algs[1], '[ALGO_BLOCK_' || stem || '_c' || lpad((len(code) + len(tabs))::VARCHAR, 4, '0') || ']') ELSE text END AS text FROM md_alg", "md_alg")
_md_windows = d.window_tables("md_t3", ("source_doc", "seg"), "mdw", 60, 12)
_strip = "regexp_replace({}, '^\\s+|\\s+$', '', 'g')"
_md_chunks = _md_windows + f""",
md_all AS (SELECT source_doc, seg, 0 AS kind_rank, 'code_block' AS kind, unnest(code) AS c, generate_subscripts(code, 1) AS pos FROM md_t3
 UNION ALL SELECT source_doc, seg, 1, 'table', unnest(tabs), generate_subscripts(tabs, 1) FROM md_t3
 UNION ALL SELECT source_doc, seg, 2, 'algorithm', unnest(algs), generate_subscripts(algs, 1) FROM md_t3
 UNION ALL SELECT source_doc, seg, 3, 'text', content, st + 1 FROM mdw),
md_chunks AS (SELECT t.stem || '_c' || lpad((row_number() OVER (PARTITION BY a.source_doc ORDER BY seg, kind_rank, pos) - 1)::VARCHAR, 4, '0') AS chunk_id,
 a.source_doc, t.section, kind, {_strip.format('c')} AS content FROM md_all a JOIN md_t3 t USING (source_doc, seg))"""
_MASK = r"\[(CODE_BLOCK|TABLE|ALGO_BLOCK)_[^\]]*\]"


def _md(spark, path):
    return k.chunk_markdown(i.markdown_docs(spark, path), 60, 12)


def _segments(spark, path):
    return k.unnest(i.markdown_docs(spark, path), ["source_doc"], k.sections(F.col("text")), "p", "n").select(
        "source_doc", "n", "p.section", "p.text")


@query("CHK1", "SELECT source_doc, text, section FROM md_segments", ("md_segments",))
def chk1(spark, path):
    return _segments(spark, path).select("source_doc", "section", "text")


@query("CHK2", "SELECT section, count(*) AS n FROM md_segments GROUP BY 1", ("md_segments",))
def chk2(spark, path):
    return _segments(spark, path).groupBy("section").agg(F.count("*").alias("n"))


def _block(pattern, keep=0):
    def run(spark, path):
        out = k.unnest(_segments(spark, path), ["source_doc", "section"], k.blocks(F.col("text"), pattern), "block").drop("_pos")
        return out.filter(F.length(k.strip(F.col("block"))) >= keep) if keep else out
    return run


query("CHK3", f"SELECT source_doc, section, unnest(regexp_extract_all(text, '{_CODE}', 1)) AS block FROM md_segments", ("md_segments",))(_block(k.CODE))
query("CHK4", f"SELECT source_doc, section, unnest(regexp_extract_all(text, '{_TAB}', 1)) AS block FROM md_segments", ("md_segments",))(_block(k.TABLE))
query("CHK5", f"SELECT * FROM (SELECT source_doc, section, unnest(regexp_extract_all(text, '{_ALG}', 1)) AS block FROM md_segments) WHERE len({_strip.format('block')}) >= 80",
      ("md_segments",))(_block(k.ALGORITHM, k.MIN_ALGORITHM_CHARS))

_SENT = r"string_split(regexp_replace(regexp_replace(text, '^\s+|\s+$', '', 'g'), '([.!?])\s+([A-ZÁÉÍÓÚÑ])', '\1' || chr(1) || '\2', 'g'), chr(1))"


@query("CHK6", f"SELECT doc_id, unnest({_SENT}) AS sentence, generate_subscripts({_SENT}, 1) - 1 AS pos FROM documents")
def chk6(spark, path):
    return k.unnest(i.read_texts(spark, path, "documents"), ["doc_id"], k.sentences(F.col("text")), "sentence", "p").select(
        "doc_id", F.col("p").cast("bigint").alias("pos"), "sentence")


@query("CHK7", "SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY st) - 1 AS pos, content FROM dw", (),
       d.window_tables("documents", ("doc_id",), "dw"))
def chk7(spark, path):
    return k.unnest(i.read_texts(spark, path, "documents"), ["doc_id"], k.windows(F.col("text")), "content", "p").select(
        "doc_id", F.col("p").cast("bigint").alias("pos"), "content")


@query("CHK8", f"SELECT chunk_id, section, kind, regexp_replace(content, '{_MASK}', '[\\1]', 'g') AS content FROM md_chunks", ("md_t3",), _md_chunks)
def chk8(spark, path):
    return _md(spark, path).select("chunk_id", "section", F.coalesce(F.col("metadata")["block_type"], F.lit("text")).alias("kind"),
                                   F.regexp_replace("content", _MASK, "[$1]").alias("content"))


_pg = d.window_tables("pg_long", ("source_doc", "page_num"), "pgw")
_pg_chunks = r"""pg AS (SELECT *, len(list_filter(regexp_split_to_array(text, '\s+'), lambda y: y <> '')) < 60 AS short FROM page_rows WHERE regexp_replace(text, '\s+', '', 'g') <> ''),
pg_long AS (SELECT source_doc, page_num, text FROM pg WHERE NOT short),""" + _pg + r""",
pg_all AS (SELECT source_doc, page_num, true AS short, 0 AS st, regexp_replace(text, '^\s+|\s+$', '', 'g') AS content FROM pg WHERE short
 UNION ALL SELECT source_doc, page_num, false, st, content FROM pgw),
pg_num AS (SELECT *, row_number() OVER (PARTITION BY source_doc ORDER BY page_num, st) - 1 AS n FROM pg_all),
pg_chunks AS (SELECT CASE WHEN short THEN regexp_replace(lower(source_doc), '[^a-z0-9]', '_', 'g') || '_p' || lpad(page_num::VARCHAR, 4, '0') || '_c' || lpad(n::VARCHAR, 4, '0')
 ELSE replace(source_doc, '.pdf', '') || '_c' || lpad(n::VARCHAR, 4, '0') END AS chunk_id, source_doc, 'Page ' || page_num AS section, short, content FROM pg_num)"""


@query("CHK9", "SELECT source_doc, section, content FROM pg_chunks", ("page_rows",), _pg_chunks)
def chk9(spark, path):
    return k.chunk_pages(i.page_rows(spark, path)).select("source_doc", "section", "content")


@query("CHK10", "SELECT chunk_id, section FROM pg_chunks", ("page_rows",), _pg_chunks)
def chk10(spark, path):
    return k.chunk_pages(i.page_rows(spark, path)).select("chunk_id", "section")


@query("CHK11", f"SELECT doc_id, {d.ctype('text')} AS content_type FROM documents")
def chk11(spark, path):
    return i.read_texts(spark, path, "documents").select("doc_id", k.content_type(F.col("text")).alias("content_type"))


_APPENDIX = ("conv_00000004.md", "conv_00000011.md")


@query("CHK12", f"""SELECT content_type, count(*) AS n FROM (SELECT CASE WHEN source_doc IN {_APPENDIX} THEN 'technical_appendix'
 WHEN kind IN ('table', 'algorithm') THEN kind ELSE {d.ctype('content')} END AS content_type FROM md_chunks) GROUP BY 1""", ("md_t3",), _md_chunks)
def chk12(spark, path):
    return k.chunk_markdown(i.markdown_docs(spark, path), 60, 12, appendix=_APPENDIX).groupBy("content_type").agg(F.count("*").alias("n"))


@query("CHK13", "SELECT source_doc, count(*) AS n FROM (SELECT source_doc FROM md_chunks UNION ALL SELECT source_doc FROM pg_chunks) GROUP BY 1",
       ("md_t3", "page_rows"), _md_chunks + ", " + _pg_chunks)
def chk13(spark, path):
    return k.all_chunks(_md(spark, path), k.chunk_pages(i.page_rows(spark, path))).groupBy("source_doc").agg(F.count("*").alias("n"))


@query("CHK14", "SELECT doc_id, substr(text, 1, 5000) AS stored FROM documents")
def chk14(spark, path):
    return i.read_texts(spark, path, "documents").select("doc_id", k.stored_text(F.col("text"), 5000).alias("stored"))


@query("GRF16", f"SELECT {d.ctype('content')} AS content_type, count(*) AS n FROM pg_chunks GROUP BY 1", ("page_rows",), _pg_chunks)
def grf16(spark, path):
    from ..operators.graph import content_type_counts
    return content_type_counts(k.chunk_pages(i.page_rows(spark, path)))


# ---- extraction ------------------------------------------------------------
from ..operators import extraction as x  # noqa: E402


def _parsed(spark, path):
    return x.parse(i.raw_extractions(spark, path))


def _e(df):
    return x.entity_rows(df).select("chunk_id", F.col("local_id").alias("id"), "label", "type", "definition", "confidence")


def _r(df):
    return x.relation_rows(df).select("chunk_id", "subject_id", "predicate", "object_id", "confidence")


_E = "SELECT chunk_id, id, label, type, definition, confidence FROM "
_R = "SELECT chunk_id, subject_id, predicate, object_id, confidence FROM "


@query("EXT1", f"SELECT chunk_id FROM (SELECT chunk_id, {d.ctype('content')} AS t FROM pg_chunks) WHERE t NOT IN ('ontology', 'technical_appendix', 'criteria')",
       ("page_rows",), _pg_chunks)
def ext1(spark, path):
    return x.select_chunks(k.chunk_pages(i.page_rows(spark, path)), (*x.SKIP_TYPES, "criteria")).select("chunk_id")


@query("EXT2", """SELECT response_id, coalesce(string_agg('e' || ord || '=' || label, '|' ORDER BY ord), '') AS found FROM responses LEFT JOIN v_canonical ON contains(response, label) GROUP BY 1""",
       ("responses", "v_canonical"))
def ext2(spark, path):
    chunks = i.responses(spark, path).select(F.col("response_id").cast("string").alias("chunk_id"), F.lit("s").alias("section"),
                                             F.col("response").alias("content"), F.lit("general").alias("content_type"))
    return x.parse(x.run_extractor(x.select_chunks(chunks))).select(
        F.col("chunk_id").cast("bigint").alias("response_id"), F.array_join(F.transform("entities", lambda e: F.concat_ws("=", e["id"], e["label"])), "|").alias("found"))


@query("EXT3", "SELECT chunk_id, j AS cleaned FROM ext_clean", ("ext_clean",))
def ext3(spark, path):
    return i.raw_extractions(spark, path).select("chunk_id", x.clean_json(F.col("raw")).alias("cleaned"))


@query("EXT4", "SELECT chunk_id, CASE WHEN raw <> '' AND root IS NULL THEN 'JSONDecodeError | raw[:200]=' || left(raw, 200) END AS error FROM ext_root", ("ext_root",))
def ext4(spark, path):
    return _parsed(spark, path).select("chunk_id", "error")


query("EXT5", _E + "ext_entities", ("ext_entities",))(lambda spark, path: _e(_parsed(spark, path)))
query("EXT6", _R + "ext_relations", ("ext_relations",))(lambda spark, path: _r(_parsed(spark, path)))
query("EXT7", _E + "ext_domain_e", ("ext_domain_e",))(lambda spark, path: _e(x.filter_domain(_parsed(spark, path))))
query("EXT8", _R + "ext_domain_r", ("ext_domain_r",))(lambda spark, path: _r(x.filter_domain(_parsed(spark, path))))
query("EXT9", _E + "ext_final_e", ("ext_final_e",))(lambda spark, path: _e(x.filter_confidence(x.filter_domain(_parsed(spark, path)))))
query("EXT10", _R + "ext_final_r", ("ext_final_r",))(lambda spark, path: _r(x.filter_confidence(x.filter_domain(_parsed(spark, path)))))


@query("EXT11", """SELECT (SELECT count(*) FROM ext_final_e) AS entities, (SELECT count(*) FROM ext_final_r) AS relations,
 (SELECT count(*) FROM ext_root WHERE raw <> '' AND root IS NULL) AS errors""", ("ext_final_r", "ext_root"))
def ext11(spark, path):
    return x.totals(x.filter_confidence(x.filter_domain(_parsed(spark, path))))
