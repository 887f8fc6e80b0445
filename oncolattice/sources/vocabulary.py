"""Curated vocabulary: seed graph, URI dictionaries, decision tables, evidence.

Everything here is data. Each ``*_df`` function turns one table into a DataFrame
that Catalyst sees as a local relation, so it can be folded or broadcast; all of
them are constant in size (tens of rows) whatever the inputs hold.
"""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

# --------------------------------------------------------------------------
# enumerations
# --------------------------------------------------------------------------
CONTENT_TYPES = [
    "algorithm", "criteria", "recommendation", "fractal_mapping", "qa",
    "table", "ontology", "general", "technical_appendix",
]
NODE_TYPES = [
    "ClinicalCategory", "IHCScore", "ISHGroup", "StainingPattern",
    "TherapeuticAgent", "ClinicalTrial", "Biomarker", "Guideline",
    "QualityMeasure", "FractalMetric", "PathologicalFeature", "Assay",
    "DiagnosticDecision", "Threshold",
]
PREDICATES = [
    "implies", "requiresReflexTest", "eligibleFor", "notEligibleFor",
    "definedIn", "hasQualityRequirement", "associatedWith",
    "proposedEquivalence", "inconsistentWith", "hasThreshold",
    "contradictsIfConcurrent", "leadsTo", "conditionedOn", "overrides",
    "supportedByEvidence", "hasStainingPattern", "refinesCategory",
    "SUPERSEDED_BY",
]
SEVERITIES = ["CRITICAL", "HIGH", "MEDIUM", "LOW"]
CATEGORY_IDS = [
    "HER2_Positive", "HER2_Negative", "HER2_Low",
    "HER2_Ultralow", "HER2_Null", "HER2_Equivocal",
]
ISH_GROUP_IDS = ["Group1", "Group2", "Group3", "Group4", "Group5"]

# --------------------------------------------------------------------------
# Label -> URI dictionaries (order matters for tie-breaks)
# --------------------------------------------------------------------------
CANONICAL_URIS = {
    "HER2 Score 0": "NCIt:C173786",
    "HER2 Score 0+": "NCIt:C173787",
    "HER2 Score 1+": "NCIt:C173788",
    "HER2 Score 2+": "NCIt:C173789",
    "HER2 Score 3+": "NCIt:C173790",
    "Score0": "NCIt:C173786",
    "Score0Plus": "NCIt:C173787",
    "Score1Plus": "NCIt:C173788",
    "Score2Plus": "NCIt:C173789",
    "Score3Plus": "NCIt:C173790",
    "IHC 0": "NCIt:C173786",
    "IHC 0+": "NCIt:C173787",
    "IHC 1+": "NCIt:C173788",
    "IHC 2+": "NCIt:C173789",
    "IHC 3+": "NCIt:C173790",
    "HER2-Positive": "NCIt:C68748",
    "HER2-Negative": "NCIt:C68749",
    "HER2-Low": "NCIt:C173791",
    "HER2-Ultralow": "NCIt:C173792",
    "HER2-Null": "NCIt:C173793",
    "HER2-Equivocal": "NCIt:C173794",
    "HER2 Positive": "NCIt:C68748",
    "HER2 Negative": "NCIt:C68749",
    "HER2 Low": "NCIt:C173791",
    "HER2 Ultralow": "NCIt:C173792",
    "HER2 Null": "NCIt:C173793",
    "HER2 Equivocal": "NCIt:C173794",
    "ISH Group 1": "NCIt:C173795",
    "ISH Group 2": "NCIt:C173796",
    "ISH Group 3": "NCIt:C173797",
    "ISH Group 4": "NCIt:C173798",
    "ISH Group 5": "NCIt:C173799",
    "Group1": "NCIt:C173795",
    "Group2": "NCIt:C173796",
    "Group3": "NCIt:C173797",
    "Group4": "NCIt:C173798",
    "Group5": "NCIt:C173799",
    "Trastuzumab": "NCIt:C1647",
    "Trastuzumab Deruxtecan": "NCIt:C155379",
    "T-DXd": "NCIt:C155379",
    "Pertuzumab": "NCIt:C64636",
    "T-DM1": "NCIt:C82492",
    "Ado-Trastuzumab Emtansine": "NCIt:C82492",
    "Fractal Dimension D0": "NCIt:C25730",
    "Fractal Dimension D1": "NCIt:C25731",
    "Capacity Dimension D0": "NCIt:C25730",
    "Information Dimension D1": "NCIt:C25731",
    "Lacunarity": "NCIt:C173800",
    "Multifractal Spectrum": "NCIt:C173801",
    "Multifractal Spread": "NCIt:C173801",
    "Multiscale Entropy": "NCIt:C173802",
    "D0": "NCIt:C25730",
    "D1": "NCIt:C25731",
    "Architectural Complexity": "NCIt:C19754",
    "Tumor Heterogeneity": "NCIt:C16947",
    "Intratumoral Heterogeneity": "NCIt:C16947",
    "HER2 Gene Amplification": "NCIt:C116178",
    "HER2 Protein Overexpression": "NCIt:C44573",
    "Spatial Heterogeneity": "NCIt:C16947",
    "ERBB2": "NCIt:C17382",
    "HER2": "NCIt:C17382",
    "CEP17": "NCIt:C173803",
    "ER": "NCIt:C17687",
    "PgR": "NCIt:C17043",
    "Ki67": "NCIt:C17203",
    "Immunohistochemistry": "NCIt:C17089",
    "IHC": "NCIt:C17089",
    "In Situ Hybridization": "NCIt:C17236",
    "ISH": "NCIt:C17236",
    "Fluorescence In Situ Hybridization": "NCIt:C17236",
    "FISH": "NCIt:C17236",
    "Chromogenic In Situ Hybridization": "NCIt:C173804",
    "CISH": "NCIt:C173804",
    "VENTANA HER2 (4B5)": "NCIt:C173805",
    "HercepTest": "NCIt:C173806",
    "ASCO_CAP_2023": "her2:ASCO_CAP_2023",
    "ASCO/CAP 2023": "her2:ASCO_CAP_2023",
    "CAP_2025": "her2:CAP_Biomarker_2025",
    "CAP 2025": "her2:CAP_Biomarker_2025",
    "ESMO_2023": "her2:ESMO_2023",
    "ESMO 2023": "her2:ESMO_2023",
    "Rakha_2026": "her2:Rakha_International_2026",
    "Rakha 2026": "her2:Rakha_International_2026",
    "DESTINY-Breast04": "her2:DESTINY_Breast04",
    "DB-04": "her2:DESTINY_Breast04",
    "DESTINY-Breast06": "her2:DESTINY_Breast06",
    "DB-06": "her2:DESTINY_Breast06",
    "DAISY": "her2:DAISY_Trial",
}
SNOMED_URIS = {
    "Invasive Breast Carcinoma": "snomed:413448000",
    "Ductal Carcinoma In Situ": "snomed:399935008",
    "Metastatic Breast Cancer": "snomed:408643008",
    "HER2 Protein": "snomed:442478000",
    "Immunohistochemistry": "snomed:117299004",
    "In Situ Hybridization": "snomed:404217000",
}

# --------------------------------------------------------------------------
# Seed entities (id, label, type, NCIt code, extra properties).
# Definitions are short descriptions of our own.
# --------------------------------------------------------------------------
_ISH_BOUNDS = {1: (2.0, 4.0), 2: (2.0, 4.0), 3: (2.0, 6.0), 4: (2.0, 4.0), 5: (2.0, 4.0)}
SEED_ENTITIES = [
    ("Score0", "IHC Score 0", "IHCScore", "NCIt:C173786", "no staining", {}),
    ("Score0Plus", "IHC Score 0+", "IHCScore", "NCIt:C173787", "faint partial staining, up to a tenth of cells", {}),
    ("Score1Plus", "IHC Score 1+", "IHCScore", "NCIt:C173788", "faint partial staining, above a tenth of cells", {}),
    ("Score2Plus", "IHC Score 2+", "IHCScore", "NCIt:C173789", "weak to moderate complete staining", {}),
    ("Score3Plus", "IHC Score 3+", "IHCScore", "NCIt:C173790", "strong complete staining", {}),
    ("HER2_Positive", "HER2-Positive", "ClinicalCategory", "NCIt:C68748", "score 3+ or amplified", {}),
    ("HER2_Negative", "HER2-Negative", "ClinicalCategory", "NCIt:C68749", "not overexpressed and not amplified", {}),
    ("HER2_Low", "HER2-Low", "ClinicalCategory", "NCIt:C173791", "score 1+, or 2+ without amplification", {"interobserver_variability": 0.25}),
    ("HER2_Ultralow", "HER2-Ultralow", "ClinicalCategory", "NCIt:C173792", "score 0+", {"interobserver_variability": 0.37}),
    ("HER2_Null", "HER2-Null", "ClinicalCategory", "NCIt:C173793", "score 0", {}),
    ("HER2_Equivocal", "HER2-Equivocal", "ClinicalCategory", "NCIt:C173794", "score 2+ awaiting ISH", {}),
    *[
        (f"Group{g}", f"ISH Group {g}", "ISHGroup", f"NCIt:C{173794 + g}", f"ISH result group {g}",
         {"ratio_threshold": _ISH_BOUNDS[g][0], "signals_per_cell_threshold": _ISH_BOUNDS[g][1], "group_number": g})
        for g in range(1, 6)
    ],
    ("IHC", "Immunohistochemistry (IHC)", "Assay", "NCIt:C17089", "protein staining assay", {}),
    ("ISH", "In Situ Hybridization (ISH)", "Assay", "NCIt:C17236", "gene copy assay", {}),
    ("Trastuzumab", "Trastuzumab", "TherapeuticAgent", "NCIt:C1647", "antibody", {}),
    ("TrastuzumabDeruxtecan", "Trastuzumab Deruxtecan (T-DXd)", "TherapeuticAgent", "NCIt:C155379", "antibody-drug conjugate", {"fda_approved": True, "approval_date": "2025"}),
    ("Pertuzumab", "Pertuzumab", "TherapeuticAgent", "NCIt:C64636", "antibody, second epitope", {}),
    ("TDM1", "T-DM1 (Ado-Trastuzumab Emtansine)", "TherapeuticAgent", "NCIt:C82492", "antibody-drug conjugate", {}),
    ("DESTINY_Breast04", "DESTINY-Breast04", "ClinicalTrial", None, "phase 3, low expression", {}),
    ("DESTINY_Breast06", "DESTINY-Breast06", "ClinicalTrial", None, "phase 3, ultralow expression", {}),
    ("DAISY_Trial", "DAISY Trial", "ClinicalTrial", None, "phase 2, all expression levels", {}),
    ("ASCO_CAP_2023", "ASCO/CAP HER2 Guideline 2023", "Guideline", None, "testing guideline", {}),
    ("CAP_Biomarker_2025", "CAP Biomarker Template 2025", "Guideline", None, "reporting template", {}),
    ("ESMO_2023", "ESMO HER2-Low Expert Consensus 2023", "Guideline", None, "expert consensus", {}),
    ("Rakha_International_2026", "Rakha International Consensus 2026", "Guideline", None, "expert consensus", {}),
    ("FractalDimension_D0", "Fractal Dimension D0 (Capacity)", "FractalMetric", "NCIt:C25730", "box counting dimension", {"value_range_low": 1.0, "value_range_high": 2.0}),
    ("FractalDimension_D1", "Fractal Dimension D1 (Information)", "FractalMetric", "NCIt:C25731", "information dimension", {"value_range_low": 1.0, "value_range_high": 2.0}),
    ("Lacunarity", "Lacunarity", "FractalMetric", "NCIt:C173800", "gap texture", {"value_range_low": 0.0, "value_range_high": 1.0}),
    ("MultifractalSpread", "Multifractal Spread (Δα)", "FractalMetric", "NCIt:C173801", "spectrum width", {"value_range_low": 0.0, "value_range_high": 2.0}),
    ("MultiscaleEntropy", "Multiscale Entropy", "FractalMetric", None, "complexity over scales", {"value_range_low": 0.0, "value_range_high": 3.0}),
]

# --------------------------------------------------------------------------
# Seed relations
# (subject, predicate, object, confidence, guideline, conditions, hypothesis)
# --------------------------------------------------------------------------
SEED_RELATIONS = [
    ("Score3Plus", "implies", "HER2_Positive", 1.0, "ASCO_CAP_2023", None, False),
    ("Score2Plus", "implies", "HER2_Equivocal", 1.0, "ASCO_CAP_2023", None, False),
    ("Score1Plus", "implies", "HER2_Negative", 1.0, "ASCO_CAP_2023", None, False),
    ("Score1Plus", "refinesCategory", "HER2_Low", 1.0, "ASCO_CAP_2023", None, False),
    ("Score0Plus", "implies", "HER2_Negative", 1.0, "CAP_Biomarker_2025", None, False),
    ("Score0Plus", "refinesCategory", "HER2_Ultralow", 1.0, "Rakha_International_2026", None, False),
    ("Score0", "implies", "HER2_Null", 1.0, "ASCO_CAP_2023", None, False),
    ("Score2Plus", "requiresReflexTest", "ISH", 1.0, "ASCO_CAP_2023", None, False),
    ("Score2Plus", "impliesIfISHAmplified", "HER2_Positive", 1.0, "ASCO_CAP_2023", None, False),
    ("Score2Plus", "impliesIfISHNonAmplified", "HER2_Low", 1.0, "ASCO_CAP_2023", None, False),
    ("Group1", "implies", "HER2_Positive", 1.0, "ASCO_CAP_2023", None, False),
    ("Group2", "requiresIHCWorkup", "HER2_Equivocal", 1.0, "ASCO_CAP_2023", None, False),
    ("Group3", "requiresIHCWorkup", "HER2_Equivocal", 1.0, "ASCO_CAP_2023", None, False),
    ("Group4", "requiresIHCWorkup", "HER2_Equivocal", 1.0, "ASCO_CAP_2023", None, False),
    ("Group5", "implies", "HER2_Low", 1.0, "ASCO_CAP_2023", None, False),
    ("HER2_Low", "eligibleFor", "TrastuzumabDeruxtecan", 1.0, None, "metastatic setting", False),
    ("HER2_Ultralow", "eligibleFor", "TrastuzumabDeruxtecan", 1.0, None, "HR+, metastatic setting", False),
    ("HER2_Positive", "notEligibleFor", "TrastuzumabDeruxtecan", 1.0, None, None, False),
    ("HER2_Null", "notEligibleFor", "TrastuzumabDeruxtecan", 1.0, None, None, False),
    ("HER2_Low", "refinesCategory", "HER2_Negative", 1.0, None, None, False),
    ("HER2_Ultralow", "refinesCategory", "HER2_Negative", 1.0, None, None, False),
    ("HER2_Null", "refinesCategory", "HER2_Negative", 1.0, None, None, False),
    ("ASCO_CAP_2023", "SUPERSEDED_BY", "Rakha_International_2026", 0.8, None, "HER2-low/ultralow scope only", False),
    ("HER2_Low", "supportedByEvidence", "DESTINY_Breast04", 1.0, None, None, False),
    ("HER2_Ultralow", "supportedByEvidence", "DESTINY_Breast06", 1.0, None, None, False),
    ("FractalDimension_D0", "proposedCorrelation", "HER2_Positive", 0.6, None, "D0 > 1.85", True),
    ("FractalDimension_D0", "proposedCorrelation", "HER2_Null", 0.6, None, "D0 < 1.45", True),
    ("Lacunarity", "proposedCorrelation", "Score3Plus", 0.55, None, "Lacunarity < 0.15", True),
    ("MultifractalSpread", "inconsistentWith", "HER2_Null", 0.65, None, "Δα > 0.80", True),
]

_ROOT_CLASSES = [
    "IHCScore", "ClinicalCategory", "ISHGroup", "TherapeuticAgent",
    "ClinicalTrial", "Guideline", "FractalMetric",
]

# --------------------------------------------------------------------------
# Therapy evidence per category
# (category, agent, eligible, context, trial) and guidelines per category
# --------------------------------------------------------------------------
STATIC_EVIDENCE = [
    ("HER2_Positive", "Trastuzumab", True, "Standard first-line (ASCO/CAP 2023)", "ToGA"),
    ("HER2_Positive", "Pertuzumab", True, "Early + mBC (ASCO/CAP 2023)", "CLEOPATRA"),
    ("HER2_Positive", "T-DXd", True, "2L+ metastatic", "DESTINY-Breast03"),
    ("HER2_Positive", "Tucatinib", True, "2L+ metastatic", "HER2CLIMB"),
    ("HER2_Equivocal", "Trastuzumab", True, "When reflexed ISH confirms positivity", "—"),
    ("HER2_Equivocal", "T-DXd", True, "When ISH+ confirmed", "DESTINY-Breast03"),
    ("HER2_Equivocal", "T-DXd", False, "Not eligible pending ISH result", "—"),
    ("HER2_Low", "T-DXd", True, "First-line metastatic (HR+/HR-)", "DESTINY-Breast04"),
    ("HER2_Low", "Trastuzumab", False, "Not eligible — IHC 1+ or 2+/ISH- is not amplified", "—"),
    ("HER2_Low", "Pertuzumab", False, "Not eligible", "—"),
    ("HER2_Ultralow", "T-DXd", True, "Expanded criteria — HR+, metastatic, endocrine-pretreated", "DESTINY-Breast06"),
    ("HER2_Ultralow", "Trastuzumab", False, "Not eligible", "—"),
    ("HER2_Ultralow", "Pertuzumab", False, "Not eligible", "—"),
    ("HER2_Null", "T-DXd", False, "Not eligible — no HER2 expression (standard criteria)", "—"),
    ("HER2_Null", "Trastuzumab", False, "Not eligible", "—"),
]
EVIDENCE_GUIDELINES = {
    "HER2_Positive": ["ASCO/CAP 2023", "ESMO 2023", "NCCN 2023"],
    "HER2_Equivocal": ["ASCO/CAP 2023"],
    "HER2_Low": ["ASCO/CAP 2023", "DESTINY-Breast04 (NEJM 2022)"],
    "HER2_Ultralow": ["Rakha_International_2026", "DESTINY-Breast06"],
    "HER2_Null": ["ASCO/CAP 2023"],
}

# --------------------------------------------------------------------------
# Decision tables. A branch is (next | None, fields); questions
# are short descriptions of our own.
# --------------------------------------------------------------------------
_ASCO, _RAKHA = "ASCO_CAP_2023", "Rakha_International_2026"
IHC_ALGORITHM = "IHC_ASCO_CAP_2023"
ISH_ALGORITHM = "ISH_ASCO_CAP_2023"
RAKHA_ALGORITHM = "Rakha_Scoring_Matrix_2026"
RECOUNT_ACTION = "Recount ≥20 additional cells; interpret as Group 1 or 5"


def _node(algorithm, node_id, kind, order, source, question, **fields):
    return {"algorithm_id": algorithm, "id": node_id, "type": kind, "node_order": order,
            "guideline_source": source, "question": question, **fields}


def _to(target):
    return {"next": target}


def _end(**fields):
    return fields


DECISION_NODES = [
    _node(IHC_ALGORITHM, "IHC_ENTRY", "entry", 0, _ASCO, "start of IHC scoring", next="IHC_NODE1"),
    _node(IHC_ALGORITHM, "IHC_NODE1", "decision", 1, _ASCO, "strong complete staining above 10%?",
          if_yes=_end(result="Score3Plus", category="HER2_Positive", label="IHC 3+"), if_no=_to("IHC_NODE2")),
    _node(IHC_ALGORITHM, "IHC_NODE2", "decision", 2, _ASCO, "weak to moderate complete staining above 10%?",
          if_yes=_end(result="Score2Plus", category="HER2_Equivocal", label="IHC 2+", action="Order reflex ISH testing (mandatory)"), if_no=_to("IHC_NODE3")),
    _node(IHC_ALGORITHM, "IHC_NODE3", "decision", 3, _ASCO, "partial or faint staining above 10%?",
          if_yes=_end(result="Score1Plus", category="HER2_Low", label="IHC 1+", note="low subcategory of negative"), if_no=_to("IHC_NODE4")),
    _node(IHC_ALGORITHM, "IHC_NODE4", "decision", 4, _RAKHA, "faint partial staining up to 10%?",
          if_yes=_end(result="Score0Plus", category="HER2_Ultralow", label="IHC 0+", note="ultralow subcategory"), if_no=_to("IHC_NODE5")),
    _node(IHC_ALGORITHM, "IHC_NODE5", "result", 5, _ASCO, "no staining",
          result="Score0", category="HER2_Null", label="IHC 0", note="null: outside T-DXd criteria"),
    _node(ISH_ALGORITHM, "ISH_GROUP1_RESULT", "result", 10, _ASCO, "group 1: ratio ≥2.0, signals ≥4.0",
          result="Group1", category="HER2_Positive", label="ISH Group 1 → Amplified"),
    *[
        row
        for g, tail in ((2, " (Comment-A)"), (3, " (Comment-A)"), (4, ""))
        for row in (
            _node(ISH_ALGORITHM, f"ISH_NODE_G{g}_ENTRY", "entry", 10 * g, _ASCO, f"group {g}: start of IHC workup",
                  next=f"ISH_NODE_G{g}_IHC_CHECK"),
            _node(ISH_ALGORITHM, f"ISH_NODE_G{g}_IHC_CHECK", "decision", 10 * g + 1, _ASCO, f"group {g}: concurrent IHC 3+?",
                  if_yes=_end(category="HER2_Positive", label=f"Group{g} + IHC 3+ → Positive"), if_no=_to(f"ISH_NODE_G{g}_IHC2")),
            _node(ISH_ALGORITHM, f"ISH_NODE_G{g}_IHC2", "decision", 10 * g + 2, _ASCO, f"group {g}: concurrent IHC 2+?",
                  if_yes=_end(action=RECOUNT_ACTION, note="comment if still unclear after recount"), if_no=_to(f"ISH_NODE_G{g}_IHC_LOW")),
            _node(ISH_ALGORITHM, f"ISH_NODE_G{g}_IHC_LOW", "result", 10 * g + 3, _ASCO, f"group {g}: concurrent IHC 0 or 1+",
                  category="HER2_Negative", label=f"Group{g} + IHC 0/1+ → Negative{tail}",
                  **({"note": "comment on limited therapy evidence"} if tail else {})),
        )
    ],
    _node(ISH_ALGORITHM, "ISH_GROUP5_RESULT", "result", 50, _ASCO, "group 5: ratio <2.0, signals <4.0",
          result="Group5", category="HER2_Negative", label="ISH Group 5 → Not Amplified"),
    _node(RAKHA_ALGORITHM, "RAKHA_ENTRY", "entry", 0, _RAKHA, "start of scoring matrix", next="RAKHA_NODE1"),
    _node(RAKHA_ALGORITHM, "RAKHA_NODE1", "decision", 1, _RAKHA, "complete and intense?",
          if_yes=_to("RAKHA_NODE1_YES"), if_no=_to("RAKHA_NODE2")),
    _node(RAKHA_ALGORITHM, "RAKHA_NODE1_YES", "decision", 11, _RAKHA, "above 10% of cells?",
          if_yes=_end(result="Score3Plus", category="HER2_Positive", label="3+ (POSITIVE)", score=3),
          if_no=_end(result="Score2Plus", category="HER2_Equivocal", label="2+ (EQUIVOCAL)", score=2, action="Reflex ISH required")),
    _node(RAKHA_ALGORITHM, "RAKHA_NODE2", "decision", 2, _RAKHA, "complete and weak to moderate?",
          if_yes=_to("RAKHA_NODE2_YES"), if_no=_to("RAKHA_NODE3")),
    _node(RAKHA_ALGORITHM, "RAKHA_NODE2_YES", "decision", 21, _RAKHA, "above 10% of cells?",
          if_yes=_end(result="Score2Plus", category="HER2_Equivocal", label="2+ (EQUIVOCAL)", score=2, action="Reflex ISH required"),
          if_no=_end(result="Score1Plus", category="HER2_Low", label="1+ (NEGATIVE/LOW)", score=1)),
    _node(RAKHA_ALGORITHM, "RAKHA_NODE3", "decision", 3, _RAKHA, "partial, any intensity, above 10%?",
          if_yes=_end(result="Score1Plus", category="HER2_Low", label="1+ (NEGATIVE/LOW)", score=1), if_no=_to("RAKHA_NODE4")),
    _node(RAKHA_ALGORITHM, "RAKHA_NODE4", "decision", 4, _RAKHA, "faint partial staining up to 10%?",
          if_yes=_end(result="Score0Plus", category="HER2_Ultralow", label="0+ (NEGATIVE/ULTRALOW)", score=0, note="ultralow subcategory"),
          if_no=_end(result="Score0", category="HER2_Null", label="0 (NEGATIVE/NULL)", score=0)),
]
# (algorithm, from, to, condition, label)
EXPLICIT_EDGES = [
    (IHC_ALGORITHM, "IHC_ENTRY", "IHC_NODE1", "start", ""),
    (IHC_ALGORITHM, "IHC_NODE1", "Score3Plus", "YES", "IHC 3+ → HER2-Positive"),
    (IHC_ALGORITHM, "IHC_NODE1", "IHC_NODE2", "NO", ""),
    (IHC_ALGORITHM, "IHC_NODE2", "Score2Plus", "YES", "IHC 2+ → Equivocal / reflex ISH"),
    (IHC_ALGORITHM, "IHC_NODE2", "IHC_NODE3", "NO", ""),
    (IHC_ALGORITHM, "IHC_NODE3", "Score1Plus", "YES", "IHC 1+ → HER2-Low"),
    (IHC_ALGORITHM, "IHC_NODE3", "IHC_NODE4", "NO", ""),
    (IHC_ALGORITHM, "IHC_NODE4", "Score0Plus", "YES", "IHC 0+ → HER2-Ultralow"),
    (IHC_ALGORITHM, "IHC_NODE4", "IHC_NODE5", "NO", ""),
    (IHC_ALGORITHM, "IHC_NODE5", "Score0", "terminal", "IHC 0 → HER2-Null"),
]

# --------------------------------------------------------------------------
# DataFrames
# --------------------------------------------------------------------------
_STR, _DBL, _BOOL, _INT = pa.string(), pa.float64(), pa.bool_(), pa.int32()
_PROPS = pa.map_(_STR, _STR)
_BRANCH = pa.struct([("next", _STR), ("result", _STR), ("category", _STR), ("label", _STR),
                     ("action", _STR), ("note", _STR), ("score", _INT)])


def local_df(spark: SparkSession, fields, rows) -> DataFrame:
    """DataFrame over a handful of literal rows (kept as a local relation)."""
    columns = list(zip(*rows)) if rows else [[] for _ in fields]
    arrays = [pa.array(list(values), type=kind) for values, (_, kind) in zip(columns, fields)]
    return spark.createDataFrame(pa.Table.from_arrays(arrays, names=[name for name, _ in fields]))


def json_props(values: dict) -> list:
    """Property map entries; a value is kept as a JSON scalar so its type survives."""
    return [(k, json.dumps(v, ensure_ascii=False)) for k, v in values.items() if v is not None]


def seed_entities_df(spark: SparkSession, created_at: str = "1970-01-01T00:00:00") -> DataFrame:
    """SRC4: seed nodes stamped with their source, creation time and confidence."""
    rows = []
    for node_id, label, kind, ncit, definition, extra in SEED_ENTITIES:
        props = {"definition": definition, "ncit_uri": ncit, **extra,
                 "source_doc": "ontology:seed", "created_at": created_at, "confidence": 1.0}
        rows.append((kind, node_id, label, json_props(props)))
    return local_df(spark, [("type", _STR), ("id", _STR), ("label", _STR), ("props", _PROPS)], rows)


def seed_relations_df(spark: SparkSession, created_at: str = "1970-01-01T00:00:00") -> DataFrame:
    """SRC5: seed edges."""
    rows = [
        (s, p, o, None, None, conf, hyp,
         json_props({"guideline_version": guide, "conditions": cond, "created_at": created_at}))
        for s, p, o, conf, guide, cond, hyp in SEED_RELATIONS
    ]
    return local_df(spark, [("src", _STR), ("predicate", _STR), ("dst", _STR), ("condition", _STR),
                            ("algorithm_id", _STR), ("confidence", _DBL), ("is_hypothesis", _BOOL),
                            ("props", _PROPS)], rows)


def canonical_df(spark: SparkSession) -> DataFrame:
    """SRC6: label -> URI with dictionary order."""
    return local_df(spark, [("label", _STR), ("uri", _STR), ("ord", _INT)],
                    [(k, v, i) for i, (k, v) in enumerate(CANONICAL_URIS.items())])


def snomed_df(spark: SparkSession) -> DataFrame:
    """SRC6: label -> SNOMED URI."""
    return local_df(spark, [("label", _STR), ("snomed_uri", _STR)], list(SNOMED_URIS.items()))


def seed_uri_rows() -> list:
    """(NCIt URI, seed id); the last seed wins where two share a URI."""
    return list({ncit: node_id for node_id, _, _, ncit, _, _ in SEED_ENTITIES if ncit}.items())


def seed_uri_df(spark: SparkSession) -> DataFrame:
    return local_df(spark, [("uri", _STR), ("seed_id", _STR)], seed_uri_rows())


def class_hierarchy_rows() -> list:
    """SRC7 as (parent, child): root classes, then each class's seed instances."""
    rows = [("HER2Entity", kind) for kind in _ROOT_CLASSES]
    return rows + [(kind, node_id) for kind in _ROOT_CLASSES
                   for node_id, _, node_kind, *_ in SEED_ENTITIES if node_kind == kind]


def class_hierarchy_df(spark: SparkSession) -> DataFrame:
    return local_df(spark, [("parent", _STR), ("child", _STR)], class_hierarchy_rows())


def decision_nodes_df(spark: SparkSession) -> DataFrame:
    """SRC8: decision nodes of all three algorithms, branches as structs."""
    text = ["id", "type", "question", "algorithm_id", "guideline_source", "result", "category",
            "label", "action", "note", "next"]
    fields = [(c, _STR) for c in text] + [("node_order", _INT), ("if_yes", _BRANCH), ("if_no", _BRANCH)]
    return local_df(spark, fields, [tuple(n.get(c) for c, _ in fields) for n in DECISION_NODES])


def explicit_edges_df(spark: SparkSession) -> DataFrame:
    return local_df(spark, [("algorithm_id", _STR), ("from_id", _STR), ("to_id", _STR),
                            ("condition", _STR), ("label", _STR)], EXPLICIT_EDGES)


def evidence_df(spark: SparkSession) -> DataFrame:
    """SRC9: one row per (category, agent, eligible)."""
    return local_df(spark, [("category", _STR), ("agent", _STR), ("eligible", _BOOL),
                            ("context", _STR), ("trial", _STR)], STATIC_EVIDENCE)


def evidence_guidelines_df(spark: SparkSession) -> DataFrame:
    return local_df(spark, [("category", _STR), ("guidelines", pa.list_(_STR))],
                    list(EVIDENCE_GUIDELINES.items()))
