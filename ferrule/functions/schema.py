"""Names of prompt sections: a dimension table from fixed values."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession

# Canonical names, those a prompt must have, their defaults, other names and German names. The default of the constraints is our own.
CANONICAL = [
    "system",
    "audience",
    "purpose",
    "tone",
    "confidence",
    "response_depth",
    "task",
    "context",
    "constraints",
    "output_format",
    "reference_materials",
    "example",
    "checklist",
    "out_of_scope",
    "deterministic_rules",
    "deterministic_codes",
    "knowledge_graph_pins",
    "retrieved_elements",
    "attachments",
]
MUST = [
    "system",
    "task",
    "context",
    "constraints",
    "output_format",
    "audience",
    "purpose",
    "tone",
]
DEFAULTS = {
    "system": "consultant",
    "audience": "general audience",
    "purpose": "inform",
    "tone": "neutral",
    "response_depth": "high",
    "constraints": "be accurate and cite sources",
    "output_format": "free_text",
}
ALIASES = {
    "system": ["llm role", "role", "persona", "assistant role"],
    "audience": ["reader", "target audience", "audience type", "stakeholders"],
    "purpose": ["goal", "objective", "aim"],
    "tone": ["style", "voice", "register"],
    "response_depth": ["depth", "level of detail"],
    "task": ["user request", "user prompt", "request", "wish", "wishes", "thing to be done"],
    "context": ["background", "notes", "assumptions"],
    "constraints": ["rules", "guidelines", "policies"],
    "output_format": ["format", "output schema", "json schema", "markdown format"],
    "reference_materials": ["sources", "references"],
    "example": ["sample", "example output", "few-shot"],
    "out_of_scope": ["non-goals", "not in scope", "exclusions"],
}
GERMAN = {
    "task": ["aufgabe"],
    "purpose": ["zweck"],
    "audience": ["zielgruppe"],
    "context": ["kontext", "hinweise", "annahmen"],
    "constraints": ["einschränkungen", "regeln", "vorgaben"],
    "output_format": ["format", "ausgabeformat"],
    "tone": ["ton"],
    "example": ["beispiel"],
    "reference_materials": ["quellen", "referenzen"],
    "out_of_scope": ["außerhalb des umfangs", "nicht im umfang"],
}


def names(spark: SparkSession) -> DataFrame:
    """name, canonical, priority: canonical names before aliases before German ones."""
    rows = [(n, n, 0) for n in CANONICAL]
    for priority, table in ((1, ALIASES), (2, GERMAN)):
        rows += [(name, canonical, priority) for canonical, listed in table.items() for name in listed]
    return spark.createDataFrame(rows, "name string, canonical string, priority int")


def must_defaults() -> dict[str, str]:
    """Defaults of the names a prompt must have, but for its task."""
    return {k: DEFAULTS.get(k, "") for k in MUST if k != "task"}


def load(spark: SparkSession, path: str) -> tuple[DataFrame, dict[str, str]]:
    """Names and defaults, as above, of a JSON file: canonical_keys, must_keys, defaults, aliases (name: canonical) and bilingual (language: name: canonical).

    Parts that aren't there are empty; a file that isn't a JSON object is an error. An alias of an unknown name counts for nothing.
    """
    found = json.loads("\n".join(r.value for r in spark.read.text(path, wholetext=True).collect()))
    if not isinstance(found, dict):
        raise ValueError(f"{path} isn't a JSON object")
    canonical = [str(n) for n in found.get("canonical_keys") or []]
    rows = [(n, n, 0) for n in canonical]
    rows += [(a, c, 1) for a, c in (found.get("aliases") or {}).items() if c in canonical]
    rows += [(a, c, 2) for listed in (found.get("bilingual") or {}).values() for a, c in (listed or {}).items() if c in canonical]
    defaults = found.get("defaults") or {}
    return spark.createDataFrame(rows, "name string, canonical string, priority int"), {k: str(defaults.get(k, "")) for k in found.get("must_keys") or [] if k != "task"}
