"""Structured answers of a model, parsed from their JSON and brought to the allowed values."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import blank, json_object, normalise_many, normalise_one, strip


def block_of(catalog: dict[str, Any], name: str) -> dict[str, Any]:
    """A field's block of an option catalog: by its name, else the catalog itself if it has options, else its only block with options."""
    if isinstance(catalog.get(name), dict):
        return catalog[name]
    if isinstance(catalog.get("options"), list):
        return catalog
    blocks = [v for v in catalog.values() if isinstance(v, dict) and isinstance(v.get("options"), list)]
    if len(blocks) != 1:
        raise KeyError(f"no block of options for {name}")
    return blocks[0]


def field_config(field: dict[str, Any]) -> dict[str, Any]:
    """allowed, default, most, labels and descriptions of a field of options; options that aren't objects with an id are skipped.

    A field takes several values if its cardinality says so, or, where it has none, if it may select more than one.
    """
    options = [o for o in field.get("options") or [] if isinstance(o, dict) and o.get("id")]
    most = field.get("max_selected", 1)
    most = int(most) if str(most).isdecimal() else 1
    many = field.get("cardinality", "many" if most > 1 else "one") == "many"
    named = lambda key: {o["id"]: o[key] for o in options if key in o}
    return {"allowed": [o["id"] for o in options], "default": field.get("default"), "most": (most if most > 1 else len(options)) if many else 1, "many": many, "labels": named("label"), "descriptions": named("description")}


def targets_text(targets: list[dict[str, Any]], fields: dict[str, dict[str, Any]], keys: dict[str, str] | None = None) -> str:
    """What an agent may choose: per target (id, label, min_selected, max_selected) its rule and its field's options; targets without an id are left out."""
    blocks = []
    for t in targets:
        if not (name := t.get("id")):
            continue
        field, most = fields.get(name, {}), int(t.get("max_selected", 1))
        lines = [f"Field '{t.get('label', name)}' (JSON key: '{(keys or {}).get(name, name)}')"]
        lines.append(f"- Select between {int(t.get('min_selected', 1))} and {most} option ids." if most > 1 else "- Select exactly one option id.")
        for option in field.get("allowed", []):
            said = [(field[what].get(option) or "").strip() for what in ("labels", "descriptions")]
            lines.append(f"  * {option}: {' — '.join(x for x in said if x)}" if any(said) else f"  * {option}")
        blocks.append("\n".join(lines))
    return "\n\n".join(blocks)


def selected(answer: Column, fields: dict[str, dict[str, Any]]) -> dict[str, Column]:
    """A column per field: a text, or an array where the field takes several; defaults stand in for what isn't allowed."""
    obj = json_object(answer)
    out = {}
    for name, f in fields.items():
        value = F.get_json_object(obj, f"$.{name}")
        if f["many"]:
            listed = F.coalesce(F.from_json(value, "array<string>"), F.array(value))
            default = f["default"] if isinstance(f["default"], list) else [f["default"]]
            out[name] = normalise_many(listed, f["allowed"], f["most"], default)
        else:
            out[name] = normalise_one(value, f["allowed"], f["default"])
    return out


def classified(answers: DataFrame, key: str, fields: dict[str, dict[str, Any]], answer: str = "answer", root: str = "item_decisions", id_key: str = "chunk_id") -> DataFrame:
    """key, id_key and a column per field for each item of the answers; items without an id are left out."""
    listed = F.from_json(F.get_json_object(json_object(F.col(answer)), f"$.{root}"), "array<string>")
    items = F.transform(listed, lambda x: F.from_json(x, "map<string,string>"))  # one by one: an odd item spoils no other
    rows = answers.select(key, F.explode(items).alias("x_")).withColumn(id_key, strip(F.try_element_at("x_", F.lit(id_key)))).where(~blank(F.col(id_key)))
    return rows.select(key, id_key, *(normalise_one(F.try_element_at("x_", F.lit(n)), f["allowed"], f["default"]).alias(n) for n, f in fields.items()))


def synthesised(answer: Column, names: list[str]) -> dict[str, Column]:
    """Stripped texts of the named parts of an answer; a missing one is empty."""
    obj = json_object(answer)
    return {n: F.coalesce(strip(F.get_json_object(obj, f"$.{n}")), F.lit("")) for n in names}


def usage(calls: DataFrame, by: list[str], response: str = "response") -> DataFrame:
    """Calls and tokens summed from the usage that responses report; what isn't reported counts 0, a missing total input and output."""
    n = lambda *path: F.coalesce(*(F.get_json_object(response, f"$.usage.{p}").cast("long") for p in path), F.lit(0).cast("long"))
    rows = calls.select(
        *by,
        n("input_tokens", "prompt_tokens").alias("input"),
        n("input_tokens_details.cached_tokens", "prompt_tokens_details.cached_tokens").alias("cached"),
        n("output_tokens", "completion_tokens").alias("output"),
        n("output_tokens_details.reasoning_tokens").alias("reasoning"),
        F.get_json_object(response, "$.usage.total_tokens").cast("long").alias("total"),
    ).withColumn("total", F.coalesce("total", F.col("input") + F.col("output")))
    return rows.groupBy(*by).agg(F.count("*").alias("calls"), *(F.sum(c).alias(c) for c in ("input", "cached", "output", "reasoning", "total")))
