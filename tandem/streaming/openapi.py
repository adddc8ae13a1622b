"""The HTTP API's contract as an OpenAPI document, and a check of values against its schemas."""

from __future__ import annotations

import html
from typing import Any

from tandem.functions.codec import camel
from tandem.functions.statemachine import STATS

VERSION = "1.0.0"
STATUSES = ["EQUAL", "EQUAL_DIVERGED", "DIFF", "MISSING_IN_LOAD", "EXTRA_IN_LOAD", "NOT_MIRRORED", "TEST_TRAFFIC", "UNANCHORED"]
TEXT, WHOLE, LONG, FLAG = {"type": "string"}, {"type": "integer"}, {"type": "integer", "format": "int64"}, {"type": "boolean"}
STATUS, SEVERITY = {"type": "string", "enum": STATUSES}, {"type": "string", "enum": ["OK", "INFO", "WARN", "ERROR"]}
CONFIG = {"type": "object", "description": "a compare config: policy, ruleSets, topics"}


def listed(items: dict) -> dict:
    return {"type": "array", "items": items}


def shaped(required: str = "", /, **properties: dict) -> dict:
    """An object that has these properties and no others; required: the names of those that it always has."""
    return {"type": "object", "properties": properties, "additionalProperties": False} | ({"required": required.split()} if required else {})


def one(value: str) -> dict:
    return {"type": "string", "enum": [value]}


def ref(name: str) -> dict:
    return {"$ref": f"#/components/schemas/{name}"}


SCHEMAS = {
    "Error": shaped("error", error=TEXT),
    "RuleType": shaped("type params", type=TEXT, params=listed(shaped("name kind required", name=TEXT, kind={"type": "string", "description": "number, text, or enum: and its values"}, required=FLAG))),
    "Verdict": shaped(
        "type guid topic status severity revision decidedAtMillis stats", type=one("verdict"), guid=TEXT, topic=TEXT, status=STATUS, severity=SEVERITY, revision=WHOLE, decidedAtMillis=LONG,
        signatureId=TEXT, signature=listed(TEXT), diffs=listed(shaped("path kind", path=TEXT, kind={"type": "string", "enum": ["added", "removed", "type-changed", "value-changed"]}, main=TEXT, load=TEXT)),
        diffsTruncated=FLAG, stats=shaped(" ".join(map(camel, STATS)), **{camel(c): WHOLE for c in STATS}),
    ),
    "Rollup": shaped(
        "type windowStartMillis windowEndMillis topic status severity count sampleGuids", type=one("rollup"), windowStartMillis=LONG, windowEndMillis=LONG, topic=TEXT, status=STATUS, severity=SEVERITY,
        signatureId=TEXT, signature=listed(TEXT), count=LONG, sampleGuids=listed(TEXT),
    ),
    "DeadLetter": shaped("type env topic timestampMillis error payloadPreview", type=one("dead-letter"), env={"type": "string", "enum": ["MAIN", "LOAD"]}, topic=TEXT, timestampMillis=LONG, error=TEXT, payloadPreview=TEXT),
    "Health": shaped("ok", ok=FLAG),
    "Active": shaped("active source", active=CONFIG | {"nullable": True}, source={"type": "string", "enum": ["control", "bootstrap", "none"]}),
    "Validation": shaped("valid", valid=FLAG, error=TEXT),
    "Applied": shaped("applied", applied=FLAG),
    "Summary": shaped("total counts", total=WHOLE, counts={"type": "object", "additionalProperties": WHOLE}),
}
_TOPIC = {"name": "topic", "in": "query", "required": False, "schema": TEXT, "description": "only this logical topic"}
_LIMIT = {"name": "limit", "in": "query", "required": False, "schema": WHOLE | {"default": 100}, "description": "how many of the newest"}
#: (method and path): (what it does, schema of its answer, whether it takes a config, its parameters)
OPERATIONS: dict[str, tuple[str, dict, bool, list[dict]]] = {
    "GET /api/health": ("Whether the API runs", ref("Health"), False, []),
    "GET /api/rule-types": ("Rule types and their parameters", listed(ref("RuleType")), False, []),
    "GET /api/config/active": ("The active compare config and where it comes from", ref("Active"), False, []),
    "POST /api/config/validate": ("Check a compare config", ref("Validation"), True, []),
    "POST /api/config/apply": ("Make a compare config the active one", ref("Applied"), True, []),
    "GET /api/verdicts": ("The newest verdicts", listed(ref("Verdict")), False, [_TOPIC, _LIMIT]),
    "GET /api/rollups": ("The newest roll-ups", listed(ref("Rollup")), False, [_TOPIC, _LIMIT]),
    "GET /api/dead-letters": ("The newest records that could not be read", listed(ref("DeadLetter")), False, [_TOPIC, _LIMIT]),
    "GET /api/summary": ("Counts of the newest verdicts by status", ref("Summary"), False, [_TOPIC, _LIMIT]),
}


def document() -> dict:
    paths: dict[str, dict] = {}
    answer = lambda schema, text: {"description": text, "content": {"application/json": {"schema": schema}}}
    for route, (what, schema, takes_config, parameters) in OPERATIONS.items():
        method, path = route.split()
        body = {"requestBody": {"required": True, "content": {"application/json": {"schema": CONFIG}}}} if takes_config else {}
        found = {"summary": what, "responses": {"200": answer(schema, "done"), "400": answer(ref("Error"), "the request can't be answered")}}
        paths.setdefault(path, {})[method.lower()] = found | body | ({"parameters": parameters} if parameters else {})
    return {"openapi": "3.0.3", "info": {"title": "tandem", "version": VERSION, "description": "Findings of a parity job and its compare config."}, "paths": paths, "components": {"schemas": SCHEMAS}}


def page() -> str:
    """The operations as a page."""
    rows = "".join(f"<tr><td><code>{html.escape(route)}</code></td><td>{html.escape(what)}</td></tr>" for route, (what, *_) in OPERATIONS.items())
    return f'<!doctype html><meta charset="utf-8"><title>tandem</title><h1>tandem</h1><p><a href="/openapi.yaml">openapi.yaml</a></p><table>{rows}</table>'


_KINDS = {"string": str, "integer": int, "boolean": bool, "array": list, "object": dict}


def faults(value: Any, schema: dict, at: str = "$") -> list[str]:
    """Where a JSON value breaks a schema of this document."""
    if "$ref" in schema:
        schema = SCHEMAS[schema["$ref"].rpartition("/")[2]]
    if value is None and schema.get("nullable"):
        return []
    if not isinstance(value, _KINDS[schema["type"]]) or (schema["type"] == "integer" and isinstance(value, bool)):
        return [f"{at}: no {schema['type']}"]
    if "enum" in schema and value not in schema["enum"]:
        return [f"{at}: not one of {schema['enum']}"]
    if isinstance(value, list):
        return [f for i, x in enumerate(value) for f in faults(x, schema["items"], f"{at}[{i}]")]
    if not isinstance(value, dict) or "properties" not in schema and "additionalProperties" not in schema:
        return []
    known, more = schema.get("properties", {}), schema["additionalProperties"]
    found = [f"{at}: lacks {name}" for name in schema.get("required", []) if name not in value]
    for name, x in value.items():
        if name in known or more:
            found += faults(x, known.get(name, more), f"{at}.{name}")
        else:
            found.append(f"{at}: {name} is unknown")
    return found
