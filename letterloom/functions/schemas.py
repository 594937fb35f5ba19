"""JSON Schemas of the documents that the dataset consists of: records, manifests, submissions and assessments."""

from __future__ import annotations

from letterloom.functions import rules

_TEXT = {"type": "string"}
_COUNT = {"type": "integer", "minimum": 0}
_SHARE = {"type": "number", "minimum": 0, "maximum": 1}
_TEXTS = {"type": "array", "items": _TEXT}
# fixed values: forms of identifiers
_IDS = {
    "indicator": {"type": "string", "pattern": "^IND-[0-9]{2}$"},
    "parameter": {"type": "string", "pattern": "^IND-[0-9]{2}-P[1-3]$"},
    "hash": {"type": "string", "pattern": "^[a-f0-9]{64}$"},
}


def _object(required: list[str], properties: dict, closed: bool = True) -> dict:
    return {"type": "object", "required": required, "properties": properties, **({"additionalProperties": False} if closed else {})}


def _all(properties: dict, closed: bool = True) -> dict:
    return _object(list(properties), properties, closed)


_FIELD_TEXTS = {f: _TEXT for f in rules.FIELDS}

RECORD = {
    "$schema": "http://json-schema.org/draft-07/schema#", "title": "What the pipeline found in one file", "definitions": _IDS,
    **_object(
        ["document_id", "filename", "sha256", "page_count", "is_scanned", "doc_type", "region", "relevant_fields", "manifest", "pipeline", "metadata", "missing_reasons", "verified", "text_excerpt"],
        {
            "document_id": {"type": ["integer", "string"]}, "filename": _TEXT, "sha256": {"$ref": "#/definitions/hash"}, "file_size_bytes": _COUNT, "page_count": _COUNT,
            "is_scanned": {"type": "boolean"}, "duplicate_of": _TEXT, "text_excerpt": _TEXT, "text_sha256": _TEXT, "relevant_fields": _TEXTS,
            "doc_type": _all({"type": {"enum": [t for t, _, _ in rules.DOC_TYPES] + [rules.MEDIA_TYPE, rules.UNKNOWN_TYPE]}, "label": _TEXT, "confidence": _SHARE}),
            "region": _all({"code": {"enum": [rules.HOME_REGION, rules.OUTSIDE_REGION, rules.UNKNOWN_REGION]}, "name": _TEXT}),
            "manifest": _all({"innovation_id": _TEXT, "indicator_id": _TEXT, "evidence_tag": _TEXT}),
            "pipeline": _all({
                "inspect": _all({"words_page_1": _COUNT, "is_scanned": {"type": "boolean"}, "text_pages_read": _COUNT}),
                "preprocess": _all({"target_dpi": _COUNT, "pages_rasterized": {"type": "array", "items": {"type": "integer", "minimum": 1}}, "skew_angle_deg": {"type": "number"}}),
                "extract": _object(["engine", "text_source"], {"engine": _TEXT, "text_source": {"enum": ["text layer", "ocr", "none"]}, "ocr_engine": _TEXT, "field_confidence": {"type": "object", "additionalProperties": _SHARE}}),
                "qr": _all({"verification_url": _TEXT, "detector": _TEXT}),
                "validate": _all({"is_valid_id": {"type": "boolean"}, "confidence_score": _SHARE, "needs_review": {"type": "boolean"}, "flags": _TEXTS}),
            }),
            "metadata": _all({**_FIELD_TEXTS, "has_stamp": {"type": "boolean"}, "has_signature": {"type": "boolean"}}),
            "missing_reasons": {"type": "object", "additionalProperties": _TEXT},
            "verified": _object(["status", "verified_by", "values"], {"status": _TEXT, "source": _TEXT, "verified_by": _TEXT, "verified_at": _TEXT, "values": _all(_FIELD_TEXTS), "differs": _TEXTS}),
        },
    ),
}

MANIFEST = {
    "title": "Files that an innovation offers as evidence", "definitions": _IDS,
    **_object(
        ["innovation_id", "manifest_version", "evidences"],
        {
            "innovation_id": _TEXT, "manifest_version": _TEXT, "created_at": _TEXT,
            "evidences": {"type": "array", "minItems": 1, "items": _object(
                ["evidence_id", "filename", "indicator_id"],
                {"evidence_id": _TEXT, "filename": _TEXT, "indicator_id": {"$ref": "#/definitions/indicator"}, "evidence_tag": _TEXT, "sha256": {"$ref": "#/definitions/hash"},
                 "page_start": {"type": "integer", "minimum": 1}, "page_end": {"type": "integer", "minimum": 1}, "note": _TEXT, "url": _TEXT},
            )},
        },
    ),
}

SUBMISSION = {
    "title": "An innovation that a unit submits", "definitions": _IDS,
    **_object(
        ["innovation_id", "name", "unit", "kind", "year", "indicators"],
        {
            "innovation_id": _TEXT, "name": {"type": "string", "minLength": 1}, "unit": _TEXT, "kind": {"enum": ["digital", "non digital", "technology"]}, "year": {"type": "integer", "minimum": 2015, "maximum": 2100},
            "status": {"enum": ["DRAFT", "SUBMITTED", "ASSESSED", "FINAL"]}, "description": _TEXT,
            "indicators": {"type": "array", "items": _object(
                ["indicator_id"], {"indicator_id": {"$ref": "#/definitions/indicator"}, "claimed_parameter_id": {"anyOf": [{"$ref": "#/definitions/parameter"}, {"type": "null"}]}, "evidence_ids": {**_TEXTS, "uniqueItems": True}, "narrative": _TEXT},
            )},
        },
    ),
}

ASSESSMENT = {
    "title": "What annotators decided about an innovation", "definitions": _IDS,
    **_object(
        ["innovation_id", "guideline_version", "annotations"],
        {
            "innovation_id": _TEXT, "guideline_version": _TEXT,
            "annotations": {"type": "array", "items": _object(
                ["indicator_id", "parameter_id", "label"],
                {"indicator_id": {"$ref": "#/definitions/indicator"}, "parameter_id": {"$ref": "#/definitions/parameter"}, "label": {"enum": ["FULFILLED", "PARTIAL", "NOT_FULFILLED", ""]},
                 "score": {"type": ["number", "null"], "minimum": 0}, "evidence_ids": _TEXTS, "reason": _TEXT, "annotator": _TEXT, "annotated_at": _TEXT, "source": {"enum": ["human", "machine"]},
                 "second_annotator": {"type": ["string", "null"]}, "second_label": {"type": ["string", "null"]}},
            )},
        },
    ),
}
