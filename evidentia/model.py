"""The tables of a workspace: Spark schemas, and rules that a JSON record of each table must meet."""

from __future__ import annotations

SOURCE = (
    "id string, kind string, locator string, canonical_locator string, title string, author string, publisher string, published_at string, retrieved_at string, tier string, tier_reason string, "
    "license string, media_type string, charset string, lang string, raw_sha256 string, normalized_sha256 string, normalizer_version int, "
    "extraction struct<tool:string,version:int,ok:boolean,notes:array<string>>, status string, error string, schema_version int"
)
TEXT = "source_id string, text string, text_len int, sha256 string"
CHUNK = "chunk_id string, source_id string, ordinal int, span_start int, span_end int, heading_path array<string>"
EVIDENCE = "struct<source_id:string,start:int,end:int,quote:string,quote_sha256:string,length:int,redacted:boolean>"
CLAIM = f"id string, text string, topic_key string, kind string, confidence string, volatile boolean, as_of string, recheck string, contradicts array<string>, status string, superseded_by string, notes string, evidence array<{EVIDENCE}>"
ADJUDICATION = "cluster_id string, topic_key string, claim_ids array<string>, outcome string, reason string, decided_at string, winner string"
SECTION = "ord int, id string, heading string, intent string, claim_ids array<string>"
CREDIT = "name string, origin string, source string, credit string, license string, license_url string, generator string, prompt string, created_at string, retrieved_at string, sha256 string"
LINE = "n int, speaker string, segment string, kind string, text string, claims array<string>"
FINDING = "gate string, code string, severity string, subject string, detail string"


def _text(**rules) -> dict:
    return {"type": "string", **rules}


def _maybe(**rules) -> dict:
    return {"type": ["string", "null"], **rules}


def _whole(**rules) -> dict:
    return {"type": "integer", **rules}


def _list(items: dict, **rules) -> dict:
    return {"type": "array", "items": items, **rules}


def _record(required: str, **properties: dict) -> dict:
    return {"type": "object", "required": required.split(), "properties": properties, "additionalProperties": False}


def _hex(prefix: str, n: int) -> str:
    return f"^{prefix}[0-9a-f]{{{n}}}$"


# The identifiers, words and bounds that records are held to.
RULES: dict[str, dict] = {
    "source": _record(
        "schema_version id kind locator canonical_locator tier tier_reason retrieved_at status",
        schema_version={"const": 1}, id=_text(pattern=_hex("src_", 12)), kind=_text(enum=["url", "file", "paste"]), locator=_text(minLength=1), canonical_locator=_text(minLength=1),
        retrieved_at=_text(format="date-time"), tier=_text(enum=["A", "B", "C", "D"]), tier_reason=_text(), status=_text(enum=["pending", "needs_extraction", "ready", "failed"]), normalizer_version={"type": ["integer", "null"]},
        extraction={"type": "object", "properties": {"tool": _text(), "version": _whole(), "ok": {"type": "boolean"}, "notes": _list(_text())}},
        **{name: _maybe() for name in ("title", "author", "publisher", "published_at", "license", "media_type", "charset", "lang", "raw_sha256", "normalized_sha256", "error")},
    ),
    "claim": _record(
        "id text topic_key kind confidence evidence status",
        id=_text(pattern=_hex("clm_", 12)), text=_text(minLength=3), topic_key=_text(pattern="^[a-z0-9]+([._-][a-z0-9]+)*$"), kind=_text(enum=["fact", "number", "date", "entity", "quote", "definition", "interpretation", "recommendation"]),
        confidence=_text(enum=["verified", "reported", "contested", "inferred", "unsupported"]), volatile={"type": "boolean"}, as_of=_maybe(format="date"), recheck=_maybe(format="uri"), contradicts=_list(_text()),
        status=_text(enum=["active", "superseded", "retracted"]), superseded_by=_maybe(), notes=_text(),
        evidence=_list(_record("source_id start end", source_id=_text(pattern=_hex("src_", 12)), start=_whole(minimum=0), end=_whole(minimum=1), quote=_text(), quote_sha256=_text(pattern=_hex("", 64)), length=_whole(minimum=0), redacted={"type": "boolean"})),
    ),
    "adjudication": _record(
        "cluster_id topic_key claim_ids outcome reason decided_at",
        cluster_id=_text(pattern=_hex("cls_", 12)), topic_key=_text(), claim_ids=_list(_text(), minItems=1), outcome=_text(enum=["supersede", "both_stand", "scope_split", "retract"]), reason=_text(minLength=20),
        decided_at=_text(format="date-time"), winner=_maybe(),
    ),
    "section": _record("id heading claim_ids", id=_text(pattern="^[a-z0-9-]+$"), heading=_text(), intent=_text(), claim_ids=_list(_text(pattern=_hex("clm_", 12)))),
    "credit": _record(
        "origin", origin=_text(enum=["sourced", "generated"]), sha256=_text(pattern=_hex("", 64)), **{name: _text() for name in ("source", "credit", "license", "license_url", "generator", "prompt", "created_at", "retrieved_at")},
    ),
    "manifest": {
        "type": "object", "required": ["schema_version", "state", "capabilities", "config"],
        "properties": {
            "schema_version": {"const": 1}, "created_at": _text(format="date-time"), "question": _text(), "revise_count": _whole(minimum=0), "blockers": _list(_text()), "tool_versions": {"type": "object"},
            "state": _text(enum=["INIT", "COLLECT", "EXTRACT", "CHUNK", "INDEX", "PLAN", "GROUND", "ADJUDICATE", "COMPOSE", "RENDER", "VERIFY", "PACKAGE", "DONE", "REVISE", "BLOCKED"]),
            "artifact_type": _maybe(enum=["answer", "explainer", "deck", "brief", "infographic", "podcast", None]),
            "capabilities": _record("web_fetch image_gen tts", web_fetch=_text(enum=["agent", "script", "none"]), image_gen=_text(enum=["agent", "none"]), tts=_text(enum=["agent", "external", "none"])),
            "config": {"type": "object", "properties": {"chunk_target": _whole(minimum=200), "chunk_overlap": _whole(minimum=0)}}, "lint_waivers": {"type": "object", "additionalProperties": _text(minLength=8)},
            "history": _list({"type": "object", "required": ["state", "at"], "properties": {"state": _text(), "at": _text(format="date-time"), "note": _text()}}),
        },
    },
    "dialogue": _record(
        "schema_version episode speakers lines",
        schema_version={"const": 1}, episode=_text(minLength=3), outline=_list(_record("name description size", name=_text(), description=_text(), size=_text(enum=["short", "medium", "long"]))),
        speakers=_list(_record("name", name=_text(), voice_hint=_text()), minItems=1),
        lines=_list(_record("n speaker text claims kind", n=_whole(minimum=1), speaker=_text(), text=_text(minLength=1), claims=_list(_text()), kind=_text(enum=["factual", "opinion", "banter", "transition"]), segment=_text()), minItems=1),
    ),
}
