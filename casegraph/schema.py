"""Tables and closed vocabularies of the data model."""

from __future__ import annotations

from pyspark.sql import types as T

# The vocabularies of the domain.
ENTITY_TYPES = ("PERSON", "PHONE", "LOCATION", "VEHICLE", "ORGANIZATION", "BANK_ACCOUNT", "CRYPTO_WALLET", "CASE", "REPORT", "SOCIAL_HANDLE", "GOV_ID")
ACTOR_TYPES = ("PERSON", "ORGANIZATION")
SYMMETRIC = ("MET", "MENTIONED_WITH", "COMMUNICATED_WITH", "ASSOCIATE_OF", "CO_ACCUSED", "CO_LOCATED", "SHARED_HANDSET")
OWNERSHIP = ("USES_PHONE", "OWNS_ACCOUNT", "OWNS_HANDLE", "ASSOCIATED_VEHICLE")
DIRECT_WEIGHTS = {"MET": 2.0, "CO_ACCUSED": 3.0, "REPORTS_TO": 3.0, "COMMUNICATED_WITH": 1.5, "MENTIONED_WITH": 0.5, "OWNS": 2.0, "DIRECTOR_OF": 2.0, "AFFILIATED_WITH": 1.0, "ASSOCIATE_OF": 2.0, "CONTROLS": 3.0}
PROTECTED_ROLES = ("victim", "complainant", "witness", "police")
SEVERITIES = ("low", "medium", "high", "critical")
EVENT_KINDS = ("CALL", "TRANSFER", "SIGHTING", "POST", "FIR", "INTEL", "JUDGMENT", "NEWS", "COMPLAINT")

_S, _D, _L, _TS = T.StringType(), T.DoubleType(), T.LongType(), T.TimestampNTZType()
_MAP = T.MapType(_S, _S)


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


TABLES = {
    "cases": _struct(id=_S, name=_S, description=_S, created_at=_TS),
    "documents": _struct(id=_S, case_id=_S, source_type=_S, title=_S, content=_S, meta=_MAP, occurred_at=_TS, ingested_at=_TS, expires_at=_TS, record_count=_L),
    "entities": _struct(id=_S, type=_S, label=_S, canonical_key=_S, aliases=T.ArrayType(_S), attributes=_MAP, mention_count=_L, first_seen=_TS, last_seen=_TS, risk_score=_D),
    "relationships": _struct(src=_S, dst=_S, rel_type=_S, weight=_D, count=_L, attributes=_MAP, first_seen=_TS, last_seen=_TS, confidence=_D),
    "evidence": _struct(id=_S, document_id=_S, entity_id=_S, relationship_id=_S, snippet=_S, confidence=_D, occurred_at=_TS, extractor=_S),
    "timeline_events": _struct(id=_S, document_id=_S, kind=_S, occurred_at=_TS, entity_ids=T.ArrayType(_S), summary=_S, details=_MAP, lat=_D, lon=_D),
    "alerts": _struct(kind=_S, severity=_S, title=_S, score=_D, reasons=T.ArrayType(_S), entity_ids=T.ArrayType(_S), review_status=_S, status=_S),
    "watches": _struct(id=_S, kind=_S, selector=_S, norm=_S, reason=_S, severity=_S, active=T.BooleanType()),
    "watch_hits": _struct(watch_id=_S, document_id=_S, entity_id=_S, matched_on=_S, snippet=_S, occurred_at=_TS),
    "evidence_ledger": _struct(index=_L, timestamp=_S, actor=_S, action=_S, subject_type=_S, subject_id=_S, payload_hash=_S, previous_hash=_S, entry_hash=_S, signature=_S, detail=_S),
}

ALERT = TABLES["alerts"]
