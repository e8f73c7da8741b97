"""Where a query goes: statute, user documents, both, or a form."""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F

from lexquarry.functions.refs import section_intent

# Words that point at an uploaded document.
DOCUMENT_SIGNALS = [
    "document", "notice", "fir", "petition", "attached file", "uploaded",
    "allegation", "complainant", "accused", "according to the document",
    "agreement", "contract", "clause", "complaint", "in my case",
    "bail application", "charge sheet", "affidavit", "plaint", "written statement",
    "resume", "cv",
]
# Words that point at the statute.
STATUTE_SIGNALS = [
    "bns", "bnss", "section", "s.", "sec.", "punishment for",
    "bailable", "cognizable", "magistrate power", "arrest procedure",
    "schedule", "offence under", "ipc", "crpc", "bare act",
    "culpable homicide", "murder", "theft", "extortion", "robbery",
    "dacoity", "cheating", "mischief", "criminal breach of trust",
]
# Words that together with "form" ask for a form.
FORM_WORDS = ["no", "number", "1", "2", "3", "4", "33", "58", "show", "get", "what is"]
FORM_NAMES = ["notice for appearance", "warrant of arrest", "bail bond"]


def _any(signals: list[str], bounded_to: int = 0) -> str:
    return "|".join(rf"\b{re.escape(s)}\b" if len(s) <= bounded_to else re.escape(s) for s in signals)


def route(query: Column, active_documents: Column) -> Column:
    """Struct(intent, confidence, section, reason); ``active_documents`` is an array.

    Signals of at most two letters must stand alone.
    """
    low = F.lower(query)
    intent = section_intent(query)
    has_doc = low.rlike(_any(DOCUMENT_SIGNALS, bounded_to=2))
    has_statute = intent.isNotNull() | low.rlike(_any(STATUTE_SIGNALS))
    none = F.size(F.coalesce(active_documents, F.array().cast("array<string>"))) == 0
    case = (
        F.when(none, 1).when(has_doc & has_statute, 2).when(has_doc, 3).when(has_statute, 4).otherwise(5)
    )

    def pick(*values) -> Column:
        return F.element_at(F.array(*[F.lit(v) for v in values]), case)

    return F.struct(
        pick("STATUTORY_ONLY", "COMBINED", "DOCUMENT_ONLY", "STATUTORY_ONLY", "COMBINED").alias("intent"),
        pick(1.0, 0.95, 0.90, 0.90, 0.70).alias("confidence"),
        F.when(case.isin(2, 4), intent["section_number"]).alias("section"),
        pick("no active documents", "document and statute signals", "document signal", "statute signal",
             "no signal, documents active").alias("reason"))


def is_form_intent(query: Column) -> Column:
    low = F.lower(query)
    return (low.contains("form") & low.rlike(_any(FORM_WORDS))) | low.rlike(_any(FORM_NAMES))


def principal_of(token: Column) -> Column:
    """User named by a development token; null when it names nobody.  Not a security check."""
    return (
        F.when(token.startswith("token_"), F.element_at(F.split(token, "_", 3), 2))
        .when(token.startswith("user_"), token)
        .when(token.contains(":"), F.element_at(F.split(token, ":", 2), 1))
        .when(F.length(token) >= 3, token)
    )


def session_of(token: Column) -> Column:
    return F.when(token.contains(":"), F.element_at(F.split(token, ":", 2), 2))


def endpoint_label(path: Column) -> Column:
    """Request path with ids replaced, so that labels stay few."""
    doc = path.startswith("/api/v1/documents/") & (path != "/api/v1/documents/upload")
    return (
        F.when(doc & path.rlike("^/api/v1/documents/status(/|$)"), "/api/v1/documents/{id}/status")
        .when(doc, "/api/v1/documents/{id}")
        .when(path.startswith("/api/v1/forms/"), "/api/v1/forms/{id}")
        .otherwise(path)
    )
