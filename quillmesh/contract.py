"""The intake contract: fixed values, kept as the contract spells them."""

from __future__ import annotations

# Fixed values.
CANONICAL_VERSION = "intake.v1"
ACCOMMODATION_CODES = ("BRAILLE_MATERIAL", "SIGN_INTERPRETER", "TEXT_ONLY", "STEP_FREE_ACCESS")
CONSENT_SCOPES = ("CONTACT_CALLBACK", "CASE_SUMMARY_TRANSFER", "ACCOMMODATION_TRANSFER")
#: channel: (source ID field, person field, callback window field or None)
CHANNELS = {
    "PHYSICAL": ("deskReceiptNo", "visitor", None),
    "HOTLINE": ("callRef", "caller", "callbackWindowMinutes"),
    "WEB": ("submissionId", "applicant", None),
}

#: Errors of a record, in the order in which they are listed.
ERRORS = (
    "MALFORMED_ENVELOPE",
    "MISSING_EVENT_ID",
    "UNKNOWN_CHANNEL",
    "MISSING_SOURCE_ID",
    "MALFORMED_FIELD",
    "UNKNOWN_ACCOMMODATION",
    "UNKNOWN_CONSENT_SCOPE",
    "NEGATIVE_CALLBACK_WINDOW",
    "EVENT_ID_CONFLICT",
)
ACCEPTED, REPLAY, REJECTED = "ACCEPTED", "REPLAY", "REJECTED"
