"""Evidence operators: infer a replacement value for an issue from the data.

Statuses: CANDIDATE, NO_RELATIONSHIP, AMBIGUOUS, INSUFFICIENT_GROUP.
"""

CANDIDATE, NO_RELATIONSHIP = "CANDIDATE", "NO_RELATIONSHIP"
AMBIGUOUS, INSUFFICIENT = "AMBIGUOUS", "INSUFFICIENT_GROUP"
