"""The rules by which an answer is accepted, for columns (operators.answers) and for one text (functions.checking)."""

from __future__ import annotations

#: Fixed phrases of refusals.
REFUSAL = "(?i)i cannot translate|i can't translate|as an ai|не могу перевести|отказ от перевода"
#: A source of more characters than this must get an answer within these bounds.
COUNTS_FROM, LEAST, LEAST_SHARE, MOST_TIMES = 20, 8, 0.15, 8
#: Targets that must come back: addresses, and what looks like a path or a file.
FIRM = "(?i)^(?:https?:|mailto:)|[/.]"
#: What is said when a rule fails, in the order in which they are looked at; the last two name the target.
EMPTY, SHORT, LONG, REFUSED, TAGS, NO_IMAGE, NO_HREF = REASONS = (
    "empty translation", "translation too short", "translation too long", "model refusal", "harness tags in translation", "missing image ", "missing href ",
)

