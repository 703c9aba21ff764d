"""Score strings and score -> segment maps.

A segment map is an ordered ``{regex: label}`` dict applied to a score string
the way a regex ``replace`` does: each pattern in turn substitutes its matches
with the label.  Scores come from small known domains (1..5 per letter), so
the map is evaluated once on the driver over every possible score string and
shipped to the executors as a literal lookup - the rows never run a regex.
"""

from __future__ import annotations

import itertools
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# The recency+frequency score patterns and their segment names,
# in their original order.
RF_SEGMENT_MAP = {
    r"[1-2][1-2]": "hibernating",
    r"[1-2][3-4]": "at_Risk",
    r"[1-2]5": "cant_loose",
    r"3[1-2]": "about_to_sleep",
    r"33": "need_attention",
    r"[3-4][4-5]": "loyal_customers",
    r"41": "promising",
    r"51": "new_customers",
    r"[4-5][2-3]": "potential_loyalists",
    r"5[4-5]": "champions",
}

# The campaign target lists of the omnichannel case.
BRAND_CAMPAIGN_SEGMENTS = ("champions", "loyal_customers")
BRAND_CAMPAIGN_CATEGORIES = ("KADIN",)
DISCOUNT_CAMPAIGN_SEGMENTS = ("cant_loose", "hibernating", "new_customers")
DISCOUNT_CAMPAIGN_CATEGORIES = ("ERKEK", "COCUK")


def score_string(*scores: Column | str) -> Column:
    """Concatenate integer scores as text ("5" + "3" -> "53"); null if any is null."""
    return F.concat(*[(F.col(s) if isinstance(s, str) else s).cast("string") for s in scores])


def apply_regex_map(value: str, mapping: dict[str, str]) -> str:
    """Apply an ordered {regex: label} map to one string, as a regex replace does."""
    for pattern, label in mapping.items():
        value = re.sub(pattern, label, value)
    return value


def segment_lookup(
    mapping: dict[str, str] | None = None, digits: int = 2, levels: int = 5
) -> dict[str, str]:
    """The mapped label of every score string of ``digits`` scores in 1..levels."""
    mapping = RF_SEGMENT_MAP if mapping is None else mapping
    lookup = {}
    for combo in itertools.product(range(1, levels + 1), repeat=digits):
        score = "".join(str(d) for d in combo)
        lookup[score] = apply_regex_map(score, mapping)
    return lookup


def segment_of(
    score: Column | str, mapping: dict[str, str] | None = None, digits: int = 2, levels: int = 5
) -> Column:
    """Segment label of a score string column via a literal map lookup."""
    lookup = segment_lookup(mapping, digits, levels)
    literal = F.create_map(*[F.lit(x) for kv in sorted(lookup.items()) for x in kv])
    col = F.col(score) if isinstance(score, str) else score
    return F.try_element_at(literal, col)
