"""The census linkage: which pairs to look at, what to compare, how to train."""

from linkwright.operators.blocking import BlockRule, block_on
from linkwright.operators.comparison import comparison_birth_year, comparison_exact, comparison_first_name
from linkwright.operators.model import LinkSettings

RULES = (
    block_on("norm_first_name", "nysiis_last_name"),
    BlockRule(("norm_race", "gender"), (("birth_year", 5),)),
)
COMPARISONS = (
    comparison_birth_year(),
    comparison_exact("norm_race"),
    comparison_exact("gender"),
    comparison_first_name(),
)
SETTINGS = LinkSettings(RULES, COMPARISONS)
DETERMINISTIC = (block_on("gender", "norm_race", "norm_first_name"),)
TRAINING_BLOCKS = (block_on("gender"), block_on("norm_race", "norm_first_name"))
RECALL = 0.9
THRESHOLD = 0.2
UNUSED = (
    "source", "confidence", "race", "occupation", "created", "full_name", "first_name", "last_name",
    "maiden_name", "death_year", "legal_status", "is_enslaver", "location_id",
)
