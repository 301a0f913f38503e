"""Every query of the subpackage, one per dealt operator."""

from regiometra.llm import q_alignment, q_ann, q_brown, q_convnet, q_jaccard, q_mixing, q_negatives, q_packing, q_repeats, q_rules, q_sharding, q_windows  # noqa: F401
from regiometra.llm.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
