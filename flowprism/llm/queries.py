"""All queries of this subpackage."""

from flowprism.llm import entries_archives, entries_bpe, entries_classifier, entries_extraction, entries_language_model, entries_minmax, entries_native, entries_recompression, entries_rules, entries_sharding, entries_vectors  # noqa: F401
from flowprism.llm.registry import ORACLES, QUERIES


def queries() -> dict:
    return dict(QUERIES)


def oracles() -> dict[str, str]:
    return dict(ORACLES)
