"""The modules whose QUERIES and ORACLE the entry point registers."""

from importlib import import_module

NAMES = ["mixing", "warc", "language_id", "ann", "pii", "substrings", "lm", "exact_dedup", "simhash", "packing", "toxicity", "prefix_trie", "metric_trees"]


def modules() -> list:
    import corpus_pipeline

    return [*(import_module(f"shotlake.llm.{n}") for n in NAMES), corpus_pipeline]
