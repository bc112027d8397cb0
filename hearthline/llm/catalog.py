"""Importing this module registers the subpackage's queries."""

from hearthline.llm import (  # noqa: F401
    classifier, decontaminate, html_text, jaccard, language_model, line_dedup, mixing, packing, pii, prefix_trie, quality, substring_dedup, whitening,
)
