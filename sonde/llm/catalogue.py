"""The queries of this subpackage and their SQL checks."""

from sonde.llm import (classifier, codes, dialogue, language, licenses, lines, mix, ngrams, packing, rules, simhash,
                       sketch, urls)

QUERIES: dict = {}
CHECKS: dict = {}
for module in (ngrams, mix, rules, classifier, packing, sketch, language, simhash, urls, licenses, dialogue, codes, lines):
    QUERIES |= module.QUERIES
    CHECKS |= module.CHECKS
