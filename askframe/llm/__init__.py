"""Training-data operators: deduplication, packing, tokens, language, toxicity, licences and quality.

Nothing outside this subpackage imports it.  ``queries`` lists the thin digest queries, ``oracles`` their SQL.
"""
