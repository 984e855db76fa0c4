"""Operators of a training-data pipeline (quality, extraction, decontamination,
licences, language-model scores, near duplicates, personal data, mixing, web
captures, language identification).

Nothing outside this subpackage imports it. Each module holds one operator
with its own general interface; ``queries`` derives the digest columns of the
registered ``opN_<name>`` queries from the operators' outputs.
"""
