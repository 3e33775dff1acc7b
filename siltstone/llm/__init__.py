"""Training-data operators (decontamination, packing, dedup, ...).

Nothing outside this subpackage imports it.  ``queries`` and ``oracles`` are
read by the repository's entry module when the subpackage is present.
"""
