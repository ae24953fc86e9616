"""The queries of this subpackage and their SQL."""

from importlib import import_module

MODULES = ("suffix_dedup", "simhash", "substring_dedup", "secret_scan", "mixing", "sentencepiece_bpe", "warc_zip", "ann", "language_id", "audio", "collocations", "decontaminate", "whitening")
QUERIES, ORACLE = {}, {}
for _name in MODULES:
    _module = import_module(f"{__package__}.{_name}")
    QUERIES.update(_module.QUERIES)
    ORACLE.update(getattr(_module, "ORACLE", {}))
