"""The queries of this package and their SQL."""

from __future__ import annotations


from rillmark.plans import Registry

REGISTRY = Registry()
add = REGISTRY.add

#: The two tables whose texts problems 1 and 4 compare: kind, table, key.
RECORDS = (("document", "extracted_documents", "ext_row"), ("chunk", "chunks_v2", "chunk_row"))
