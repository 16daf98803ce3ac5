from .hashing import (
    keyed_payload,
    payload_digest,
    payload_hash,
    with_field_hashes,
    with_payload,
    with_row_hash,
)
from .keys import KEY, KEY_ALIAS, keyed, reject_null_keys
from .normalize import Strategy, document_text, normalize, normalized, quoted, staged_texts
from .tags import has_tag, normalize_tags, with_tags

__all__ = [
    "KEY",
    "KEY_ALIAS",
    "Strategy",
    "document_text",
    "has_tag",
    "keyed",
    "keyed_payload",
    "normalize",
    "normalize_tags",
    "normalized",
    "payload_digest",
    "payload_hash",
    "quoted",
    "reject_null_keys",
    "staged_texts",
    "with_field_hashes",
    "with_payload",
    "with_row_hash",
    "with_tags",
]
