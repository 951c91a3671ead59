"""Column functions, and their registration for SQL."""

from .hashing import (  # noqa: F401
    chunk,
    chunks,
    dhash_9x8,
    dhash_9x8_arrow,
    hamming32,
    hamming64,
    image_hamming,
    image_hash_error,
    image_hash_from_hex,
    image_hash_hex,
    image_hash_hex_arrow,
    image_words,
    parse_fingerprint,
    register,
    sha256_hex,
)
from .overlap import adaptive_floor, classify, edge_pair, matched, moving_mask, orient  # noqa: F401
