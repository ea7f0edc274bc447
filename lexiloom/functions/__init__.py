"""Column functions over byte strings."""

from lexiloom.functions.byte_strings import as_bytes, byte_at, byte_length, compare_bytes, lcp_bytes, leading_uint, leading_zeros, lower_byte, not_above, prefix_bytes, same_byte, suffix_bytes, trailing_zeros, varint_size
from lexiloom.functions.codecs import golomb_bits, golomb_values, varint_bytes, varint_value
from lexiloom.functions.hashes import extended_hash, keyed_hash, multiplied_hash, prefix_hash

__all__ = [
    "as_bytes", "byte_at", "byte_length", "compare_bytes", "extended_hash", "golomb_bits", "golomb_values", "keyed_hash", "lcp_bytes", "leading_uint", "leading_zeros", "lower_byte",
    "multiplied_hash", "not_above", "prefix_bytes", "prefix_hash", "same_byte", "suffix_bytes", "trailing_zeros", "varint_bytes", "varint_size", "varint_value",
]
