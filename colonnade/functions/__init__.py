"""Column functions of the engine: conversions between text, booleans and numbers."""

from colonnade.schema import convert, equals_as_long, is_integral_number, logical_to_number, parse_double, parse_long

__all__ = ["convert", "equals_as_long", "is_integral_number", "logical_to_number", "parse_double", "parse_long"]
