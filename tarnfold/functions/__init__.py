"""Scalar functions as column expressions."""

from tarnfold.functions.numbers import clamp, cyclic, day_angle, leading_zero_bit, universal_hash, wind, year_angle, zscore
from tarnfold.functions.text import clean_post, flip_name, non_word_tokens, short_date, space_tokens, strip_message

__all__ = ["clamp", "clean_post", "cyclic", "day_angle", "flip_name", "leading_zero_bit", "non_word_tokens", "short_date", "space_tokens", "strip_message", "universal_hash", "wind", "year_angle", "zscore"]
