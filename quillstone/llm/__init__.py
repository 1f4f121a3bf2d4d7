"""Operators for text collections used in training; nothing outside this folder imports them."""
