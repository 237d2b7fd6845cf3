"""Operators that prepare text and names for training language models; nothing outside imports them."""
