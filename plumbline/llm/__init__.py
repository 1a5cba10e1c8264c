"""Operators that prepare a text corpus for training; nothing outside this folder imports them."""
