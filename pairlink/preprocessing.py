"""Cleaning and phonetic encoding."""

from pairlink.functions.clean import clean, phonenumbers, value_occurence  # noqa: F401
from pairlink.functions.phonetic import phonetic, phonetic_algorithms  # noqa: F401
