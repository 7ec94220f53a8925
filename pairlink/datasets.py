"""Data sets and generators."""

from pairlink.sources.febrl import load_febrl1, load_febrl2, load_febrl3, load_febrl4  # noqa: F401
from pairlink.sources.generate import binary_vectors  # noqa: F401
from pairlink.sources.patterns import clear_data_home, get_data_home  # noqa: F401
from pairlink.sources.patterns import load_patterns as load_krebsregister  # noqa: F401
