"""Adapters of models from other libraries."""

from pairlink.operators.classify import KerasAdapter, SKLearnAdapter, SparkMLClassifier  # noqa: F401
