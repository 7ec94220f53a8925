"""The comparison features."""

from pairlink.operators.features import (  # noqa: F401
    Date, Exact, Frequency, FrequencyA, FrequencyB, Geographic, Numeric, RandomContinuous, RandomDiscrete, String, Variable, VariableA, VariableB,
)
