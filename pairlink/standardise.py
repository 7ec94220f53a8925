"""Old names of the preprocessing functions; each warns and forwards."""

import warnings
from collections.abc import Callable
from functools import wraps

from pairlink import preprocessing


def _old(function: Callable) -> Callable:
    @wraps(function)
    def forward(*args, **kwargs):
        warnings.warn(f"standardise.{function.__name__} is deprecated, use preprocessing.{function.__name__}", DeprecationWarning, stacklevel=2)
        return function(*args, **kwargs)

    return forward


clean, phonenumbers, value_occurence, phonetic = map(_old, (preprocessing.clean, preprocessing.phonenumbers, preprocessing.value_occurence, preprocessing.phonetic))
