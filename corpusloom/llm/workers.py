"""Memory of Python workers; see :mod:`corpusloom.functions.workers`."""

from ..functions.workers import give_back, tidy  # noqa: F401  for the operators
