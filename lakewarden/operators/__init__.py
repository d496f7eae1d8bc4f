"""The predicate operators. Importing the package fills the registry."""

from . import compare, dates, dictionary, grouping, presence, sequence, sets, strings  # noqa: F401
from .registry import OPERATORS, get, operator  # noqa: F401
