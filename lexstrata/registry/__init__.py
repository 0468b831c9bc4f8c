"""Queries on the driver's tables. Importing this package registers all of them."""

from . import extraction, phonology, relational  # noqa: F401
from .views import QUERIES, Query  # noqa: F401
