"""All registered queries."""

from retentia.plans.catalog import (  # noqa: F401
    merging, profiling, reporting, scalars, selecting, storing, modelling,
)
from retentia.plans.catalog.base import ORACLES, QUERIES  # noqa: F401
