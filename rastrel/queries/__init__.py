from rastrel.queries import (  # noqa: F401
    annotations,
    cohorts,
    display,
    measures,
    models,
    names,
    objects,
    pixels,
    readers,
    regions,
    spots,
    streams,
)
from rastrel.queries.registry import CHECKS, QUERIES  # noqa: F401
