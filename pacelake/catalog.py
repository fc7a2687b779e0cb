"""All registries of the library's own queries."""

from __future__ import annotations

from .operators import relational, windows
from .plans import assertions, context, course, features, fitness, longruns, reads, rollups, routes, segments, signals, telemetry
from .sources import ingest, published
from .streaming import replace

REGISTRIES = [m.R for m in (ingest, published, relational, windows, rollups, telemetry, segments, signals, routes, features, fitness, longruns, context, reads, course, assertions, replace)]
