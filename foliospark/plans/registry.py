"""All registered queries with their check SQL."""

from __future__ import annotations

from foliospark.plans import cataloguing, detection, files, ordering, reporting

_AREAS = (ordering, detection, cataloguing, reporting, files)

QUERIES = {name: fn for area in _AREAS for name, fn in area.QUERIES.items()}
ORACLE = {name: sql for area in _AREAS for name, sql in area.ORACLE.items()}
