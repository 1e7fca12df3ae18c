"""Every job as a registered query on the supplied tables, with DuckDB SQL for the same rows where SQL can express them."""

from __future__ import annotations

from quireworks.queries import citing, lines, records

QUERIES = lines.QUERIES | citing.QUERIES | records.QUERIES
ORACLES = lines.ORACLES | citing.ORACLES | records.ORACLES
