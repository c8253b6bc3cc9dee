"""All geography queries by name, with their oracles."""

from __future__ import annotations

from areaframe.plans import audits, inputs, lookups, publishing, records, shapes

QUERIES = lookups.QUERIES | records.QUERIES | audits.QUERIES | shapes.QUERIES | inputs.QUERIES | publishing.QUERIES
ORACLES = lookups.ORACLES | records.ORACLES | audits.ORACLES | shapes.ORACLES | inputs.ORACLES | publishing.ORACLES
