"""All registered queries and their SQL."""

from __future__ import annotations

from postmill.plans import flows, numbers, outputs, pages, records, rules, services, texts

QUERIES = pages.QUERIES | texts.QUERIES | numbers.QUERIES | services.QUERIES | records.QUERIES | flows.QUERIES | outputs.QUERIES | rules.QUERIES
ORACLE = pages.ORACLE | texts.ORACLE | numbers.ORACLE | services.ORACLE | records.ORACLE | flows.ORACLE | outputs.ORACLE | rules.ORACLE
