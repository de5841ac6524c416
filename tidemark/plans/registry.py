"""All queries of the timed-event part by name, with their SQL."""

from __future__ import annotations

from tidemark.plans import alignments, analysis, editing, lookups, measures, merging, projecting, signals, texts, timeline

QUERIES = {**timeline.QUERIES, **analysis.QUERIES, **editing.QUERIES, **measures.QUERIES, **lookups.QUERIES, **merging.QUERIES, **texts.QUERIES, **alignments.QUERIES, **signals.QUERIES, **projecting.QUERIES}
SQL = {**timeline.SQL, **analysis.SQL, **editing.SQL, **measures.SQL, **lookups.SQL, **merging.SQL, **texts.SQL, **alignments.SQL, **signals.SQL, **projecting.SQL}
