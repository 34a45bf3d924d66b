"""All queries of the core package and their SQL."""

from __future__ import annotations

from tidemark.plans import alignment, analysis, dealt, documents, models, ordering


def queries() -> dict:
    """Name to function of (spark, folder)."""
    return {**alignment.R.queries, **ordering.R.queries, **analysis.R.queries, **documents.R.queries, **models.R.queries, **dealt.QUERIES}


def oracles() -> dict[str, str]:
    """Name to SQL over the views of the tables."""
    return {**alignment.R.oracles, **ordering.R.oracles, **analysis.R.oracles, **documents.R.oracles, **models.R.oracles, **dealt.ORACLES}
