"""Registered queries: each operator on the test tables, next to equivalent SQL."""

from seqrec.checks import (  # noqa: F401
    cleaning,
    examples,
    features,
    files,
    identifiers,
    jobs,
    losses,
    metrics,
    retrieval,
    semantic,
    sequences,
)
from seqrec.checks.registry import REGISTRY  # noqa: F401
