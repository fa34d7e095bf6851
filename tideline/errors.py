"""Exceptions raised on the driver; violations in rows become columns instead."""


class TidelineError(Exception):
    pass


class PoolViolation(TidelineError):
    """A manifest was read without saying which pools."""


class UncalibratedClaim(TidelineError):
    """A bound was claimed of a boundary that has not been calibrated."""


class DegenerateEmbedding(TidelineError):
    """A threshold does not keep the share of rows that was asked for."""


class TemplateError(TidelineError):
    """A prompt template lacks a placeholder or a value."""


class UnknownComponent(TidelineError):
    pass


class SinkEvicted(TidelineError):
    """A context budget is smaller than what may never be evicted."""


class BudgetExceeded(TidelineError):
    pass
