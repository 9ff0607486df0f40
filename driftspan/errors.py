"""Errors that callers may want to tell apart."""


class DriftspanError(Exception):
    """Base of all errors of this library."""


class ValidationError(DriftspanError, ValueError):
    """Bad parameters or data."""


class NotEnoughDataError(ValidationError):
    """Too few rows are left to compute with."""


class NotFittedError(DriftspanError):
    """A detector was asked before it had a reference."""


class DataLoadingError(DriftspanError):
    """A source could not be read or decoded."""


def require(ok: bool, message: str) -> None:
    if not ok:
        raise ValidationError(message)
