"""Errors of the SQL front-end and the catalog."""


class SqlError(ValueError):
    """The text is not a statement of this dialect, or does not fit the schema."""


class ConstraintError(SqlError):
    """A row breaks a constraint of its table."""


class ConflictError(RuntimeError):
    """Another transaction committed something that this one depends on; run it again."""
