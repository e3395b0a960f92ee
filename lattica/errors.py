"""What goes wrong with a statement or a table, told to the user."""


class QueryError(ValueError):
    """A statement cannot be run."""


class ParseError(QueryError):
    """A statement is not well formed."""


class ValidationError(QueryError):
    """A well-formed statement breaks a rule of the language or does not fit the table."""


class LoadError(ValueError):
    """Input does not fit the table it is loaded into."""


class AccessError(QueryError):
    """The caller may not read the table."""
