"""Errors of the pipe language and of declarative configuration."""


class QueryError(ValueError):
    """A query that cannot be read or resolved; pos is the offset in its text, if known."""

    def __init__(self, message: str, pos: int | None = None) -> None:
        super().__init__(message if pos is None else f"{message} (at offset {pos})")
        self.message, self.pos = message, pos


class ConfigError(ValueError):
    """A model, rule or action definition that cannot be used."""
