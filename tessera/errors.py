"""Error names. Analysis and parse errors are Spark's own, under short names."""

from pyspark.errors import AnalysisException as AnalysisError
from pyspark.errors import ParseException as ParseError


class FunctionNotFound(LookupError):
    """No function of that name is registered."""


class SchemaMismatch(ValueError):
    """Branches of a set operation whose columns don't match, or a wrong number of names."""


class DialectError(ValueError):
    """SQL text that the dialect's rewriting can't follow."""


__all__ = ["AnalysisError", "DialectError", "FunctionNotFound", "ParseError", "SchemaMismatch"]
