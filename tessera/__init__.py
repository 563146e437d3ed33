"""tessera: a relational engine expressed directly on PySpark DataFrames."""

from tessera.operators.frame import Frame
from tessera.operators.windows import Window
from tessera.session import Engine

__all__ = ["Engine", "Frame", "Window"]
