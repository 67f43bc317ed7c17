from .settings import Settings  # noqa: F401
from .symbolic import H, Node, Sym, evaluate, register  # noqa: F401
