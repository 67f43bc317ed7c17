from .generate import of_cardinality, rows, uniform, unique  # noqa: F401
from .catalog import TABLES, load, register_views, save, table_literal  # noqa: F401
