"""Reading tables, writing predictions, and intermediate tables in the shared folder."""

from riskloom.sources.shared import freeze
from riskloom.sources.tables import read_stream, read_table, write_predictions

__all__ = ["freeze", "read_stream", "read_table", "write_predictions"]
