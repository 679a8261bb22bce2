"""Research-imaging archive analytics as Spark jobs.

Everything here is a function from DataFrames to a DataFrame (or a Column): nothing collects data to
the driver, and all ordering or neighbour logic is written so that one key owning a large share of the
rows is still spread over many tasks.
"""

from scanloom.catalog import Catalog, load_catalog

__all__ = ["Catalog", "load_catalog"]
