"""Site-selection analytics expressed as PySpark DataFrame, SQL and Structured Streaming jobs."""

from sitehex.cities import CITIES, City, UnknownCity, check_city
from sitehex.tables import Tables

__all__ = ["CITIES", "City", "Tables", "UnknownCity", "check_city"]
