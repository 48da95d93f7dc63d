"""All registered queries: importing the modules registers them."""

from tarifa.plans import catalogue, landing, market, texts  # noqa: F401
from tarifa.plans.oracles import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
