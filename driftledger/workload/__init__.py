"""The registered queries. Importing the parts fills the registry."""

from driftledger.workload import checks, contracts, ledgers, objects, reports, scripts  # noqa: F401
from driftledger.workload.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
