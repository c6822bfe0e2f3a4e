"""Proved figures over messy transaction ledgers, as Spark DataFrame operators."""

from tallyproof.config import Mapping, Policy, RateColumns, RefundColumns, Request, SummaryColumns

__all__ = ["Mapping", "Policy", "RateColumns", "RefundColumns", "Request", "SummaryColumns"]
