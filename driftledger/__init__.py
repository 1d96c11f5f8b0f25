"""Ledger, drift and schema-contract auditing of versioned scripts, as Spark table operators."""
