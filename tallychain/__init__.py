"""Provenance-ledger analytics on Spark: canonical payloads, hash chains, Merkle roots, anchors, audits."""
