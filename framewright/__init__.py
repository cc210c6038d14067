"""Framewright: capture-set quality measurement and file reconciliation as Spark jobs."""
