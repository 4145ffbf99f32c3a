"""Composite queries; importing this package registers all of them."""

from quern.plans import forms, ledgers, panels, periods, quarters, reports, rollups, rules, structures, texts  # noqa: F401
