"""Imports every query module and exposes the catalogue in the driver's form."""

from __future__ import annotations

import framelens.plans.composed_queries  # noqa: F401
import framelens.plans.io_queries  # noqa: F401
import framelens.plans.record_queries  # noqa: F401
import framelens.plans.text_queries  # noqa: F401
import framelens.plans.web_queries  # noqa: F401
from framelens.plans.registry import CATALOGUE, Tables


def queries():
    return {name: (lambda spark, sf_dir, q=q: q.build(Tables(spark, sf_dir))) for name, q in CATALOGUE.items()}


def oracle_sql():
    return {name: q.sql for name, q in CATALOGUE.items() if q.sql is not None}
