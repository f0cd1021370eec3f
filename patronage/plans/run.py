"""The two-table run: map, complete, join, analyse, store, tidy up."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from patronage.operators import rollups
from patronage.operators.models import Fitted
from patronage.operators.reports import newest_per_key
from patronage.plans.analysis import analyze_churn, analyze_revenue, process_tables
from patronage.session import materialize
from patronage.sources.store import RunStore


@dataclass
class RunResult:
    allowed: bool
    analysis_id: int | None = None
    customers: int = 0
    churn_model: DataFrame | None = None
    revenue_model: DataFrame | None = None


def customer_rows(customers: DataFrame, metrics: DataFrame) -> DataFrame:
    """Customer grain for the store: master data with totals and purchase dates."""
    known = [c for c in ("customer_name", "age", "gender") if c in customers.columns]
    place = next((c for c in ("country", "location") if c in customers.columns), None)
    people = customers.select("customer_id", *known, *([F.col(place).alias("country")] if place else []))
    totals = metrics.select(
        "customer_id", F.col("total_amount").alias("total_spent"), "transaction_count",
        F.col("first_purchase").alias("first_purchase_date"), F.col("last_purchase").alias("last_purchase_date"),
    )
    return totals.join(people, "customer_id", "left")


def run_analysis(
    store: RunStore, user_id: str, customers: DataFrame, transactions: DataFrame, customer_roles: dict,
    transaction_roles: dict, at: dt.datetime, training: dict | None = None, models: dict[str, Fitted] | None = None,
    customer_order: list | None = None, transaction_order: list | None = None,
) -> RunResult:
    """One stored analysis of a tenant, unless its daily quota is used up.

    Required roles must be mapped. The customer metrics are written once and
    feed both models; runs past the retention are dropped at the end. ``models``
    may hold trained models, ``churn`` and ``revenue``, that score instead of new
    ones. The models that were used are stored with the run.
    """
    missing = [r for r, roles in (("customer_id", customer_roles), ("date", transaction_roles), ("amount", transaction_roles)) if not roles.get(r)]
    if missing:
        raise ValueError(f"roles not mapped: {missing}")
    if not store.quota(user_id, at.date())["allowed"]:
        return RunResult(False)
    c, t = process_tables(customers, transactions, customer_roles, transaction_roles, customer_order, transaction_order)
    # Transactions shrink to one row per customer first; ages and genders join there,
    # which gives the same rows as carrying them through every transaction.
    people = newest_per_key(c, ["customer_id"])
    metrics = rollups.customer_rollup(t, at, first_date=True)
    metrics = metrics.join(people.select("customer_id", "age", "gender"), "customer_id", "left")
    metrics = materialize(metrics, "run-metrics")
    models, used = models or {}, {}
    churn, churn_model = analyze_churn(
        metrics.drop("first_purchase"), at, fitted=models.get("churn"), keep_model=lambda f: used.update(churn=f), **(training or {})
    )
    revenue, revenue_model = analyze_revenue(
        metrics.drop("first_purchase"), at, fitted=models.get("revenue"), keep_model=lambda f: used.update(revenue=f), **(training or {})
    )
    run = store.save_run(user_id, churn, revenue, customer_rows(people, metrics), at, used)
    store.cleanup(user_id, at)
    return RunResult(True, run, metrics.count(), churn_model, revenue_model)
