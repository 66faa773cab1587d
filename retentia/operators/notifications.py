"""Rows for notification delivery and display."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from retentia.functions.scalars import alert_targets
from retentia.operators.joins import lookup_join
from retentia.operators.selection import push_audience, role_in


def fan_out(notices: DataFrame, users: DataFrame) -> DataFrame:
    """One notification per notice and reachable user of its role."""
    audience = push_audience(users).select(F.col("_id").alias("user_id"), "role")
    return lookup_join(audience, notices.select("role", "title", "body", "url"), ["role"]).select(
        "user_id", "title", "body", "url")


def registration_alerts(users: DataFrame) -> DataFrame:
    """An alert per registration, addressed to the roles that hear about it."""
    return users.select(
        F.lit("new_registration").alias("alertType"), F.col("role").alias("userType"),
        alert_targets(F.col("role")).alias("targetEntityType"),
        F.concat(F.lit("New user registered: "), "role").alias("message"),
        F.col("created_at").alias("generatedAt"))


def inbox(notifications: DataFrame, alerts: DataFrame, user_id, role: str | None) -> DataFrame:
    """A user's own notifications and the alerts for the user's role, in one shape."""
    own = notifications.filter(F.col("user_id") == user_id).select(
        F.lit("notification").alias("kind"), F.col("title").alias("text"),
        F.col("created_at").alias("at"))
    if not role:
        return own
    return own.unionByName(alerts.filter(role_in("targetEntityType", role)).select(
        F.lit("alert").alias("kind"), F.col("message").alias("text"), F.col("generatedAt").alias("at")))
