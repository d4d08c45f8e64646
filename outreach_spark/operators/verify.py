"""Email verification as joins on landed tables (P10-P12 helpers, J6-J8, K2).

Live DNS / SMTP probing is out of scope: MX records and probe codes are landed tables, and the
verdict is the application's decision chain evaluated as one CASE over left joins.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..functions.emails import email_domain, email_key, email_syntax_ok, is_role_address
from .dedupe import spread_key
from .lookup import one_row_lookup


def mx_lookup(mx: DataFrame) -> DataFrame:
    """Per domain the exchange with the lowest preference (ties: lowest exchange), trailing '.' removed.

    ``min`` over (preference, exchange) is a partial aggregate; a domain holding most records
    costs one row per map task.
    """
    d = mx.select(email_domain(F.concat(F.lit("x@"), F.col("domain"))).alias("domain"),
                  F.struct("preference", "exchange").alias("p"))
    best = d.groupBy("domain").agg(F.min("p").alias("p"))
    return best.select("domain", F.col("p.preference").alias("preference"),
                       F.regexp_replace(F.col("p.exchange"), r"\.+$", "").alias("mx_host"))


def verify_emails(requests: DataFrame, mx: DataFrame, email_col: str = "email", code_col: str = "probe_code", heavy_domains: int = 0) -> DataFrame:
    """Syntax -> role prefix -> MX -> probe code (250 deliverable; 550 not; other code deliverable;
    no answer = blocked, deliverable). Where the probe table has ``probe_error``, a row with one is VERIFY_ERROR
    (deliverable); the reason of other codes and of a block is the server's ``probe_message``.

    The MX table is per domain; its size is bounded by the number of distinct domains, and the join is
    left to the optimizer (broadcast when its statistics are under the threshold, else shuffled). Where it is too large for
    that, ``heavy_domains`` names how many of the commonest domains are answered from a map instead, so that a mail
    provider with a third of all requests is not shuffled to one task. Requests without a domain are dealt.
    """
    e = F.col(email_col)
    syntax = email_syntax_ok(e)
    role = is_role_address(e)
    req = requests.withColumn("domain", email_domain(e)).withColumn("syntax_valid", syntax).withColumn("_role", role)
    j = one_row_lookup(req, mx_lookup(mx).select("domain", "mx_host"), "domain", heavy_domains)
    code = F.col(code_col)
    mx_found = F.col("mx_host").isNotNull()
    none = F.lit(None).cast("string")
    error = F.col("probe_error") if "probe_error" in requests.columns else none
    message = F.col("probe_message") if "probe_message" in requests.columns else none
    result = (
        F.when(~F.col("syntax_valid"), "INVALID_SYNTAX")
        .when(F.col("_role"), "ROLE_BASED")
        .when(~mx_found, "MX_NOT_FOUND")
        .when(error.isNotNull(), "VERIFY_ERROR")
        .when(code.isNull(), "SMTP_BLOCK")
        .when(code == 250, "DELIVERABLE")
        .when(code == 550, "SMTP_550")
        .otherwise(F.concat(F.lit("SMTP_"), code.cast("string")))
    )
    deliverable = ~F.col("smtp_result").isin("INVALID_SYNTAX", "ROLE_BASED", "MX_NOT_FOUND", "SMTP_550")
    said = F.col("smtp_result")
    reason = F.when(said == "VERIFY_ERROR", error).when(said == "SMTP_BLOCK", F.coalesce(message, F.lit(K.NO_ANSWER_REASON)))
    for verdict, text in K.VERIFY_REASONS.items():
        reason = reason.when(said == verdict, text)
    reason = reason.when(said != "DELIVERABLE", message)
    out = j.withColumn("smtp_result", result)
    return out.select(
        *requests.columns,
        F.col("syntax_valid"),
        (F.col("syntax_valid") & ~F.col("_role") & mx_found).alias("mx_found"),
        "mx_host", "smtp_result",
        F.coalesce(deliverable, F.lit(False)).alias("is_deliverable"),
        reason.alias("failure_reason"),
    )


def upsert_verifications(results: DataFrame, ts_col: str = "verified_at", tie_col: str = "id") -> DataFrame:
    """K2: insert-or-replace by email: the latest verdict per address (ties by ``tie_col``)."""
    r = results.withColumn("email_key", email_key(F.col("email"))).filter(F.col("email_key").isNotNull())
    cols = ["email", "is_deliverable", "smtp_result", "failure_reason"]
    best = r.groupBy("email_key").agg(F.max(F.struct(F.col(ts_col).alias("verified_at"), F.col(tie_col).alias("_tie"), *cols)).alias("v"))
    return best.select("email_key", *[F.col("v")[c].alias(c) for c in cols], F.col("v.verified_at").alias("verified_at"))


def verification_lookup(requests: DataFrame, cache: DataFrame) -> DataFrame:
    """The cached verdict when there is one; otherwise the row is marked to_verify (the work list)."""
    r = requests.withColumn("email_key", email_key(F.col("email")))
    r = r.withColumn("_k", spread_key(F.col("email_key"), F.xxhash64(*requests.columns)))
    c = cache.select(F.col("email_key").alias("_k"), F.col("smtp_result").alias("cached_result"), F.col("is_deliverable").alias("cached_deliverable"))
    j = r.join(c, "_k", "left").select("email_key", *requests.columns, "cached_result", "cached_deliverable")
    return j.withColumn("lookup", F.when(F.col("cached_result").isNotNull(), "cached").otherwise("to_verify"))
