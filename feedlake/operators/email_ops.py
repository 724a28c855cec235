"""E-mail operations: bounce triage and pending e-mails."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedlake.functions.ordered import first_per_key

# Bounce classes and the wait before each retry (attempt count -> minutes).
NOISE_BOUNCES = ["Subscribe", "AutoResponder", "OpenRelayTest"]
SOFT_BOUNCES = ["Transient", "DnsError", "SoftBounce", "Undeliverable"]
RETRY_MINUTES = {1: 5, 2: 15, 3: 40, 4: 120, 5: 180, 6: 360}


def triage_bounces(bounces: DataFrame, messages: DataFrame, subs: DataFrame, marked: DataFrame) -> DataFrame:
    """Action per bounce: ``noise``, ``retry`` with its wait, ``mark_user`` (first hard one) or ``already_marked``.

    ``bounces(bounce_id, message_id, bounce_type)``, ``messages(message_id, message_type, subscription_id,
    subscription_post_id)``, ``subs(subscription_id, user_id)``, ``marked(user_id)``. Bounces whose message is not
    known yet do not come out; the stream keeps them for its next batch.
    """
    keys = ["message_type", "subscription_id", "subscription_post_id"]
    attempts = messages.groupBy(*keys).agg(F.count("*").alias("attempt_count"))
    known = bounces.where("message_id is not null").join(messages, "message_id").alias("b")
    counted = known.join(attempts.alias("a"), [F.col(f"b.{k}").eqNullSafe(F.col(f"a.{k}")) for k in keys]).select(
        "b.*", "a.attempt_count").join(subs.select("subscription_id", "user_id"), "subscription_id")
    wait = F.coalesce(*[F.when(F.col("attempt_count") == n, m) for n, m in RETRY_MINUTES.items()])
    noise = F.col("bounce_type").isin(NOISE_BOUNCES)
    soft = F.col("bounce_type").isin(SOFT_BOUNCES)
    waited = counted.withColumn("wait_minutes", F.when(soft, wait))
    kind = F.when(noise, "noise").when(F.col("wait_minutes").isNotNull(), "retry").otherwise("hard")
    triaged = waited.withColumn("_kind", kind)
    first = first_per_key(triaged.where("_kind = 'hard'").select("user_id", "bounce_id"), ["user_id"], ["bounce_id"])
    fresh = first.join(marked, "user_id", "left_anti").select("bounce_id", F.lit(True).alias("_marks"))
    joined = triaged.join(fresh, "bounce_id", "left")
    action = F.when(F.col("_kind") != "hard", F.col("_kind")).when(F.col("_marks"), "mark_user").otherwise("already_marked")
    return joined.withColumn("action", action).drop("_kind", "_marks")


def new_bounces(polled: DataFrame, known: DataFrame) -> DataFrame:
    return polled.dropDuplicates(["bounce_id"]).join(known.select("bounce_id"), "bounce_id", "left_anti")


def email_batch(sub_posts: DataFrame, subs: DataFrame, bounced_users: DataFrame) -> DataFrame:
    """Pending posts of users who may still get mail: ``sub_posts(subscription_id, publish_status, ...)``."""
    pending = sub_posts.where("publish_status = 'email_pending'").join(subs.select("subscription_id", "user_id"), "subscription_id")
    return pending.join(bounced_users.select("user_id"), "user_id", "left_anti")


def pending_by_date(batch: DataFrame) -> DataFrame:
    return batch.groupBy("user_id", "published_at_local_date").agg(F.count("*").alias("n"))


def email_outcomes(batch: DataFrame) -> DataFrame:
    """Per user: sent and unsent counts (``error_code`` 0 is sent); the final item follows only a full success."""
    counts = batch.groupBy("user_id").agg(
        F.count_if(F.col("error_code") == 0).alias("n_sent"), F.count_if(F.col("error_code") != 0).alias("n_unsent"))
    return counts.withColumn("send_final_item", F.col("n_unsent") == 0)
