"""Fixed schemas of the stored tables, and readers that hold data to them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

# Columns of the stored tables. Timestamps are UTC; local dates are kept as text.
TABLES = {
    "blogs": "id long, name string, feed_url string, url string, status string, status_updated_at timestamp, version int, update_action string",
    "blog_posts": "id long, blog_id long, index int, url string, title string",
    "blog_post_categories": "id long, blog_id long, name string, index int, is_top boolean",
    "blog_post_category_assignments": "id long, blog_post_id long, category_id long",
    "blog_canonical_equality_configs": "blog_id long, same_hosts array<string>, expect_post_paths boolean",
    "blog_discarded_feed_entries": "id long, blog_id long, url string",
    "blog_missing_from_feed_entries": "id long, blog_id long, url string",
    "blog_crawl_votes": "id long, user_id long, blog_id long, value string",
    "subscriptions": "id long, user_id long, blog_id long, name string, status string, is_paused boolean, schedule_version int, "
                     "finished_setup_at timestamp, created_at timestamp, final_item_published_at timestamp, discarded_at timestamp",
    "subscription_posts": "id long, subscription_id long, blog_post_id long, random_id string, published_at timestamp, "
                          "published_at_local_date string, publish_status string",
    "schedules": "id long, subscription_id long, day_of_week string, count int",
    "users": "id long, email string, product_user_id string",
    "user_settings": "user_id long, timezone string, delivery_channel string, version int",
    "product_events": "id long, product_user_id string, event_type string, event_properties string, user_properties string, user_ip string, "
                      "browser string, os_name string, os_version string, bot_name string, created_at timestamp, dispatched_at timestamp",
    "admin_telemetries": "id long, key string, value double, extra string, created_at timestamp",
    "start_pages": "id long, content binary, url string, final_url string",
    "start_feeds": "id long, start_page_id long, title string, url string, final_url string, content binary",
    "delayed_jobs": "id long, handler string, run_at timestamp, locked_by string",
    "responses": "start_link_id int, fetch_url string, code string, content_type string, location string, body binary",
}


def schema_of(table: str) -> StructType:
    return StructType.fromDDL(TABLES[table])


def load_table(spark: SparkSession, folder: str, table: str) -> DataFrame:
    """Snapshot of one table out of ``<folder>/<table>.parquet`` with its fixed schema."""
    return spark.read.schema(schema_of(table)).parquet(f"{folder}/{table}.parquet")


def conform(df: DataFrame, table: str) -> DataFrame:
    """Hold a frame to the schema of a table: columns in order, cast; missing ones are null, others are dropped."""
    return df.select(*[
        (F.col(f"`{f.name}`") if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema_of(table).fields])
