"""Declared schemas: nothing is inferred when a table is read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = {
    "region": "r_regionkey INT, r_name STRING",
    "nation": "n_nationkey INT, n_name STRING, n_regionkey INT",
    "customer": "c_custkey BIGINT, c_name STRING, c_nationkey INT, c_acctbal DOUBLE, c_mktsegment STRING",
    "supplier": "s_suppkey BIGINT, s_name STRING, s_nationkey INT, s_acctbal DOUBLE",
    "part": "p_partkey BIGINT, p_name STRING, p_brand STRING, p_type STRING, p_size INT, p_retailprice DOUBLE",
    "orders": "o_orderkey BIGINT, o_custkey BIGINT, o_orderstatus STRING, o_totalprice DOUBLE, "
    "o_orderdate TIMESTAMP_NTZ, o_orderpriority STRING",
    "lineitem": "l_orderkey BIGINT, l_partkey BIGINT, l_suppkey BIGINT, l_linenumber INT, l_quantity DOUBLE, "
    "l_extendedprice DOUBLE, l_discount DOUBLE, l_tax DOUBLE, l_returnflag STRING, l_linestatus STRING, "
    "l_shipdate TIMESTAMP_NTZ",
    "events": "event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING, value DOUBLE, props STRING",
    "documents": "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT",
    "labels": "doc_id BIGINT, quality INT, toxic INT",
    "pages": "page_id BIGINT, url STRING, html STRING",
    "benchmark": "item_id BIGINT, text STRING",
    "conversations": "conv_id BIGINT, turn BIGINT, role STRING, text STRING",
    "embeddings": "vec_id BIGINT, embedding ARRAY<FLOAT>, label INT",
}

# The product's own tables, for snapshots this package writes and reads back.
LAKE = {
    "ai_usage_events": "id STRING, created_at TIMESTAMP, day DATE, request_id STRING, user_id STRING, "
    "purpose STRING, model STRING, prompt_tokens INT, cached_tokens INT, completion_tokens INT, "
    "web_searches INT, cost_usd DOUBLE, ok BOOLEAN, duration_ms INT",
    "request_log": "ts TIMESTAMP, level STRING, request_id STRING, user_id STRING, method STRING, path STRING, "
    "endpoint STRING, status INT, duration_ms DOUBLE",
    "traffic_daily": "day DATE, area STRING, requests BIGINT, errors BIGINT, ai_calls BIGINT",
    "user_activity_daily": "day DATE, user_id STRING",
    "documents": "id STRING, user_id STRING, source_type STRING, url STRING, title STRING, content_clean STRING, "
    "original_filename STRING, file_size BIGINT, page_count INT, word_count INT, extraction_status STRING, "
    "last_read_page INT, is_read BOOLEAN, read_fraction DOUBLE, collection_id STRING, license STRING, "
    "created_at TIMESTAMP, updated_at TIMESTAMP, "
    "source_map ARRAY<STRUCT<key: STRING, boxes: ARRAY<ARRAY<DOUBLE>>>>, "
    "content_aside STRUCT<classifier: STRING, blocks: ARRAY<STRUCT<type: STRING, text: STRING, page: INT, "
    "box: ARRAY<DOUBLE>, confidence: DOUBLE, reason: STRING>>>",
    "highlights": "id STRING, user_id STRING, document_id STRING, block_id STRING, start_offset INT, "
    "end_offset INT, rects ARRAY<STRUCT<x: DOUBLE, y: DOUBLE, w: DOUBLE, h: DOUBLE>>, selected_text STRING, "
    "color STRING, category STRING, note STRING, page_number INT, prefix STRING, suffix STRING, "
    "content_version STRING, canonical_start INT, canonical_end INT, "
    "clean_anchor ARRAY<STRUCT<block: STRING, start: INT, `end`: INT>>, anchor_status STRING, "
    "sync_status STRING, created_at TIMESTAMP, updated_at TIMESTAMP",
    "notes": "id STRING, user_id STRING, document_id STRING, body STRING, origin STRING, source_key STRING, "
    "created_at TIMESTAMP, updated_at TIMESTAMP",
    "document_chunks": "document_id STRING, position INT, page_number INT, heading STRING, text STRING, "
    "token_count INT, embedding ARRAY<FLOAT>",
    "page_items": "doc_id STRING, page INT, ord INT, x0 DOUBLE, y0 DOUBLE, x1 DOUBLE, y1 DOUBLE, "
    "page_width DOUBLE, page_height DOUBLE, text STRING, kind STRING, size DOUBLE, bold BOOLEAN",
    "map_nodes": "artifact_id STRING, ord INT, id STRING, parent STRING, label STRING, detail STRING, "
    "sources ARRAY<INT>",
}


def read_table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).parquet(path)


class Tables:
    """The tables below one folder, each read on first use with its declared schema."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def __getattr__(self, name: str) -> DataFrame:
        if name not in TABLES:
            raise AttributeError(name)
        path = f"{self.folder}/{name}.parquet"
        return read_table(self.spark, path, TABLES[name])
