import datetime
import os

import pytest

AT = datetime.datetime(2025, 1, 1)
BLOCKS = "block_id bigint, book_id string, page_index int, block_pos int, type string, content string, loc array<double>, translation string, updated_at timestamp, ingested_at timestamp"
CLASHES = ["key", "n", "class", "source", "line", "item", "text", "lang", "tokens", "word", "page", "id", "title"]


@pytest.fixture(scope="session")
def blocks_of(spark):
    """blocks_of([(block_id, book, page, pos, type, content[, translation])]) with columns that operators must not mind."""

    def make(rows, more=True):
        from pyspark.sql import functions as F

        df = spark.createDataFrame([(r[0], r[1], r[2], r[3], r[4], r[5], [0.0, 0.0, 9.0, 9.0], r[6] if len(r) > 6 else None, AT, AT) for r in rows], BLOCKS)
        for c in CLASHES if more else []:
            df = df.withColumn(c, F.lit(7))
        return df

    return make


@pytest.fixture(scope="session")
def tables(spark, tmp_path_factory):
    """tables(blocks=df, ...) -> a folder with those tables, the others empty."""
    empty = {
        "blocks": BLOCKS,
        "page_info": "book_id string, page_index int, finished boolean, translated boolean, src_lang string, target_lang string, width_pt double, height_pt double",
        "page_results": "result_id bigint, book_id string, page_index int, source string, truncated boolean, arrived_at timestamp",
        "service_pages": "service_page_id bigint, book_id string, page_index int, service_index int, markdown string, blocks array<struct<type string, top_left_x int, top_left_y int, bottom_right_x int, bottom_right_y int, content string, label string, image_id string>>, received_at timestamp",
        "documents": "doc_id bigint, text string, lang string, source string",
        "eval_items": "item_id bigint, suite string, lang string, passage string, question string, answer string",
        "mix_targets": "mix_id int, source string, target_share double, max_repeats int",
    }

    def make(**given):
        d = str(tmp_path_factory.mktemp("tables"))
        for name, ddl in empty.items():
            df = given.get(name)
            (spark.createDataFrame([], ddl) if df is None else df).write.parquet(os.path.join(d, f"{name}.parquet"))
        return d

    return make
