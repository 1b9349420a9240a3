"""Each operator's query on the smallest tables, against its SQL where there is one."""

import re

import pytest

import __spark_entry__ as contract
from tests.test_queries import FOLDER, compare, duck, pytestmark  # noqa: F401

NAMES = sorted(n for n in contract.queries() if re.match(r"op\d+_", n))


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, duck, name):  # noqa: F811
    status, _, rows = compare(spark, duck, FOLDER, name)
    assert status in ("ok", "rows only") and rows >= 100
    assert (status == "ok") == bool(re.match(r"op(4|5|9|10|11|13)_", name))


def test_columns_of_the_contract(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    wanted = {
        "op1": "doc_id:bigint held_out:boolean lang_pred:string score:double",
        "op2": "doc_id:bigint held_out:boolean n_tokens:bigint n_known:bigint train_tokens:bigint"
        " base_score:double score:double",
        "op3": "doc_id:bigint held_out:boolean score:double predicted:int",
        "op4": "doc_id:bigint n_words:bigint n_removed:bigint kept_sha256:string",
        "op5": "doc_id:bigint n_words:bigint n_hit:bigint n_items:bigint items_sha256:string contaminated:boolean",
        "op6": "doc_id:bigint held_out:boolean score:double predicted:int",
        "op8": "doc_id:bigint n_email:bigint n_ip:bigint n_card:bigint n_phone:bigint base_sha256:string spans:string",
        "op9": "doc_id:bigint n_shingles:bigint component_id:bigint kept:boolean",
        "op11": "vec_id:bigint code:string error:bigint label_error:bigint codebooks_sha256:string",
        "op12": "doc_id:bigint size:bigint source_size:bigint target:double taken:bigint",
        "op13": "conv_id:bigint depth:bigint parent_conv_id:bigint n_convs:bigint n_children:bigint n_leaves:bigint"
        " saved_tokens:bigint ends_sha256:string",
        "op10": "doc_id:bigint n_words:bigint word_chars:bigint n_symbols:bigint n_dup_lines:bigint"
        " n_repeat_words:bigint base_failed:boolean kept:boolean",
    }
    for name in NAMES:
        frame = contract.queries()[name](spark, FOLDER)
        kinds = [f"{c}:{kind}" for c, kind in frame.dtypes]
        expect = wanted.get(name.split("_")[0], "").split()
        assert kinds[: len(expect)] == expect, name
    assert docs.count() >= 200
