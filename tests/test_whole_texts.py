"""Queries over whole texts: nothing behind a prefix is lost."""

import base64
import hashlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from flowledger.plans import ORACLE, QUERIES
from flowledger.plans.scalars import whole_sql

LONG = "a\n" * 400 + "b ````` & \"c\"\nEnd of the text"


@pytest.fixture(scope="module")
def texts(spark, tmp_path_factory):
    sf = str(tmp_path_factory.mktemp("whole"))
    spark.createDataFrame([(i, LONG, "en", "web", len(LONG)) for i in range(3)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame([(1, 0, "user", LONG), (1, 1, "assistant", LONG + "!")], "conv_id long, turn long, role string, text string").write.parquet(f"{sf}/conversations.parquet")
    return sf


def rows(spark, sf, name):
    return QUERIES[name](spark, sf).orderBy(F.col(QUERIES[name](spark, sf).columns[0])).collect()


def test_documents_are_whole(spark, texts):
    assert rows(spark, texts, "inject_docs")[0].block == f"## Material\n\n``````\n{LONG}\n end\n``````\n"
    assert [r.part for r in rows(spark, texts, "section_docs")] == ["", *[f"## Part\n\n{LONG}\n"] * 2]
    prompt = rows(spark, texts, "prompt_resolution")[0]
    assert prompt.prompt == f"Summarise.\nBe brief.\n## Text\n\n``````\n{LONG}\n``````\n"
    assert prompt.prompt_sha == hashlib.sha256(prompt.prompt.encode()).hexdigest() and prompt.chars == len(prompt.prompt)
    assert rows(spark, texts, "judge_prompts")[0].prompt == f"## Answer\n\n``````\n{LONG}\n``````\nScore 0 to 1."
    label = rows(spark, texts, "mermaid_labels")[0]
    assert label.label == f'en & "web"\n{LONG}'.replace("&", "&amp;").replace('"', "&quot;").replace("\n", "<br/>") and len(label.short_label) == 40
    found = rows(spark, texts, "attachment_data_url")[0]
    assert base64.b64decode(found.data_url.partition(",")[2]).decode() == LONG and found.digest == hashlib.sha256(LONG.encode()).hexdigest()


def test_conversations_are_whole(spark, texts):
    under = LONG.replace("\n", "\n  ")
    assert rows(spark, texts, "render_bullets")[0].bullets == f"- {under}\n- {under}!"
    assert rows(spark, texts, "normalize_messages")[0].wire == f"system:Answer.\nuser:{LONG}\nassistant:{LONG}!"


def test_sql_has_no_prefix_left():
    whole = "inject_docs section_docs render_bullets prompt_resolution mermaid_labels normalize_messages attachment_data_url judge_prompts map_incremental".split()
    assert not any("substr(text" in ORACLE[n] for n in whole)
    assert whole_sql("substr(t, 1, 37)") == "substr(t, 1, 37)"


def test_artifacts_are_of_whole_texts(spark, tmp_path):
    same_start = ["the same twenty letters and " + x for x in ("one", "two")]
    spark.createDataFrame(list(enumerate(same_start, 1)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert [(r.hit, r.artifact) for r in rows(spark, str(tmp_path), "map_incremental")] == [(True, t[::-1] + str(len(t))) for t in same_start]


def test_all_keys_and_pages_are_asked(spark, tmp_path):
    key = lambda i: hashlib.sha256(f"Customer#{i}".encode()).hexdigest()
    keys = range(1, 200)
    spark.createDataFrame([(i, f"Customer#{i}") for i in keys], "c_custkey long, c_name string").write.parquet(f"{tmp_path}/customer.parquet")
    spark.createDataFrame([(i, f"<p>{i}") for i in (1, 2, 3)], "page_id long, html string").write.parquet(f"{tmp_path}/pages.parquet")
    count = Counter(key(i)[:2] for i in keys)
    want = {p: "found" if n == 1 else "ambiguous" for p, n in count.items()} | {"zz": "not found"}
    assert {r.prefix: r.state for r in rows(spark, str(tmp_path), "call_prefix_lookup")} == want
    assert [(r.page_id, r.digest) for r in rows(spark, str(tmp_path), "item_files")] == [(i, hashlib.sha256(f"<p>{i}".encode()).hexdigest()) for i in (1, 2, 3)]
