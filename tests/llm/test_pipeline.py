"""The pipeline's rows, stage by stage, against what brute force keeps."""

import hashlib

import corpus_pipeline
import pytest
import tiktoken
from helpers import docs, prose

from lociflow.llm.registry import ORACLE_SQL, QUERIES, vocabulary


@pytest.fixture
def folder(spark, tmp_path):
    bench = prose(1, 40)
    base = prose(2, 120)
    near = list(base)
    near[60] = "changed"
    key = "0123456789abcdef0123456789abcdef"
    texts = [" ".join(base), " ".join(near), " ".join(prose(3, 80)), "lead " + " ".join(bench[20:] + prose(4, 9) + bench[:20]), f'{" ".join(prose(5, 60))} token = "{key}" end', " ".join(prose(2, 120)), None, "", "1234 !!", " ".join(prose(6, 90)), "Re."]
    rows = docs(spark, texts, lang={i: "aa" for i in range(11)})
    rows.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, " ".join(bench))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return str(tmp_path), texts, key


def test_stages(spark, folder):
    path, texts, key = folder
    rows = spark.read.parquet(f"{path}/documents.parquet")
    names = rows.columns
    kept = {"language_id": {0, 1, 2, 3, 4, 5, 9, 10}, "near_dedup": {0, 2, 3, 4, 9, 10}, "decontaminate": {0, 2, 4, 9, 10}, "secret_scan": {0, 2, 4, 9, 10}, "byte_bpe": {0, 2, 4, 9, 10}}
    assert [n for n, _ in corpus_pipeline.STAGES] == list(kept)
    for name, stage in corpus_pipeline.STAGES:
        rows = stage(spark, rows, path)
        got = {r.doc_id: r for r in rows.collect()}
        assert set(got) == kept[name], name
        if name != "byte_bpe":
            assert rows.columns == names
        if name == "secret_scan":
            assert key not in got[4].text and got[4].n_chars == len(got[4].text) and got[0].text == texts[0]
            left = {i: r.text for i, r in got.items()}
    vocab = vocabulary()
    library = tiktoken.Encoding("own", pat_str=vocab.pattern, mergeable_ranks={t: i for i, t in vocab.tokens.items()}, special_tokens={})
    final = {r.doc_id: r for r in corpus_pipeline.run(spark, path).collect()}
    assert set(final) == set(left)
    for i, text in left.items():
        ids = library.encode_ordinary(text)
        assert final[i].n_tokens == len(ids) and final[i].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert final[i].decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()


def test_every_operator_is_registered():
    assert sorted(int(q[2:].split("_")[0]) for q in QUERIES) == list(range(1, 14)) and set(ORACLE_SQL) <= set(QUERIES)


CLASHING = ["id", "_key", "text_id", "body", "live", "new", "hits", "base", "repository", "owner", "keep", "item_id", "root", "lang_pred", "score", "_order"]


def test_an_empty_table_and_columns_of_clashing_names(spark, tmp_path):
    """No rows give no rows; columns that the stages use themselves pass through all but the last untouched."""
    some = ["first text of a few words", "another text of a few words", "token = '0123456789abcdef0123456789abcdef'"]
    rows = docs(spark, some, lang={i: "aa" for i in range(3)})
    more = rows.selectExpr("*", *[f"concat('{c}', doc_id) as `{c}`" for c in CLASHING])
    for name, table in (("none", more.limit(0)), ("some", more)):
        table.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        spark.createDataFrame([(0, "nothing that any text here has in it at all")], "item_id long, text string").write.parquet(f"{tmp_path}/{name}/benchmark.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0
    left = more
    for name, stage in corpus_pipeline.STAGES[:-1]:
        left = stage(spark, left, f"{tmp_path}/some")
        assert left.columns == more.columns, name
    got = left.collect()
    assert len(got) == 3 and all(r[c] == f"{c}{r.doc_id}" for r in got for c in CLASHING)
    assert {r.doc_id for r in corpus_pipeline.run(spark, f"{tmp_path}/some").collect()} == {0, 1, 2}
