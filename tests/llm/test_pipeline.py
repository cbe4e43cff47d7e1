"""Each stage of the pipeline on what its predecessor kept, against plain versions, and the registered queries."""

import random
import re

import duckdb
import numpy as np
import pytest

import corpus_pipeline
from tests.conftest import DATA
from tests.llm.test_operators import BPE, base_spans, plain_components, talk
from tidemark.llm import packing, queries


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("stages")
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, DATA).write.parquet(f"file://{root}/{name}")
        docs = spark.read.parquet(f"file://{root}/{name}")
        out.append(docs)
    return out


def texts(df):
    return {r.doc_id: r.text for r in df.select("doc_id", "text").collect()}


def test_stages_keep_the_columns(stages):
    assert all(s.columns == stages[0].columns for s in stages[:-1])


def test_language_stage_keeps_clean_documents(stages):
    before, after = texts(stages[0]), texts(stages[1])
    assert set(after) <= set(before) and len(after) >= 0.97 * len(before)
    assert all(not any(c.isalpha() for c in before[i] or "") or len(re.findall(r"\w+", before[i])) < 8 for i in set(before) - set(after))


def test_code_switched_documents_and_texts_of_one_id_stay(spark):
    rng = random.Random(6)
    rows = [(i, talk(lang, 40, rng), lang) for i, lang in enumerate(["en", "de", "es"] * 40)]
    mixed = " ".join(talk(lang, 20, rng) for lang in ("en", "de", "es"))
    docs = spark.createDataFrame([*rows, (900, mixed, None)], "doc_id long, text string, lang string")
    assert 900 in texts(corpus_pipeline.keep_known_languages(spark, docs, DATA))
    pair = spark.createDataFrame([(1, "one two three four five six"), (1, "quite another text of seven words"), (1, "one two three four five six")], "doc_id long, text string")
    assert corpus_pipeline.drop_near_duplicates(spark, pair, DATA).count() == 2


def test_stages_of_odd_tables(spark):
    rng = random.Random(7)
    shape = "doc_id long, text string, lang string, source string, n_chars long, score double, digest binary, spans string, certainty string"
    rows = [(i, talk(lang, 40, rng), lang, "s", 0, 1.0, b"x", "y", "z") for i, lang in enumerate(["en", "de", "es"] * 20)]
    odd = [(None, talk("en", 30, rng), None, None, None, None, None, None, None), (None, None, None, None, None, None, None, None, None), (70, "", "en", "s", 0, 0.0, b"", "", ""), rows[0], rows[0]]
    docs = spark.createDataFrame(rows + odd, shape)
    for table in (docs, docs.limit(0), spark.createDataFrame(odd[:3], shape)):
        out = table
        for name, stage in corpus_pipeline.STAGES:
            kept = stage(spark, out, DATA)
            assert name == "packing" or kept.columns == table.columns
            out = kept
        out.collect()
    first = corpus_pipeline.keep_known_languages(spark, docs, DATA)
    assert first.filter("doc_id IS NULL").count() == 1 and first.count() == 63
    assert corpus_pipeline.drop_near_duplicates(spark, docs, DATA).filter("doc_id IS NULL").count() == 2


def test_one_document_of_each_group_stays(stages):
    before, after = texts(stages[1]), texts(stages[2])
    ids = sorted(before)
    _, roots = plain_components([before[i] for i in ids])
    assert sorted(after) == sorted({ids[r] for r in roots})


def test_no_benchmark_item_is_left(stages):
    folded = lambda t: re.sub(r"\s+", " ", t).strip().lower()
    items = [folded(r[0]) for r in duckdb.sql(f"SELECT text FROM '{DATA}/benchmark.parquet'").fetchall()]
    before, after = texts(stages[2]), texts(stages[3])
    leaked = {i for i, t in before.items() if any(x in folded(t) for x in items)}
    assert leaked and set(before) - set(after) == leaked


def test_personal_data_is_gone(stages):
    before, after = texts(stages[3]), texts(stages[4])
    assert set(before) == set(after) and any(base_spans(t) for t in before.values())
    for i, t in before.items():
        assert not base_spans(after[i])
        if not base_spans(t):
            assert after[i] == t


def test_sequences_hold_all_tokens(stages):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(BPE)
    docs, rows = texts(stages[4]), stages[5].toPandas()
    want = {i: len(t.encode(x or "", add_special_tokens=False).ids) + 1 for i, x in docs.items()}
    assert rows.groupby("doc_id")["length"].sum().to_dict() == want
    used = rows.groupby("sequence_id")["length"].sum()
    assert used.max() <= packing.Capacity().tokens and len(used) <= 1.05 * np.ceil(sum(want.values()) / 1024)


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_with_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "labels", "embeddings"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    want, got = con.sql(queries.ORACLE_SQL[name]).df(), queries.QUERIES[name](spark, DATA).toPandas()
    columns = sorted(want.columns)
    assert columns == sorted(got.columns)
    # A whole number may come as an integer or, in a column with nulls, as a float.
    plain = lambda v: "" if v is None or v != v else str(int(v)) if isinstance(v, float) and v.is_integer() else str(v)
    a, b = (x[columns].map(plain).sort_values(columns, ignore_index=True) for x in (want, got))
    assert a.equals(b)


def test_run_and_registration(spark):
    import __spark_entry__

    names = __spark_entry__.queries()
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 14))
    assert corpus_pipeline.run(spark, DATA).count() > 0
