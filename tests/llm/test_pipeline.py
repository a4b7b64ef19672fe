"""The pipeline's stages on a small fixture, and the registered queries on the smallest tables."""

import os
import random
import sys

import pytest

import __spark_entry__ as contract
import corpus_pipeline
from pulsewatch.llm import catalog, pieces
from tests.llm.helpers import AWKWARD

sys.path.insert(0, os.path.join(os.path.dirname(__file__), "..", "..", "tools"))

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n long"


@pytest.mark.skipif(not os.path.exists(pieces.MODEL), reason="no model file")
def test_stages_take_effect(spark, tmp_path):
    pick = random.Random(4)
    word = [f"{a}{b}" for a in "bdfgklmnprst" for b in ("an", "el", "ir", "os", "um")]
    prose = lambda n: " ".join(pick.choice(word) for _ in range(n))
    some = lambda: pick.randint(40, 120)
    docs = [(i, prose(some())) for i in range(120)]
    labels = [(i, 1, 0) for i in range(60)]
    for i in range(200, 260):
        docs.append((i, " ".join(w + "###" for w in prose(some()).split())))
        labels.append((i, 0, 0))
    for i in range(300, 360):
        docs.append((i, prose(some() // 2) + " vile nasty " + prose(some() // 2)))
        labels.append((i, 1, 1))
    near = docs[0][1].split()
    near[30] = "other"
    leak = prose(30)
    docs += [(400, docs[0][1]), (401, " ".join(near)), (402, prose(40) + " " + leak.upper() + " " + prose(40))]
    docs += [(403, prose(60) + " token=abcdef123456 " + prose(9))] + AWKWARD
    folder = str(tmp_path)
    rows = [(i, t, "en", "src1", len(t or ""), 1) for i, t in docs]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, leak), (2, None)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    now = spark.read.parquet(f"{folder}/documents.parquet")
    after = []
    for number, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, now, folder)
        if number < 4:
            assert out.columns == now.columns and out.dtypes == now.dtypes
        out.write.parquet(f"{folder}/{number}")
        now = spark.read.parquet(f"{folder}/{number}")
        after.append({r["doc_id"]: r for r in now.collect()})
    clean = set(range(120))
    assert clean <= after[0].keys() and not after[0].keys() & {*range(200, 260), *range(300, 360)}
    assert clean <= after[1].keys() and not after[1].keys() & {400, 401}
    assert clean <= after[2].keys() and 402 in after[1] and 402 not in after[2]
    assert clean <= after[3].keys() and "token=abc" not in after[3][403]["text"]
    assert after[3][403]["n_chars"] == len(after[3][403]["text"]) and after[3][5]["text"] == after[2][5]["text"]
    assert after[4].keys() == after[3].keys() and all(r["round_trip"] for r in after[4].values())
    assert sorted(r["n_ids"] for r in corpus_pipeline.run(spark, folder).collect()) == sorted(r["n_ids"] for r in now.collect())


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_registered_queries_return_a_row_for_each_input(spark, name):
    table = {"op1": "conversations", "op4": "embeddings"}.get(name.split("_")[0], "documents")
    out = contract.queries()[name](spark, SF)
    if name.startswith(("op1", "op8")):
        assert out.count() > 0
    else:
        assert out.count() == spark.read.parquet(f"{SF}/{table}.parquet").count()


def test_sql_agrees(spark):
    from compare import register, rows_of

    con = register(SF)
    for name, sql in catalog.ORACLES.items():
        df = contract.queries()[name](spark, SF)
        rel = con.sql(sql)
        assert sorted(df.columns) == sorted(rel.columns)
        assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of(rel.columns, rel.fetchall())
