"""The named text queries and the pipeline on the smallest tables."""

import subprocess
import sys
from pathlib import Path

import duckdb
import pandas as pd
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from quantspan.llm import bpe, decontamination, toxicity
from quantspan.llm.queries import ORACLE, QUERIES
from quantspan.llm.text import table
from test_near import _brute as near_groups
from test_repeats import _brute_lines
from quantspan.llm.minhash import Near

COLUMNS = {
    "op1_toxicity": ["doc_id", "held_out", "score", "predicted"],
    "op8_language_id": ["doc_id", "held_out", "lang_pred", "score"],
    "op9_weak_quality": ["doc_id", "weak_label", "score", "predicted"],
}


def _rows(df):
    return sorted(tuple(r) for r in df[sorted(df.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_statement(spark, data, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "benchmark", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    assert _rows(QUERIES[name](spark, data).toPandas()) == _rows(con.execute(ORACLE[name]).df())


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_scores(spark, data, name):
    got = QUERIES[name](spark, data).toPandas()
    docs = pd.read_parquet(f"{data}/documents.parquet")
    assert list(got.columns) == COLUMNS[name] and sorted(got["doc_id"]) == sorted(docs["doc_id"]) and got["score"].between(0, 1).all()
    if name == "op8_language_id":
        both = got[got["held_out"]].merge(docs, on="doc_id")
        assert (both["lang_pred"] == both["lang"]).mean() > 0.9
    else:
        label = "toxic" if name == "op1_toxicity" else "quality"
        both = got.merge(pd.read_parquet(f"{data}/labels.parquet"), on="doc_id")
        assert (both["predicted"] == both[label]).mean() > 0.85


def test_pipeline(spark, data):
    """Every stage against a plain version of it over the same input."""
    library = Tokenizer.from_file(bpe.default_path())
    docs = table(spark, data, "documents")
    scored = {r["doc_id"]: r["toxicity"] for r in toxicity.add_scores(docs, toxicity.fit(docs, table(spark, data, "labels"))).collect()}
    want = {r["doc_id"]: r["text"] for r in docs.collect() if scored[r["doc_id"]] < toxicity.THRESHOLD}
    lines = _brute_lines(list(want.items()), 2, 50)
    want = {i: text for i, (text, n, gone) in lines.items() if gone < n}
    groups = near_groups(list(want.items()), Near())
    want = {i: t for i, t in want.items() if groups[i][1] == i}
    items = tuple((str(r["item_id"]), r["text"].encode()) for r in table(spark, data, "benchmark").collect())
    automaton = decontamination.Automaton(items, decontamination.WINDOW)
    for i, text in list(want.items()):
        hit, _ = automaton.hits(decontamination.words_of(text.encode()))
        if hit.sum() > decontamination.MAX_COVERAGE * len(hit):
            del want[i]
        else:
            want[i] = decontamination.cut_words(text, decontamination.spans(hit).tolist())
    got = {r["doc_id"]: r for r in corpus_pipeline.run(spark, data).collect()}
    assert set(got) == set(want) and len(want) > 100
    for i, text in want.items():
        assert got[i]["ids"] == library.encode(text, add_special_tokens=False).ids and got[i]["lossless"]


def test_stages_keep_columns_and_take_odd_rows(spark, data, docs, odd):
    rows = docs([*odd, (50, "A text. " * 20)]).selectExpr("doc_id", "text", "'en' lang", "'s' source", "length(text) n_chars", "part", "key")
    columns = rows.columns
    for _, stage in corpus_pipeline.STAGES[:-1]:
        empty = stage(spark, rows.limit(0), data)
        rows = stage(spark, rows, data)
        assert rows.columns == columns and empty.columns == columns and empty.count() == 0
    left = {r["doc_id"]: r for r in rows.collect()}
    assert {None, 1, 2, 3, 4, 50} <= set(left) and left[50]["n_chars"] == len(left[50]["text"])
    last = corpus_pipeline.STAGES[-1][1](spark, rows, data)
    assert last.count() == rows.count() and last.where("not lossless").count() == 0


def test_the_rest_does_without(tmp_path):
    """The entry imports where the subpackage and the pipeline are absent."""
    root = Path(__file__).parents[2]
    code = f"""
import sys
sys.path.insert(0, {str(root)!r})
class Absent:
    def find_spec(self, name, path=None, target=None):
        if name == "corpus_pipeline" or name.startswith("quantspan.llm"):
            raise ModuleNotFoundError(name, name=name)
sys.meta_path.insert(0, Absent())
import __spark_entry__ as e
assert e.queries() and not [x for x in e.queries() if x == "pipeline" or x.startswith("op")]
"""
    subprocess.run([sys.executable, "-c", code], check=True)
