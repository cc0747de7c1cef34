"""A small folder of tables: the smallest test data with texts, nulls and copies that the operators must survive."""

import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

#: Names of columns that operators make.
CLASHES = (
    "_among", "_copy", "_draw", "_id", "_in", "_last", "_map", "_n", "_none", "_packed", "_parts", "_part", "_range", "_rest", "_row", "_salt", "_spot", "_spans", "_all", "all", "passes", "s", "z", "c0", "c1", "text_", "same", "twins", "of", "least", "size_", "n",
    "fp", "row", "root", "component_id", "ids", "decoded", "n_words", "tail_prob", "expected_grade", "lang_pred", "score", "spans", "paths", "class", "bucket", "node", "held_out", "payload", "media", "taken", "target",
)
DATA = "/root/testdata/sf0.001"
SCHEMA = pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("lang", pa.string()), ("source", pa.string()), ("n_chars", pa.int64())])


def odd_rows(base: pd.DataFrame) -> list[tuple]:
    one, two = base["text"].iloc[3], base["text"].iloc[7]
    words = one.split()
    changed = " ".join([*words[: len(words) // 2], "changed", *words[len(words) // 2 + 1 :]])
    long = " ".join(base["text"].head(60)) + " " + " ".join(f"n{i % 977}" for i in range(30_000))
    texts = [
        (None, "en", "web"), ("", "en", None), (" \t\n ", None, "web"), ("x", "en", None), ("A b", None, None), (one, "en", "web"), (one, "en", "books"),
        (changed, None, "web"), (long, "en", "web"), ("a\0b  c\r\n\r\nd   ", None, "web"), ("éß中文 \U0001f600\U0001f468‍\U0001f469 nbsp in", "fr", "web"),
        (f"start {two} end of it", "en", "web"), ("123 456 !!!", "en", "web"), ("word " * 500, "en", "web"), ("!" * 3000 + "a" * 3000, None, "web"), (None, None, None),
    ]
    return [(10_000_000 + i, t, lang, source, None if t is None else len(t)) for i, (t, lang, source) in enumerate(texts)]


@pytest.fixture(scope="session")
def sf_dir(tmp_path_factory):
    path = tmp_path_factory.mktemp("tables")
    base = pd.read_parquet(f"{DATA}/documents.parquet")[["doc_id", "text", "lang", "source", "n_chars"]]
    rows = [tuple(r) for r in base.itertuples(index=False)] + odd_rows(base)
    table = pa.Table.from_pydict({n: [r[i] for r in rows] for i, n in enumerate(SCHEMA.names)}, schema=SCHEMA)
    pq.write_table(table, path / "documents.parquet")
    pq.write_table(pq.read_table(f"{DATA}/labels.parquet"), path / "labels.parquet")
    return str(path)


@pytest.fixture(scope="session")
def docs(sf_dir):
    """(doc_id, text, lang, source) in ascending order of doc_id."""
    rows = pq.read_table(f"{sf_dir}/documents.parquet").to_pylist()
    return sorted(rows, key=lambda r: r["doc_id"])


@pytest.fixture(scope="session")
def empty_docs(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")


@pytest.fixture(scope="session")
def clashing(spark):
    """Null and repeated ids, and columns named as operators name theirs."""
    rows = [(1, "one two three", "fp", 1), (1, "one two three", "fp", 1), (None, "one two three", None, 2), (2, None, None, None), (None, None, "x", 0), (3, "", "x", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, size int")
    return docs.withColumns({c: F.lit(f"own {c}") for c in CLASHES})
