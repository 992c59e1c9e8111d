"""The registered queries, and the pipeline against a plain version of it."""

import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

import __spark_entry__ as E
import corpus_pipeline
from corpus_fixtures import docs, odd, texts  # noqa: F401
from creditframe.llm import decontaminate, mixing, quality, queries, simhash
from test_models_and_dedup import print_of, roots
from test_rules_and_search import search_brute


def test_names():
    numbers = sorted(int(re.match(r"op(\d+)_", n)[1]) for n in queries.QUERIES)
    assert numbers == list(range(1, 14))
    assert set(queries.QUERIES) | {"pipeline"} <= set(E.queries())
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "simhash_near_dedup", "benchmark_decontamination",
                                                      "source_mixing", "token_output"]


@pytest.fixture(scope="module")
def sf_dir(tmp_path_factory, docs, texts):
    out = tmp_path_factory.mktemp("sf")
    long = [t for t in texts if t and len(t.split()) > 15]
    rows = [*texts, *long, *(t + " omega" for t in long)]
    pq.write_table(pa.table({"doc_id": pa.array(range(len(rows)), pa.int64()), "text": pa.array(rows, pa.string()),
                             "lang": ["en"] * len(rows), "source": [f"s{min(i % 9, 3)}" for i in range(len(rows))],
                             "n_chars": pa.array([len(t or "") for t in rows], pa.int64())}), out / "documents.parquet")
    pq.write_table(pa.table({"item_id": pa.array([0, 1], pa.int64()), "text": [texts[34].split("\n")[1], texts[1]]}),
                   out / "benchmark.parquet")
    return str(out)


def test_every_query_covers_its_table(spark, sf_dir):
    n = pq.read_table(f"{sf_dir}/documents.parquet").num_rows
    for name, fn in queries.QUERIES.items():
        got = fn(spark, sf_dir)
        rows = got.collect()
        ids = {r.doc_id for r in rows}
        if not name.startswith("op5_"):
            assert ids == set(range(n)), name


def test_pipeline_against_its_parts(spark, sf_dir):
    rows = {r["doc_id"]: r for r in pq.read_table(f"{sf_dir}/documents.parquet").to_pylist()}
    bench = [(r["item_id"], r["text"]) for r in pq.read_table(f"{sf_dir}/benchmark.parquet").to_pylist()]
    table = spark.read.parquet(f"{sf_dir}/documents.parquet")
    kept = sorted(r.doc_id for r in quality.judge(table).collect() if r.kept)
    f = {i: print_of(rows[i]["text"]) for i in kept}
    root = roots(kept, [(a, b) for a in kept for b in kept if a < b and (f[a] ^ f[b]).bit_count() <= 4])
    kept = sorted(i for i in kept if root[i] == i)
    assert 0 < len(kept) < len(root)
    hits = search_brute([rows[i]["text"] for i in kept], bench)
    kept = [i for i, h in zip(kept, hits) if not h[3]]
    left = table.filter(table.doc_id.isin(kept))
    uses = Counter(r.doc_id for r in mixing.mix(left).collect())
    assert set(uses) == set(kept)

    from tokenizers import Tokenizer
    from creditframe.llm.common import tokenizer_file
    tok = Tokenizer.from_file(tokenizer_file("byte_bpe_50k.json"))
    want, at = [], 0
    for i in sorted(uses.elements()):
        ids = [*tok.encode(rows[i]["text"], add_special_tokens=False).ids, 2]
        want.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    got = sorted(tuple(r) for r in corpus_pipeline.run(spark, sf_dir).collect())
    assert got == sorted(want)


def test_stages_keep_the_columns_of_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, sf_dir).columns == docs.columns
        assert stage(spark, docs.limit(0), sf_dir).count() == 0
