"""Each stage of the pipeline, on what its predecessor kept, against a plain computation of what it has to keep."""

from __future__ import annotations

import math
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from test_cluster import rows_on_a_cluster
from test_ops import classes_by_force, cuts_by_definition

import corpus_pipeline
from tablescope.llm import mixing, quality
from tablescope.llm.common import table, written


@pytest.fixture(scope="module")
def steps(spark, sf_dir) -> list[list]:
    """The rows of documents, and of each stage's result."""
    docs = table(spark, sf_dir, "documents")
    out = [docs.collect()]
    for name, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, sf_dir), f"test-{name}")
        out.append(docs.collect())
    return out


def test_order():
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality", "line_dedup", "near_dedup", "mixing", "packing"]


def test_rejected_documents_go_and_the_others_stay_as_they_are(spark, sf_dir, steps):
    scored = quality.scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).collect()
    good = {r["doc_id"] for r in scored if r["predicted"] == 1}
    assert sorted(steps[1]) == sorted(r for r in steps[0] if r["doc_id"] in good)
    # of the labelled documents that the classifier did not learn from, the good ones stay and the bad ones go, nearly all
    held = {r["doc_id"]: r["quality"] for r in table(spark, sf_dir, "labels").collect() if zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1}
    assert sum((d in good) == (q == 1) for d, q in held.items()) > 0.85 * len(held)


def test_repeated_chunks_of_lines_go(steps):
    seen: dict[bytes, tuple] = {}
    want = {}
    for r in sorted(steps[1], key=lambda r: r["doc_id"]):
        data, kept = (r["text"] or "").encode(), []
        for a, b, n in cuts_by_definition(data):
            if n >= 2 and seen.setdefault(data[a:b].rstrip(b"\n"), (r["doc_id"], a)) != (r["doc_id"], a):
                continue
            kept.append(data[a:b])
        want[r["doc_id"]] = b"".join(kept).decode()
    assert {r["doc_id"]: r["text"] or "" for r in steps[2]} == want
    assert any(want[r["doc_id"]] != r["text"] for r in steps[1])


def test_one_document_of_each_class_stays(steps):
    roots = classes_by_force([r["text"] for r in steps[2]])
    least: dict[int, int] = {}
    for r, k in zip(steps[2], roots, strict=True):
        least[k] = min(least.get(k, r["doc_id"]), r["doc_id"])
    assert sorted(r["doc_id"] for r in steps[3]) == sorted(least.values()) and len(steps[3]) < len(steps[2])
    before = {r["doc_id"]: r for r in steps[2]}
    assert all(r == before[r["doc_id"]] for r in steps[3])


def test_sources_are_mixed_as_sql_says(steps):
    """The SQL of op7 on what the stage got: how many words of each document it takes."""
    con = duckdb.connect()
    con.sql("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, source VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?)", [(r["doc_id"], r["text"], r["source"]) for r in steps[3]])
    taken = {r[0]: (r[1], r[4]) for r in con.sql(mixing.OP7_SQL).fetchall()}
    copies = Counter(r["doc_id"] for r in steps[4])
    assert {d: copies[d] * size for d, (size, _) in taken.items()} == {d: n for d, (_, n) in taken.items()}
    before = {r["doc_id"]: r for r in steps[3]}
    assert all(r == before[r["doc_id"]] for r in steps[4])


def test_all_that_is_mixed_is_packed(steps):
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want, whole = Counter(), 0
    for r in steps[4]:
        ids = [*tokenizer.encode(r["text"] or "", add_special_tokens=False).ids, 2]
        first = len(ids) % 1024 or 1024
        for k, (a, n) in enumerate([(0, first), *((x, 1024) for x in range(first, len(ids), 1024))]):
            want[(r["doc_id"], k, a, n, zlib.crc32(np.asarray(ids[a : a + n], "<u4").tobytes()))] += 1
        whole += len(ids)
    assert Counter(tuple(r)[:5] for r in steps[5]) == want
    bins = defaultdict(list)
    for r in steps[5]:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for some in bins.values():
        some.sort()
        assert some[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(some, some[1:], strict=False)) and sum(some[-1]) <= 1024
    assert len(bins) <= 1.02 * math.ceil(whole / 1024) + 1


def test_the_run_is_its_stages(spark, sf_dir, steps):
    got = corpus_pipeline.run(spark, sf_dir)
    key = lambda r: (r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"])
    assert Counter(map(key, got.collect())) == Counter(map(key, steps[5]))


def test_on_a_cluster(spark, sf_dir, tmp_path, steps):
    """With Python workers in other processes, one query after another in one session, which ships the package once."""
    n = table(spark, sf_dir, "documents").count()
    assert rows_on_a_cluster(("op1_repeats", "op9_line_dedup", "op5_quality", "pipeline"), sf_dir, tmp_path) == {"op1_repeats": n, "op9_line_dedup": n, "op5_quality": n, "pipeline": len(steps[5])}
