"""The stages in turn, against plain versions of what each lets through."""

import gc
import re
import time
from collections import Counter
from pathlib import Path

import corpus_pipeline
import plain
import pytest
from pyspark.sql import functions as F

from arcloom.llm import decontaminate, language, line_dedup, near_dedup, packing
from arcloom.llm.common import table

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    docs = table(spark, SMALL, "documents")
    odd = [(9001, "123 456"), (9002, None), (9003, "")]
    odd = spark.createDataFrame([(i, t, None, None, 0) for i, t in odd], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    docs = docs.unionByName(odd.select(*(F.col(f.name).cast(f.dataType) for f in docs.schema)))
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        at = str(tmp_path_factory.mktemp(name) / "t")
        stage(spark, out[-1], SMALL).write.parquet(at)
        out.append(spark.read.parquet(at))
    return out


def test_odd_rows_and_nothing(spark, stages, tmp_path):
    """Null ids, rows that repeat and ids that do, and tables without rows, through all stages."""
    few = stages[0].where("doc_id < 60")
    few = few.unionAll(few.where("doc_id < 5")).unionAll(few.where("doc_id < 9").withColumn("doc_id", F.lit(None).cast("bigint"))).unionAll(few.where("doc_id = 7").withColumn("text", F.lit(None).cast("string")))
    for k, docs in enumerate((few, few.where("false"))):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, SMALL)
            out.write.parquet(at := str(tmp_path / f"{name}{k}"))
            docs = spark.read.schema(out.schema).parquet(at)
        assert (docs.count() > 30) is (k == 0) and (docs.count() == 0) is (k == 1)


def rows(df):
    return {r.doc_id: r for r in df.collect()}


def test_columns(stages):
    assert all(s.columns == stages[0].columns for s in stages[:-1]) and [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "near_dedup", "decontamination", "packing"]


def test_language(stages):
    before, after = rows(stages[0]), rows(stages[1])
    assert not {9001, 9002, 9003} & set(after) and len(after) >= len(before) - 6 and all(after[i] == before[i] for i in after)


def test_lines(stages):
    before, after = rows(stages[1]), rows(stages[2])
    texts = [(i, r.text) for i, r in before.items()]
    left = {i: t for (i, _), (t, _) in plain.without_runs(texts).items()}
    assert not plain.runs_left([(i, after[i].text) for i in sorted(after)]) and all(r.n_chars == len(r.text) for r in after.values())
    for (i, t), (must, may, lines) in plain.chunk_bounds(left.items()).items():
        gone = lines - Counter(plain.lines(after[i].text) if i in after else [])
        assert not must - gone and not gone - may and (i in after or not t.strip() or gone == lines)
    assert len(after) > len(before) // 2


def test_near(stages):
    before = rows(stages[2])
    prints = {i: near_dedup.simhash(r.text.encode(), 4) for i, r in before.items()}
    root = {i: i for i in prints}
    for a in prints:
        for b in prints:
            if a < b and (prints[a] ^ prints[b]).bit_count() <= near_dedup.RADIUS and root[a] != root[b]:
                low, high = sorted((root[a], root[b]))
                root = {k: low if v == high else v for k, v in root.items()}
    assert sorted(rows(stages[3])) == sorted(set(root.values()))


def test_leaks(stages, spark):
    items = [(r.item_id, r.text.encode()) for r in table(spark, SMALL, "benchmark").collect()]
    b, w = decontaminate.Benchmark(items), decontaminate.WordHashes()
    assert sorted(rows(stages[4])) == sorted(i for i, r in rows(stages[3]).items() if not b.find(w.of(r.text.encode())))


def test_packing(stages):
    packed = stages[5].collect()
    assert {r.doc_id for r in packed} == set(rows(stages[4]))
    used = Counter()
    for r in packed:
        used[r.sequence_id] += r.length
    assert max(used.values()) <= 2048


class Begun(Exception):
    """Raised where a stage's operator begins."""


@pytest.mark.parametrize("name, module, operator", [
    ("language_id", language, "train"), ("line_dedup", line_dedup, "dedup_lines"), ("near_dedup", near_dedup, "first_of_similar"), ("decontamination", decontaminate, "clean"), ("packing", packing, "pack"),
])
def test_driver_gives_back(spark, monkeypatch, name, module, operator):
    """What the driver's JVM has freed of native memory, among small blocks that stay, goes back to the system before a stage's operator begins."""
    jvm = spark._jvm
    status = Path(f"/proc/{jvm.java.lang.ProcessHandle.current().pid()}/status")
    mb = lambda: int(re.search(r"RssAnon:\s+(\d+)", status.read_text())[1]) >> 10
    buffers = [jvm.java.nio.ByteBuffer.allocateDirect(1 << 16) for _ in range(4000)]
    buffers = buffers[::50]
    gc.collect()
    time.sleep(1)
    jvm.java.lang.System.gc()  # so that only the memory of the buffers themselves is looked at
    time.sleep(2)
    before = mb()

    def begun(*_, **__):
        raise Begun

    monkeypatch.setattr(module, operator, begun)
    with pytest.raises(Begun):
        dict(corpus_pipeline.STAGES)[name](spark, table(spark, SMALL, "documents"), SMALL)
    assert before - mb() > 64 and len(buffers) == 80
