import zlib
from collections import Counter
from pathlib import Path

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline as pipeline
from histlens.llm import queries
from histlens.llm.common import work_path
from histlens.llm.packing import file_order
from histlens.llm.quality import quality_rules
from histlens.llm.similar import similar_classes
from histlens.llm.tokens import tokenizer_path


@pytest.fixture(scope="module")
def stages(spark, small, tmp_path_factory):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    found = {"input": docs}
    for name, stage in pipeline.STAGES:
        path = str(tmp_path_factory.mktemp("stages") / name)
        stage(spark, docs, small).write.parquet(path)
        docs = found[name] = spark.read.parquet(path)
    return found


def ids(df):
    return Counter(r[0] for r in df.select("doc_id").collect())


def test_columns_and_order(stages):
    assert [n for n, _ in pipeline.STAGES] == ["quality", "lines", "near_dedup", "mixing", "packing"]
    for name in ("quality", "lines", "near_dedup", "mixing"):
        assert stages[name].columns == stages["input"].columns


def test_each_decision_takes_effect(stages):
    kept = {r["doc_id"] for r in quality_rules(stages["input"]).where("kept").collect()}
    assert set(ids(stages["quality"])) == kept
    assert ids(stages["lines"]) == ids(stages["quality"])
    components = {r["component_id"] for r in similar_classes(stages["lines"]).collect()}
    assert ids(stages["near_dedup"]) == Counter(components)
    assert set(ids(stages["mixing"])) <= set(ids(stages["near_dedup"])) and max(ids(stages["mixing"]).values()) <= 3
    assert ids(stages["packing"].where("piece = 0")) == ids(stages["mixing"])


def test_hard_rows_pass_all_stages(spark, hard, none):
    """Each stage on the hard rows: what goes, what stays, and how it leaves the columns."""
    kept = pipeline.quality(spark, hard, "")
    # All but one have fewer than 50 words, and that one repeats itself.
    assert kept.columns == hard.columns and kept.count() == 0
    lined = pipeline.lines(spark, hard, "")
    assert Counter(tuple(r) for r in lined.collect()) == Counter(tuple(r) for r in hard.collect())
    assert ids(pipeline.near_dedup(spark, hard, "")) == Counter([1, 2, 6, 7, -8])
    mixed = ids(pipeline.mixing(spark, hard, ""))
    # Texts without words come along in their turn; none comes more than three times a copy.
    assert mixed[6] > 0 and all(n <= 3 * ids(hard)[i] for i, n in mixed.items())
    pieces = pipeline.packing(spark, hard, "")
    assert ids(pieces.where("piece = 0")) == ids(hard)
    for name, stage in pipeline.STAGES:
        found = stage(spark, none, "")
        assert found.count() == 0 and (name == "packing" or found.columns == none.columns)


def test_the_curriculum_s_order_comes_through(stages):
    """Documents of an early stretch of the mix are in sequences of lower ids; checked in small ranges."""
    order = {}
    place = file_order(stages["mixing"])
    for k, r in enumerate(stages["mixing"].orderBy(place).select("doc_id").collect()):
        order.setdefault(r["doc_id"], k)
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr("histlens.llm.packing.SHARD_PIECES", 60)
        pieces = pipeline.packing(stages["mixing"].sparkSession, stages["mixing"], "").collect()
    once = {i for i, n in ids(stages["mixing"]).items() if n == 1}
    shards = {}
    for r in pieces:
        if r["doc_id"] in once:
            shards.setdefault(r["sequence_id"] >> 32, []).append(order[r["doc_id"]])
    ranges = [(min(x), max(x)) for _, x in sorted(shards.items())]
    assert len(ranges) > 2 and all(a[1] <= b[0] for a, b in zip(ranges, ranges[1:]))


def test_run(spark, small):
    """Every sequence is put together from the result alone, and nothing else is left in the shared folder's tables."""
    found = pipeline.run(spark, small)
    rows = found.collect()
    sequences = {}
    for r in rows:
        assert len(r["ids"]) == r["length"] and zlib.crc32(np.array(r["ids"], "<u4").tobytes()) == r["ids_crc32"]
        assert r["offset"] not in sequences.setdefault(r["sequence_id"], {})
        sequences[r["sequence_id"]][r["offset"]] = r["ids"]
    for parts in sequences.values():
        whole = [x for _, x in sorted(parts.items())]
        assert sorted(parts) == [sum(map(len, whole[:i])) for i in range(len(whole))] and sum(map(len, whole)) <= 2048
    # A document's pieces, put together, are the tokens of a text of the corpus whose lines may have gone.
    first = next(r for r in rows if r["piece"] == 0 and r["start"] + r["length"] < 2048)
    text = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json")).decode(first["ids"][:-1])
    source = spark.read.parquet(f"{small}/documents.parquet").where(F.col("doc_id") == first["doc_id"]).first()["text"]
    assert set(text.split("\n")) <= set(source.split("\n"))


def test_run_removes_what_it_wrote_when_a_stage_fails(spark, small, monkeypatch):
    made = []

    def path(spark, name):
        made.append(work_path(spark, name))
        return made[-1]

    def fails(spark, docs, sf_dir):
        raise RuntimeError("lost")

    monkeypatch.setattr(pipeline, "work_path", path)
    monkeypatch.setattr(pipeline, "STAGES", [pipeline.STAGES[0], ("fails", fails)])
    with pytest.raises(RuntimeError, match="lost"):
        pipeline.run(spark, small)
    assert len(made) == 2 and not any(Path(x.removeprefix("file:")).exists() for x in made)


def test_order_of_files_that_have_none(spark, hard, tmp_path):
    """A table that was appended to or renamed has no order of its own, and is no curriculum by accident."""
    docs = hard.select("doc_id", "text")
    docs.repartition(2).write.parquet(str(tmp_path / "twice"))
    assert file_order(spark.read.parquet(str(tmp_path / "twice"))) is not None
    docs.write.mode("append").parquet(str(tmp_path / "twice"))
    with pytest.raises(ValueError, match="order"):
        file_order(spark.read.parquet(str(tmp_path / "twice")))
    docs.coalesce(1).write.parquet(str(tmp_path / "named"))
    next((tmp_path / "named").glob("part-*")).rename(tmp_path / "named" / "rows.parquet")
    with pytest.raises(ValueError, match="order"):
        file_order(spark.read.parquet(str(tmp_path / "named")))
    assert file_order(hard) is None


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_queries_match_sql(spark, small, name):
    con = duckdb.connect()
    for file in Path(small).glob("*.parquet"):
        con.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    theirs = con.execute(queries.oracle_sql()[name])
    columns = [d[0] for d in theirs.description]
    ours = queries.queries()[name](spark, small)
    assert sorted(ours.columns) == sorted(columns)
    clean = lambda r: tuple(float(f"{v:.9g}") if isinstance(v, float) else v for v in r)
    assert Counter(clean(r) for r in ours.select(*columns).collect()) == Counter(map(clean, theirs.fetchall()))


@pytest.mark.parametrize("name", sorted(set(queries.queries()) - set(queries.oracle_sql())))
def test_other_queries_run_over_whole_tables(spark, small, name):
    found = queries.queries()[name](spark, small)
    everyone = ids(spark.read.parquet(f"{small}/documents.parquet"))
    assert set(ids(found)) == set(everyone)
    assert found.select(F.count_distinct("doc_id")).first()[0] == len(everyone)
