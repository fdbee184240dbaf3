import pytest

import corpus_pipeline


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("sf")
    passage = " ".join(f"secret{i}" for i in range(20))
    rows = [(i, " ".join(f"w{i}x{j}" for j in range(30)), "en", f"s{i % 3}", 1) for i in range(60)]
    rows += [(100 + i, rows[i][1], "en", "s0", 1) for i in range(20)]
    rows += [(200 + i, "!!! $$$ %%% " * 12 + str(i), "en", "s1", 1) for i in range(30)]
    rows += [(900, f"{rows[0][1]} {passage}", "en", "s0", 1), (901, None, "en", None, 1), (902, "", None, "s1", None)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(i, int(i < 200), 0) for i, *_ in rows if i < 900], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return str(d)


def test_stages(spark, sf_dir, monkeypatch):
    """Each stage of run() on what the one before kept."""
    columns, seen = spark.read.parquet(f"{sf_dir}/documents.parquet").columns, []

    def noted(name, stage):
        def f(s, docs, d):
            seen.append((name, docs.columns, sorted(r["doc_id"] for r in docs.select("doc_id").collect())))
            return stage(s, docs, d)

        return name, f

    monkeypatch.setattr(corpus_pipeline, "STAGES", [noted(*x) for x in corpus_pipeline.STAGES])
    out = corpus_pipeline.run(spark, sf_dir).collect()
    assert all(c == columns for _, c, _ in seen)
    kept = {name: set(ids) for name, _, ids in seen}
    assert not any(200 <= i < 900 for i in kept["near duplicates"]) and set(range(60)) <= kept["near duplicates"]
    assert not any(100 <= i < 900 for i in kept["decontamination"]) and len({901, 902} & kept["decontamination"]) <= 1
    assert 900 not in kept["mix"] and set(range(60)) <= kept["mix"]
    assert sorted(r["doc_id"] for r in out) == seen[-1][2]
    for s in range(8):
        slots = sorted(r["slot"] for r in out if r["shard"] == s)
        assert slots == list(range(len(slots)))


def test_empty_long_repeated_rows_and_clashing_columns(spark, tmp_path):
    """Extra columns named like those the stages use inside stay as they are; a repeated row and a very long text go through; empty tables give no rows."""
    names = "doc_id long, text string, lang string, source string, n_chars long, label int, size long, row string, digest string, bin int, w string"
    rows = [(i, " ".join(f"v{i}y{j}" for j in range(25)), "en", f"s{i % 2}", 1, 7, -1, "r", "d", 3, "w") for i in range(24)]
    rows += [rows[3]] * 4 + [(50, " ".join(f"long{j}" for j in range(60_000)), "en", "s0", 1, 7, -1, "r", "d", 3, "w")]
    labels = "doc_id long, quality int, toxic int"
    for name, docs in (("full", rows), ("empty", [])):
        d = str(tmp_path / name)
        spark.createDataFrame(docs, names).write.parquet(f"{d}/documents.parquet")
        spark.createDataFrame([(r[0], 1, 0) for r in docs], labels).write.parquet(f"{d}/labels.parquet")
        spark.createDataFrame([], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    kept = corpus_pipeline.one_of_each(spark, spark.read.parquet(f"{tmp_path}/full/documents.parquet"), "")
    assert sorted(map(tuple, kept.collect())) == sorted(set(rows))
    out = corpus_pipeline.run(spark, str(tmp_path / "full")).collect()
    assert {r["doc_id"] for r in out} <= {r[0] for r in rows} and len(out) > 20 and all(0 <= r["shard"] < 8 for r in out)
    assert corpus_pipeline.run(spark, str(tmp_path / "empty")).count() == 0
