"""The window index: runs are compacted on the main path, and any number of batches gives the same rows."""

from quillspark.llm import substring_dedup


def test_batches_agree_and_runs_are_compacted(spark, monkeypatch):
    passage = " ".join(f"w{i}" for i in range(30))
    rows = [(i, f"{passage if i % 3 else ''} " + " ".join(f"d{i // 2 if i % 5 == 0 else i}x{j}" for j in range(25))) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    made, compact = [], substring_dedup.WindowIndex.compact

    def counted(self):
        made.append(len(self.runs))
        compact(self)
        assert len(self.runs) <= substring_dedup.MAX_RUNS

    monkeypatch.setattr(substring_dedup.WindowIndex, "compact", counted)
    run = lambda **k: sorted(map(tuple, substring_dedup.substring_dedup(docs, window=8, **k).collect()))
    got = run()
    assert max(made) > substring_dedup.MAX_RUNS  # the registered query's own number of batches
    assert sum(r[2] for r in got) >= 25 * 30 and all(run(batches=n) == got for n in (1, 2, 5))
