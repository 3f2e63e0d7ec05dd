"""Streams with state: memory of sessions across restarts, work that resumes, upserts that are applied once."""

import pytest
from pyspark.sql import functions as F

from quillspark import registry
from quillspark.sources.keyed import KeyedTable
from quillspark.streaming import events as stream
from quillspark.streaming import memory, work

SF = "/root/testdata/sf0.001"
NAME = r"\b[A-Z][a-z]{4,}\b"


def ended(q):
    q.awaitTermination(120)
    assert q.exception() is None


def test_memory_across_a_restart(spark, tmp_path):
    """Turns come in three files; the stream stops after two and is started again: the same as the batch query."""
    memory.with_state(spark)
    c = spark.read.parquet(f"{SF}/conversations.parquet").select(F.col("conv_id").alias("session"), "turn", "role", "text")
    source, out, at = (str(tmp_path / x) for x in ("in", "out", "at"))

    def arrive(low, high):
        c.where(F.col("turn").between(low, high)).coalesce(1).write.mode("append").parquet(source)

    def run():
        s = spark.readStream.schema(c.schema).option("maxFilesPerTrigger", 1).parquet(source)
        ended(memory.remember(s, NAME, ("the",), ttl_ms=86_400_000).writeStream.format("parquet").option("path", out).option("checkpointLocation", at).outputMode("append").trigger(availableNow=True).start())

    arrive(0, 1)
    arrive(2, 2)
    run()
    arrive(3, 99)
    run()
    rows = spark.read.parquet(out)
    assert rows.count() == c.count()
    last = rows.groupBy("session").agg(F.max_by(F.struct("turns", "questions", "roles"), "turn").alias("m"))
    got = {r.session: (r.m.turns, r.m.questions, r.m.roles) for r in last.collect()}
    want = {r.conv_id: (r.turns, r.questions, r.roles) for r in registry.queries()["session_memory"](spark, SF).collect()}
    assert got == want
    key = lambda d: sorted(map(str, d.select("session", "turn", "question", "target", "targets").collect()))
    assert key(rows) == key(memory.remember(c, NAME, ("the",)))  # the batch, from no state


def test_memory_resolves_pronouns(spark):
    memory.with_state(spark)
    turns = [(1, 0, "user", "who is Alice"), (1, 1, "assistant", "Robert knows"), (1, 2, "user", "where is 他们 and 他"), (1, 3, "user", "and Carol"), (1, 4, "user", "他?"), (2, 0, "user", "他?"), (2, 1, "user", None)]
    rows = memory.remember(spark.createDataFrame(turns, "session long, turn long, role string, text string"), NAME).collect()
    got = {(r.session, r.turn): (r.question, r.target) for r in rows}
    assert got[1, 2] == ("where is Alice and Alice", "Alice") and got[1, 3] == ("and Carol", "Carol") and got[1, 4] == ("Carol?", "Carol")
    assert got[2, 0] == ("他?", None) and got[2, 1] == ("", None) and got[1, 1] == ("Robert knows", "Alice")


def test_work_resumes(spark, tmp_path):
    """Killed in the third batch, before or after its results are written; run again: each chapter recorded once."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 60").select("doc_id", "text")
    for i in range(4):
        docs.where(F.col("doc_id") % 4 == i).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream_ = lambda: work.poll(spark, str(tmp_path / "in"), docs.schema)
    worked, killed = [], []

    def task(chapters):
        ids = [r.doc_id for r in chapters.select("doc_id").collect()]
        if len(worked) == 2 and len(killed) == 0:
            killed.append(ids)
            raise RuntimeError("killed")
        worked.append(ids)
        return chapters.select("doc_id", F.char_length("text").alias("n"))

    made = lambda: work.Work(spark, f"file://{tmp_path}/w", ["doc_id"], "doc_id long", task, buckets=2)
    with pytest.raises(Exception, match="killed"):
        made().start(stream_(), str(tmp_path / "cp")).awaitTermination(120)
    w = made()
    assert w.record.read().count() == 30 == w.results().count()
    upsert, w.record.upsert = w.record.upsert, lambda *a, **k: (_ for _ in ()).throw(RuntimeError("killed again"))
    with pytest.raises(Exception, match="killed again"):  # results are there, the record is not
        w.start(stream_(), str(tmp_path / "cp")).awaitTermination(120)
    assert made().results().count() == 30
    ended(made().start(stream_(), str(tmp_path / "cp")))
    w = made()
    assert sorted(map(tuple, w.results().collect())) == sorted((r.doc_id, len(r.text)) for r in docs.collect())
    assert {r.status for r in w.record.read().collect()} == {"SUCCESS"}
    recorded = worked[:2] + worked[3:]
    assert sorted(x for ids in recorded for x in ids) == list(range(60))
    docs.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))  # all again: nothing to do
    ended(w.start(stream_(), str(tmp_path / "cp")))
    assert worked[-1] == [] and made().results().count() == 60


def test_failed_chapters_are_tried_again(spark, tmp_path):
    df = spark.createDataFrame([(i,) for i in range(6)], "c int")
    w = work.Work(spark, f"file://{tmp_path}/w", ["c"], "c int", lambda d: d.where("c <> 3").withColumn("bad", F.col("c") == 4), F.col("bad"), retries=2, buckets=2)
    assert w.results().collect() == []
    for n in range(4):
        w.batch(df, n)
    r = {x.c: (x.status, x.tries, x.batch) for x in w.record.read().collect()}
    assert r[0] == ("SUCCESS", 1, 0) and r[3] == r[4] == ("FAILED", 2, 1) and sorted(x.c for x in w.results().collect()) == [0, 1, 2, 5]


def test_upserts_of_a_stream(spark, tmp_path):
    """Bytes of a batch follow its keys, not the table."""
    schema = "k int, n int, v string"
    rows = spark.range(8000).select(F.col("id").cast("int").alias("k"), F.lit(0).alias("n"), F.sha2(F.col("id").cast("string"), 256).alias("v"))
    table = KeyedTable(spark, f"file://{tmp_path}/t", schema, ["k"], 64)
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    run = lambda: ended(stream.upsert_into(stream.read(spark, str(tmp_path / "in"), schema), table, "n", str(tmp_path / "cp")))
    run()
    before = {p: p.stat().st_mtime_ns for p in (tmp_path / "t" / "data").glob("kb=*")}
    size = table.files.size(f"file://{tmp_path}/t/data")
    spark.createDataFrame([(1, 2, "new"), (1, 1, "old"), (2, -1, "late"), (9000, 0, "x")], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    run()
    changed = [p for p in (tmp_path / "t" / "data").glob("kb=*") if before.get(p) != p.stat().st_mtime_ns]
    assert 1 <= len(changed) <= 3 and sum(f.stat().st_size for p in changed for f in p.glob("*.parquet")) < size / 10
    got = {r.k: (r.n, r.v) for r in table.read().where("k IN (1, 9000)").collect()}
    assert got == {1: (2, "new"), 9000: (0, "x")} and table.read().where("k = 2 AND v = 'late'").isEmpty() and table.read().count() == 8001
