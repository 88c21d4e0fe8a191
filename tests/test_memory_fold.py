"""The keyed fold, in batch and as a stream, against merge() row by row."""

import random

from spindrift.streaming import memory

DDL = "project string, at int, summary_update string, topics_add array<string>, preferences_add array<string>, topics string"


def plain(rows):
    out = {}
    for project, _, summary, topics, preferences, *_ in sorted(rows, key=lambda r: r[1]):
        add = lambda v: [x for x in v or [] if x is not None]
        out[project] = memory.merge(out.get(project, memory.EMPTY), {"summary_update": summary, "topics_add": add(topics), "preferences_add": add(preferences)})
    return {k: tuple(v.values()) for k, v in out.items()}


def told(df):
    return {r.project: (r.project_summary, r.topics, r.preferences) for r in df.collect()}


def made(seed, n, first=0):
    rnd = random.Random(seed)
    words = [None, "", " ", *(f" W{i}" for i in range(25)), *(f"w{i} " for i in range(60))]
    take = lambda most: rnd.choice([None, [], [rnd.choice(words) for _ in range(rnd.randrange(most))]])
    projects = [None, "a", "hot", "hot", "hot", *"bcdef"]
    return [(rnd.choice(projects), first + i, rnd.choice([None, "", "  ", f" s{i}\n"]), take(9), take(4), "x") for i in range(n)]


def test_a_full_list_grows_by_one_with_each_reply(spark):
    rows = [("p", i, None, [f"t{5 * i + j}" for j in range(5)], None, "") for i in range(8)]
    got = told(memory.fold_frames(spark.createDataFrame(rows, DDL), "project", order="at"))
    assert len(got["p"][1]) == 24 and got == plain(rows)


def test_batch(spark):
    rows = made(1, 700)
    frame = spark.createDataFrame(rows, DDL).repartition(7)
    assert told(memory.fold_frames(frame, "project", order="at")) == plain(rows)
    assert memory.fold_frames(frame.limit(0), "project", order="at").collect() == []
    only = memory.fold_frames(frame.select("project", "at", "topics_add"), "project", order="at")
    assert told(only) == plain([(p, i, None, t, None) for p, i, _, t, *_ in rows])
    two = memory.fold_frames(frame.withColumn("k", frame["at"] % 2), "project", "k", order="at")
    assert {(r.project, r.k): r.topics for r in two.collect()} == {(p, k): v[1] for k in (0, 1) for p, v in plain([r for r in rows if r[1] % 2 == k]).items()}


def test_stream_goes_on_where_it_stopped(spark, tmp_path):
    source, folder, checkpoint = (str(tmp_path / x) for x in ("in", "states", "checkpoint"))

    def start():
        stream = spark.readStream.schema(DDL).parquet(source)
        memory.start_fold(stream, "project", order="at", folder=folder, checkpoint=checkpoint)
        return told(memory.latest_states(spark, folder, "project"))

    rows = []
    for k in range(3):
        new = made(10 + k, 120, first=1_000 * k)
        spark.createDataFrame(new, DDL).repartition(3).write.mode("append").parquet(source)
        rows += new
        assert start() == plain(rows)
    assert start() == plain(rows)  # nothing new: nothing changes
    late = [("a", 5, "late", ["of all"], None, "")]
    spark.createDataFrame(late, DDL).write.mode("append").parquet(source)
    assert start() == plain([*rows, ("a", 10_000, *late[0][2:])])  # a row that comes later is merged later


def test_a_batch_that_is_run_again_replaces_what_it_wrote(spark, tmp_path):
    """The last batch's commit is taken back, as if the driver had died before it."""
    source, folder, checkpoint = (str(tmp_path / x) for x in ("in", "states", "checkpoint"))
    rows = made(4, 60)
    spark.createDataFrame(rows, DDL).write.parquet(source)
    for again in (False, True):
        if again:
            for f in (tmp_path / "checkpoint" / "commits").glob("*0*"):
                f.unlink()
        stream = spark.readStream.schema(DDL).parquet(source)
        memory.start_fold(stream, "project", order="at", folder=folder, checkpoint=checkpoint)
        assert told(memory.latest_states(spark, folder, "project")) == plain(rows)
    assert [p.name for p in (tmp_path / "states").iterdir() if p.is_dir()] == ["batch=0"]
