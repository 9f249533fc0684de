"""The streaming buffer over files, and its restart from the checkpoint."""

import json

from embertide.functions.decay import Decay
from embertide.streaming.buffer import commands_of_files, start


def test_stream_restarts_where_it_stopped(spark, tmp_path):
    source, out, mark = (str(tmp_path / x) for x in ("in", "out", "mark"))
    (tmp_path / "in").mkdir()
    decay = Decay(half_life=1, max_age=2, capacity=4)

    def feed(name, rows):
        (tmp_path / "in" / name).write_text("\n".join(json.dumps(r) for r in rows))
        q = start(commands_of_files(spark, source), decay, out, mark)
        q.processAllAvailable()
        q.stop()

    add = lambda b, seq, v, qs: {"buffer_id": b, "seq": seq, "op": "add", "version": v, "qs": qs, "slots": []}
    feed("a.json", [add(1, 0, 0, [1, 2, 3]), add(2, 0, 0, [7])])
    feed("b.json", [add(1, 0, 0, [1, 2, 3]), add(1, 1, 1, [4, 5]), {"buffer_id": 1, "seq": 2, "op": "advance", "version": 3, "slots": [], "qs": []}])
    rows = spark.read.parquet(out).orderBy("buffer_id", "seq").collect()
    assert sum(r.op == "insert" for r in rows if r.buffer_id == 1) == 5
    assert sorted((r.slot, r.reason) for r in rows if r.op == "evict") == [(0, "capacity"), (1, "stale"), (2, "stale")]
    assert [r.slot for r in rows if r.buffer_id == 2] == [0]
