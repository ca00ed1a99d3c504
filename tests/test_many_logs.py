"""Very many small logs: few tasks, batches and lists that span logs."""

import json

from worktrail.sources import logs
from worktrail.sources.scan import TailReader, batches_of
from worktrail.streaming import live


def write_logs(root, n):
    for i in range(n):
        folder = root / f"p{i % 2}"
        (folder / f"2024_s{i}").mkdir(parents=True)
        (folder / f"2024_s{i}.jsonl").write_text(f'{{"a": {i}}}\n')
        (folder / f"2024_s{i}" / "__advisor.jsonl").write_text(f'{{"b": {i}}}\n{{"b": "x"}}\n')


def test_small_logs_share_tasks_and_keep_their_owners(spark, tmp_path):
    write_logs(tmp_path / "logs", 400)
    _, owned = logs.find_logs(logs.list_files(spark, str(tmp_path / "logs")), str(tmp_path / "logs"), "a")
    lines = logs.read_logs(owned)
    assert lines.rdd.getNumPartitions() <= 60  # 800 logs; a megabyte for opening each made 800
    want = sorted([(f"s{i}", "primary", "", 0, f'{{"a": {i}}}') for i in range(400)] + [
        (f"s{i}", "advisor", "__advisor", at, line) for i in range(400) for at, line in ((0, f'{{"b": {i}}}'), (len(f'{{"b": {i}}}') + 1, '{"b": "x"}'))])
    assert sorted(tuple(r)[1:] for r in lines.collect()) == want


def test_a_tail_of_small_logs_is_few_partitions(spark, tmp_path):
    write_logs(tmp_path / "logs", 400)
    reader = TailReader({"path": str(tmp_path / "logs"), "listings": str(tmp_path / "listings")})
    end = reader.latestOffset()
    parts = reader.partitions({"listing": 0}, end)
    assert len(parts) <= 64  # one for each of 800 logs before
    found = sorted(x for part in parts for batch in reader.read(part) for x in zip(*[c.to_pylist() for c in batch.columns]))
    assert len(found) == 1200 and len({x[:4] for x in found}) == 800
    assert json.loads([x for x in found if x[1] == "s7" and x[2] == "primary"][0][5]) == {"a": 7}
    reader.commit(end)
    assert not list((tmp_path / "listings" / "ranges").iterdir())
    stream = live.live_logs(spark, str(tmp_path / "logs"), str(tmp_path / "more"))
    assert live.run_once(stream).count() == 1200


def test_a_batch_spans_logs():
    batches = list(batches_of(((("a", s, "primary", ""), 0, b'{"x": 1}\n') for s in "pqr")))
    assert [b.num_rows for b in batches] == [3]
    assert batches[0].column(1).to_pylist() == ["p", "q", "r"]
