"""Landed files become units once, in order, without copies across batches; a batch run again asks nothing again."""

import os

from learngraph.operators import generation
from learngraph.streaming import ingest


def counting(path):
    def client():
        good = generation.stub_client()

        def answer(messages, model, temperature):
            with open(path, "a") as f:
                f.write("x")
            return good(messages, model, temperature)

        return answer

    return client


def test_files_become_units_across_batches(spark, tmp_path):
    landing, root, calls = tmp_path / "up", str(tmp_path / "state"), str(tmp_path / "calls")
    landing.mkdir()
    (landing / "a.html").write_bytes(b"<h1>Loops</h1><p>A loop repeats its body again and again.</p>")
    (landing / "b.txt").write_bytes(b"?")

    def run():
        ingest.unit_stream(spark, str(landing), counting(calls), root, buckets=2).awaitTermination()
        return [r["statement"] for r in ingest.units(spark, root).orderBy("seq").collect()]

    first = run()
    assert len(first) == 1 and [r["path"].endswith("b.txt") for r in ingest.refused(spark, root).collect()] == [True]
    (landing / "c.html").write_bytes(b"<h1>Loops</h1><p>A loop repeats its body again and again.</p><h2>Arrays</h2><p>An array holds many values in one order.</p>")
    both = run()
    assert both[0] == first[0] and len(both) == 2 and "array" in both[1].lower()
    asked = os.path.getsize(calls)
    for name in ("1", ".1.crc"):
        os.remove(f"{root}/log/commits/{name}")  # the second batch is run again
    assert run() == both and os.path.getsize(calls) == asked
