"""Calls within a budget against a server that limits: slots and rate are kept, every answer comes, once."""

import json
import threading
import time
from collections import Counter
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

from pyspark.sql import functions as F

from learngraph.operators import generation
from learngraph.sources.budget import Budget, call_within
from learngraph.sources.connectors import RateLimited


class Limiter:
    """At most ``slots`` calls at once and ``rate`` in a second are answered."""

    def __init__(self, slots, rate):
        self.slots, self.rate, self.lock = slots, rate, threading.Lock()
        self.now, self.most, self.recent, self.answered, self.refused = 0, 0, [], Counter(), 0
        outer = self

        class Handler(BaseHTTPRequestHandler):
            def do_POST(self):  # noqa: N802
                body = self.rfile.read(int(self.headers["Content-Length"])).decode()
                with outer.lock:
                    outer.now += 1
                    outer.most = max(outer.most, outer.now)
                    t = time.monotonic()
                    outer.recent = [x for x in outer.recent if t - x < 1]
                    ok = len(outer.recent) < outer.rate
                    if ok:
                        outer.recent.append(t)
                        outer.answered[body] += 1
                    else:
                        outer.refused += 1
                time.sleep(0.01)
                with outer.lock:
                    outer.now -= 1
                self.send_response(200 if ok else 429)
                self.end_headers()
                self.wfile.write(b"answer to " + body.encode())

            def log_message(self, *_):
                pass

        self.server = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
        threading.Thread(target=self.server.serve_forever, daemon=True).start()
        self.url = f"http://127.0.0.1:{self.server.server_port}/"


def client_of(url):
    def client():
        import urllib.error
        import urllib.request

        def ask(messages, model, temperature):
            text = messages[0]["content"]
            if text == "bad":
                raise ValueError("no")
            try:
                with urllib.request.urlopen(urllib.request.Request(url, text.encode()), timeout=20) as r:
                    return r.read().decode()
            except urllib.error.HTTPError as e:
                if e.code == 429:
                    raise RateLimited from e
                raise

        return ask

    return client


def prompts(spark, texts):
    return spark.createDataFrame([(str(k), None, json.dumps([{"role": "user", "content": t}])) for k, t in enumerate(texts)], "batch string, model string, messages string").repartition(7)


def test_slots_and_rate_hold_and_no_answer_is_lost(spark):
    limiter = Limiter(slots=3, rate=30)
    texts = [f"prompt {k % 60}" for k in range(70)] + ["bad"]
    budget = Budget(slots=3, per_minute=6000, seconds=0.5, wait=0.7, longest_wait=1.0)
    waits = []
    found, history = call_within(prompts(spark, texts), client_of(limiter.url), budget, sleep=lambda s: waits.append(s) or time.sleep(s))
    got = {r["batch"]: (r["status"], r["response"]) for r in found.collect()}
    assert limiter.most <= 3 and set(limiter.answered.values()) == {1} and len(limiter.answered) == 60
    assert all(got[str(k)] == ("ok", f"answer to {t}") for k, t in enumerate(texts[:-1])) and got["70"][0].startswith("error: ValueError")
    assert limiter.refused and waits and min(r for r, _, _ in history) < 6000 and limiter.refused <= 3 * len(history)
    assert all(b[0] <= a[0] * (budget.fall if a[2] else budget.rise) + 1e-9 for a, b in zip(history, history[1:], strict=False))


def test_replayed_prompts_are_not_asked_and_hopeless_ones_end(spark):
    limiter = Limiter(slots=2, rate=0)
    held = prompts(spark, ["a", "b"])
    one, _ = call_within(held.where("batch = '0'"), lambda: lambda *_: "known", Budget())
    found, history = call_within(held, client_of(limiter.url), Budget(slots=2, patience=3, wait=0.0), replay=one, sleep=lambda _: None)
    got = {r["batch"]: (r["status"], r["response"]) for r in found.collect()}
    assert got == {"0": ("ok", "known"), "1": ("error: RateLimited", None)} and len(history) == 3 and limiter.refused == 3


def test_operators_keep_a_budget(spark):
    units = spark.createDataFrame([(i, "fact", f"word{i} is here", "S", 1) for i in range(12)], "seq long, type string, statement string, source_title string, source_page int")
    plain, _ = generation.ask(units, generation.GENERATE, generation.stub_client, ["statement"])
    paced, _ = generation.ask(units, generation.GENERATE, generation.stub_client, ["statement"], budget=Budget(slots=2, per_minute=60_000))
    rows = lambda df: sorted((r["seq"], r["question"]) for r in df.where(F.col("answered")).collect())
    assert rows(plain) == rows(paced) and len(rows(paced)) == 12
