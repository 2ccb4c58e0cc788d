"""Paid requests: each is sent once, whatever happens to the tasks that send them, and all within one budget."""

import collections
import json
import os
import subprocess
import sys
import textwrap
import threading
import time
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest

from corrobora.operators import remote
from corrobora.operators.remote import Chat, HttpEmbedder, Kept, Ledger, Sending, ask

SEEN = collections.Counter()
TIMES = []


class Service(BaseHTTPRequestHandler):
    def log_message(self, *args):
        pass

    def do_POST(self):
        asked = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
        text = asked["messages"][1]["content"] if "messages" in asked else "|".join(asked["input"])
        SEEN[text] += 1
        TIMES.append(time.monotonic())
        code = 429 if "busy" in text and SEEN[text] < 3 else 500 if "down" in text else 200
        self.send_response(code)
        if code == 429:
            self.send_header("Retry-After", "0.05")
        self.end_headers()
        body = {"choices": [{"message": {"content": f"answer to {text}"}}]} if "messages" in asked else {"data": [{"index": k, "embedding": [len(t), 1.0]} for k, t in enumerate(asked["input"])]}
        self.wfile.write(json.dumps(body).encode())


@pytest.fixture
def url():
    SEEN.clear()
    TIMES.clear()
    server = ThreadingHTTPServer(("127.0.0.1", 0), Service)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}"
    server.shutdown()


def prompts(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "id long, prompt string")


def test_equal_requests_and_later_runs_are_not_sent_again(spark, url, tmp_path):
    sending = Sending(str(tmp_path / "ledger"), 3)
    rows = prompts(spark, ["a", "b", "a", None, "c"])
    for _ in range(2):
        got = {r.id: (r.raw, r.error) for r in ask(rows, Chat(url, "m"), sending=sending).collect()}
        assert got == {0: ("answer to a", None), 1: ("answer to b", None), 2: ("answer to a", None), 3: (None, None), 4: ("answer to c", None)}
    assert SEEN == {"a": 1, "b": 1, "c": 1}
    # Another model is another request.
    ask(rows, Chat(url, "other"), sending=sending).collect()
    assert SEEN == {"a": 2, "b": 2, "c": 2}
    assert ask(rows.limit(0), Chat(url, "m"), sending=sending).count() == 0


def test_failures_are_not_kept_and_busy_services_are_asked_again(spark, url, tmp_path):
    sending = Sending(str(tmp_path / "ledger"), 2)
    send = Chat(url, "m", tries=3, pause=0.01)
    for k in (1, 2):
        got = {r.prompt: (r.raw, r.error) for r in ask(prompts(spark, ["busy x", "down y", "z"]), send, sending=sending).collect()}
        assert got["busy x"] == ("answer to busy x", None) and got["z"] == ("answer to z", None)
        assert got["down y"][0] is None and got["down y"][1].startswith(remote.UNANSWERED) and "500" in got["down y"][1]
        assert SEEN == {"busy x": 3, "down y": 3 * k, "z": 1}


def test_all_tasks_keep_to_one_budget(spark, url, tmp_path):
    began = time.monotonic()
    ask(prompts(spark, [f"p{k}" for k in range(12)]), Chat(url, "m"), sending=Sending(None, 2, per_minute=240)).collect()
    # Four a second at most in the long run; the first ones of each sender may go at once.
    assert len(TIMES) == 12 and time.monotonic() - began > 1.0
    for t in TIMES:
        assert sum(t <= u < t + 1 for u in TIMES) <= 4 + 2


def dies(inner, at, mark):
    """A sender that ends its worker once, before the request for ``at`` is sent; of a local class, so it travels whole."""

    class Dies:
        def __repr__(self):
            return repr(inner)

        def __call__(self, text):
            if text == at and not os.path.exists(mark):
                open(mark, "w").close()
                os._exit(1)
            return inner(text)

    return Dies()


def test_a_run_after_a_killed_worker_asks_for_the_rest_only(spark, url, tmp_path):
    rows = prompts(spark, [f"p{k}" for k in range(20)])
    send = dies(Chat(url, "m"), "p7", str(tmp_path / "mark"))
    sending = Sending(str(tmp_path / "ledger"), 1)
    with pytest.raises(Exception):  # noqa: B017  a local master has one try
        ask(rows, send, sending=sending)
    done = sum(SEEN.values())
    assert "p7" not in SEEN and done == len(SEEN)
    assert ask(rows, send, sending=sending).where("raw IS NOT NULL").count() == 20
    assert SEEN == {f"p{k}": 1 for k in range(20)}


def test_a_task_that_is_run_again_asks_for_the_rest_only(url, tmp_path):
    """The same within one run, in a session whose tasks have several tries."""
    code = textwrap.dedent(f"""
        import sys
        sys.path[:0] = [{os.path.dirname(__file__)!r}, {os.getcwd()!r}]
        from corrobora.operators.remote import Chat, Sending, ask
        from corrobora.session import session
        from test_ledger import dies
        spark = session("local[2,4]", 2, "1g")
        rows = spark.createDataFrame([(k, f"p{{k}}") for k in range(20)], "id long, prompt string")
        got = ask(rows, dies(Chat({url!r}, "m"), "p7", {str(tmp_path / "mark")!r}), sending=Sending({str(tmp_path / "ledger")!r}, 2))
        print("ROWS", got.where("raw IS NOT NULL").count())
    """)
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=170, check=False, env=os.environ | {"PYTHONPATH": f"{os.path.dirname(__file__)}:{os.getcwd()}"})
    assert "ROWS 20" in out.stdout, out.stderr[-2000:]
    assert os.path.exists(tmp_path / "mark") and SEEN == {f"p{k}": 1 for k in range(20)}


def test_embeddings_are_kept_by_request(url, tmp_path):
    kept = Kept(HttpEmbedder(url, "m"), str(tmp_path / "ledger"))
    first = kept.embed(["abc", "é"])
    assert [v.tolist() for v in kept.embed(["abc", "é"])] == [v.tolist() for v in first] and sum(SEEN.values()) == 1
    kept.embed(["abc"])
    assert sum(SEEN.values()) == 2


def test_ledger(tmp_path):
    ledger = Ledger(f"file://{tmp_path}/l")
    assert ledger.get("ab12") is None
    ledger.put("ab12", "x")
    ledger.put("ab12", ["ü", None])
    assert Ledger(str(tmp_path / "l")).get("ab12") == ["ü", None]
    assert [p.name for p in (tmp_path / "l" / "ab").iterdir()] == ["ab12.json"]
