"""Judges and embedders over HTTP, against a server in this process."""

import json
import os
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer

import numpy as np
import pytest

from corrobora import cli, config
from corrobora.operators import assess, remote, vectors

GOOD = {"subcategory_id": "x", "coverage": "full", "confidence": 0.9, "evidence": [{"source_file": "f", "quote": "backups are taken every single night"}], "rationale": "r", "needs_review": False}
HITS = "outcome_id string, rank int, chunk_id string, source_file string, page int, text string"


class Service(BaseHTTPRequestHandler):
    def log_message(self, *args):
        pass

    def answer(self, body, code=200):
        self.send_response(code)
        self.end_headers()
        self.wfile.write(json.dumps(body).encode())

    def do_GET(self):
        self.answer({"models": [{"name": "small:latest"}]})

    def do_POST(self):
        asked = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
        if self.path.endswith("/embeddings"):
            return self.answer({"data": [{"index": k, "embedding": [len(t), 1.0]} for k, t in reversed(list(enumerate(asked["input"])))]})
        if "temperature" in asked:
            return self.answer({"error": "Unsupported parameter: temperature"}, 400)
        user = asked["messages"][1]["content"]
        if "Outcome v" in user:
            return self.answer({"error": "overloaded"}, 503)
        if "Outcome u" in user:
            return self.answer({"unexpected": []})
        if "first judgement" in user:
            text = {"p": json.dumps(GOOD | {"coverage": "partial", "rationale": "less"}), "q": json.dumps(GOOD), "r": "nonsense"}[user.split("Outcome ")[1][0]]
        elif "Outcome y" in user:
            text = "never an object"
        elif "Outcome z" in user and "not accepted" not in user:
            text = json.dumps(GOOD | {"coverage": "maybe"})
        else:
            text = f"Sure.\n{json.dumps(GOOD)}"
        self.answer({"message": {"content": text}, "choices": [{"message": {"content": text}}]})


@pytest.fixture(scope="module")
def url():
    server = HTTPServer(("127.0.0.1", 0), Service)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}"
    server.shutdown()


@pytest.mark.parametrize("kind", [remote.Chat, remote.LocalChat])
def test_judge(spark, url, kind):
    outcomes = spark.createDataFrame([(k, "Backups are taken") for k in "xyzw"], "outcome_id string, outcome string")
    hits = spark.createDataFrame([(k, 1, "c", "f", 2, "Backups are  taken every single night.") for k in "xyz"], HITS)
    got = {r.outcome_id: r for r in assess.assess(outcomes, hits, remote.judge(kind(url, "small"))).collect()}
    assert (got["x"].coverage, got["x"].fallback, got["x"].evidence[0].page) == ("full", False, 2)
    assert got["z"].coverage == "full"
    assert (got["y"].coverage, got["y"].fallback, got["y"].fallback_reason) == ("none", True, remote.INVALID)
    assert got["w"].fallback_reason == assess.NO_EVIDENCE


def test_critique_changes_confirms_or_is_ignored(spark, url):
    outcomes = spark.createDataFrame([(k, "Backups are taken") for k in "pqry"], "outcome_id string, outcome string")
    hits = spark.createDataFrame([(k, 1, "c", "f", 2, "Backups are  taken every single night.") for k in "pqry"], HITS)
    got = {r.outcome_id: r for r in assess.assess(outcomes, hits, remote.judge(remote.LocalChat(url, "small")), critique=True).collect()}
    assert (got["p"].coverage, got["p"].critique_applied, got["p"].critique_note, got["p"].needs_review) == ("partial", True, "less", False)
    assert (got["q"].coverage, got["q"].critique_applied, got["q"].needs_review) == ("full", False, False)
    assert (got["r"].coverage, got["r"].critique_applied, got["r"].critique_note, got["r"].needs_review) == ("full", False, assess.IGNORED, True)
    assert (got["y"].fallback, got["y"].critique_applied) == (True, None)


def test_one_failed_request_is_one_rows_fallback(spark, url):
    outcomes = spark.createDataFrame([(k, "Backups are taken") for k in "uvx"], "outcome_id string, outcome string")
    hits = spark.createDataFrame([(k, 1, "c", "f", 2, "Backups are  taken every single night.") for k in "uvx"], HITS)
    got = {r.outcome_id: r for r in assess.assess(outcomes, hits, remote.judge(remote.LocalChat(url, "small"))).collect()}
    assert got["v"].fallback_reason.startswith(remote.UNANSWERED) and "503" in got["v"].fallback_reason
    assert got["u"].fallback_reason.startswith("KeyError") and got["x"].coverage == "full"


def test_providers_by_settings(spark, url, tmp_path, monkeypatch):
    monkeypatch.setenv("OLLAMA_HOST", url)
    monkeypatch.setenv("OPENAI_BASE_URL", f"{url}/v1")
    monkeypatch.delenv("OPENAI_API_KEY", raising=False)
    with pytest.raises(remote.ServiceError, match="OPENAI_API_KEY"):
        remote.judge_of(config.DEFAULTS["llm"] | {"provider": "openai"})
    (tmp_path / ".env").write_text("OPENAI_API_KEY=k\n")
    monkeypatch.setenv("OPENAI_API_KEY", "")
    monkeypatch.delenv("OPENAI_API_KEY")
    config.load_env(str(tmp_path / ".env"), os.environ)
    (tmp_path / "docs").mkdir()
    (tmp_path / "docs" / "f.txt").write_text("Backups are taken every single night. Someone looks at them.")
    rows = [{"function": "GV", "category": "C", "id": k, "outcome": "Backups are taken"} for k in ("x", "y", "v")]
    (tmp_path / "c.json").write_text(json.dumps({"frameworkVersion": "1", "sample": False, "functions": [{"id": "GV", "name": "GOVERN"}], "subcategories": rows}))
    made, warnings = config.load(None, {"docsPath": str(tmp_path / "docs"), "cataloguePath": str(tmp_path / "c.json"), "workDir": str(tmp_path / "out"), "llm": {"provider": "ollama", "model": "small"}, "embeddings": {"provider": "openai"}})
    assert not warnings
    run = cli.Run(spark, made)
    run.ingest()
    with pytest.raises(remote.ServiceError, match="1 of 3"):
        run.analyze()
    kept = {r.outcome_id: r.coverage for r in run._read("assessments").collect()}
    assert kept == {"x": "full", "y": "none"}
    index = run._read("index").first()
    assert (index.embedder, index.dim) == ("openai:text-embedding-3-small", 2)


def test_preflight(url):
    assert remote.LocalChat(url, "small").preflight() == []
    assert len(remote.LocalChat(url, "large").preflight()) == 1
    with pytest.raises(remote.ServiceError):
        remote.LocalChat("http://127.0.0.1:9", "small").preflight()


def test_embedder(spark, url, monkeypatch):
    monkeypatch.setitem(vectors.EMBEDDERS, "http", lambda: remote.HttpEmbedder(url, "m"))
    got = remote.HttpEmbedder(url, "m").embed(["abc", "a"])
    assert np.allclose(got, [[3 / 10**0.5, 1 / 10**0.5], [0.5**0.5, 0.5**0.5]])


def test_env(tmp_path):
    (tmp_path / ".env").write_text("# c\nA=1\nexport B='two words'\nHAVE=new\nbroken\nC=\"x=y\"\n")
    env = {"HAVE": "old"}
    assert config.load_env(str(tmp_path / ".env"), env) == ["A", "B", "C"]
    assert env == {"HAVE": "old", "A": "1", "B": "two words", "C": "x=y"}
    assert config.load_env(str(tmp_path / "none"), env) == []
