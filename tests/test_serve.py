import io
import json
import threading
import urllib.error
import urllib.request

import pytest

from mnestra import serve
from mnestra.cli import main
from mnestra.engine import MemoryEngine
from mnestra.functions.embed import TableEmbedder
from mnestra.providers import MockProvider
from mnestra.sources.config import Config


@pytest.fixture(scope="module")
def engine(spark, tmp_path_factory):
    return MemoryEngine(spark, Config(data_dir=str(tmp_path_factory.mktemp("serve"))), MockProvider(), TableEmbedder({"hello there": [1, 0, 0, 0]}, 4))


def test_http(engine):
    server = serve.http_server(engine, port=0, key="k")
    threading.Thread(target=server.serve_forever, daemon=True).start()

    def ask(method, path, body=None, key="k"):
        raw = body if isinstance(body, bytes) else None if body is None else json.dumps(body).encode()
        request = urllib.request.Request(f"http://127.0.0.1:{server.server_port}{path}", raw, {"Authorization": f"Bearer {key}"}, method=method)
        try:
            with urllib.request.urlopen(request, timeout=120) as r:
                return r.status, r.read().decode()
        except urllib.error.HTTPError as e:
            return e.code, e.read().decode()

    assert ask("GET", "/health", key="wrong") == (200, "ok")
    assert ask("GET", "/v1/memories/search?q=x", key="wrong")[0] == 401
    assert ask("POST", "/v1/memories", {"tags": []})[0] == 400 == ask("POST", "/v1/memories", b"{")[0] == ask("GET", "/v1/memories/recall")[0]
    assert ask("GET", "/nowhere")[0] == 404 == ask("PATCH", "/v1/memories/nobody", {"importance": 2})[0]
    status, text = ask("POST", "/v1/memories", {"content": "hello there", "tags": ["a"], "importance": 30})
    stored = json.loads(text)
    assert (status, stored["importance"], stored["tags"]) == (201, 10.0, ["a"])
    assert [r["id"] for r in json.loads(ask("GET", "/v1/memories/search?q=hello+there&filter_tags=a,%20b")[1])] == [stored["id"]]
    assert json.loads(ask("PATCH", f"/v1/memories/{stored['id'].upper()}", {"importance": 2})[1])["importance"] == 2.0
    assert json.loads(ask("DELETE", f"/v1/memories/{stored['id']}")[1]) == {"success": True}
    assert json.loads(ask("DELETE", f"/v1/memories/{stored['id']}?mode=archive")[1]) == {"success": False}
    assert json.loads(ask("POST", "/v1/sessions/none/consolidate", {})[1])["new_facts"] == 0
    server.shutdown()
    with pytest.raises(ValueError):
        serve.http_server(engine, "0.0.0.0", 0, "")


def test_json_rpc(engine):
    call = lambda name, **a: json.dumps({"jsonrpc": "2.0", "id": 5, "method": "tools/call", "params": {"name": name, "arguments": a}})
    lines = ["{", "", "[]", '{"method": "initialize", "id": 1}', '{"method": "notifications/initialized"}', '{"method": "tools/list", "id": 2}', '{"method": "nothing", "id": 3}', call("mem_store", content="hello there"), call("mem_other"), call("mem_forget"), call("mem_update", id="nobody")]
    out = io.StringIO()
    serve.serve_stdio(engine, lines, out)
    said = [json.loads(x) for x in out.getvalue().splitlines()]
    assert [x.get("error", {}).get("code") for x in said] == [-32700, -32600, None, None, -32601, None, -32000, -32000, -32000]
    assert [t["name"] for t in said[3]["result"]["tools"]] == list(serve.TOOLS)
    id = json.loads(said[5]["result"]["content"][0]["text"])["id"]
    assert engine.get(id).count() == 1


def test_models_are_listed(capsys):
    assert {"none", "mock"} <= set(json.loads(main(["models"]))["providers"])
