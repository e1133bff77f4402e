import json
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer

import numpy as np
import pytest

from mnestra.sources import http_models


@pytest.fixture
def service(monkeypatch):
    """A local server that answers as the public interfaces do; the first question is put off."""
    seen = []

    class Answer(BaseHTTPRequestHandler):
        def do_POST(self):
            body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            seen.append((self.path, dict(self.headers), body))
            if len(seen) == 1:
                self.send_response(429)
                self.end_headers()
                return
            if self.path.endswith("embeddings"):
                out = {"data": [{"index": i, "embedding": [float(len(t)), 1.0]} for i, t in reversed(list(enumerate(body["input"])))]}
            elif self.path.endswith("messages"):
                out = {"content": [{"type": "text", "text": "from m"}]}
            elif "generateContent" in self.path:
                out = {"candidates": [{"content": {"parts": [{"text": "from g"}]}}]}
            else:
                out = {"choices": [{"message": {"content": "from c"}}]} if body["model"] != "odd" else {"choices": []}
            self.send_response(200)
            self.end_headers()
            self.wfile.write(json.dumps(out).encode())

        def log_message(self, *_):
            pass

    for s in http_models.SERVICES.values():
        monkeypatch.setenv(s.key, "secret")
    server = HTTPServer(("127.0.0.1", 0), Answer)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}", seen
    server.shutdown()


def test_each_interface(service, monkeypatch):
    base, seen = service
    said = {name: http_models.HttpProvider(name, base=base).complete("extract", "hello") for name in http_models.SERVICES}
    assert said == {"openai": "from c", "anthropic": "from m", "google": "from g"}
    assert len(seen) == 4 and all("hello" in json.dumps(body) for _, _, body in seen)
    assert any(h.get("Authorization") == "Bearer secret" for _, h, _ in seen)
    with pytest.raises(http_models.ServiceError):
        http_models.HttpProvider("openai", "odd", base).complete("extract", "x")
    monkeypatch.delenv("OPENAI_API_KEY")
    with pytest.raises(http_models.ServiceError):
        http_models.HttpProvider("openai", base=base).complete("extract", "x")


def test_embeddings_in_order(service):
    base, seen = service
    x = http_models.HttpEmbedder("openai", dim=2, base=base, batch=2).embed_batch(["a", "", "ccc", None, "bb"])
    assert np.array_equal(x, np.array([[1, 1], [0, 0], [3, 1], [0, 0], [2, 1]], "f4")) and len(seen) == 3
    with pytest.raises(http_models.ServiceError):
        http_models.HttpEmbedder("openai", dim=3, base=base).embed_batch(["a"])
