import json
import threading
import urllib.error
import urllib.request

import pytest

from tidemark.config import Config
from tidemark.engine import Engine
from tidemark.http_api import server

from .samples import LAYOUT, LOG1, START


@pytest.fixture
def at(spark, tmp_path):
    (tmp_path / "store").mkdir()
    (tmp_path / "1.log").write_text(LOG1)
    engine = Engine(spark, Config(f"{tmp_path}/*.log", f"{tmp_path}/store", START, LAYOUT))
    engine.ingest()
    http = server(engine)
    threading.Thread(target=http.serve_forever, daemon=True).start()
    yield engine, f"http://127.0.0.1:{http.server_port}"
    http.shutdown()


def call(url, body=None):
    try:
        with urllib.request.urlopen(urllib.request.Request(url, None if body is None else json.dumps(body).encode())) as r:
            return r.status, json.load(r)
    except urllib.error.HTTPError as e:
        return e.code, json.load(e)


def test_routes(at):
    engine, url = at
    assert call(f"{url}/api/query") == (200, [])
    status, said = call(f"{url}/api/query", {"query": "user OR backup", "fromDate": "2024-07-30T00:00:00Z"})
    assert status == 200 and said["query"]["finished"] is False
    i = said["query"]["query_id"]
    engine.results.wait(i)
    status, page = call(f"{url}/api/query/{i}?skip=1&limit=5")
    assert page["query"]["messages"] == 2 and page["query"]["finished"] and [m["pos"] for m in page["messages"]] == [571]
    assert [q["query_id"] for q in call(f"{url}/api/query")[1]] == [i]
    assert call(f"{url}/api/query/99") == (200, {"query": None, "messages": []})
    for bad in ({"query": ""}, {"query": "a OR"}, {"query": "a", "fromDate": "x"}, {"query": "~("}, {}, []):
        assert call(f"{url}/api/query", bad)[0] == 400
    assert call(f"{url}/nope")[0] == 404
    for path in ("/", "/query/1"):
        with urllib.request.urlopen(url + path) as r:
            assert r.headers["Content-Type"].startswith("text/html") and b"/api/query" in r.read()
