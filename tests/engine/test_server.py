import http.client
import json
import threading

import pytest
import zstandard

from sawmill import server


@pytest.fixture(scope="module")
def ask(spark, tmp_path_factory):
    config = server.ServerConfig.load("data_root = x\nmax_body = 4k # bytes\nworkers=2", {"SAWMILL_DATA_ROOT": str(tmp_path_factory.mktemp("http")), "SAWMILL_PORT": "0", "SAWMILL_MAX_PENDING": "8"})
    assert (config.max_body, config.workers, config.port, config.max_pending) == (4096, 2, 0, 8)
    httpd = server.start(spark, config)
    threading.Thread(target=httpd.serve_forever, daemon=True).start()

    def ask(method, path, body=None, headers=None, chunked=False):
        c = http.client.HTTPConnection("127.0.0.1", httpd.server_address[1], timeout=120)
        c.request(method, path, body, headers or {}, encode_chunked=chunked)
        r = c.getresponse()
        return r.status, json.loads(r.read())

    ask.service = httpd.RequestHandlerClass
    yield ask
    httpd.shutdown()


def test_requests(ask):
    assert ask("GET", "/health") == (200, {"status": "ok", "indices": 0})
    assert ask("POST", "/indices", "index=web&max_segments=9") == (200, {"ok": True})
    lines = "".join(f"2024-01-01 00:00:{i:02d} user=u{i % 3} said hello+100% {i}\n" for i in range(40))
    assert ask("POST", "/_bulk?index=web", lines)[1]["ingested"] == 40
    packed = zstandard.ZstdCompressor().compress(lines.replace("said", "sang").encode())
    assert ask("POST", "/_bulk?index=web", packed, {"Content-Encoding": "zstd"})[1]["ingested"] == 40
    pieces = iter([packed[:20], packed[20:]])
    assert ask("POST", "/_bulk?index=web", pieces, {"Content-Encoding": "zstd", "Transfer-Encoding": "chunked"}, True)[1]["ingested"] == 40
    pieces = iter([lines[:30].encode(), lines[30:].encode()])  # a line may cross chunks
    assert ask("POST", "/_bulk?index=web", pieces, {"Transfer-Encoding": "chunked"}, True)[1]["ingested"] == 40
    assert ask("GET", "/query?index=web&q=said%20%7C%20stats%20count") == (200, {"count": 80})
    assert ask("POST", "/search?index=none&q=x", "index=web&q=hello%2B100%25+%7C+stats+count&pretty=1") == (200, {"count": 160})
    assert len(ask("GET", "/query?index=web&q=sang&limit=7")[1]) == 7
    status, got = ask("GET", "/indices")
    assert status == 200 and got["indices"][0]["segments"] == 4 and got["indices"][0]["index"] == "web"
    assert {"pending", "workers", "max_pending", "indices", "writers"} <= set(ask("GET", "/metrics")[1])


def test_errors(ask):
    assert ask("GET", "/query?index=web") == (400, {"error": "missing index or q"})
    assert ask("GET", "/query?index=none&q=x") == (404, {"error": "unknown index"})
    assert ask("GET", "/nothing")[0] == 404
    assert ask("POST", "/_bulk?index=web", "x" * 5000)[0] == 413
    assert ask("POST", "/_bulk?index=web", zstandard.ZstdCompressor().compress(b"x" * 50_000), {"Content-Encoding": "zstd"})[0] == 413
    assert ask("POST", "/_bulk?index=web", iter([b"x" * 3000] * 2), {"Transfer-Encoding": "chunked"}, True)[0] == 413
    assert ask("GET", "/health", headers={"X-Long": "x" * 20_000})[0] == 431
    ask("POST", "/indices", "index=gone")
    assert ask("POST", "/indices", "index=gone&delete=1") == (200, {"ok": True})
    assert ask("POST", "/indices", "index=gone&delete=1")[0] == 404


def test_busy(spark):
    service = server.Service(spark, server.ServerConfig(workers=1, max_pending=0))
    service.enter()
    with pytest.raises(server.Refused) as e:
        service.enter()
    assert e.value.status == 503
    service.leave()
    service.enter()
