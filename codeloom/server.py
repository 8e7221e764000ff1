"""HTTP service: GET / (a page), GET /get_repositories, POST /search (query, repository)."""

from __future__ import annotations

import json
from collections.abc import Callable
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs

from pyspark.sql import SparkSession

from codeloom.operators import catalog
from codeloom.plans import build
from codeloom.plans import search as S

RESULTS = 10
PAGE = """<!doctype html><html><head><meta charset="utf-8"><title>Code search</title></head><body>
<form onsubmit="go(); return false"><select id="r"></select> <input id="q" size="60"> <button>Search</button></form><div id="out"></div>
<script>
fetch('/get_repositories').then(x => x.json()).then(rows => { for (const row of rows) r.add(new Option(row.full_name, row.index_name)); });
function go() {
  fetch('/search', {method: 'POST', headers: {'Content-Type': 'application/json'}, body: JSON.stringify({query: q.value, repository: r.value})}).then(x => x.json()).then(rows => {
    out.replaceChildren(...(Array.isArray(rows) ? rows : []).map(row => { const box = document.createElement('pre'); box.textContent = row.path + ' ' + row.name + ' ' + row.score.toFixed(2) + '\\n' + row.content; return box; }));
  });
}
</script></body></html>"""


def repositories(spark: SparkSession, store: str) -> list[dict]:
    rows = catalog.displayed(build.list_indexes(spark, store)).collect()
    return [{k: r[k] for k in ("name", "full_name", "git_version", "timestamp", "index_name")} for r in rows]


def answer(spark: SparkSession, store: str, request: dict) -> tuple[int, object]:
    query, repository = (request.get(k) or "" for k in ("query", "repository"))
    if not query or not repository:
        return 400, {"error": "query and repository are needed"}
    try:
        return 200, [json.loads(x) for x in S.json_rows(S.search(spark, store, query, RESULTS, repository)).toJSON().collect()]
    except Exception as why:
        return 500, {"error": str(why)}


def handler(spark: SparkSession, store: str) -> type[BaseHTTPRequestHandler]:
    class Handler(BaseHTTPRequestHandler):
        def _send(self, status: int, body: str, kind: str = "application/json") -> None:
            data = body.encode()
            self.send_response(status)
            self.send_header("Content-Type", f"{kind}; charset=utf-8")
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        def do_GET(self) -> None:
            if self.path == "/":
                self._send(200, PAGE, "text/html")
            elif self.path == "/get_repositories":
                self._send(200, json.dumps(repositories(spark, store)))
            else:
                self._send(404, json.dumps({"error": "not found"}))

        def do_POST(self) -> None:
            if self.path != "/search":
                return self._send(404, json.dumps({"error": "not found"}))
            body = self.rfile.read(int(self.headers.get("Content-Length") or 0)).decode()
            try:
                request = json.loads(body) if "json" in (self.headers.get("Content-Type") or "") else {k: v[0] for k, v in parse_qs(body).items()}
                if not isinstance(request, dict):
                    raise ValueError
            except ValueError:
                return self._send(400, json.dumps({"error": "the request can't be read"}))
            status, out = answer(spark, store, request)
            self._send(status, json.dumps(out))

        def log_message(self, *args) -> None:
            pass

    return Handler


def serve(spark: SparkSession, store: str, host: str = "127.0.0.1", port: int = 5000, started: Callable[[ThreadingHTTPServer], None] | None = None) -> None:
    server = ThreadingHTTPServer((host, port), handler(spark, store))
    if started:
        started(server)
    server.serve_forever()
