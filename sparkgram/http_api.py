"""A small HTTP front for a service and a spell checker.

GET  /dict/list/
GET  /search/{dict}/{query}/?metric=&similarity=&topK=
GET  /autocomplete/{dict}/{query}/?topK=
GET  /predict/{query}/?similarity=&topK=
POST /internal/reindex/
"""

from __future__ import annotations

import json
from collections.abc import Callable
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, unquote, urlsplit

from sparkgram.functions.metric import METRICS
from sparkgram.plans.spell import SpellChecker
from sparkgram.service import Service, UnknownDictionary

DEFAULT_TOP_K, DEFAULT_SIMILARITY = 5, 0.5


class BadRequest(ValueError):
    pass


def top_k_of(params: dict[str, str]) -> int:
    try:
        k = int(params.get("topK", DEFAULT_TOP_K))
    except ValueError:
        raise BadRequest("topK must be a number") from None
    if k <= 0:
        raise BadRequest("topK must be positive")
    return k


def similarity_of(params: dict[str, str]) -> float:
    try:
        s = float(params.get("similarity", DEFAULT_SIMILARITY))
    except ValueError:
        raise BadRequest("similarity must be a number") from None
    if not 0 < s <= 1:
        raise BadRequest("similarity must be in (0, 1]")
    return s


def answer(service: Service, speller: SpellChecker | None, reindex: Callable[[], None] | None, method: str, url: str) -> tuple[int, object]:
    """(status, JSON body) of a request."""
    parts = urlsplit(url)
    path = [unquote(p) for p in parts.path.split("/") if p]
    params = {k: v[-1] for k, v in parse_qs(parts.query).items()}
    try:
        if method == "POST":
            if path != ["internal", "reindex"] or reindex is None:
                return 404, {"error": "not found"}
            reindex()
            return 200, {"status": "ok"}
        if path == ["dict", "list"]:
            return 200, service.dictionaries()
        if len(path) == 3 and path[0] == "search":
            if params.get("metric") not in METRICS:
                raise BadRequest(f"metric must be one of {', '.join(METRICS)}")
            rows = service.search(path[1], path[2], params["metric"], similarity_of(params), top_k_of(params)).collect()
            return 200, [{"Score": r.score, "Value": r.value} for r in rows]
        if len(path) == 3 and path[0] == "autocomplete":
            rows = service.autocomplete(path[1], path[2], top_k_of(params)).collect()
            return 200, [{"Score": 0.0, "Value": r.value} for r in rows]
        if len(path) == 2 and path[0] == "predict" and speller is not None:
            rows = speller.predict(path[1], top_k_of(params), similarity_of(params)).orderBy("pos").collect()
            return 200, [r.word for r in rows]
        return (200, {"status": "ok"}) if not path else (404, {"error": "not found"})
    except UnknownDictionary as e:
        return 404, {"error": f"no dictionary {e.args[0]}"}
    except ValueError as e:
        return 400, {"error": str(e)}


def server(service: Service, speller: SpellChecker | None = None, reindex: Callable[[], None] | None = None, host: str = "127.0.0.1", port: int = 8080) -> ThreadingHTTPServer:
    class Handler(BaseHTTPRequestHandler):
        timeout = 15

        def _answer(self) -> None:
            status, body = answer(service, speller, reindex, self.command, self.path)
            data = json.dumps(body, ensure_ascii=False).encode("utf-8")
            self.send_response(status)
            self.send_header("Content-Type", "application/json; charset=utf-8")
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        do_GET = do_POST = _answer  # noqa: N815

    return ThreadingHTTPServer((host, port), Handler)
