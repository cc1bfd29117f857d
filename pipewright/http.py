"""The service as a WSGI application, for any server that speaks it (``wsgiref.simple_server`` for one).

``/query`` and ``/new-query`` take dataset, query, context (as ``context.<name>``), copy, rowCount, rollupName, allowRollups, queryTimeoutSeconds and an
``If-None-Match`` header, from the query string or a form; ``/new-query`` answers compressed. ``/info`` explains; ``/schema``, ``/exists``,
``/rollups`` and ``/version`` look a dataset up.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Callable, Iterator
from urllib.parse import parse_qsl

from .plans.lexer import QueryError
from .service import Request, Response, Service

# Reasons of the status codes in use.
REASONS = {200: "OK", 304: "Not Modified", 400: "Bad Request", 404: "Not Found", 405: "Method Not Allowed", 408: "Request Timeout", 429: "Too Many Requests"}


def _request(given: dict[str, str], environ: dict) -> Request:
    copy = given.get("copy")
    return Request(
        dataset=given.get("dataset", ""), query=given.get("query", "select *"), context={k.removeprefix("context."): v for k, v in given.items() if k.startswith("context.")},
        copy=int(copy) if copy and copy.isdigit() else copy or None, view=given.get("rollupName"), allow_views=given.get("allowRollups", "true") == "true", row_count=given.get("rowCount", "") not in ("", "false"),
        seconds=float(given["queryTimeoutSeconds"]) if "queryTimeoutSeconds" in given else None, if_none_match=environ.get("HTTP_IF_NONE_MATCH", "").strip('"') or None,
    )


def _chunks(lines: Iterator[str], press: bool) -> Iterator[bytes]:
    own = zlib.compressobj(wbits=31) if press else None
    for line in lines:
        data = (line + "\n").encode()
        if own is not None:
            data = own.compress(data)
        if data:
            yield data
    if own is not None:
        yield own.flush()


def application(service: Service) -> Callable:
    lookups = {"/schema": service.schema, "/rollups": service.rollups, "/version": service.version}

    def app(environ: dict, start: Callable) -> Iterator[bytes]:
        path, given = environ.get("PATH_INFO", ""), dict(parse_qsl(environ.get("QUERY_STRING", "")))
        if environ.get("REQUEST_METHOD") == "POST":
            given |= dict(parse_qsl(environ["wsgi.input"].read(int(environ.get("CONTENT_LENGTH") or 0)).decode()))
        dataset = given.get("dataset", "")
        press = path == "/new-query"
        try:
            if path in ("/query", "/new-query"):
                out = service.query(_request(given, environ))
            elif path == "/exists":
                out = Response(200 if service.exists(dataset) else 404, body=iter([json.dumps(service.exists(dataset))]))
            elif path == "/info" and service.exists(dataset):
                out = Response(200, body=iter([json.dumps(service.info(_request(given, environ)))]))
            elif path in lookups and service.exists(dataset):
                out = Response(200, body=iter([json.dumps(lookups[path](dataset))]))
            else:
                out = Response(404)
        except (QueryError, ValueError) as x:
            out = Response(400, body=iter([str(x)]))
        headers = [("Content-Type", "application/json"), *((k, f'"{v}"' if k == "ETag" else v) for k, v in out.headers.items())]
        if press and out.status == 200:
            headers.append(("Content-Encoding", "gzip"))
        start(f"{out.status} {REASONS[out.status]}", headers)
        return _chunks(out.body, press and out.status == 200)

    return app
